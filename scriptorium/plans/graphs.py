"""H rows: intervals and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import graph as G
from scriptorium.operators import temporal as T
from scriptorium.operators.joins import pairs_within
from scriptorium.plans.joins import _SPANS, _spans
from scriptorium.registry import query
from scriptorium.tables import load


@query(
    f"""SELECT k, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN 'bounded' WHEN s IS NOT NULL OR e IS NOT NULL THEN 'one_sided' WHEN id % 2 = 0 THEN 'relative_only' ELSE 'unknown' END AS state FROM ({_SPANS})"""
)
def h1_temporal_state(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", T.state(F.col("s"), F.col("e"), F.col("id") % 2 == 0).alias("state"))


@query(
    f"""SELECT view, count(*) AS n FROM (SELECT CASE WHEN s IS NULL AND e IS NULL THEN 'unknown' WHEN e <= 1996 THEN 'pre' WHEN s > 1996 THEN 'post' ELSE 'potentially_active' END AS view FROM ({_SPANS})) GROUP BY 1"""
)
def h3_cutoff_views(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy(T.cutoff_view(F.col("s"), F.col("e"), 1996).alias("view")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN s > e THEN 'inverted' WHEN p = 'exact_year' AND NOT (s IS NOT NULL AND e IS NOT NULL AND s = e) THEN 'exact_year_needs_equal_bounds'
      WHEN p = 'event' AND (s IS NULL OR e IS NULL) THEN 'bounds_missing' WHEN p = 'unknown' AND (s IS NOT NULL OR e IS NOT NULL) THEN 'bounds_not_allowed' END AS error
      FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'exact_year' WHEN 1 THEN 'event' ELSE 'unknown' END AS p FROM ({_SPANS}))) WHERE error IS NOT NULL GROUP BY 1"""
)
def h4_precision_audit(spark, sf_dir):
    kind = F.when(F.col("k") % 3 == 0, "exact_year").when(F.col("k") % 3 == 1, "event").otherwise("unknown")
    found = _spans(spark, sf_dir).withColumn("error", T.precision_errors(kind, F.col("s"), F.col("e"))).filter("error IS NOT NULL")
    return found.groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT k, CAST(s - (1950 + id % 30 + 2) AS BIGINT) AS low, CAST(s + 4 - (1950 + id % 30) AS BIGINT) AS high FROM (" + _SPANS + ") WHERE s IS NOT NULL")
def h6_age_range(spark, sf_dir):
    born = F.lit(1950) + F.col("id") % 30
    age = T.age_range(F.col("s"), F.col("s") + 4, born, born + 2)
    return _spans(spark, sf_dir).filter("s IS NOT NULL").select("k", age["low"].alias("low"), age["high"].alias("high"))


@query(
    """SELECT p_partkey, CASE WHEN p_size <= 36 THEN 'one' WHEN p_size <= 43 THEN 'two' WHEN p_size <= 55 THEN 'three' WHEN p_size <= 68 THEN 'four' ELSE 'five' END AS phase FROM part"""
)
def h8_phase_bands(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.phase(F.col("p_size")).alias("phase"))


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'rule' END, CASE WHEN o_orderstatus = 'F' THEN 'phase' END, CASE WHEN o_totalprice > 300000 THEN 'curated' END, 'none') AS "window" FROM orders"""
)
def h7_era_window(spark, sf_dir):
    rule = T.first_known(
        F.when(F.col("o_orderpriority") == "1-URGENT", "rule"), F.when(F.col("o_orderstatus") == "F", "phase"),
        F.when(F.col("o_totalprice") > 300000, "curated"), F.lit("none"),
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", rule.alias("window"))


@query(
    """SELECT l_suppkey AS src, l_partkey AS dst, count(DISTINCT l_orderkey) AS n_facts, sha256('sells|supplier|' || l_suppkey || '|part|' || l_partkey) AS edge_id FROM lineitem GROUP BY ALL"""
)
def h10_projection(spark, sf_dir):
    facts = load(spark, sf_dir, "lineitem").withColumn("fact_id", F.col("l_orderkey"))
    edges = G.project(facts, "sells", "supplier", "l_suppkey", "part", "l_partkey", ["external"])
    return edges.select(F.col("src_id").cast("bigint").alias("src"), F.col("dst_id").cast("bigint").alias("dst"), F.size("fact_ids").cast("bigint").alias("n_facts"), "edge_id")


def _shared(spark, sf_dir, least: int = 1):
    pairs = pairs_within(load(spark, sf_dir, "lineitem").filter("l_quantity > 45"), "l_orderkey", "l_suppkey")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


_SHARED = """(WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 45) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n
  FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)"""


@query(f"SELECT node, count(*) AS n FROM (SELECT a AS node, b AS other FROM {_SHARED} UNION SELECT b, a FROM {_SHARED}) GROUP BY 1")
def h16_neighbours(spark, sf_dir):
    return G.neighbours(_shared(spark, sf_dir), "a", "b").groupBy("node").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT DISTINCT o_orderdate AS g, o_custkey AS c FROM orders) SELECT x.c AS o_custkey, count(DISTINCT y.c) FILTER (y.c <> x.c) AS reachable FROM m x JOIN m y USING (g) GROUP BY 1"""
)
def h15_one_hop(spark, sf_dir):
    return G.one_hop(load(spark, sf_dir, "orders"), "o_orderdate", "o_custkey")


_CUST = "(SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey // 40 AS b FROM orders WHERE o_orderstatus = 'P')"


def _bipartite(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return o.select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_orderkey") / 40) + 1_000_000).cast("bigint").alias("b")).distinct()


@query(
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_CUST} UNION SELECT b, a FROM {_CUST}), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
    SELECT node, min(other) AS component FROM r GROUP BY 1"""
)
def h13_components(spark, sf_dir):
    return G.components(_bipartite(spark, sf_dir), "a", "b")


@query()
def h14_articulation_points(spark, sf_dir):
    return G.articulation_points(_bipartite(spark, sf_dir), "a", "b")


@query(
    """SELECT * FROM (VALUES ('dangling_end', CAST((SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) + (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS BIGINT)),
    ('repeated_node', CAST(0 AS BIGINT)), ('repeated_key', (SELECT count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1))),
    ('reverse_repeat', (SELECT count(*) FROM lineitem x WHERE l_suppkey < l_partkey AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_partkey AND y.l_partkey = x.l_suppkey AND y.l_partkey < y.l_suppkey)
      ))) AS t(issue, n)"""
)
def h17_integrity(spark, sf_dir):
    nodes = load(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node_id"))
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).withColumn("edge_type", F.lit("sells"))
    return G.integrity(nodes, edges.withColumn("semantic_key", G.edge_key("src_id", "dst_id")))


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k"""
)
def h18_graph_delta(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    return G.delta(lines.filter("l_shipdate < TIMESTAMP'1996-01-01'"), lines.filter("l_shipdate >= TIMESTAMP'2000-01-01'"), "k")


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7|' || o_orderkey), o_orderkey) <= (SELECT count(*) // 5 FROM orders) AS held_out FROM orders"""
)
def h21_link_split(spark, sf_dir):
    return G.holdout(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", (1, 5), 7)


@query(
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rk FROM events)
    SELECT count(*) AS n, round(avg(rk::DOUBLE), 6) AS mean_rank, round(avg(1 / rk::DOUBLE), 6) AS mrr, round(avg((rk <= 1)::INT), 6) AS hits_at_1, round(avg((rk <= 3)::INT), 6) AS hits_at_3,
    round(avg((rk <= 10)::INT), 6) AS hits_at_10 FROM r WHERE event_type = 'purchase'"""
)
def h22_ranking_metrics(spark, sf_dir):
    scores = load(spark, sf_dir, "events").withColumn("positive", F.col("event_type") == "purchase")
    return G.ranking_metrics(scores, "user_id", "value", "positive")


@query(
    """WITH d AS (SELECT s_suppkey, count(DISTINCT l_partkey) AS degree FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
    m AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), o AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM m x JOIN m y ON x.p = y.p AND x.s < y.s GROUP BY ALL)
    SELECT a, b, shared, round(shared / sqrt(da.degree * db.degree), 6) AS cosine FROM o JOIN d da ON da.s_suppkey = a JOIN d db ON db.s_suppkey = b"""
)
def h23_structural_baselines(spark, sf_dir):
    """Two-hop overlap and its cosine for suppliers of the same parts."""
    m = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    degree = m.groupBy("l_suppkey").agg(F.count("*").alias("degree"))
    shared = pairs_within(m, "l_partkey", "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / F.sqrt(F.col("da") * F.col("db")), 6).alias("cosine"))


@query(
    """WITH e AS (SELECT DISTINCT 'sells' AS edge_type, l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem), s AS (SELECT p_partkey + 1000000 AS n, p_size::DOUBLE AS x FROM part UNION ALL SELECT s_suppkey, 0.0 FROM supplier),
    m AS (SELECT edge_type, a AS node, b AS other FROM e UNION ALL SELECT edge_type, b, a FROM e)
    SELECT node AS node_id, edge_type, round(avg(x), 6) AS message FROM m JOIN s ON s.n = m.other GROUP BY ALL"""
)
def h24_message_pass(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.lit("sells").alias("edge_type"), F.col("l_suppkey").alias("src_id"), (F.col("l_partkey") + 1_000_000).alias("dst_id")).distinct()
    parts = load(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("node_id"), F.array(F.col("p_size").cast("double")).alias("state"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.array(F.lit(0.0)).alias("state"))
    out = G.message_pass(e, parts.unionByName(suppliers), 1)
    return out.select("node_id", "edge_type", F.round(F.col("message")[0], 6).alias("message"))
