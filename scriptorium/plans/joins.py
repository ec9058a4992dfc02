"""J rows over orders, lineitem, customer and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import joins as J
from scriptorium.registry import query
from scriptorium.tables import load


@query(
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def j1_nested_lookup(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = load(spark, sf_dir, "orders").join(customer, "o_custkey", "left").join(places, "n_nationkey", "left")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    """WITH l AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    r AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 3000)
    SELECT coalesce(l.id, r.id) AS id, n_orders, segment, CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 'both' WHEN l.id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
    FROM l FULL OUTER JOIN r ON l.id = r.id"""
)
def j2_full_outer_audit(spark, sf_dir):
    left = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    right = load(spark, sf_dir, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return J.full_outer_audit(left, right, ["id"])


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN c_custkey IS NULL THEN 'no_customer' END,
      CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS reasons FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    WHERE o_totalprice > 400000 OR c_custkey IS NULL OR o_orderstatus = 'P'"""
)
def j3_anomalies(spark, sf_dir):
    known = load(spark, sf_dir, "customer").select("c_custkey")
    rows = load(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    tests = {"large": F.col("o_totalprice") > 400000, "no_customer": F.col("c_custkey").isNull(), "pending": F.col("o_orderstatus") == "P"}
    return J.with_anomalies(rows, tests)[1].select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query(
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"""
)
def j4_j5_semi_anti(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = load(spark, sf_dir, "customer").join(orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi")
    return rows.join(orders.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n_shared
    FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL"""
)
def j6_pairs_within(spark, sf_dir):
    pairs = J.pairs_within(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM m x JOIN m y
      ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)
    SELECT s.s_suppkey AS a, t.s_suppkey AS b, coalesce(n, 0) AS n_shared FROM supplier s JOIN supplier t ON s.s_suppkey < t.s_suppkey AND s.s_nationkey = t.s_nationkey
    LEFT JOIN p ON p.a = s.s_suppkey AND p.b = t.s_suppkey"""
)
def j7_all_pairs_with_zero(spark, sf_dir):
    """Every pair of suppliers of a nation, with its shared orders, 0 included."""
    shared = J.pairs_within(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    frame = J.pairs_within(load(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("a", "b")
    return frame.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n_shared"))


def _seconds(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
    m AS (SELECT c.event_id, p.event_id AS r_event_id, abs(c.t - p.t) AS gap, p.t AS rt, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - p.t), p.t, p.event_id) AS n
      FROM e c JOIN e p ON c.user_id = p.user_id AND abs(c.t - p.t) <= 21600000000 WHERE c.event_type = 'click' AND p.event_type = 'purchase')
    SELECT event_id, r_event_id, gap FROM m WHERE n = 1"""
)
def j8_nearest_in_band(spark, sf_dir):
    """The nearest purchase of the same user within six hours of each click."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _seconds().alias("t")).withColumn("t2", F.col("t"))
    clicks, buys = (e.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "purchase"))
    return J.nearest_in_band(clicks, buys, "user_id", "t", "t2", 21_600_000_000).select("event_id", "r_event_id", "gap")


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 3600000000 AS t, epoch_us(ts) // 3600000000 + CAST(floor(value) AS BIGINT) AS t2 FROM events),
    m AS (SELECT c.event_id, p.event_id AS r_event_id, greatest(p.t - c.t2, c.t - p.t2, 0) AS gap,
        row_number() OVER (PARTITION BY c.event_id ORDER BY greatest(p.t - c.t2, c.t - p.t2, 0), p.t, p.event_id) AS n
      FROM e c JOIN e p ON c.user_id = p.user_id AND greatest(p.t - c.t2, c.t - p.t2, 0) <= 12 WHERE c.event_type = 'click' AND p.event_type = 'purchase')
    SELECT event_id, r_event_id, gap FROM m WHERE n = 1"""
)
def j8_nearest_range(spark, sf_dir):
    """Ranges of as many hours as an event's value: the nearest purchase's within twelve hours of each click's."""
    hour = F.floor(_seconds() / 3_600_000_000).cast("bigint")
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", hour.alias("t"), (hour + F.floor("value").cast("bigint")).alias("t2"))
    clicks, buys = (e.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "purchase"))
    return J.nearest_in_band(clicks, buys, "user_id", "t", "t2", 12).select("event_id", "r_event_id", "gap")


_SPANS = """SELECT o_custkey AS id, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS s,
  CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) + CAST(o_orderkey % 4 AS INTEGER) END AS e FROM orders"""


def _spans(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("s"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate") + (F.col("o_orderkey") % 4).cast("int")).alias("e"),
    )


@query(
    f"""SELECT k, CASE WHEN s IS NULL AND e IS NULL THEN 'unknown' ELSE 'potential' END AS bucket FROM ({_SPANS})
    WHERE (s IS NULL OR s <= 1997) AND (e IS NULL OR e >= 1996)"""
)
def j9_h2_interval_slice(spark, sf_dir):
    from scriptorium.operators.temporal import slice_

    return slice_(_spans(spark, sf_dir), "s", "e", 1996, 1997, include_unknown=True).select("k", "bucket")


@query(
    f"""SELECT id, CASE WHEN NOT c THEN lo END AS s, CASE WHEN NOT c THEN hi END AS e, c AS conflict FROM
    (SELECT id, max(s) AS lo, min(e) AS hi, coalesce(max(s) > min(e), false) AS c FROM ({_SPANS}) GROUP BY id)"""
)
def j10_intersection(spark, sf_dir):
    return J.intersection(_spans(spark, sf_dir), ["id"], "s", "e")


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT event_id, value FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts"""
)
def j11_as_of(spark, sf_dir):
    """The last view's value at each purchase."""
    e = load(spark, sf_dir, "events")
    marks = e.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("value"))
    points = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.as_of(points, marks, "user_id", "ts", "at", "value").select("event_id", "value")


@query(
    """WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS a, epoch_us(ts) // 3600000000 + 1 + event_id % 12 AS b FROM events)
    SELECT user_id, a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.user_id = s.user_id AND o.a <= s.a AND o.b >= s.b AND (o.a < s.a OR o.b > s.b))"""
)
def j12_not_contained(spark, sf_dir):
    hour = F.floor(_seconds() / 3_600_000_000).cast("bigint")
    spans = load(spark, sf_dir, "events").select("user_id", hour.alias("a"), (hour + 1 + F.col("event_id") % 12).alias("b")).distinct()
    return J.not_contained(spans, ["user_id"], "a", "b")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey),
    v AS (SELECT a AS me, b AS other, 'sells' AS my_role, 'sold_by' AS other_role FROM e UNION ALL SELECT b, a, 'sold_by', 'sells' FROM e)
    SELECT me, my_role, count(*) AS n_others FROM v GROUP BY ALL"""
)
def j14_both_ways(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    seen = J.both_ways(e.withColumn("ar", F.lit("sells")).withColumn("br", F.lit("sold_by")), "a", "b", "ar", "br")
    return seen.groupBy("me", "my_role").agg(F.count("*").alias("n_others"))


@query(
    """WITH RECURSIVE edges AS (SELECT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders WHERE o_orderkey > 0),
    path(id, node, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION ALL SELECT id, parent, depth + 1 FROM path JOIN edges ON child = node)
    SELECT id, CAST(max(depth) AS INTEGER) AS depth, string_agg(CAST(node AS VARCHAR), '>' ORDER BY depth) AS path FROM path GROUP BY id"""
)
def j15_lineage_path(spark, sf_dir):
    """Ordered path of every order to its root, of any length."""
    ids = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"))
    edges = ids.filter("child > 0").withColumn("parent", F.floor(F.col("child") / 3).cast("bigint"))
    return J.lineage_paths(ids, edges).select("id", (F.size("path") - 1).alias("depth"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier, o_orderdate FROM orders)
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_orderdate, o_orderkey) AS n FROM c) WHERE n = 1"""
)
def j16_prioritised_fallback(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.min_by("o_orderkey", F.struct(tier, F.col("o_orderdate"), F.col("o_orderkey")))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query(
    """WITH a AS (SELECT p_name AS surface, list_sort(list(DISTINCT p_brand)) AS persons FROM part GROUP BY 1),
    k AS (SELECT p_name AS surface, list_sort(list(DISTINCT p_brand)) AS known FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT surface, len(persons) AS n_persons, CASE WHEN len(persons) > 1 THEN 'ambiguous' WHEN known IS NOT NULL AND NOT list_has_any(known, persons) THEN 'conflict'
      WHEN known IS NOT NULL THEN 'existing' ELSE 'new' END AS state FROM a LEFT JOIN k USING (surface)"""
)
def j17_surface_states(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("person"), "p_size")
    out = J.surface_states(p, "surface", "person", p.filter("p_size > 45"))
    return out.select("surface", F.size("persons").cast("bigint").alias("n_persons"), "state")


@query(
    """SELECT 'document' AS origin, doc_id AS ref, lang AS layer, md5(text) AS quote_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT 'benchmark', item_id, 'benchmark', md5(text) FROM benchmark"""
)
def j18_evidence_union(spark, sf_dir):
    reviewed = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = load(spark, sf_dir, "documents").join(reviewed, "doc_id", "left_semi")
    a = docs.select(F.lit("document").alias("origin"), F.col("doc_id").alias("ref"), F.col("lang").alias("layer"), F.md5("text").alias("quote_md5"))
    b = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("ref"), F.lit("benchmark").alias("layer"), F.md5("text").alias("quote_md5"))
    return a.unionByName(b)


@query(
    """SELECT p_brand, count(DISTINCT o_custkey) AS n_customers, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""
)
def j19_j21_context_assembly(spark, sf_dir):
    facts = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = facts.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = rows.join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return rows.groupBy("p_brand").agg(F.countDistinct("o_custkey").alias("n_customers"), F.sum("l_quantity").cast("bigint").alias("quantity"))
