"""K rows: allocation, sampling and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import selection as K
from scriptorium.registry import query
from scriptorium.tables import load

SEED = 20260816


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_nationkey, s_suppkey LIMIT 20")
def k1_k3_top_k(spark, sf_dir):
    return load(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_nationkey", "s_suppkey").limit(20).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, first_order FROM (SELECT c_custkey, min(o_orderdate) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY first_order NULLS LAST, c_custkey LIMIT 100")
def k2_nulls_last(spark, sf_dir):
    firsts = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"))
    rows = load(spark, sf_dir, "customer").select("c_custkey").join(firsts, "c_custkey", "left")
    return rows.orderBy(F.asc_nulls_last("first_order"), "c_custkey").limit(100)


@query("SELECT doc_id, CAST(position('the of' IN text) - 1 AS INTEGER) AS first_offset FROM documents WHERE contains(text, 'the of') ORDER BY doc_id LIMIT 25")
def k4_scan_limit(spark, sf_dir):
    hits = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the of")))
    return hits.orderBy("doc_id").limit(25).select("doc_id", (F.locate("the of", F.col("text")) - 1).alias("first_offset"))


@query("SELECT unnest(['graph', 'coverage', 'random', 'counter']) AS channel, unnest([8, 6, 3, 3])::BIGINT AS n")
def k6_allocation(spark, sf_dir):
    return spark.createDataFrame(list(K.allocate(20).items()), "channel string, n bigint")


_CHANNELS = """g AS (SELECT p_partkey, 'graph' AS channel, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part ORDER BY n LIMIT 8),
  c AS (SELECT p_partkey, 'coverage' AS channel, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM g) ORDER BY n LIMIT 6),
  k AS (SELECT p_partkey, 'counter' AS channel, row_number() OVER (ORDER BY p_size, p_partkey) AS n FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM g UNION SELECT p_partkey FROM c) ORDER BY n LIMIT 3)"""


@query(f"WITH {_CHANNELS} SELECT p_partkey, channel, CAST(n AS INTEGER) AS channel_rank FROM (SELECT * FROM g UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k)")
def k7_disjoint_channels(spark, sf_dir):
    order = {"graph": [F.desc("p_retailprice")], "coverage": [F.desc("p_size")], "counter": [F.asc("p_size")]}
    out = K.channels(load(spark, sf_dir, "part"), "p_partkey", order, K.allocate(20))
    return out.select("p_partkey", "channel", "channel_rank")


@query(
    f"""WITH t AS (SELECT c_custkey, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}|random|' || c_custkey), c_custkey) AS turn FROM customer)
    SELECT c_custkey, stratum FROM t ORDER BY turn, sha256('{SEED}|' || stratum), stratum LIMIT 32"""
)
def k8_round_robin(spark, sf_dir):
    return K.round_robin(load(spark, sf_dir, "customer"), F.col("c_mktsegment"), "c_custkey", 32, SEED).select("c_custkey", "stratum")


@query()
def k9_k10_greedy_cover(spark, sf_dir):
    """Sixteen orders that cover twelve suppliers, chosen from all orders."""
    wanted, count = list(range(12)), 16
    members = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("m"))
    orders = load(spark, sf_dir, "orders").join(members, "o_orderkey", "left").select("o_orderkey", "o_totalprice", "o_orderpriority", "m")
    rows = K.cover_candidates(orders, "o_orderkey", "o_totalprice", "o_orderpriority", "m", wanted, count).collect()
    pool = [{"id": r[0], "score": r[1] / 1e5, "group": r[2], "members": set(r[3] or ())} for r in rows]
    chosen = K.greedy_cover(pool, set(wanted), count)
    return spark.createDataFrame([(i, c["id"]) for i, c in enumerate(chosen, 1)], "place int, o_orderkey bigint")


@query(
    """WITH t AS (SELECT p_partkey, p_brand, p_size * 4 + p_retailprice / 15 AS base FROM part ORDER BY base DESC, p_partkey LIMIT 60)
    SELECT p_partkey, round(base + CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY base DESC, p_partkey) = 1 THEN 1.5 ELSE 0 END, 4) AS selection_score FROM t"""
)
def k11_score_then_cap(spark, sf_dir):
    """The bonus for a brand's first is recorded; it doesn't change the order."""
    base = F.col("p_size") * 4 + F.col("p_retailprice") / 15
    top = load(spark, sf_dir, "part").withColumn("base", base).orderBy(F.desc("base"), "p_partkey").limit(60)
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("base"), "p_partkey")) == 1
    return top.select("p_partkey", F.round(F.col("base") + F.when(first, 1.5).otherwise(0.0), 4).alias("selection_score"))


@query(
    """SELECT source, arg_min(doc_id, lpad(CAST(n_chars AS VARCHAR), 9, '0') || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS shortest,
    arg_max(doc_id, lpad(CAST(n_chars AS VARCHAR), 9, '0') || lpad(CAST(999999999 - doc_id AS VARCHAR), 9, '0')) AS richest FROM documents GROUP BY 1"""
)
def k13_qualification_sample(spark, sf_dir):
    return K.extremes(load(spark, sf_dir, "documents"), "source", "n_chars", "n_chars", "doc_id")


@query(
    """WITH t AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'low' WHEN event_type = 'signup' THEN 'medium' ELSE 'high' END AS confidence FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, confidence ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id, confidence) AS n FROM t)
    SELECT event_id, confidence FROM n WHERE confidence <> 'high' OR pos IN (0, n // 2, n - 1)"""
)
def k14_review_sample(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "error", "low").when(kind == "signup", "medium").otherwise("high")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", level.alias("confidence"))
    return K.review_sample(rows, "user_id", "confidence", ["event_id"]).select("event_id", "confidence")


@query(
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS INTEGER) AS class FROM orders ORDER BY class, o_orderdate, o_orderkey LIMIT 40"""
)
def k16_priority_order(spark, sf_dir):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return load(spark, sf_dir, "orders").withColumn("class", order).orderBy("class", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey", "class")


@query(
    """SELECT 'person-' || lpad(CAST(100 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS VARCHAR), 3, '0') AS person_id, c_custkey FROM
    (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25)"""
)
def k17_selection_wave(spark, sf_dir):
    top = load(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    n = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")) + 100  # 25 rows
    return top.select(F.concat(F.lit("person-"), F.lpad(n.cast("string"), 3, "0")).alias("person_id"), "c_custkey")


@query(
    """SELECT c_custkey, CASE WHEN s >= 60 AND r <= 0.35 THEN 'A' WHEN s >= 40 AND r <= 0.60 THEN 'B' WHEN s >= 20 AND r <= 0.80 THEN 'C' ELSE 'deferred' END AS tier
    FROM (SELECT c_custkey, c_acctbal / 100 AS s, (c_custkey % 100) / 100.0 AS r FROM customer)"""
)
def k18_tiers(spark, sf_dir):
    risk = (F.col("c_custkey") % 100) / 100
    return load(spark, sf_dir, "customer").select("c_custkey", K.tier(F.col("c_acctbal") / 100, risk).alias("tier"))
