"""W rows: ranks, fills, islands, normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import windows as W
from scriptorium.registry import query
from scriptorium.tables import load


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w1_global_rank(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return W.global_rank(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS channel_rank FROM part)
    SELECT p_partkey, channel_rank, row_number() OVER (ORDER BY p_brand, channel_rank) AS overall_rank FROM r"""
)
def w2_channel_ranks(spark, sf_dir):
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    rows = load(spark, sf_dir, "part").withColumn("channel_rank", F.row_number().over(by).cast("bigint")).select("p_brand", "p_partkey", "channel_rank")
    return W.global_rank(rows, [F.asc("p_brand"), F.asc("channel_rank")], "overall_rank").select("p_partkey", "channel_rank", "overall_rank")


@query(
    """SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER () AS n FROM part WHERE p_size >= 10) WHERE rank >= ceil(0.5 * n)"""
)
def w3_lower_half(spark, sf_dir):
    rows = load(spark, sf_dir, "part").filter("p_size >= 10").select("p_partkey", "p_retailprice")
    ranked = W.global_rank(rows, [F.desc("p_retailprice"), F.asc("p_partkey")])
    most = ranked.agg(F.max("rank").alias("most"))  # one row
    return ranked.join(F.broadcast(most)).filter("rank >= ceil(0.5 * most)").select("p_partkey", "rank")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events"""
)
def w4_forward_fill(spark, sf_dir):
    value = F.when(F.col("event_type") == "signup", F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", W.forward_filled(value, ["user_id"], ["ts", "event_id"]).alias("filled"))


@query(
    """SELECT event_id, CASE WHEN p = event_type THEN 'repeated' WHEN p IS NULL THEN 'first' ELSE 'ok' END AS finding FROM
    (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"""
)
def w5_adjacent_check(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").withColumn("p", before)
    finding = F.when(F.col("p") == F.col("event_type"), "repeated").when(F.col("p").isNull(), "first").otherwise("ok")
    return rows.select("event_id", finding.alias("finding"))


_RUNS = "SELECT l_suppkey AS g, l_orderkey AS a, l_orderkey + (l_orderkey // 50) AS b FROM lineitem GROUP BY ALL"


@query(
    f"""WITH x AS (SELECT g, a, b, row_number() OVER (PARTITION BY g ORDER BY a, b) AS n FROM ({_RUNS}))
    SELECT g, min(a) AS first_from, max(a) AS first_to, min(b) AS second_from, max(b) AS second_to, count(*) AS n FROM x GROUP BY g, a - n, b - n"""
)
def w7_islands(spark, sf_dir):
    a = F.col("l_orderkey")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), a.alias("a"), (a + F.floor(a / 50).cast("bigint")).alias("b")).distinct()
    return W.islands(rows, ["g"], "a", "b")


@query(
    """SELECT conv_id, turn, CAST(length(text) - lag(length(text), 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS gain FROM conversations"""
)
def w8_round_delta(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("depth", F.char_length("text").cast("bigint"))
    return rows.select("conv_id", "turn", W.delta(F.col("depth"), ["conv_id"], "turn").alias("gain"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events")
def w9_occurrence_number(spark, sf_dir):
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", F.row_number().over(by).cast("bigint").alias("occurrence"))


@query("SELECT p_partkey, round(p_size / (SELECT max(p_size) FROM part), 6) AS share FROM part")
def w10_max_normalised(spark, sf_dir):
    rows = load(spark, sf_dir, "part")
    most = rows.agg(F.max("p_size").alias("most"))
    return rows.join(F.broadcast(most)).select("p_partkey", F.round(F.col("p_size") / F.col("most"), 6).alias("share"))


@query(
    """SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank FROM part"""
)
def w11_average_rank(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", W.average_rank(F.col("p_size"), ["p_brand"]).cast("double").alias("rank"))


@query(
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 3600000000 AS b FROM events)
    SELECT event_id, coalesce(a < max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM s"""
)
def w12_overlaps(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", start.alias("a"), (start + F.floor("value") * 3_600_000_000).alias("b"))
    return rows.select("event_id", W.overlaps_previous("a", "b", ["user_id"], "event_id").alias("overlaps"))
