"""A rows: grouped measures over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import aggregates as A
from scriptorium.registry import query
from scriptorium.tables import load

_MENTIONS = """SELECT user_id AS person_id, CAST(value AS INTEGER) % 5 AS entry_id, event_id AS mention_id, event_type AS section,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'high' ELSE 'low' END AS confidence FROM events"""


def _mentions(spark, sf_dir):
    high = F.when(F.col("event_type").isin("purchase", "signup"), "high").otherwise("low")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), (F.floor(F.col("value")).cast("int") % 5).alias("entry_id"), F.col("event_id").alias("mention_id"),
        F.col("event_type").alias("section"), high.alias("confidence"),
    )


@query(
    f"""SELECT person_id, entry_id, count(*) AS n_mentions, string_agg(DISTINCT section, ',' ORDER BY section) AS sections,
    count(*) FILTER (confidence = 'high') AS n_supporting, CASE WHEN bool_or(confidence = 'high') THEN 'reviewed' ELSE 'candidate' END AS review_status,
    CASE WHEN bool_and(confidence = 'high') THEN 'deterministic' WHEN bool_or(confidence = 'high') THEN 'mixed' ELSE 'contextual' END AS resolution_status
    FROM ({_MENTIONS.replace("CAST(value AS INTEGER)", "CAST(floor(value) AS INTEGER)")}) GROUP BY ALL"""
)
def a1_links(spark, sf_dir):
    out = A.links(_mentions(spark, sf_dir))
    return out.select(
        "person_id", "entry_id", "n_mentions", F.array_join("sections", ",").alias("sections"), F.size("supporting").cast("bigint").alias("n_supporting"),
        "review_status", "resolution_status",
    )


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def a2_distribution(spark, sf_dir):
    return A.distribution(load(spark, sf_dir, "documents"), "source")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def a3_distinct_sets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders"))


@query(
    """SELECT lang, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, round(max(n) / sum(n), 8) AS top_share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang"""
)
def a4_concentration(spark, sf_dir):
    return A.concentration(load(spark, sf_dir, "documents"), ["lang"], "source")


@query(
    """SELECT c_mktsegment, coalesce(round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4), 0.0) AS mean_pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def a5_mean_or_zero(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = load(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))
    return rows.groupBy("c_mktsegment").agg(A.mean_or_zero(pending, 4).alias("mean_pending"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), d AS (SELECT s_suppkey, count(DISTINCT y.l_suppkey) FILTER (y.l_suppkey <> s_suppkey) AS degree
      FROM supplier LEFT JOIN m x ON x.l_suppkey = s_suppkey LEFT JOIN m y ON y.l_orderkey = x.l_orderkey GROUP BY 1)
    SELECT median(degree) AS median_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS n_isolated FROM d"""
)
def a6_h12_median_degree(spark, sf_dir):
    from scriptorium.operators.joins import pairs_within

    pairs = pairs_within(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").select("a", "b").distinct()
    degree = A.degrees(load(spark, sf_dir, "supplier").select("s_suppkey"), pairs, "a", "b")
    return degree.agg(F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"))


@query(
    """SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count_if(lang = 'en') AS n_en, count_if(n_chars > 5000) AS n_long, count_if(contains(lower(text), 'license')) AS n_license,
    CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents"""
)
def a7_snapshot_metrics(spark, sf_dir):
    has = F.contains(F.lower("text"), F.lit("license"))
    return load(spark, sf_dir, "documents").agg(
        F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("lang") == "en").alias("n_en"),
        F.count_if(F.col("n_chars") > 5000).alias("n_long"), F.count_if(has).alias("n_license"), F.sum("n_chars").alias("n_chars"),
    )


@query(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS filled,
    count(DISTINCT CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '5-LOW' THEN o_orderkey END) AS low_only FROM orders GROUP BY 1"""
)
def a8_rollup(spark, sf_dir):
    f = F.col("o_orderstatus") == "F"
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.countDistinct("o_orderkey").alias("total"), F.countDistinct(F.when(f, F.col("o_orderkey"))).alias("filled"),
        F.countDistinct(F.when(~f & (F.col("o_orderpriority") == "5-LOW"), F.col("o_orderkey"))).alias("low_only"),
    )


@query(
    """SELECT user_id, count_if(event_type = 'view') AS "view", count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase FROM events GROUP BY 1"""
)
def a9_layer_counts(spark, sf_dir):
    wide = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return wide.fillna(0)


@query(
    """SELECT token, count(*) AS n_ids, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) WHERE length(token) > 12 GROUP BY 1"""
)
def a14_inverted_index(spark, sf_dir):
    tokens = F.filter(F.split("text", " "), lambda t: F.char_length(t) > 12)
    index = A.inverted_index(load(spark, sf_dir, "documents"), "doc_id", tokens)
    return index.select("token", F.size("ids").cast("bigint").alias("n_ids"), F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query(
    """SELECT family, count(DISTINCT p_size) AS n_numbers, min(p_size) AS low, max(p_size) AS high, count(*) AS n FROM
    (SELECT *, CASE WHEN p_type LIKE 'ECON%' THEN 'ECON' WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE 'P%' THEN 'P' END AS family FROM part) WHERE family IS NOT NULL GROUP BY 1"""
)
def a15_prefix_families(spark, sf_dir):
    return A.prefix_families(load(spark, sf_dir, "part"), "p_type", "p_size", ["ECON", "S", "P"])


@query(
    """SELECT k AS semantic_key, n FROM (SELECT concat_ws('|', l_returnflag, l_linestatus, l_suppkey) AS k, count(*) AS n FROM lineitem GROUP BY 1)
    WHERE k NOT IN (SELECT concat_ws('|', l_returnflag, l_linestatus, l_suppkey) FROM lineitem WHERE l_quantity > 49)"""
)
def a11_semantic_keys(spark, sf_dir):
    key = A.semantic_key("l_returnflag", "l_linestatus", "l_suppkey")
    rows = load(spark, sf_dir, "lineitem").withColumn("semantic_key", key)
    counted = rows.groupBy("semantic_key").agg(F.count("*").alias("n"))
    return counted.join(rows.filter("l_quantity > 49").select("semantic_key"), "semantic_key", "left_anti")


@query(
    """SELECT CAST(sum(n * size) AS BIGINT) AS total_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS unique_values
    FROM (SELECT text, count(*) AS n, max(strlen(text)) AS size FROM documents GROUP BY 1)"""
)
def a12_duplicate_bytes(spark, sf_dir):
    return A.duplicate_bytes(load(spark, sf_dir, "documents"), F.col("text"))[0]


@query()
def a13_field_bytes(spark, sf_dir):
    return A.field_bytes(load(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query(
    """WITH u AS (SELECT l_returnflag AS channel, count(*) AS n_items, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1)
    SELECT c.channel, coalesce(n_items, 0) AS n_items, coalesce(units, 0) AS units, CASE WHEN n_items > 0 THEN round(units / n_items, 6) ELSE 0.0 END AS per_item
    FROM (SELECT DISTINCT l_returnflag AS channel FROM lineitem UNION SELECT 'none') c LEFT JOIN u USING (channel)"""
)
def a16_yields(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_quantity").cast("bigint").alias("unit"))
    every = items.select("channel").distinct().union(spark.range(1).select(F.lit("none").alias("channel")))
    out = A.yields(items, every, "channel", "unit")
    return out.select("channel", "n_items", "units", F.round("per_item", 6).alias("per_item"))


@query(
    """SELECT k, count(*) AS frequency, min(event_id) AS first_id FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY 1"""
)
def a18_gap_rollup(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props"))
    rows = load(spark, sf_dir, "events").select("event_id", keys.alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("frequency"), F.min("event_id").alias("first_id"))


@query(
    """SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS ids FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1"""
)
def a19_window_members(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP'1996-01-01' AND o_orderdate < TIMESTAMP'1997-01-01'")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))


@query(
    """SELECT source, CASE WHEN count_if(lang = 'en') > 0 THEN 'available' ELSE 'missing' END AS en, CASE WHEN count_if(lang = 'fr') > 0 THEN 'available' ELSE 'missing' END AS fr FROM documents GROUP BY 1"""
)
def a20_coverage_matrix(spark, sf_dir):
    wide = load(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr"]).count()
    state = lambda c: F.when(F.col(c) > 0, "available").otherwise("missing").alias(c)
    return wide.select("source", state("en"), state("fr"))


@query(
    """SELECT lang AS tree, sha256(unhex(string_agg(hex(encode(p)) || '00' || h, '' ORDER BY p))) AS tree_sha256 FROM
    (SELECT lang, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS p, upper(sha256(text)) AS h FROM documents) GROUP BY 1"""
)
def a23_tree_hash(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select("lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return A.tree_hash(files.withColumnRenamed("lang", "tree"), "tree", "path", F.encode("text", "UTF-8"))


@query(
    """SELECT s_suppkey, CAST(n_orders + 3 * n_parts + 2 * n_flags AS BIGINT) AS score FROM (SELECT s_suppkey, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts,
    count(DISTINCT l_returnflag) AS n_flags FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)"""
)
def a24_structural_score(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.countDistinct("l_orderkey").alias("o"), F.countDistinct("l_partkey").alias("p"), F.countDistinct("l_returnflag").alias("f")
    )
    rows = load(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left").fillna(0, ["o", "p", "f"])
    return rows.select("s_suppkey", (F.col("o") + 3 * F.col("p") + 2 * F.col("f")).alias("score"))
