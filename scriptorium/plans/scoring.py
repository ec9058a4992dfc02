"""V, H25 and O rows: scores by rounds, stability, feedback, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import streaming
from scriptorium.operators import scoring as V
from scriptorium.registry import query
from scriptorium.tables import load


@query(
    """WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS b FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN len(list_filter(b, lambda x: x IS NOT NULL)) = 0 THEN 1.0 ELSE len(list_intersect(list_slice(list_sort(a), 1, 3), b)) / len(list_filter(b, lambda x: x IS NOT NULL)) END AS recall,
    len(list_filter(list_slice(list_sort(a), 1, 3), lambda x: NOT list_contains(list_filter(b, lambda y: y IS NOT NULL), x))) AS strays FROM g"""
)
def v1_v3_recall(spark, sf_dir):
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3).alias("found"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("wanted")
    )
    return g.select("o_custkey", V.recall(F.col("found"), F.col("wanted")).alias("recall"), V.strays(F.col("found"), F.col("wanted")).cast("bigint").alias("strays"))


@query(
    """SELECT conv_id, turn, round(least(1.0, d / 3.0) + least(1.0, e / 3.0) + least(1.0, (turn % 4) / 2.0) + least(1.0, (turn % 3) / 2.0) + least(1.0, (turn % 2) / 2.0) - least(1.0, (conv_id % 5) / 2.0), 6) AS total
    FROM (SELECT conv_id, turn, (length(text) // 400) AS d, len(regexp_extract_all(text, '[0-9]+')) AS e FROM conversations)"""
)
def v4_gain_vector(spark, sf_dir):
    t = F.col("turn")
    parts = {
        "depth": F.floor(F.char_length("text") / 400), "evidence": F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)), "relations": t % 4,
        "uncertainty": t % 3, "operations": t % 2, "distraction": F.col("conv_id") % 5,
    }
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(V.gains(parts)["total"], 6).alias("total"))


@query(
    """SELECT conv_id, CAST(max(CASE WHEN regexp_matches(text, 'que .* que') THEN 3 WHEN regexp_matches(text, 'the .* the') THEN 2 WHEN regexp_matches(text, 'the|que') THEN 1 ELSE 0 END) AS INTEGER) AS depth FROM conversations GROUP BY 1"""
)
def v5_question_depth(spark, sf_dir):
    depth = V.question_depth(F.col("text"), ["the|que", "the .* the", "que .* que"])
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(depth).alias("depth"))


@query(
    """SELECT conv_id, turn, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS changed FROM conversations"""
)
def v6_v7_trajectory(spark, sf_dir):
    return V.against_previous(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "changed")


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(day(ts) // 10 AS INTEGER) AS round, event_type AS ref FROM events),
    r AS (SELECT DISTINCT user_id, round FROM d) SELECT r.user_id, r.round, string_agg(DISTINCT d.ref, ',' ORDER BY d.ref) AS known,
    bool_or(d.round < r.round AND EXISTS (SELECT 1 FROM d n WHERE n.user_id = r.user_id AND n.round = r.round AND n.ref = d.ref)) AS shown_twice
    FROM r JOIN d ON d.user_id = r.user_id AND d.round <= r.round GROUP BY ALL"""
)
def v8_cumulative_exposure(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.floor(F.dayofmonth("ts") / 10).cast("int").alias("round"), F.col("event_type").alias("ref"))
    return V.exposed(rows, "user_id", "round", "ref").select("user_id", "round", F.array_join("known_refs", ",").alias("known"), "shown_twice")


@query(
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'conflicted' WHEN quality = 0 THEN 'uncertain' ELSE 'attested' END AS status FROM labels"""
)
def v10_epistemic(spark, sf_dir):
    refs = F.array(F.when(F.col("toxic") == 1, "conflicted").otherwise("fine"), F.when(F.col("quality") == 0, "uncertain").otherwise("fine"))
    return load(spark, sf_dir, "labels").select("doc_id", V.epistemic(F.lit("attested"), refs).alias("status"))


@query(
    """WITH s AS (SELECT DISTINCT user_id AS story_id FROM events), r AS (SELECT unnest(['click', 'purchase', 'refund']) AS role),
    c AS (SELECT user_id AS story_id, event_type AS role, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(value) AS INTEGER) DESC, event_id) AS n FROM events WHERE value >= 1)
    SELECT s.story_id, r.role, event_id AS candidate_id, CASE WHEN event_id IS NULL THEN 'abstained' ELSE 'selected' END AS status FROM s CROSS JOIN r LEFT JOIN c ON c.story_id = s.story_id AND c.role = r.role AND n = 1"""
)
def v11_role_slots(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    candidates = e.select(F.col("user_id").alias("story_id"), F.col("event_type").alias("role"), F.col("event_id").alias("candidate_id"), F.floor("value").cast("int").alias("n_evidence"))
    return V.role_slots(candidates, ["click", "purchase", "refund"], candidates)


@query(
    """WITH s AS (SELECT l_returnflag AS c, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1)
    SELECT a.c AS "left", b.c AS "right", b.n - a.n AS n, b.q - a.q AS q FROM s a JOIN s b ON (a.c = 'A' AND b.c = 'N') OR (a.c = 'N' AND b.c = 'R')"""
)
def a22_channel_deltas(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("c")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    return V.deltas(s, "c", ["n", "q"], [("A", "N"), ("N", "R")])


@query(
    """WITH f AS (SELECT event_id, ts, sha256(lower(CAST(user_id AS VARCHAR)) || chr(31) || lower(event_type)) AS fingerprint FROM events),
    d AS (SELECT *, first_value(event_id) OVER (PARTITION BY fingerprint ORDER BY ts, event_id) AS first FROM f)
    SELECT event_id, CASE WHEN first = event_id THEN 'new' ELSE 'duplicate' END AS status, CASE WHEN first <> event_id THEN first END AS duplicate_of FROM d"""
)
def o8_feedback_dedup(spark, sf_dir):
    log = load(spark, sf_dir, "events").withColumn("fingerprint", streaming.fingerprint("user_id", "event_type"))
    return streaming.deduplicated(log, "event_id", "ts").select("event_id", "status", "duplicate_of")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'reviewed' ELSE 'new' END AS status FROM events"""
)
def o9_feedback_review(spark, sf_dir):
    store = load(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), "event_type").withColumn("status", F.lit("new"))
    to = F.when(F.col("event_type").isin("click", "view"), "reviewed").when(F.col("event_type") == "error", "exported")
    changes = store.withColumn("to_status", to).filter("to_status IS NOT NULL").select("feedback_id", "to_status")
    return streaming.reviewed(store, changes)[0].select(F.col("feedback_id").alias("event_id"), "status")


@query(
    """SELECT text_md5, copies FROM (SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY 1) WHERE copies > 1"""
)
def o2_shared_display(spark, sf_dir):
    """The registry that repeated texts move to, one row a text."""
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies")).filter("copies > 1")


@query(
    "SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY n_chars DESC, doc_id) AS place FROM (SELECT doc_id, lang AS category, n_chars FROM documents)"
)
def o4_static_index(spark, sf_dir):
    by = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.row_number().over(by).cast("bigint").alias("place"))


@query(
    """WITH a AS (SELECT source AS path, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1) SELECT path, h FROM a"""
)
def o6_manifest(spark, sf_dir):
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda u: u["h"]), "")
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.md5(parts).alias("h"))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)) AS v FROM embeddings), n AS (SELECT a.vec_id, b.label = a.label AS same,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) DESC, b.vec_id) AS n
      FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT vec_id, count(*) FILTER (same) AS same_label FROM n WHERE n <= 5 GROUP BY 1"""
)
def h25_neighbour_overlap(spark, sf_dir):
    """How many of a vector's five nearest carry its label, every row against every other."""
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    return V.label_overlap(load(spark, sf_dir, "embeddings").select("vec_id", "label", whole.alias("v")), "vec_id", "label", "v")


