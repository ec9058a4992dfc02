"""T and K5/A10 rows over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import search as S
from scriptorium.registry import query
from scriptorium.tables import load

PHRASE, HINTS = "under the apache", ("license", "copy")


def _folded_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '\\s+', '', 'g')"


def _terms() -> list[str]:
    return X.ngrams("".join(PHRASE.split()))


def _layer_sql(text: str, linked: str) -> str:
    whole = "".join(PHRASE.split())
    terms = [t for t in _terms() if len(t) > 1]
    part = " + ".join(f"contains({text}, '{t}')::INT" for t in terms)
    score = f"CASE WHEN contains({text}, '{whole}') THEN {S.PHRASE + S.PER_CHAR * len(whole)} ELSE {S.TERM} * ({part}) END"
    return f"CASE WHEN ({score}) > 0 THEN ({score}) + CASE WHEN {linked} THEN {S.LINKED} ELSE 0 END ELSE 0 END"


_PIECES = "(SELECT doc_id, text, string_split(text, 'the of') AS p FROM documents WHERE contains(text, 'the of'))"


@query(
    f"""SELECT doc_id, "offset", substring(text, greatest("offset" - 40, 0) + 1, least("offset" + 40, length(text)) - greatest("offset" - 40, 0)) AS snippet
    FROM (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 6 AS INTEGER) AS "offset"
      FROM (SELECT doc_id, text, p, unnest(range(1, len(p))) AS k FROM {_PIECES}))"""
)
def t1_exact_occurrences(spark, sf_dir):
    return S.occurrences(load(spark, sf_dir, "documents"), "doc_id", "text", "the of", 40)


def _scored(spark, sf_dir, *more):
    docs = load(spark, sf_dir, "documents").select("doc_id", X.compact(F.lower("text")).alias("folded"), *more)
    linked = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("linked", F.lit(True))
    # The score without its bonus decides what matches, so the texts don't travel to the labels.
    own = S.computed(docs, "own", S.layer_score(F.col("folded"), PHRASE)).filter("own > 0").drop("folded")
    bonus = F.when(F.col("linked"), F.lit(S.LINKED)).otherwise(F.lit(0))
    return own.join(linked, "doc_id", "left").withColumn("score", F.col("own") + bonus).drop("own", "linked")


_SCORED = f"""SELECT doc_id, score FROM (SELECT d.doc_id, {_layer_sql("d.folded", "l.doc_id IS NOT NULL")} AS score
  FROM (SELECT doc_id, {_folded_sql("text")} AS folded FROM documents) d
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)) WHERE score > 0"""


@query(
    f"""WITH s AS ({_SCORED}) SELECT doc_id, CAST(score AS INTEGER) AS score, (SELECT count(*) FROM s) AS raw_match_count,
    CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20"""
)
def t3_layer_score_search(spark, sf_dir):
    return S.ranked(_scored(spark, sf_dir), "score", ["doc_id"], 20).select("doc_id", "score", "raw_match_count", "rank")


@query(
    f"""WITH layers AS (SELECT 'main' AS layer, doc_id AS id, {_folded_sql("text")} AS folded FROM documents
      UNION ALL SELECT 'benchmark', item_id, {_folded_sql("text")} FROM benchmark),
    s AS (SELECT layer, id, {_layer_sql("folded", "false")} AS score FROM layers)
    SELECT layer, id, CAST(score AS INTEGER) AS score, (SELECT count(*) FROM s WHERE score > 0) AS raw_match_count,
      CAST(row_number() OVER (ORDER BY score DESC, layer, id) AS INTEGER) AS rank
    FROM s WHERE score > 0 ORDER BY score DESC, layer, id LIMIT 30"""
)
def t2_layered_search(spark, sf_dir):
    main = load(spark, sf_dir, "documents").select(F.lit("main").alias("layer"), F.col("doc_id").alias("id"), "text")
    other = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("layer"), F.col("item_id").alias("id"), "text")
    folded = main.unionByName(other).select("layer", "id", X.compact(F.lower("text")).alias("folded"))
    scored = S.computed(folded, "score", S.layer_score(F.col("folded"), PHRASE))
    return S.ranked(scored.filter("score > 0").select("layer", "id", "score"), "score", ["layer", "id"], 30)


@query(
    """WITH w AS (SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS q FROM part),
    t AS (SELECT p_partkey, q AS term FROM w UNION SELECT p_partkey, substring(q, i, 3) FROM (SELECT *, unnest(range(1, length(q) - 1)) AS i FROM w)
      UNION SELECT p_partkey, substring(q, i, 2) FROM (SELECT *, unnest(range(1, length(q))) AS i FROM w))
    SELECT p_partkey, string_agg(term, ',' ORDER BY length(term) DESC, term) AS terms FROM t WHERE term <> '' GROUP BY p_partkey"""
)
def t4_ngram_terms(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(X.ngram_terms(F.col("p_name")), ",").alias("terms"))


def _evidence_sql() -> str:
    whole = "".join(PHRASE.split())
    parts = [f"CASE WHEN contains(folded, '{whole}') THEN 20 ELSE 0 END"]
    parts += [f"CASE WHEN contains(folded, '{t}') THEN {2 if len(t) <= 2 else 4} ELSE 0 END" for t in _terms()]
    parts += [f"CASE WHEN contains(folded, '{h}') THEN 8 ELSE 0 END" for h in HINTS]
    return " + ".join(parts)


@query(
    f"""SELECT doc_id, CAST(score AS INTEGER) AS score FROM (SELECT doc_id, {_evidence_sql()} AS score
    FROM (SELECT doc_id, {_folded_sql("text")} AS folded FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5"""
)
def t5_evidence_search(spark, sf_dir):
    folded = load(spark, sf_dir, "documents").select("doc_id", X.compact(F.lower("text")).alias("folded"))
    scored = S.computed(folded, "score", S.evidence_score(F.col("folded"), PHRASE, HINTS)).filter("score > 0").drop("folded")
    return scored.orderBy(F.desc("score"), "doc_id").limit(S.checked_k(5, S.MAX_EVIDENCE_K)).select("doc_id", "score")


@query(
    """WITH v AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS v FROM documents WHERE contains(text, 'icense')),
    s AS (SELECT doc_id, v, greatest(0, position('icense' IN v) - 1 - 24) AS s FROM v)
    SELECT doc_id, substring(v, least(s, greatest(0, length(v) - 110)) + 1, 110) AS excerpt FROM s"""
)
def t7_excerpt(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("icense")))
    return docs.select("doc_id", S.excerpt(F.col("text"), ["icense"]).alias("excerpt"))


@query(
    """SELECT user_id, arg_min(status, (CASE status WHEN 'reviewed' THEN '0' WHEN 'candidate' THEN '1' ELSE '2' END) || status) AS status FROM
    (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'reviewed' WHEN 'click' THEN 'candidate' ELSE event_type END AS status
     FROM events WHERE value > 60) GROUP BY user_id"""
)
def t9_link_status(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "reviewed").when(kind == "click", "candidate").otherwise(kind)
    rows = load(spark, sf_dir, "events").filter("value > 60").select("user_id", status.alias("status"))
    return rows.groupBy("user_id").agg(S.best_status(F.col("status")).alias("status"))


@query(
    f"""WITH h AS (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 6 AS INTEGER) AS "offset"
      FROM (SELECT doc_id, text, p, unnest(range(1, len(p))) AS k FROM {_PIECES}))
    SELECT doc_id, "offset", regexp_matches(substring(text, greatest("offset" - 48, 0) + 1, least("offset" + 6 + 96, length(text)) - greatest("offset" - 48, 0)), 'icense|said|by[.]') AS is_citation FROM h"""
)
def t13_citation_context(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the of")))
    hits = docs.withColumn("offset", F.explode(S.offsets(F.col("text"), "the of")))
    low = F.greatest(F.col("offset") - 48, F.lit(0))
    around = F.substring("text", low + 1, F.least(F.col("offset") + 6 + 96, F.char_length("text")) - low)
    return hits.select("doc_id", "offset", around.rlike("icense|said|by[.]").alias("is_citation"))


@query(
    f"""WITH s AS ({_SCORED}), k AS (SELECT s.doc_id, s.score, length(d.text) AS size FROM s JOIN documents d USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50),
    t AS (SELECT *, CAST(sum(size) OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS total_size FROM k)
    SELECT doc_id, CAST(score AS INTEGER) AS score, total_size FROM t WHERE total_size <= 24000"""
)
def k5_budgeted_hits(spark, sf_dir):
    sized = load(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("bigint").alias("size"))
    top = _scored(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(S.MAX_K)
    hits = sized.join(F.broadcast(top), "doc_id")
    return S.within_budget(hits, "size", [F.desc("score"), F.col("doc_id")], 24_000).select("doc_id", "score", "total_size")


@query(
    f"""WITH s AS ({_SCORED}), k AS (SELECT s.doc_id, score, regexp_replace(text, '\\s+', '', 'g') AS key FROM s JOIN documents USING (doc_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY md5(key) ORDER BY score DESC, doc_id) AS n, count(*) OVER (PARTITION BY md5(key)) AS copies FROM k)
    SELECT doc_id, CAST(score AS INTEGER) AS score, copies FROM n WHERE n = 1"""
)
def a10_keep_best(spark, sf_dir):
    hits = _scored(spark, sf_dir, "text").withColumn("key", F.sha2(X.compact(F.col("text")), 256)).drop("text")
    return S.keep_best(hits, ["key"], [F.desc("score"), F.col("doc_id")]).select("doc_id", "score", "copies")
