"""E and L rows: mentions, relations, alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import alignment as L
from scriptorium.operators import entities as E
from scriptorium.registry import query
from scriptorium.tables import load

SURFACES = ["Apache License", "MIT License", "GNU General Public License", "License", "token", "the of"]


def _matches(spark, sf_dir):
    return E.dictionary_matches(load(spark, sf_dir, "documents"), "doc_id", "text", SURFACES)


_HITS = " UNION ALL ".join(
    f"""SELECT doc_id, '{s}' AS surface, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {len(s)} AS INTEGER) AS start
    FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS k FROM (SELECT doc_id, string_split(text, '{s}') AS p FROM documents WHERE contains(text, '{s}')))"""
    for s in SURFACES
)


@query(f'SELECT doc_id, surface, start, CAST(start + length(surface) AS INTEGER) AS "end" FROM ({_HITS})')
def e1_dictionary_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"SELECT surface, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM ({_HITS}) GROUP BY 1")
def e4_alias_registry(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT sha256(doc_id || chr(31) || surface || chr(31) || start) AS mention_id, doc_id, surface FROM ({_HITS})")
def e3_mention_table(spark, sf_dir):
    return _matches(spark, sf_dir).select(X.stable_hash(F.col("doc_id"), F.col("surface"), F.col("start")).alias("mention_id"), "doc_id", "surface")


@query(
    f"""WITH h AS (SELECT *, start + length(surface) AS e FROM ({_HITS})), w AS (SELECT doc_id, start, e FROM h WHERE surface = 'License'),
    s AS (SELECT doc_id, surface, start, e FROM h WHERE surface IN ('Apache License', 'MIT License', 'GNU General Public License'))
    SELECT w.doc_id, w.start, count(DISTINCT s.surface) AS n_candidates, CASE count(DISTINCT s.surface) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'medium' ELSE 'ambiguous' END AS resolution
    FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.e >= w.start - 120 AND s.start <= w.e + 120 GROUP BY ALL"""
)
def e2_contextual_resolution(spark, sf_dir):
    hits = _matches(spark, sf_dir)
    weak = hits.filter("surface = 'License'").select("doc_id", "start", "end")
    strong = hits.filter(F.col("surface").isin(SURFACES[:3])).withColumnRenamed("surface", "person_id")
    out = E.contextual(weak, strong, "doc_id")
    return out.select("doc_id", "start", F.size("candidate_ids").cast("bigint").alias("n_candidates"), "resolution")


@query(
    f"""WITH h AS (SELECT *, start + length(surface) AS e FROM ({_HITS})) SELECT doc_id, surface, start FROM h x
    WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y.e >= x.e AND length(y.surface) > length(x.surface))"""
)
def e5_longest_spans(spark, sf_dir):
    return E.longest_spans(_matches(spark, sf_dir), "doc_id").select("doc_id", "surface", "start")


@query(
    f"""WITH h AS (SELECT doc_id, surface, start, start + length(surface) AS e FROM ({_HITS}) WHERE surface IN ('token', 'the of', 'License')),
    p AS (SELECT x.doc_id, x.surface AS a, y.surface AS b, greatest(y.start - x.e, x.start - y.e, 0) AS gap FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.surface < y.surface)
    SELECT doc_id, a, b, CAST(min(gap) AS INTEGER) AS gap FROM p WHERE gap <= 96 GROUP BY ALL"""
)
def e13_nearest_pairs(spark, sf_dir):
    hits = _matches(spark, sf_dir).filter(F.col("surface").isin("token", "the of", "License")).withColumnRenamed("surface", "person_id")
    return E.nearest_pairs(hits, "doc_id").select("doc_id", "a", "b", F.col("gap").cast("int").alias("gap"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '@') THEN 'contact' END, CASE WHEN regexp_matches(text, '[Ll]icense') THEN 'license' END,
      CASE WHEN NOT regexp_matches(text, '@|[Ll]icense|token') THEN 'plain' END, CASE WHEN regexp_matches(text, 'token') THEN 'secret' END) AS types FROM documents"""
)
def e17_fact_types(spark, sf_dir):
    types = E.fact_types(F.col("text"), {"contact": "@", "license": "[Ll]icense", "secret": "token"}, "plain")
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(types, ",").alias("types"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders"""
)
def e20_id_migration(spark, sf_dir):
    mapping = load(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1_000_000).alias("new_id"))
    return E.migrated(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], mapping)


@query(
    """SELECT c_custkey, round(greatest(0.0, least(100.0, (0.22 * coalesce(n_orders, 0) / 40 + 0.16 * (c_nationkey % 5) / 4.0 + 0.12 * c_acctbal / 10000 - 0.15 * (c_custkey % 3) / 2.0) * 100)), 4) AS score
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def e10_person_score(spark, sf_dir):
    n = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = load(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    parts = {
        "story_coverage": F.col("n") / 40, "network": (F.col("c_nationkey") % 5) / 4, "corpus": F.col("c_acctbal") / 10000,
        "ambiguity": (F.col("c_custkey") % 3) / 2,
    }
    return rows.select("c_custkey", E.person_score(parts).alias("score"))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) = length(p_type) THEN CASE WHEN p_name = p_type THEN 'exact' ELSE 'variant' END ELSE 'disputed' END AS class FROM part"""
)
def l7_alignment_class(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", L.alignment_class(F.col("p_name"), F.col("p_type")).alias("class"))


@query(
    """WITH p AS (SELECT p_partkey, p_name AS a, p_brand AS b, least(length(p_name), length(p_brand)) AS n FROM part),
    h AS (SELECT p_partkey, a, b, n, count(*) FILTER (substring(a, i, 1) = substring(b, i, 1)) AS hits FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p) GROUP BY ALL)
    SELECT p_partkey, round((hits - 0.70 * (n - hits) - 0.20 * abs(length(a) - length(b))) / greatest(length(a), length(b)), 6) AS score FROM h"""
)
def l6_positional_score(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.round(L.positional_score(F.col("p_name"), F.col("p_brand")), 6).alias("score"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\p{P}\\s]', '', 'g')) AS bare_md5 FROM documents")
def l8_strip_punctuation(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(L.stripped(F.col("text"))).alias("bare_md5"))


@query("SELECT doc_id, CAST(length(regexp_replace(substring(text, 1, 200), '[\\p{P}\\s]', '', 'g')) AS INTEGER) AS logical_offset FROM documents")
def l9_logical_offset(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", L.logical_offset(F.col("text"), F.lit(200)).alias("logical_offset"))


@query("SELECT doc_id, md5(translate(text, 'éèê', 'eee')) AS text_md5 FROM documents")
def l13_conversion(spark, sf_dir):
    """Whole texts converted; their hashes stand for them."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(L.converted(F.col("text"), {"é": "e", "è": "e", "ê": "e"})).alias("text_md5"))


@query()
def l1_l3_alignment(spark, sf_dir):
    """Similarity of each document with the one before it in its source, whole texts."""
    return L.aligned_in_order(load(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query()
def l14_opening_class(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = load(spark, sf_dir, "documents").withColumn("other", before).filter("other IS NOT NULL")
    return rows.select("doc_id", L.opening_class(F.col("text"), F.col("other")).alias("class"))


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_type, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
    SELECT p_partkey, contains(p_name, p_type) OR contains(p_type, p_name) OR len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.55 AS matched FROM t"""
)
def l15_span_match(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", L.spans_match(F.col("p_name"), F.col("p_type")).alias("matched"))
