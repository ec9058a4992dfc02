"""L2, L4, L5 over the benchmark's items as chapters; O5, O10, P17 and K15."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import boundaries as B
from scriptorium.operators import report as R
from scriptorium.operators import selection as K
from scriptorium.operators.windows import global_rank
from scriptorium.registry import query
from scriptorium.tables import load

SURFACES = {"apache license": "apache", "mit license": "mit", "stupid": "insult"}
DRAW = 0.37


@R.provider("reversed")
def _reversed(payloads: list) -> list:
    return [None if p is None else p[::-1] for p in payloads]


def _chapters(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chapter"), F.col("text").alias("source"))


def _entries(spark, sf_dir):
    """Every sentence as an entry; of every third the vowels e are lost in the reference."""
    rows = _chapters(spark, sf_dir).select("chapter", F.posexplode(F.split("source", r"(?<=\.)\s+")).alias("ordinal", "text"))
    return rows.withColumn("text", F.when(F.col("ordinal") % 3 == 2, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text"))).withColumn("opening", F.col("text"))


@query()
def l2_best_opening(spark, sf_dir):
    """The words from place 30 on, sought around place 45."""
    sought = _chapters(spark, sf_dir).select("chapter", "source", F.substring("source", 31, 36).alias("opening"), F.lit(45).alias("about"))
    return B.best_openings(sought, "chapter", "source", "opening", "about", F.lit(0), F.char_length("source"))


@query()
def l4_boundary_proposal(spark, sf_dir):
    return B.propose(_entries(spark, sf_dir), _chapters(spark, sf_dir))


@query()
def l5_boundary_audit(spark, sf_dir):
    chapters = _chapters(spark, sf_dir)
    return B.audit(B.propose(_entries(spark, sf_dir), chapters), chapters)


@query(
    """WITH c AS (SELECT coalesce(lang, '') AS lang, CAST(count(*) AS VARCHAR) AS texts, CAST(sum(coalesce(n_chars, 0)) AS VARCHAR) AS characters FROM documents GROUP BY 1),
    r AS (SELECT 1 + row_number() OVER (ORDER BY lang) AS n, '| ' || lang || ' | ' || texts || ' | ' || characters || ' |' AS line FROM c)
    SELECT CAST(n AS BIGINT) AS n, line FROM r UNION ALL SELECT 0, '| lang | texts | characters |' UNION ALL SELECT 1, '| --- | --- | --- |'"""
)
def o5_report_lines(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang"))
    counts = docs.agg(F.count("*").alias("texts"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("characters"))
    return R.markdown_table(counts, ["lang", "texts", "characters"], [F.col("lang")])


@query("SELECT p_partkey, reverse(p_name) AS reading FROM part")
def o10_provider_readings(spark, sf_dir):
    return R.readings(load(spark, sf_dir, "part"), "p_partkey", "p_name", "reversed")


@query(
    """WITH e AS (SELECT doc_id, 'stupid' AS surface, 'known' AS person FROM labels WHERE toxic = 1),
    k(surface, person) AS (VALUES ('apache license', 'apache'), ('mit license', 'mit'), ('stupid', 'insult')),
    h AS (SELECT doc_id, surface, person FROM documents, k WHERE contains(text, surface))
    SELECT * FROM e UNION ALL SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = h.doc_id AND e.surface = h.surface)"""
)
def p17_known_conflicts(spark, sf_dir):
    found = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("stupid").alias("surface"), F.lit("known").alias("person"))
    return R.with_known_conflicts(found, load(spark, sf_dir, "documents"), "doc_id", "text", SURFACES)


@query(
    f"""SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE i = CAST(floor({DRAW} * n) AS BIGINT)"""
)
def k15_drawn_member(spark, sf_dir):
    """The member of each segment that an injected draw picks, by its place in the order of ids."""
    customers = load(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    sizes = {r["c_mktsegment"]: r["n"] for r in customers.groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()}
    ranked = global_rank(customers, [F.col("c_mktsegment"), F.col("c_custkey")])
    first, at = {}, 0
    for segment in sorted(sizes):
        first[segment], at = at, at + sizes[segment]
    wanted = [first[s] + K.picked(n, DRAW) + 1 for s, n in sizes.items()]
    return ranked.filter(F.col("rank").isin(wanted)).select("c_mktsegment", "c_custkey")
