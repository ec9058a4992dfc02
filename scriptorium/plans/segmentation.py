"""S and G rows: lines, sections, layered text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import segment as G
from scriptorium.registry import query
from scriptorium.tables import load

_LINES = """(SELECT doc_id, line_no, line, e - length(line) AS s, e FROM (SELECT doc_id, line_no, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS e
  FROM (SELECT doc_id, n - 1 AS line_no, p[n] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))))"""


def _lines(spark, sf_dir):
    return G.lines(load(spark, sf_dir, "documents"), "doc_id", "text")


@query(f'SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, s AS start, e AS "end", md5(line) AS line_md5 FROM {_LINES}')
def g4_line_table(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", "start", "end", F.md5("line").alias("line_md5"))


@query(
    f"""WITH l AS {_LINES}, o AS (SELECT doc_id, CAST(unnest([0, n_chars // 3, n_chars // 2, n_chars - 1]) AS BIGINT) AS pos FROM documents)
    SELECT o.doc_id, pos AS "at", CAST(max(line_no) AS INTEGER) AS line_no FROM (SELECT DISTINCT * FROM o) o JOIN l ON l.doc_id = o.doc_id AND l.s <= pos GROUP BY ALL"""
)
def g5_line_of_offset(spark, sf_dir):
    n = F.col("n_chars")
    points = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.floor(n / 3), F.floor(n / 2), n - 1)).alias("at")).distinct()
    return G.line_of(points, _lines(spark, sf_dir), "doc_id", "at")


RULES = [("license", ["icense"]), ("contact", ["@", "+1 ("]), ("secret", ["token"])]


@query(
    """SELECT doc_id, CASE WHEN contains(text, 'icense') THEN 'license' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' WHEN contains(text, 'token') THEN 'secret' ELSE 'unknown' END AS section FROM documents"""
)
def g1_section_class(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", G.classified(F.col("text"), RULES).alias("section"))


@query(
    f"""WITH l AS {_LINES}, h AS (SELECT doc_id, line_no, split_part(line, ' ', 1) AS heading, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM l WHERE length(line) BETWEEN 3 AND 40)
    SELECT h.doc_id, heading, CAST(h.line_no AS INTEGER) AS from_line, CAST(coalesce(nxt, n) AS INTEGER) AS to_line FROM h JOIN (SELECT doc_id, max(line_no) + 1 AS n FROM l GROUP BY 1) USING (doc_id)"""
)
def g3_section_spans(spark, sf_dir):
    head = F.when(F.char_length("line").between(3, 40), F.split_part("line", F.lit(" "), F.lit(1)))
    return G.sections(_lines(spark, sf_dir), "doc_id", head)


@query(f'SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM {_LINES} WHERE e > 500 AND s < 800')
def g11_unit_slice(spark, sf_dir):
    return G.unit_slice(_lines(spark, sf_dir), 500, 800).select("doc_id", "line_no")


@query()
def g7_g8_layers(spark, sf_dir):
    """Bracketed blocks of pages, counted; units end to end are the text."""
    units = G.layered(load(spark, sf_dir, "pages"), "page_id", "html")
    return units.groupBy("page_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.col("layer") == "annotation").alias("n_annotations"), F.sum(F.char_length("text")).alias("n_chars"), F.max("issues").alias("issues")
    )


@query(
    """WITH a AS (SELECT doc_id, anchor_no, substring(text, 1 + anchor_no * 60, 18) AS anchor, text FROM documents, (SELECT unnest([0, 1, 2]) AS anchor_no) WHERE n_chars >= 240),
    f AS (SELECT *, position(anchor IN text) - 1 AS first, position(anchor IN substring(text, position(anchor IN text) + 1)) AS again FROM a),
    m AS (SELECT *, max(first) OVER (PARTITION BY doc_id ORDER BY anchor_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f)
    SELECT doc_id, CAST(anchor_no AS INTEGER) AS anchor_no, CAST(first AS INTEGER) AS "offset", CASE WHEN again > 0 THEN 'repeated' WHEN first <= last THEN 'out_of_order' ELSE 'ok' END AS state FROM m"""
)
def g6_unique_anchors(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter("n_chars >= 240")
    anchors = docs.select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("anchor_no"))
    anchors = anchors.select("doc_id", "anchor_no", F.substring("text", F.col("anchor_no") * 60 + 1, F.lit(18)).alias("anchor"))
    return G.unique_anchors(anchors, docs, "doc_id", "anchor_no", "anchor", "text").select("doc_id", "anchor_no", "offset", "state")


@query(
    f"""WITH w AS (SELECT doc_id, line_no, trim(line, ' ') AS t FROM {_LINES} WHERE trim(line, ' ') <> ''), n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM w)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, t AS heading, CASE WHEN starts_with(nxt, t) THEN 'high' ELSE 'medium' END AS confidence FROM n
    WHERE length(t) <= 16 AND NOT regexp_matches(t, '\\p{{P}}') AND (starts_with(nxt, t) OR starts_with(nxt, right(t, 1)))"""
)
def g14_headings(spark, sf_dir):
    return G.headings(_lines(spark, sf_dir), "doc_id")


@query(
    f"""WITH w AS (SELECT doc_id, line_no, split_part(line, ' ', 1) AS k FROM {_LINES}) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) AS occurrence FROM w"""
)
def g13_volume_occurrences(spark, sf_dir):
    word = F.split_part("line", F.lit(" "), F.lit(1))
    by = Window.partitionBy("doc_id", word).orderBy("line_no")
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.row_number().over(by).cast("bigint").alias("occurrence"))


@query(
    f"""SELECT d.doc_id, string_agg(line, chr(10) ORDER BY line_no) = any_value(d.text) AS whole, count(*) AS n_units FROM {_LINES} l JOIN documents d USING (doc_id) GROUP BY 1"""
)
def g15_reconstruction(spark, sf_dir):
    """Units put together again are the text."""
    parts = _lines(spark, sf_dir).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda u: u["line"]), "\n").alias("again"), F.count("*").alias("n_units")
    )
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(parts, "doc_id").select("doc_id", (F.col("again") == F.col("text")).alias("whole"), "n_units")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'replaced' WHEN doc_id % 10 = 1 THEN 'inserted' ELSE 'kept' END AS change, CASE WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents"""
)
def g17_repair_overlay(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    patches = docs.filter("doc_id % 10 < 2").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "replaced").otherwise("inserted").alias("change"), F.upper("lang").alias("new"))
    out = docs.join(patches, "doc_id", "left")
    return out.select("doc_id", F.coalesce("change", F.lit("kept")).alias("change"), F.when(F.col("change") == "replaced", F.col("new")).otherwise(F.col("lang")).alias("lang"))


@query(
    "SELECT doc_id, substring(text, position('the ' IN text) + 4, 30) AS tail FROM documents WHERE contains(text, 'the ')"
)
def s12_exact_source(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the ")))
    return docs.select("doc_id", F.substring(G.exact_source(F.col("text"), "the "), 1, 30).alias("tail"))


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"""
)
def s8_page_scan(spark, sf_dir):
    return load(spark, sf_dir, "pages").select(
        "page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("bigint").alias("n_paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s10_json_scan(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """WITH a AS (SELECT source, sha256(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents WHERE source <> 'src3' GROUP BY 1),
    b AS (SELECT source, sha256(string_agg(md5(CASE WHEN source IN ('src5', 'src8') AND doc_id % 7 = 0 THEN text || ' changed' ELSE text END), '' ORDER BY doc_id)) AS h FROM documents WHERE source <> 'src4' GROUP BY 1)
    SELECT coalesce(a.source, b.source) AS path, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unlisted' ELSE 'changed' END AS state FROM a FULL OUTER JOIN b ON a.source = b.source
    WHERE a.h IS DISTINCT FROM b.h"""
)
def s5_s15_tree_comparison(spark, sf_dir):
    """Trees of all documents; a source is missing from either, rows of two others changed."""
    from scriptorium.sources import locked

    def tree(rows):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda u: u["h"]), "")
        return rows.groupBy(F.col("source").alias("path")).agg(F.sha2(parts, 256).alias("sha256"))

    docs = load(spark, sf_dir, "documents")
    changed = F.col("source").isin("src5", "src8") & (F.col("doc_id") % 7 == 0)
    second = docs.filter("source <> 'src4'").withColumn("text", F.when(changed, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return locked(tree(docs.filter("source <> 'src3'")), tree(second))


@query("SELECT page_id, regexp_extract(html, '<!--\\s*(.*?)\\s*-->', 1) AS note FROM pages")
def g9_editorial_spans(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<!--\s*(.*?)\s*-->", 1).alias("note"))


@query(
    f"""WITH l AS {_LINES} SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_no FROM l WHERE regexp_matches(line, '[0-9]{{4}}') GROUP BY 1"""
)
def g12_first_chronology_line(spark, sf_dir):
    return _lines(spark, sf_dir).filter(F.col("line").rlike("[0-9]{4}")).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


@query("SELECT doc_id, heading FROM (SELECT doc_id, split_part(text, ' ', 1) AS heading, row_number() OVER (PARTITION BY split_part(text, ' ', 1) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def g18_first_headings(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("heading"))
    return rows.groupBy("heading").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "heading")
