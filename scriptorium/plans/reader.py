"""S, G, H, L and O rows on scans, constraints and what a reader shows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import graph as G
from scriptorium.operators import joins as J
from scriptorium.operators import reader as D
from scriptorium.operators import segment as M
from scriptorium.plans.joins import _SPANS, _spans
from scriptorium.plans.segmentation import _LINES
from scriptorium.registry import query
from scriptorium.tables import load


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(regexp_replace(line, '¶$', '')) AS body_md5 FROM {_LINES} WHERE NOT starts_with(line, '#')")
def s3_physical_lines(spark, sf_dir):
    rows = M.physical_lines(load(spark, sf_dir, "documents"), "doc_id", "text").filter("body IS NOT NULL")
    return rows.select("doc_id", "line_no", F.md5("body").alias("body_md5"))


@query()
def s4_templates(spark, sf_dir):
    """Every outermost template of each page's whole html, which is a template's field itself.

    SQL can't match brackets; tests compare with a plain scan.
    """
    pages = load(spark, sf_dir, "pages")
    wrapped = pages.select("page_id", F.concat(F.lit("a {{note|"), "html", F.lit("}} b")).alias("t"))
    return M.template_rows(wrapped, "page_id", "t").select("page_id", "n", "name", "n_fields", F.md5("fields").alias("fields_md5"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang FROM documents")
def s6_front_matter(spark, sf_dir):
    head = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\nlang: '"), "lang", F.lit("'\n---\n"), "text")
    return M.front_matters(load(spark, sf_dir, "documents").select("doc_id", head.alias("t")), "doc_id", "t", ["id", "lang"])


@query("SELECT doc_id, 'main_text' AS section, md5(trim(source, ' ')) AS body_md5 FROM documents UNION ALL SELECT doc_id, 'notes', md5(lang) FROM documents")
def s7_sections(spark, sf_dir):
    text = F.concat(F.lit("top\n## main_text\n"), "source", F.lit("\n## notes\n"), "lang")
    parts = M.markdown_sections(load(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "doc_id", "t")
    return parts.select("doc_id", "section", F.md5("body").alias("body_md5"))


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, split_part(line, ' ', 1) AS heading FROM {_LINES} WHERE split_part(line, ' ', 1) IN ('The', 'Is', 'Of', 'Le', 'Die')")
def g2_heading_detection(spark, sf_dir):
    catalog = spark.createDataFrame([(w,) for w in ("The", "Is", "Of", "Le", "Die")], "heading string")
    rows = M.lines(load(spark, sf_dir, "documents"), "doc_id", "text").withColumn("heading", F.split_part("line", F.lit(" "), F.lit(1)))
    return rows.join(F.broadcast(catalog), "heading").select("doc_id", "line_no", "heading")


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '\\([^()]*\\)')) AS n_annotations FROM documents WHERE NOT regexp_matches(text, '\\([^)]*\\(') AND length(replace(text, '(', '')) = length(replace(text, ')', '')) AND NOT regexp_matches(text, '^[^(]*\\)|\\)[^(]*\\)')"""
)
def g10_parenthetical_layers(spark, sf_dir):
    units = M.layered(load(spark, sf_dir, "documents"), "doc_id", "text")
    out = units.groupBy("doc_id").agg(F.count_if(F.col("layer") == "annotation").alias("n_annotations"), F.max("issues").alias("issues"))
    return out.filter("issues = ''").select("doc_id", "n_annotations")


@query(
    """SELECT source, count(*) AS n_entries, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS reconstruction FROM documents GROUP BY 1"""
)
def g16_corpus_index(spark, sf_dir):
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda u: u["h"]), "")
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_entries"), F.md5(parts).alias("reconstruction"))


@query(f"SELECT s.k, s.s, s.e FROM ({_SPANS}) s JOIN orders ON o_orderkey = s.k WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND s.s IS NOT NULL AND s.e IS NOT NULL")
def h5_office_constraints(spark, sf_dir):
    """Only reviewed tenures of hard roles with both bounds constrain."""
    hard = load(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("k"))
    return _spans(spark, sf_dir).filter("s IS NOT NULL AND e IS NOT NULL").join(hard, "k", "left_semi").select("k", "s", "e")


@query(
    f"""SELECT id, n, CASE WHEN NOT c THEN lo END AS s, CASE WHEN NOT c THEN hi END AS e, c AS conflict FROM
    (SELECT id, count(*) AS n, max(s) AS lo, min(e) AS hi, coalesce(max(s) > min(e), false) AS c FROM ({_SPANS}) WHERE s IS NOT NULL AND e IS NOT NULL GROUP BY id)"""
)
def h9_constraint_projection(spark, sf_dir):
    own = _spans(spark, sf_dir).filter("s IS NOT NULL AND e IS NOT NULL")
    return own.groupBy("id").agg(F.count("*").alias("n")).join(J.intersection(own, ["id"], "s", "e"), "id")


@query(
    """SELECT l_linenumber % 3 AS kind, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'F' GROUP BY 1"""
)
def h11_layer_views(spark, sf_dir):
    """Edges with a layer besides the returned one."""
    layers = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned").otherwise("story"), F.when(F.col("l_linestatus") == "F", "reviewed")))
    view = G.layer_view(load(spark, sf_dir, "lineitem").withColumn("layers", layers), drop=["returned"])
    return view.groupBy((F.col("l_linenumber") % 3).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT n_nationkey, round(cos(2 * pi() * p / n - pi() / 2) * 100.0, 3) + 0 AS x, round(sin(2 * pi() * p / n - pi() / 2) * 100.0, 3) + 0 AS y FROM
    (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)"""
)
def h19_ego_layout(spark, sf_dir):
    w = Window.partitionBy("n_regionkey")
    rows = load(spark, sf_dir, "nation").withColumn("p", F.row_number().over(w.orderBy("n_nationkey")) - 1).withColumn("n", F.count("*").over(w))
    return D.ego_layout(rows, "p", "n").select("n_nationkey", (F.round("x", 3) + 0).alias("x"), (F.round("y", 3) + 0).alias("y"))


@query(
    """SELECT doc_id, len(string_split(text, 'icense')) * 2 - 1 - CASE WHEN starts_with(text, 'icense') THEN 1 ELSE 0 END - CASE WHEN ends_with(text, 'icense') THEN 1 ELSE 0 END AS n_segments, md5(text) AS text_md5
    FROM documents WHERE contains(text, 'icense') AND NOT contains(text, 'icenseicense')"""
)
def l11_l12_segments(spark, sf_dir):
    """Texts cut at their mentions; the pieces are the text again."""
    from scriptorium.operators.entities import dictionary_matches

    docs = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("icense")) & ~F.contains("text", F.lit("icenseicense")))
    marks = dictionary_matches(docs, "doc_id", "text", ["icense"]).withColumn("target", F.lit("mention"))
    pieces = D.segments(docs, marks, "doc_id", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda s: s["piece"]), "")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.md5(whole).alias("text_md5"))


@query(
    """SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, count(quality) AS n_labels, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
)
def o1_o3_projection_manifest(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.count("quality").alias("n_labels"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query(
    """WITH a AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS b FROM documents GROUP BY 1),
    z AS (SELECT source, CAST(sum(strlen(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END)) AS BIGINT) AS b FROM documents WHERE source <> 'src3' GROUP BY 1)
    SELECT coalesce(a.source, z.source) AS asset, coalesce(a.b, 0) AS "before", coalesce(z.b, 0) AS "after", coalesce(z.b, 0) - coalesce(a.b, 0) AS delta,
    CASE WHEN coalesce(a.b, 0) > 0 THEN round((coalesce(z.b, 0) - a.b) * 100.0 / a.b, 4)::DOUBLE END AS percent FROM a FULL OUTER JOIN z ON a.source = z.source"""
)
def o7_size_deltas(spark, sf_dir):
    """All documents against a second version: every fifth changed, one source gone."""
    def sizes(rows):
        return rows.groupBy(F.col("source").alias("asset")).agg(F.sum(F.octet_length("text")).alias("n_bytes"))

    docs = load(spark, sf_dir, "documents")
    second = docs.filter("source <> 'src3'").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return D.size_deltas(sizes(docs), sizes(second)).withColumn("percent", F.col("percent").cast("double"))


@query("SELECT doc_id, regexp_full_match(lang, '[㐀-鿿]+') AS han FROM documents")
def f11_han(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.is_han(F.col("lang")).alias("han"))
