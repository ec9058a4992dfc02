"""F, U and P rows: scalar functions, sets and predicates over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import alignment as L
from scriptorium.operators import selection as K
from scriptorium.registry import query
from scriptorium.tables import load


@query("SELECT doc_id, lower(nfc_normalize(source || ' ' || lang)) AS folded FROM documents")
def f1_fold(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.fold(F.concat_ws(" ", "source", "lang")).alias("folded"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS compact_md5 FROM documents")
def f2_compact(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.compact(F.col("text"))).alias("compact_md5"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '[\\s/]+', '', 'g')) AS source_md5 FROM pages")
def f3_source_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(X.source_text(F.col("html"))).alias("source_md5"))


@query("SELECT page_id, length(html) AS n_chars, length(html) - length(replace(html, chr(10), '')) AS n_lines FROM pages")
def f4_masked_comments(spark, sf_dir):
    masked = X.masked_comments(F.col("html"))
    return load(spark, sf_dir, "pages").select(
        "page_id", F.char_length(masked).cast("bigint").alias("n_chars"),
        (F.char_length(masked) - F.char_length(F.replace(masked, F.lit("\n"), F.lit("")))).cast("bigint").alias("n_lines"),
    )


@query("SELECT p_partkey, p_size AS number FROM part")
def f5_f6_numerals(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.han_number(X.ordinal_text(F.col("p_size"))).alias("number"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(least(1.0, ln(1 + c_acctbal) / ln(1 + (SELECT max(c_acctbal) FROM customer))), 6) ELSE 0.0 END AS norm
    FROM customer"""
)
def f7_log_norm(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    most = rows.agg(F.max("c_acctbal").alias("most"))  # one row
    return rows.join(F.broadcast(most)).select("c_custkey", X.log_norm(F.col("c_acctbal"), F.col("most"), 6).alias("norm"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type || chr(31) || props) AS hash FROM events")
def f8_stable_hash(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", X.stable_hash(F.col("user_id"), F.col("event_type"), F.col("props")).alias("hash"))


@query()
def f9_plain_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.plain_text(F.col("html"), 500).alias("text"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t]*[\\r\\n]+[ \\t]*', ' ', 'g'), ' ')) AS line_md5 FROM documents")
def f10_one_line(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.one_line(F.col("text"))).alias("line_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 260 THEN substring(text, 1, 259) || '…' ELSE text END AS text FROM documents")
def f12_cut(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.cut(F.col("text"), 260).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def f13_fenced_json(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object(X.unfenced(fenced), "$.k").cast("int").alias("k"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS leaves FROM orders")
def f14_text_leaves(spark, sf_dir):
    nested = F.to_json(F.struct(F.col("o_orderstatus").alias("a"), F.struct(F.col("o_orderkey").alias("n"), F.array("o_orderpriority").alias("l")).alias("b")))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.text_leaves(nested), "|").alias("leaves"))


@query(
    """SELECT doc_id, CAST(strlen(substring(text, 1, 40)) AS BIGINT) AS byte_start, CAST(strlen(substring(text, 1, 140)) AS BIGINT) AS byte_end
    FROM documents WHERE length(text) >= 140"""
)
def f15_byte_span(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.char_length("text") >= 140)
    span = X.byte_span(F.col("text"), F.lit(40), F.lit(140))
    return docs.select("doc_id", span["start"].cast("bigint").alias("byte_start"), span["end"].cast("bigint").alias("byte_end"))


_SETS = """SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS a, list_sort(list_distinct(list(o_orderpriority[1:1]))) AS b,
  list_sort(list_distinct(list(CASE WHEN o_totalprice > 200000 THEN o_orderstatus END))) AS c FROM orders GROUP BY o_custkey"""


@query(
    f"""SELECT o_custkey, array_to_string(a, ',') AS statuses, CASE WHEN len(list_distinct(list_concat(a, list_filter(c, lambda x: x IS NOT NULL)))) = 0 THEN 1.0
    ELSE len(list_intersect(a, c)) / len(list_distinct(list_concat(a, list_filter(c, lambda x: x IS NOT NULL)))) END AS jaccard FROM ({_SETS})"""
)
def u4_u5_sets(spark, sf_dir):
    own = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus"))).alias("c")
    )
    return own.select("o_custkey", F.array_join(X.sorted_unique(F.col("a")), ",").alias("statuses"), X.jaccard(F.col("a"), F.col("c")).alias("jaccard"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def u6_canonical_pairs(spark, sf_dir):
    a, b = X.pair(F.col("l_partkey"), F.col("l_suppkey"))
    return load(spark, sf_dir, "lineitem").groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@query(
    """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)) AS n_union,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_difference,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS n_intersection"""
)
def u1_u2_u3_scopes(spark, sf_dir):
    a = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    counts = [a.union(b).distinct(), b.join(a, "k", "left_anti").distinct(), b.join(a, "k", "left_semi").distinct()]
    one = [df.agg(F.count("*").alias(n)) for df, n in zip(counts, ("n_union", "n_difference", "n_intersection"), strict=True)]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


@query(
    "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND source NOT LIKE '%9' ORDER BY n_chars NULLS LAST, doc_id LIMIT 50"
)
def p1_p2_publication_filter(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & ~F.endswith("source", F.lit("9")))
    return docs.orderBy(F.asc_nulls_last("n_chars"), "doc_id").limit(50).select("doc_id", "lang", "n_chars")


_TESTS = {"balance": "c_acctbal > 0", "orders": "n_orders >= 5", "segment": "c_mktsegment <> 'MACHINERY'"}


@query(
    "SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(c_acctbal > 0, false) THEN 'balance' END, CASE WHEN NOT coalesce(n_orders >= 5, false) THEN 'orders' END, "
    "CASE WHEN NOT coalesce(c_mktsegment <> 'MACHINERY', false) THEN 'segment' END) AS reasons, "
    "coalesce(c_acctbal > 0 AND n_orders >= 5 AND c_mktsegment <> 'MACHINERY', false) AS eligible "
    "FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def p4_eligibility(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    rows = load(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    failed = K.reasons({k: F.expr(v) for k, v in _TESTS.items()})
    return rows.select("c_custkey", F.array_join(failed, ",").alias("reasons"), (F.size(failed) == 0).alias("eligible"))


TERMS = ("apache", "license", "mit", "public", "token")


@query(
    f"SELECT doc_id, terms FROM (SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TERMS)}) AS terms FROM documents) WHERE terms <> ''"
)
def p9_text_signals(spark, sf_dir):
    found = X.present_terms(F.lower("text"), TERMS)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("terms")).filter("terms <> ''")


@query(
    """SELECT 'order_without_customer' AS issue, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'repeated_event', count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def p12_referential_audit(spark, sf_dir):
    def missing(child, key, parent, parent_key, issue):
        keys = load(spark, sf_dir, parent).select(F.col(parent_key).alias(key))
        return load(spark, sf_dir, child).join(keys, key, "left_anti").agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))

    again = load(spark, sf_dir, "events").groupBy("event_id").count().filter("count > 1")
    out = missing("orders", "o_custkey", "customer", "c_custkey", "order_without_customer")
    out = out.unionByName(missing("lineitem", "l_orderkey", "orders", "o_orderkey", "line_without_order"))
    out = out.unionByName(again.agg(F.lit("repeated_event").alias("issue"), F.count("*").alias("n")))
    return out.unionByName(missing("labels", "doc_id", "documents", "doc_id", "label_without_document"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'disputed' WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'not_materialized' ELSE 'unknown' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def p6_status_mapping(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "disputed").when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "not_materialized").otherwise("unknown")
    return rows.select("doc_id", status.alias("status"))


@query()
def l16_glyph_issues(spark, sf_dir):
    found = L.glyph_issues(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("issues")).filter("issues <> ''")


@query(
    "SELECT event_id, list_aggregate([x IN ('view', 'click') FOR x IN [event_type]], 'bool_and') AND (value <= 50 OR event_type = 'click') AS ok FROM events"
)
def p15_claim_evidence(spark, sf_dir):
    from scriptorium.operators.scoring import claims_ok

    rows = load(spark, sf_dir, "events")
    ok = claims_ok(F.array("event_type"), F.array(F.lit("view"), F.lit("click")), F.lit(False)) & ((F.col("value") <= 50) | (F.col("event_type") == "click"))
    return rows.select("event_id", ok.alias("ok"))
