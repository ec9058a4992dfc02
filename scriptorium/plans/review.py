"""P, E, K, J, W and V rows on review and readiness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import aggregates as A
from scriptorium.operators import alignment as L
from scriptorium.operators import entities as E
from scriptorium.operators import review as R
from scriptorium.operators import segment as G
from scriptorium.operators import windows as W
from scriptorium.registry import query
from scriptorium.tables import load


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def p3_reviewed_direct(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").withColumn("review_status", F.when(F.col("quality") == 1, "reviewed").otherwise("candidate"))
    return R.reviewed(rows.withColumn("basis", F.when(F.col("toxic") == 0, "direct").otherwise("derived")), direct_only=True).select("doc_id")


@query(
    """SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus <> '' UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority <> ''"""
)
def p5_whitelist(spark, sf_dir):
    return R.whitelisted(load(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "absent"])


@query(
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'production_ready' ELSE 'preview_ready' END AS state FROM documents LEFT JOIN labels USING (doc_id)"""
)
def p7_publication_gate(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    marks = F.when(F.col("quality") == 1, "reviewed").otherwise("proposed")
    return rows.select("doc_id", R.publication_state(marks, F.concat("text", F.lit(" .")), F.col("text")).alias("state"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN NOT n_chars > 500 THEN 'long' END, CASE WHEN NOT coalesce(quality = 1, false) THEN 'reviewed' END, CASE WHEN NOT lang = 'en' THEN 'language' END) AS missing,
    coalesce(n_chars > 500 AND quality = 1 AND lang = 'en', false) AS ready FROM documents LEFT JOIN labels USING (doc_id)"""
)
def p8_readiness(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    out = R.readiness(rows, {"long": F.col("n_chars") > 500, "reviewed": F.col("quality") == 1, "language": F.col("lang") == "en"})
    return out.select("doc_id", F.array_join("missing", ",").alias("missing"), "ready")


@query(
    """SELECT o_orderkey, CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN 'both' WHEN p IS NULL AND c IS NULL THEN 'neither' WHEN coalesce(c_name, s_name) IS NULL THEN 'unknown'
      WHEN coalesce(c_name, s_name) <> 'Customer#000000007' AND o_orderkey % 11 = 0 THEN 'name_differs' ELSE 'ok' END AS state
    FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS p, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 7 > 0 THEN o_orderkey % 150 END AS c FROM orders)
    LEFT JOIN customer ON c_custkey = p LEFT JOIN supplier ON s_suppkey = c"""
)
def p13_typed_targets(spark, sf_dir):
    k = F.col("o_orderkey")
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    candidates = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_custkey")).alias("person_id"), F.when((k % 3 < 2) & (k % 7 > 0), k % 150).alias("candidate_id"))
    named = rows.join(people.toDF("person_id", "pn"), "person_id", "left").join(candidates.toDF("candidate_id", "cn"), "candidate_id", "left")
    named = named.withColumn("name", F.when(k % 11 == 0, "Customer#000000007").otherwise(F.coalesce("pn", "cn"))).drop("pn", "cn")
    return R.typed_targets(named, people, candidates).select("o_orderkey", "state")


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '5-LOW' THEN 'rejected' ELSE 'unresolved' END AS decision,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'direct' WHEN '5-LOW' THEN 'weak' ELSE 'no rule' END AS reason FROM orders"""
)
def p16_fact_decisions(spark, sf_dir):
    rules = spark.createDataFrame([("1-URGENT", "accepted", "direct"), ("5-LOW", "rejected", "weak")], "o_orderpriority string, decision string, reason string")
    return R.decided(load(spark, sf_dir, "orders"), F.broadcast(rules), ["o_orderpriority"]).select("o_orderkey", "decision", "reason")


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') OR contains(url, '/es/') THEN 'romance' ELSE 'unknown' END AS class FROM pages")
def p18_path_class(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", G.classified(F.col("url"), [("english", ["/en/"]), ("romance", ["/fr/", "/es/"])]).alias("class"))


@query(
    """SELECT 'dear' AS "check", count(*) AS n_violations, count(*) = 0 AS passed FROM orders WHERE o_totalprice > 1e9 UNION ALL
    SELECT 'negative_quantity', count(*), count(*) = 0 FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'pending', count(*), count(*) = 0 FROM orders WHERE o_orderstatus = 'P'"""
)
def a21_named_checks(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return R.checks({"dear": orders.filter("o_totalprice > 1e9"), "negative_quantity": load(spark, sf_dir, "lineitem").filter("l_quantity < 0"), "pending": orders.filter("o_orderstatus = 'P'")})


@query("SELECT * FROM (VALUES ('graph', 0.4::DOUBLE), ('coverage', 0.3::DOUBLE), ('random', 0.15::DOUBLE), ('counter', 0.15::DOUBLE)) AS t(channel, share)")
def a17_rebalance(spark, sf_dir):
    """Shares of the next batch; the yields of the two channels are alike here."""
    items = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "F", "graph").otherwise("coverage").alias("channel"), F.lit(1).alias("unit"))
    gains = {r["channel"]: r["per_item"] for r in A.yields(items, items, "channel", "unit").collect()}  # two rows
    return spark.createDataFrame(list(A.rebalanced(gains).items()), "channel string, share double")


@query(
    """WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents QUALIFY n <= 40), b AS (SELECT item_id, text AS other, row_number() OVER (ORDER BY item_id) AS n FROM benchmark QUALIFY n <= 40)
    SELECT doc_id, item_id, CASE WHEN text = other THEN 'exact' WHEN length(text) = length(other) THEN 'variant' ELSE 'disputed' END AS class FROM d JOIN b USING (n)"""
)
def j13_ordinal_alignment(spark, sf_dir):
    """Both sides numbered and paired by their ordinal, as far as the shorter goes.

    The SQL numbers forty rows a side; it agrees where a side has no more, and
    otherwise on its forty. As there, null ids come last and a pair without both
    texts is disputed.
    """
    order = lambda *c: [F.col(x).asc_nulls_last() for x in c]
    d = W.global_rank(load(spark, sf_dir, "documents").select("doc_id", "text"), order("doc_id", "text"), "n")
    b = W.global_rank(load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("other")), order("item_id", "other"), "n")
    kind = F.coalesce(L.alignment_class(F.col("text"), F.col("other")), F.lit("disputed"))
    return d.join(b, "n").select("doc_id", "item_id", kind.alias("class"))


NAMES = ["Apache", "MIT", "GNU"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN true ELSE false END AS confirmed FROM documents WHERE contains(lower(text), '{n.lower()} ')" for n in NAMES))
def j20_biography_match(spark, sf_dir):
    folded = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    known = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("ok", F.lit(True))
    found = F.filter(F.array(*map(F.lit, NAMES)), lambda n: F.contains(F.col("t"), F.concat(F.lower(n), F.lit(" "))))
    hits = folded.select("doc_id", F.explode(found).alias("name"))
    return hits.join(known, "doc_id", "left").select("name", "doc_id", F.coalesce("ok", F.lit(False)).alias("confirmed"))


@query(
    """WITH a AS (SELECT p_partkey, p_name || p_type AS x, substring(p_name || p_type, 2) AS shifted, p_name || 'Z' AS o FROM part),
    f AS (SELECT p_partkey, coalesce(list_position(list_transform(range(1, least(length(x), length(o)) + 1), lambda i: substring(x, i, 1) = substring(o, i, 1)), false), least(length(x), length(o)) + 1) - 1 AS here,
      coalesce(list_position(list_transform(range(1, least(length(shifted), length(o)) + 1), lambda i: substring(shifted, i, 1) = substring(o, i, 1)), false), least(length(shifted), length(o)) + 1) - 1 AS there FROM a)
    SELECT p_partkey, CAST(here AS INTEGER) AS here, CAST(there AS INTEGER) AS there, there >= 8 AND there > here + 4 AS shifted FROM f"""
)
def w6_one_character_shift(spark, sf_dir):
    x, o = F.concat("p_name", "p_type"), F.concat("p_name", F.lit("Z"))
    rows = load(spark, sf_dir, "part").select("p_partkey", L.common_prefix(x, o).alias("here"), L.common_prefix(F.substring(x, F.lit(2), F.char_length(x)), o).alias("there"))
    return rows.withColumn("shifted", (F.col("there") >= 8) & (F.col("there") > F.col("here") + 4))


@query(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey = 17 THEN 0 WHEN p_brand = 'Brand#7' THEN 1 ELSE 2 END AS tier, p_size, p_retailprice FROM part)
    SELECT p_partkey, CAST(tier AS INTEGER) AS tier FROM t ORDER BY tier, p_size DESC, p_retailprice DESC, p_partkey LIMIT 16"""
)
def k12_gold_selection(spark, sf_dir):
    tier = F.when(F.col("p_partkey") == 17, 0).when(F.col("p_brand") == "Brand#7", 1).otherwise(2)
    rows = load(spark, sf_dir, "part").withColumn("tier", tier)
    return rows.orderBy("tier", F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(16).select("p_partkey", "tier")


@query("SELECT p_brand, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS terms FROM (SELECT p_brand, p_name FROM part) GROUP BY 1")
def t8_entity_expansion(spark, sf_dir):
    """Names of each brand; longest first within the operator, here by name."""
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("terms"))


@query(
    """SELECT doc_id, md5(regexp_replace(lower(text || ' ' || lang), '\\s+', '', 'g')) AS search_md5, CASE WHEN quality = 1 THEN 'published' ELSE 'corpus' END AS scope FROM documents LEFT JOIN labels USING (doc_id)"""
)
def t10_search_corpus(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    folded = X.compact(F.lower(F.concat_ws(" ", "text", "lang")))
    return rows.select("doc_id", F.md5(folded).alias("search_md5"), F.when(F.col("quality") == 1, "published").otherwise("corpus").alias("scope"))


@query(
    """SELECT o_custkey, count(*) AS n_stories, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS stories, count(DISTINCT o_orderstatus) AS n_states FROM orders GROUP BY 1"""
)
def t11_person_surface(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string"))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_stories"), F.array_join(ids, ",").alias("stories"), F.countDistinct("o_orderstatus").alias("n_states"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{1,7} License')) AS n, array_to_string(regexp_extract_all(text, '[A-Za-z]{1,7} License'), '|') AS surfaces FROM documents WHERE contains(text, ' License')")
def e6_title_surfaces(spark, sf_dir):
    spans = G.pattern_spans(load(spark, sf_dir, "documents").filter(F.contains("text", F.lit(" License"))), "doc_id", "text", "[A-Za-z]{1,7} License")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "surface"))), lambda s: s["surface"])
    return spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(ordered, "|").alias("surfaces"))


@query("SELECT p_partkey, p_brand AS unit FROM part")
def e7_repeated_units(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.unrepeated(F.repeat("p_brand", F.lit(2))).alias("unit"))


@query("SELECT p_partkey, '甲乙' AS alias FROM part")
def e8_identity_cue(spark, sf_dir):
    text = F.concat(F.lit("前文 "), "p_name", F.lit("，字甲乙也"))
    return load(spark, sf_dir, "part").select("p_partkey", E.cue_alias(text, F.regexp_replace("p_name", " ", ""), "，字").alias("alias"))


@query(
    """WITH h AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS surface FROM documents)
    SELECT surface, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CASE WHEN count(DISTINCT source) > 5 THEN 'broad' WHEN count(*) = 1 THEN 'single' ELSE 'fine' END AS risk FROM h GROUP BY 1"""
)
def e9_candidate_discovery(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), 0)).alias("surface"))
    risk = F.when(F.countDistinct("source") > 5, "broad").when(F.count("*") == 1, "single").otherwise("fine")
    return rows.groupBy("surface").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), risk.alias("risk"))


@query(
    """WITH p AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS m, count(DISTINCT l_partkey) AS u, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(0.24 * round(ln(1 + m) / ln(1 + (SELECT max(m) FROM p)), 8) + 0.14 * round(ln(1 + u) / ln(1 + (SELECT max(u) FROM p)), 8) - 0.20 * CASE WHEN c > 0 THEN round(ln(1 + c) / ln(1 + (SELECT max(c) FROM p)), 8) ELSE 0 END, 6) AS score FROM p"""
)
def e11_experience_ranking(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_orderkey").alias("m"), F.countDistinct("l_partkey").alias("u"), F.count_if(F.col("l_returnflag") == "R").alias("c")
    )
    most = p.agg(*[F.max(x).alias(f"max_{x}") for x in "muc"])  # one row
    parts = {n: X.log_norm(F.col(x), F.col(f"max_{x}")) for n, x in (("main", "m"), ("unlock", "u"), ("citation", "c"))}
    return p.join(F.broadcast(most)).select("l_suppkey", E.experience_score(parts).alias("score"))


@query(
    """WITH h AS (SELECT user_id, event_type AS surface, CASE WHEN value > 20 THEN 'resolved' WHEN value > 5 THEN 'alias' ELSE 'owner' END AS basis FROM events)
    SELECT user_id, surface, CASE max(CASE basis WHEN 'owner' THEN 3 WHEN 'alias' THEN 2 ELSE 1 END) WHEN 3 THEN 'owner' WHEN 2 THEN 'alias' ELSE 'resolved' END AS basis FROM h GROUP BY ALL"""
)
def e12_identity_hits(spark, sf_dir):
    basis = F.when(F.col("value") > 20, "resolved").when(F.col("value") > 5, "alias").otherwise("owner")
    hits = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("surface"), basis.alias("basis"))
    order = F.when(F.col("basis") == "owner", 3).when(F.col("basis") == "alias", 2).otherwise(1)
    return R.preferred(hits, ["user_id", "surface"], order).select("user_id", "surface", "basis")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'idiot|scum') AND NOT regexp_matches(text, 'icense')")
def e14_weak_signals(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(F.col("text").rlike("idiot|scum") & ~F.col("text").rlike("icense")).select("doc_id")


@query(
    """SELECT l_suppkey, l_returnflag, count(*) AS n_hits, CASE WHEN count(DISTINCT l_orderkey) > 1 THEN 'strong' ELSE 'needs_attention' END AS disposition FROM lineitem GROUP BY ALL"""
)
def e15_merged_candidates(spark, sf_dir):
    return R.merged(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_orderkey").select("l_suppkey", "l_returnflag", "n_hits", "disposition")


@query(
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, 'n' || l_suppkey AS note FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY 1"""
)
def e16_materialised_relations(spark, sf_dir):
    candidates = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))
    verdict = F.when(F.col("s_suppkey") % 4 == 0, "approved").otherwise("rejected")
    decisions = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), verdict.alias("decision"), F.concat(F.lit("n"), "s_suppkey").alias("note"))
    return R.materialised(candidates, decisions, ["l_suppkey"]).select("l_suppkey", "n_parts", "note")


@query(
    """SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['tenure', 'kinship'] WHEN o_orderstatus = 'O' THEN ['tenure'] ELSE [] END) AS fact FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def e18_fact_materialisation(spark, sf_dir):
    facts = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("tenure"), F.lit("kinship"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("tenure")))
    return load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.explode(facts).alias("fact"))


@query(
    """SELECT user_id, event_type, CASE WHEN bool_or(value > 100) THEN 'present' WHEN count(*) > 3 THEN 'mentioned' ELSE 'unresolved' END AS role FROM events GROUP BY ALL"""
)
def e19_participant_review(spark, sf_dir):
    role = F.when(F.bool_or(F.col("value") > 100), "present").when(F.count("*") > 3, "mentioned").otherwise("unresolved")
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(role.alias("role"))


@query()
def e21_gap_audit(spark, sf_dir):
    from scriptorium.plans.entities import SURFACES, _matches

    hits = _matches(spark, sf_dir)
    effective = hits.filter(F.col("surface").isin(SURFACES[:2])).withColumnRenamed("surface", "person_id")
    out = E.gap_audit(hits.filter("surface = 'License'"), effective, "doc_id")
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS g, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY 1)
    SELECT o_custkey, len(list_intersect(g, coalesce(m, []))) / len(g) AS agreement FROM a"""
)
def v2_operation_jaccard(spark, sf_dir):
    a = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("g"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("m"))
    return a.select("o_custkey", X.jaccard(F.col("g"), F.col("m")).alias("agreement"))


@query(
    """SELECT doc_id, v.view, CASE WHEN v.view = 'resolved' THEN quality WHEN toxic = 0 THEN quality END AS answer FROM labels, (VALUES ('resolved'), ('base')) AS v(view)"""
)
def v12_benchmark_views(spark, sf_dir):
    """Every item in both views; where the base can't know, its answer is null."""
    rows = load(spark, sf_dir, "labels").withColumn("view", F.explode(F.array(F.lit("resolved"), F.lit("base"))))
    return rows.select("doc_id", "view", F.when((F.col("view") == "resolved") | (F.col("toxic") == 0), F.col("quality")).alias("answer"))


@query(
    """SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1"""
)
def v13_situation_documents(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(roles, ">").alias("roles"), F.sum(F.char_length("text")).alias("n_chars"))
