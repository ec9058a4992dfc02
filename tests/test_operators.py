import random
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import registry
from scriptorium.operators import aggregates as A
from scriptorium.operators import alignment as L
from scriptorium.operators import entities as E
from scriptorium.operators import graph as G
from scriptorium.operators import joins as J
from scriptorium.operators import scoring as V
from scriptorium.operators import search as S
from scriptorium.operators import segment as M
from scriptorium.operators import selection as K
from scriptorium.operators import temporal as T
from scriptorium.operators import windows as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- search


def test_occurrences_do_not_overlap(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "b"), (3, None)], "k int, t string")
    assert [r[1] for r in S.occurrences(df, "k", "t", "aa", 1).orderBy("offset").collect()] == [0, 2]
    assert df.select(S.offsets(F.col("t"), "aa", overlapping=True)).first()[0] == [0, 1, 2]


def test_snippet_clamps_and_ignores_query_length(spark):
    df = spark.createDataFrame([("0123456789", 2), ("0123456789", 8)], "t string, p int")
    assert [r[0] for r in df.select(S.snippet(F.col("t"), F.col("p"), 3)).collect()] == ["01234", "56789"]


def test_layer_score(spark):
    df = spark.createDataFrame([("xabcx", True), ("xabx", False), ("zzz", True)], "t string, l boolean")
    got = [r[0] for r in df.select(S.layer_score(F.col("t"), "a b c", linked=F.col("l"))).collect()]
    assert got == [109 + 20, 4, 0]


@pytest.mark.parametrize("k", [0, 51, True, 2.0])
def test_top_k_bounds(k):
    with pytest.raises(ValueError):
        S.checked_k(k)


def test_opened_evidence(spark):
    ev = spark.createDataFrame([("a", "x" * 10), ("b", "y")], "ref string, text string")
    session = S.OpenedEvidence(ev, "ref", "text", budget=10)
    with pytest.raises(PermissionError):
        session.open("a")
    session.returned(["a", "b"])
    assert session.open("a") == "x" * 10
    with pytest.raises(ValueError):
        session.open("b")


# --- windows, joins


def test_average_rank_of_ties(spark):
    scores = spark.createDataFrame([(1, 0.5, i == 0) for i in range(4)], "q int, s double, p boolean")
    got = G.ranking_metrics(scores, "q", "s", "p").first()
    assert (got["mean_rank"], got["mrr"], got["hits_at_1"]) == (2.5, 0.4, 0.0)


def test_global_rank_equals_row_number(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 101)
    got = {r.id: r.rank for r in W.global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("v"), "id"))).collect()}
    assert got == want


def test_islands(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (1, 7, 6), (1, 8, 7)], "g int, a int, b int")
    assert [(r[1], r[2], r[3], r[4]) for r in W.islands(df, ["g"], "a", "b").orderBy("first_from").collect()] == [(2, 3, 3, 4), (7, 8, 6, 7)]


def test_unknown_never_overlaps(spark):
    df = spark.createDataFrame([(322, 324), (None, None), (None, 330), (400, None)], "s int, e int")
    assert [r[0] for r in df.select(J.may_overlap(F.col("s"), F.col("e"), 323, 329)).collect()] == [True, False, True, False]
    assert df.filter("s = 322").select(J.may_overlap(F.col("s"), F.col("e"), 325, 329)).first()[0] is False


def test_intersection_conflict_is_null(spark):
    df = spark.createDataFrame([(1, 307, 317), (1, 328, 329), (2, 1, 5), (2, 3, None)], "k int, s int, e int")
    assert [tuple(r) for r in J.intersection(df, ["k"], "s", "e").orderBy("k").collect()] == [(1, None, None, True), (2, 3, 5, False)]


def test_not_contained(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 0, 4), (1, 8, 12), (1, 0, 10)], "k int, s int, e int")
    assert rows(J.not_contained(df, ["k"], "s", "e")) == [(1, 0, 10), (1, 0, 10), (1, 8, 12)]


def test_as_of(spark):
    points = spark.createDataFrame([("k", 5), ("k", 1), ("k", 9)], "k string, at int")
    marks = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b")], "k string, m int, v string")
    assert {r["at"]: r["v"] for r in J.as_of(points, marks, "k", "at", "m", "v").collect()} == {1: None, 5: "b", 9: "b"}


def test_anomalies_count_unknown_as_bad(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    good, bad = J.with_anomalies(df, {"large": F.col("v") > 10})
    assert rows(good.select("k")) == [(1,)] and rows(bad.select("k")) == [(2,), (3,)]


# --- aggregates, selection


def test_links(spark):
    data = [("m1", "p", "e", "main", "high"), ("m2", "p", "e", "note", "low"), ("m3", "q", "e", "note", "low"), ("m4", None, "e", "main", "high")]
    df = spark.createDataFrame(data, "mention_id string, person_id string, entry_id string, section string, confidence string")
    got = {r.person_id: (r.review_status, r.resolution_status, r.supporting, r.candidates) for r in A.links(df).collect()}
    assert got == {"p": ("reviewed", "mixed", ["m1"], ["m2"]), "q": ("candidate", "contextual", [], ["m3"])}


def test_tree_hash(spark):
    import hashlib

    files = {"b.txt": b"two", "a.txt": b"one"}
    df = spark.createDataFrame([("t", p, bytearray(c)) for p, c in files.items()], "g string, p string, c binary")
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + hashlib.sha256(files[p]).digest() for p in sorted(files))).hexdigest()
    assert A.tree_hash(df, "g", "p", F.col("c")).first()[1] == want


def test_allocation():
    assert K.allocate(20) == {"graph": 8, "coverage": 6, "random": 3, "counter": 3}
    assert sum(K.allocate(7).values()) == 7


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "k int, s string")
    got = K.round_robin(df, F.col("s"), "k", 4, 1)
    assert sorted(r.stratum for r in got.collect()) == ["a", "a", "b", "b"]


def test_channels_are_disjoint(spark):
    pool = spark.range(50).withColumn("x", F.col("id") % 7)
    got = K.channels(pool, "id", {"one": [F.desc("x")], "two": [F.asc("x")]}, {"one": 8, "two": 6})
    assert got.count() == 14 == got.select("id").distinct().count()


def test_greedy_cover_covers_first():
    pool = [{"id": "a", "score": 9, "group": 1, "members": {1}}, {"id": "b", "score": 1, "group": 2, "members": {2}}, {"id": "c", "score": 8, "group": 1, "members": {1}}]
    assert [c["id"] for c in K.greedy_cover(pool, {1, 2}, 3)] == ["a", "b", "c"]


@pytest.mark.parametrize("n, draw, exclude, want", [(3, 0.0, None, 0), (3, 1.0, None, 2), (3, 0.0, 0, 1), (1, 0.5, 0, 0), (0, 0.5, None, None)])
def test_picked(n, draw, exclude, want):
    assert K.picked(n, draw, exclude) == want


# --- graphs, intervals


def test_components_and_articulation(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (8, 9), (7, 7)], "a int, b int")
    got = dict(rows(G.components(edges, "a", "b")))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7}
    assert rows(G.articulation_points(edges, "a", "b")) == [(3,), (4,)]


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in G.components(edges, "a", "b").collect()} == {0}


def test_age_range(spark):
    df = spark.createDataFrame([(100, 105, 60, 70), (100, None, 60, 70)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(T.age_range(*map(F.col, "abcd"))).collect()]
    assert (got[0]["low"], got[0]["high"]) == (30, 45) and got[1] is None


def test_slice_keeps_unknown_apart(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, None, None), (3, 9, None)], "k int, s int, e int")
    assert rows(T.slice_(df, "s", "e", 2, 3, True).select("k", "bucket")) == [(1, "potential"), (2, "unknown")]


# --- text structure


def test_blocks_rebuild_the_text():
    text = "ab(c(d)e)f(g)"
    units, issues = M.blocks(text)
    assert "".join(text[a:b] for a, b, _ in units) == text and issues == ["nested"]
    assert M.blocks("a(b")[1] == ["unclosed"] and M.blocks("a)b")[1] == ["unopened"]


def test_strict_split_raises(spark):
    df = spark.createDataFrame([(1, "a(b")], "k int, t string")
    with pytest.raises(Exception, match="unmatched"):
        M.layered(df, "k", "t", strict=True).collect()


def test_lines_and_pages(spark):
    df = spark.createDataFrame([(1, "#+TITLE: x\n<pb:A_1>one¶\ntwo"), (2, "")], "k int, t string")
    assert [(r.line_no, r.start, r.end) for r in M.lines(df, "k", "t").filter("k = 1").orderBy("line_no").collect()] == [(0, 0, 10), (1, 11, 23), (2, 24, 27)]
    got = M.physical_lines(df, "k", "t").filter("k = 1").orderBy("line_no").collect()
    assert [(r.header, r.page, r.body) for r in got] == [("TITLE", None, None), (None, "A_1", "one"), (None, "A_1", "two")]


def test_front_matter():
    got, rest = M.front_matter("---\na: 1\nb: [x, 'y']\nc:\n  d: true\nl:\n- p\n- q\n---\nbody")
    assert got == {"a": 1, "b": ["x", "y"], "c": {"d": True}, "l": ["p", "q"]} and rest == "body"


def test_templates_are_balanced():
    assert M.templates("a{{x|{{y|1}}|b}}c{{z}}") == [(1, 16, "x", ["{{y|1}}", "b"]), (17, 22, "z", [])]


def test_anchors(spark):
    bodies = spark.createDataFrame([(1, "xxabcyyabz")], "k int, t string")
    anchors = spark.createDataFrame([(1, 0, "abc"), (1, 1, "ab"), (1, 2, "q"), (1, 3, "xx")], "k int, n int, a string")
    got = {r.a: r.state for r in M.unique_anchors(anchors, bodies, "k", "n", "a", "t").collect()}
    assert got == {"abc": "ok", "ab": "repeated", "q": "missing", "xx": "repeated"} or got["xx"] == "out_of_order"


# --- entities, alignment, scores


def test_nested_surfaces_survive(spark):
    df = spark.createDataFrame([(1, "abcab"), (2, None)], "k int, t string")
    assert rows(E.dictionary_matches(df, "k", "t", ["ab", "abc"])) == [(1, "ab", 0, 2), (1, "ab", 3, 5), (1, "abc", 0, 3)]


def test_short_form_needs_an_antecedent(spark):
    data = [(1, 0, 2, "short", ["p"]), (1, 5, 9, "full", ["p"]), (1, 12, 14, "short", ["p"]), (1, 20, 24, "full", ["p", "q"])]
    got = E.effective(spark.createDataFrame(data, "k int, start int, end int, form string, person_ids array<string>"), "k")
    assert [r.person_id for r in got.orderBy("start").collect()] == [None, "p", "p", None]


def test_cooccurrence_is_no_relation(spark):
    hits = spark.createDataFrame([(1, "p", 0, 2), (1, "q", 8, 10)], "k int, person_id string, start int, end int")
    pairs = E.nearest_pairs(hits, "k")
    texts = spark.createDataFrame([(1, "AB likes CD")], "k int, t string")
    assert E.relations(pairs, texts, "k", "t", {"kin": (18, "son of")}).count() == 0
    assert rows(E.relations(pairs, texts, "k", "t", {"fond": (18, "likes")}).select("a", "b", "family")) == [("p", "q", "fond")]


def test_alignment(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("abc", "ab")], "a string, b string")
    assert [r[0] for r in df.select(L.alignment_class(F.col("a"), F.col("b"))).collect()] == ["exact", "variant", "disputed"]
    assert df.select(L.mismatches(F.col("a"), F.col("b"))).collect()[1][0] == [2]
    assert L.transferred("abcd", "ab, cd.") == "ab, cd." and L.transferred("abc", "ab, cd") is None
    assert L.best_opening("xxxxhello world", "hello", 2)[0] == 4
    assert L.alignment_map("abcd", "abXd")[0] == [0, 1, 2, 3, 4]
    assert L.reading_segments("abcdef", [(1, 3, "m")]) == [("text", "a"), ("m", "bc"), ("text", "def")]
    with pytest.raises(ValueError):
        L.reading_segments("abcdef", [(1, 3, "m"), (2, 4, "n")])


def test_opening_class(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(base,), ("abcdXfghijklmnop",), ("XbcdefYhij",), ("zzzzzzzzzzzz",), ("ab",)], "t string")
    assert [r[0] for r in df.select(L.opening_class(F.col("t"), F.lit(base))).collect()] == ["exact", "near", "near", "variant", "ambiguous"]


def test_epistemic(spark):
    df = spark.createDataFrame([("attested", ["conflicted"]), ("attested", ["uncertain"]), ("conflicted", ["fine"]), ("inference", ["fine"])], "s string, r array<string>")
    assert [r[0] for r in df.select(V.epistemic(F.col("s"), F.col("r"))).collect()] == ["conflicted", "uncertain", "uncertain", "inference"]


def test_exposure_flags_repeats(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "a")], "k string, r int, e string")
    got = [(x.known_refs, x.shown_twice) for x in V.exposed(df, "k", "r", "e").orderBy("r").collect()]
    assert got == [(["a"], False), (["a", "b"], False), (["a", "b"], True)]


@pytest.mark.parametrize("block, scale", [(8192, 1), (70, 1), (70, 1 << 30)])
def test_label_overlap_reads_every_row(spark, monkeypatch, block, scale):
    import random

    monkeypatch.setattr(V, "BLOCK", block)
    r = random.Random(5)
    data = [(i * 3, r.choice([1, 2, 3, None]), [r.randrange(-3, 4) * scale for _ in range(4)]) for i in range(150)]
    want = set()
    for q, label, a in data:
        near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i, own) for i, own, b in data if i != q)[:5]
        want.add((q, sum(label is not None and own == label for _, _, own in near)))
    rows = spark.createDataFrame([*data, (None, 1, [9, 9, 9, 9]), (999, 1, None)], "id bigint, label int, v array<bigint>")
    assert {tuple(x) for x in V.label_overlap(rows, "id", "label", "v").collect()} == want


def test_neighbour_overlap_query_answers_for_all_vectors(spark):
    from scriptorium import registry

    sf = "/root/testdata/sf0.001"
    found = registry.queries()["h25_neighbour_overlap"](spark, sf)
    assert len(found.collect()) == spark.read.parquet(f"{sf}/embeddings.parquet").count() > 60


def test_similarity_is_that_of_difflib(monkeypatch):
    import random
    from difflib import SequenceMatcher

    r = random.Random(2)
    for wide in (2048, 1, 8):
        monkeypatch.setattr(L, "WIDE", wide)
        for _ in range(150):
            a, b = ("".join(r.choice("ab甲😀"[: r.randrange(1, 5)]) for _ in range(r.randrange(40))) for _ in "xy")
            m = SequenceMatcher(None, a, b, autojunk=False)
            assert L.similarity(a, b) == (m.ratio(), m.find_longest_match().size), (a, b)


def test_texts_are_converted_and_aligned_to_their_ends(spark, tmp_path):
    from scriptorium import registry

    head = "".join(chr(97 + i * 7 % 26) for i in range(300))
    data = [(1, "s", head + "é one"), (2, "s", head + "è two"), (3, "s", head + "è two")]
    spark.createDataFrame(data, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.ratio, r.longest) for r in registry.queries()["l1_l3_alignment"](spark, str(tmp_path)).collect()}
    assert found[2][0] < 1 and found[2][1] == 300 and found[3] == (1.0, 305)
    md5 = {r.doc_id: r.text_md5 for r in registry.queries()["l13_conversion"](spark, str(tmp_path)).collect()}
    assert md5[1] != md5[2] == md5[3]


def test_ordinals_are_paired_beyond_forty(spark, tmp_path):
    from scriptorium import registry

    docs = [(i * 2, f"text {i % 3}") for i in range(75)]
    items = [(i, f"text {i % 2}" + "x" * (i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i, "exact" if a == b else "variant" if len(a) == len(b) else "disputed") for (d, a), (i, b) in zip(docs, items, strict=False)}
    assert {tuple(r) for r in registry.queries()["j13_ordinal_alignment"](spark, str(tmp_path)).collect()} == want


def test_cover_is_chosen_among_all_orders(spark, tmp_path):
    import random

    from scriptorium import registry
    from scriptorium.operators import selection as K

    r = random.Random(4)
    for run in range(2):
        # Wanted suppliers stand only in cheap orders; in the second run prices tie.
        orders = [(i, float(r.randrange(500_000, 900_000) if i < 300 else r.randrange(1, 9)) if run == 0 else r.choice([1e5, 2e5]), r.choice("abc")) for i in range(400)]
        lines = [(i, r.randrange(100, 200) if i < 300 else r.randrange(20)) for i, *_ in orders for _ in range(2)]
        spark.createDataFrame(orders, "o_orderkey bigint, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/{run}/orders.parquet")
        spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/{run}/lineitem.parquet")
        pool = [{"id": i, "score": p / 1e5, "group": g, "members": {s for k, s in lines if k == i}} for i, p, g in orders]
        want = [(n, c["id"]) for n, c in enumerate(K.greedy_cover(pool, set(range(12)), 16), 1)]
        assert sorted(tuple(x) for x in registry.queries()["k9_k10_greedy_cover"](spark, f"{tmp_path}/{run}").collect()) == want


def test_lineage_paths_of_any_length(spark):
    edges = [(i, i - 1) for i in range(1, 21)] + [(100, 50), (101, 100)]  # 50 is no row
    ids = [(i,) for i in [*range(21), 100, 101]]
    found = {r.id: r.path for r in J.lineage_paths(spark.createDataFrame(ids, "child bigint"), spark.createDataFrame(edges, "child bigint, parent bigint")).collect()}
    assert found == {**{i: list(range(i, -1, -1)) for i in range(21)}, 100: [100, 50], 101: [101, 100, 50]}


def test_whole_queries_read_every_row(spark, tmp_path):
    from scriptorium import registry

    q = registry.queries()
    sf = "/root/testdata/sf0.001"
    assert len(q["j15_lineage_path"](spark, sf).collect()) == spark.read.parquet(f"{sf}/orders.parquet").count()
    spark.createDataFrame([(1, "s", "abc"), (5, "s", "abcd"), (7, "s", "x")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.before, r.after) for r in q["o7_size_deltas"](spark, str(tmp_path)).collect()] == [(8, 16)]
    assert q["s5_s15_tree_comparison"](spark, str(tmp_path)).collect() == []


def test_templates_of_whole_pages(spark, tmp_path):
    import hashlib

    from scriptorium import registry

    def plain(t):
        """Outermost templates by their depths, as (name, fields)."""
        out, i = [], 0
        while (i := t.find("{{", i)) >= 0:
            depth, j = 0, i
            while True:
                two = t[j : j + 2]
                if two in ("{{", "}}"):
                    depth, j = depth + (1 if two == "{{" else -1), j + 2
                else:
                    j += 1
                if depth == 0 or j >= len(t):
                    break
            if depth:
                break
            fields, level = [""], 0
            for c in t[i + 2 : j - 2]:
                level += {"{": 1, "[": 1, "}": -1, "]": -1}.get(c, 0)
                fields = [*fields, ""] if c == "|" and level == 0 else [*fields[:-1], fields[-1] + c]
            out.append((fields[0].strip(), fields[1:]))
            i = j
        return out

    pages = ["plain " * 30, "{{a|b|c}} mid {{d|[[x|y]]|{{e|f}}}} end", "x" * 60 + "}} then {{late|one}} {{more", "p|q{r|s}", "", "{{un|closed"]
    data = [(i, "u", h) for i, h in enumerate(pages)]
    spark.createDataFrame(data, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {
        (k, n, name, len(f), hashlib.md5("\x1f".join(f).encode()).hexdigest())
        for k, _, h in data for n, (name, f) in enumerate(plain("a {{note|" + h + "}} b"))
    }
    assert {tuple(r) for r in registry.queries()["s4_templates"](spark, str(tmp_path)).collect()} == want
    assert any(n for _, n, *_ in want) and any(m > 1 for *_, m, _ in want)


def test_nearest_of_long_ranges(spark):
    """Ranges longer than the gap, near each other by an end or overlapping."""
    r = random.Random(4)
    spans = [[(k, i, a := r.randrange(300), a + r.choice([0, 3, 40, 120])) for i in range(60)] for k in range(2)]
    left, right = (spark.createDataFrame([(k, i, s, e) for i, (k, _, s, e) in enumerate(x)], "k int, i int, s int, e int") for x in ([(n % 3, *x[1:]) for n, x in enumerate(spans[0])], [(n % 3, *x[1:]) for n, x in enumerate(spans[1])]))
    want = set()
    for a in left.collect():
        near = [(max(b.s - a.e, a.s - b.e, 0), b.s, b.i) for b in right.collect() if b.k == a.k]
        near = [x for x in near if x[0] <= 10]
        if near:
            want.add((a.i, min(near)[0]))
    assert {(x.i, x.gap) for x in J.nearest_in_band(left, right, "k", "s", "e", 10).collect()} == want
    one = spark.createDataFrame([(1, 0, 100)], "k int, s int, e int")
    other = spark.createDataFrame([(1, 105, 110)], "k int, s int, e int")
    assert [x.gap for x in J.nearest_in_band(one, other, "k", "s", "e", 10).collect()] == [5]


def test_search_folds_a_text_once(spark):
    for name in ("t5_evidence_search", "a10_keep_best"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(lower(") == 1, plan


def test_one_hop_counts_without_pairs(spark, tmp_path, monkeypatch):
    """As the SQL, unknown dates and customers included; in several blocks; a date with most customers."""
    import duckdb

    r = random.Random(5)
    rows = [(r.choice([None, *range(60)]), r.choice([None, *[f"2001-01-{d:02} 00:00:00" for d in range(1, 29)]])) for _ in range(250)]
    rows += [(100 + i, None if i % 3 else "2001-02-01 00:00:00") for i in range(6)]
    rows += [(1000 + i, "2001-03-01 00:00:00") for i in range(30_000)] + [(1000, "2001-01-01 00:00:00")]
    data = spark.createDataFrame(rows, "o_custkey bigint, o_orderdate string")
    data.selectExpr("o_custkey", "cast(o_orderdate as timestamp) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    small = data.filter("o_custkey IS NULL OR o_custkey < 1000")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' WHERE o_custkey IS NULL OR o_custkey < 1000")
        want = set(c.execute(registry.oracle_sql()["h15_one_hop"]).fetchall())
    for block in (G.BLOCK, 40):
        monkeypatch.setattr(G, "BLOCK", block)
        assert {tuple(x) for x in G.one_hop(small, "o_orderdate", "o_custkey").collect()} == want
    monkeypatch.undo()
    found = {x.o_custkey: x.reachable for x in registry.queries()["h15_one_hop"](spark, str(tmp_path)).collect()}
    first = {c for c, d in rows if d == "2001-01-01 00:00:00" and c is not None}
    assert found[1001] == 29_999 and found[1000] == 29_999 + len(first) - 1 and 101 not in found


def test_similarity_of_long_texts_takes_no_product_of_lengths():
    """Some 0.1 s; 15 s where every place of one text meets its like in the other."""
    import time

    r = random.Random(8)
    a, b = ("".join(r.choices("ab", k=32_000)) for _ in "xy")
    began = time.process_time()
    assert L.similarity(a, b)[0] > 0.1
    assert time.process_time() - began < 4


def test_texts_are_aligned_with_the_one_before_across_ranges(spark):
    from difflib import SequenceMatcher

    r = random.Random(9)
    texts = [None, "", *["".join(r.choices("ab c", k=r.randrange(1, 30))) for _ in range(20)]]
    rows = [(i, r.choice(["s", "s", "s", "t", None, "u"]), r.choice(texts)) for i in range(300)]
    want, last = set(), {}
    for i, group, text in rows:
        if (before := last.get(group)) is not None:
            m = SequenceMatcher(None, text or "", before, autojunk=False)
            want.add((i, round(m.ratio(), 6), m.find_longest_match().size))
        last[group] = text
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    found = L.aligned_in_order(df, "doc_id", "source", "text")
    assert found.columns == ["doc_id", "ratio", "longest"]
    assert {tuple(x) for x in found.collect()} == want and len(want) > 200
    assert "hashpartitioning(source" not in found._jdf.queryExecution().toString()
    assert L.aligned_in_order(df.filter("doc_id < 0"), "doc_id", "source", "text").collect() == []


def test_ordinal_alignment_of_unknown_ids_and_texts_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    docs = [(i or None, None if i % 4 == 1 else f"text {i % 3}") for i in range(30)]
    items = [(i if i != 3 else None, None if i % 5 == 2 else f"text {i % 2}" + "x" * (i % 7 == 0)) for i in range(35)]
    with duckdb.connect() as c:
        for name, rows, schema in (("documents", docs, "doc_id bigint, text string"), ("benchmark", items, "item_id bigint, text string")):
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = c.execute(registry.oracle_sql()["j13_ordinal_alignment"]).fetchall()
    found = [tuple(x) for x in registry.queries()["j13_ordinal_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) == 30
