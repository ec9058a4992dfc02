"""Token counts, pseudonyms, packing, toxicity, search, licenses, pipeline."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import licenses, packing, pii, queries, tokens, topk, toxicity

from . import brute

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "It's 12 o'clock, naïve CAFÉ — 東京 😀"), (6, "x" * 3000), (7, "the of " * 5000), (4, "Word"), (8, "<|endoftext|> is text")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- token counts


def test_token_counts(docs):
    pieces = tokens.read_pieces(queries.PIECES)
    want = []
    for i, t in EDGES:
        w = brute.spaced(t)
        own = {x: brute.token_count(x, pieces) for x in set(w)}
        want.append((i, len((t or "").encode()), len(w), sum(own[x] for x in w)))
    assert rows(tokens.counts(docs(EDGES), queries.PIECES)) == sorted(want, key=str)


def test_counts_are_near_the_encoders(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=queries.PIECES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sum(len(own.encode(r.text or "")) for r in docs.select("text").collect())
    found = tokens.counts(docs, queries.PIECES).agg(F.sum("n_tokens")).first()[0]
    assert abs(found - want) < 0.03 * want


def test_log_probabilities():
    assert tokens.log_probabilities({"a": -1.5, "b": -2.0}) == {"a": -1.5, "b": -2.0}
    made = tokens.log_probabilities({"a": -1.0, "b": -2.0, "c": -900.0})
    assert made["a"] > made["b"] > made["c"] and abs(sum(np.exp(list(made.values()))) - 1) < 1e-9


def test_long_pre_tokens_hold_few_scores():
    pieces = tokens.read_pieces(queries.PIECES)
    r = random.Random(8)
    for n in (200, 201, 333, 1500):
        word = "".join(r.choice("etaoinshr東京é😀") for _ in range(n))
        assert tokens.Trie(pieces).count([word]) == brute.token_count(word, pieces)


def test_trie_restart_changes_nothing():
    pieces = tokens.read_pieces(queries.PIECES)
    r = random.Random(0)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(500)]
    assert tokens.Trie(pieces).count(words) == tokens.Trie(pieces, nodes=20, counts=7).count(words)


def test_long_pre_token_scores_alike():
    pieces = tokens.read_pieces(queries.PIECES)
    word = "ab" * 120
    assert tokens.Trie(pieces).insert(word) == brute.token_count(word, pieces)


# --- pseudonyms

VALUES = [
    ("email", "jo.doe7@mail.example.com"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (788) 555-2942"), ("ssn", "123-45-6789"),
    ("ipv4", "10.20.3.240"), ("date", "2020-02-29"), ("date", "31.12.1999"), ("date", "12/25/2020"), ("date", "0900-01-05"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", 'token = "A1b2-C3d4"'),
]


@pytest.mark.parametrize("kind, value", VALUES)
def test_pseudonym_keeps_format_and_reverses(kind, value):
    text = f"see {value}, ok".encode()
    new, counts = pii.pseudonyms(text, b"k")
    assert counts == {kind: 1} and new != text and len(new) == len(text)
    again, twice = pii.pseudonyms(new, b"k", back=True)
    assert again == text and twice == {kind: 1}
    assert pii.pseudonyms(f"x {value} y {value}".encode(), b"k")[0].count(new[4:-4]) == 2
    assert pii.pseudonyms(text, b"other")[0] != new


@pytest.mark.parametrize("value", ["999.1.1.1", "2020-02-30", "666-12-1234", "a@b", "12345", "4111111111111112", "GB00 WEST 1234 5698 7654 32"])
def test_invalid_values_stay(value):
    assert pii.pseudonyms(f"see {value} ok".encode(), b"k")[0] == f"see {value} ok".encode()


@given(st.integers(1, 5000), st.binary(min_size=1, max_size=8))
@settings(max_examples=20, deadline=None)
def test_permutation(n, key):
    assert sorted(pii.permuted(x, n, key, "t") for x in range(min(n, 300))) != [] and len({pii.permuted(x, n, key, "t") for x in range(min(n, 300))}) == min(n, 300)
    assert all(pii.permuted(pii.permuted(x, n, key, "t"), n, key, "t", True) == x for x in range(min(n, 300)))


def test_replaced_rows(docs):
    data = [*EDGES, (20, "mail a.b@c.example.com now"), (21, "mail a.b@c.example.com now")]
    out = pii.replace_text(docs(data))
    assert out.columns == docs(data).columns
    found = {r.doc_id: r for r in out.collect()}
    assert found[20].text == found[21].text != data[-1][1] and found[1].text is None and found[7].text == EDGES[6][1]
    assert found[20].n_chars == len(found[20].text)
    assert rows(pii.pseudonymised(docs(data)).select("doc_id", "n_found"))[:2] == [(1, 0), (2, 0)]


def test_detected_values(spark, sf_dir):
    """Every value that a plain detector finds changes, and nothing else in between."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    seen = Counter()
    for text in texts:
        new = pii.pseudonyms(text.encode(), b"k")[0].decode()
        for kind, value in brute.personal(text):
            seen[kind] += 1
            at = text.index(value)
            assert len(new) == len(text) and new[at : at + len(value)] != value or kind == "email" and len(value) < 3
        assert pii.pseudonyms(new.encode(), b"k", back=True)[0].decode() == text
    assert len(seen) >= 2


def test_many_values_take_linear_time():
    text = " ".join(f"user{i}@mail.example.com" for i in range(20_000)).encode()
    began = time.process_time()
    new, counts = pii.pseudonyms(text, b"k")
    assert counts == {"email": 20_000} and time.process_time() - began < 10


def test_key_of_the_session(spark):
    drawn = pii.key_of(spark)
    assert len(drawn) >= 32 and drawn == pii.key_of(spark)
    spark.conf.set("spark.scriptorium.pii.key", "own")
    try:
        assert pii.key_of(spark) != drawn and b"own" not in pii.key_of(spark)
    finally:
        spark.conf.unset("spark.scriptorium.pii.key")


# --- packing


def test_ids_equal_the_tokenizer():
    bpe = packing.word_bpe(queries.WORD_BPE)
    latin = [chr(c) for c in [*range(1, 0x180), 0x2013, 0x2019, 0x20AC, 0x130, 0x4E00, 0x1F600]]
    texts = [t or "" for _, t in EDGES] + [f"a{c}b 1{c}2 {c}'s {c}" for c in latin]
    for t in texts:
        assert bpe(t).tolist() == bpe.full.encode(t, add_special_tokens=False).ids, t


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_uses_everything_once(histogram):
    used = Counter()
    for times, chosen in packing.plan(histogram, 60):
        assert times > 0 and sum(n * k for n, k in chosen.items()) <= 60
        for n, k in chosen.items():
            used[n] += times * k
    assert used == Counter(histogram)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=8), st.integers(0, 90))
@settings(max_examples=60, deadline=None)
def test_fullest_is_fullest(lengths, room):
    stock = Counter(lengths)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    chosen = packing.fullest(sorted(stock, reverse=True), stock, room)
    assert sum(n * k for n, k in chosen.items()) == max(sums) and all(stock[n] >= k for n, k in chosen.items())


def test_packed(docs):
    out = packing.best_fit(docs(EDGES), queries.WORD_BPE).collect()
    bpe = packing.word_bpe(queries.WORD_BPE)
    want = []
    for i, t in EDGES:
        ids = np.array([*bpe.full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.best_fit(docs([]), queries.WORD_BPE).collect() == []


# --- toxicity


def test_score_equals_the_plain_one():
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), -0.3)
    texts = [None, b"", b"a", b"abcd", "Ünïcode ÄB".encode(), b"The Quick brown fox " * 30]
    want = [brute.toxic_score(t, model, toxicity.ORDERS, toxicity.BITS, toxicity.PER) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-9) and np.allclose(model.score(texts, 7), want, atol=1e-9)


def test_held_out_recall(spark):
    """At sf0.1 the held-out rows of label 1 are found as far as the README says, few others are."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    judged = toxicity.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    share = lambda label: np.mean([r.predicted for r in judged if r.toxic == label])
    assert share(1) > 0.57 and share(0) < 0.01


def labelled(n):
    r = random.Random(3)
    good, bad = [f"calm{i}" for i in range(200)], ["vilest", "rotten", "cursed"]
    out = []
    for i in range(n):
        w = [r.choice(good) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(bad)
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_held_out_accuracy(spark, docs):
    data = labelled(600)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(10**6, 0, None)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(docs([(i, t) for i, t, _ in data] + [(-1, None), (-2, "")]), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    tested = [(y, out[i]) for i, _, y in data if out[i].held_out]
    assert len(tested) > 80 and np.mean([y == r.predicted for y, r in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values()) and out[-1].score == out[-2].score
    kept = toxicity.keep_clean(docs([(i, t) for i, t, _ in data]), labels)
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if i >= 0 and not r.predicted}


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.predicted for r in toxicity.classify(docs([(1, "x"), (1, "x")]), none).collect()] == [0, 0]
    assert toxicity.classify(docs([]), none).collect() == []


def test_runs_of_long_texts_add_up():
    model = toxicity.Model(np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32), 0.1)
    texts = [b"abcdefgh" * 200, None, b"", b"a", b"xyz" * 999]
    whole = model.score(texts)
    assert np.allclose(whole, model.score(texts, most=64)) and np.allclose(whole, [model.score([t])[0] for t in texts])


# --- search


@pytest.mark.parametrize("split", [16384, 100])
def test_top_k(spark, monkeypatch, split):
    monkeypatch.setattr(topk, "SPLIT", split)
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = np.random.default_rng(1)
    data = [(i, r.integers(-2, 3, size=3).astype(float).tolist()) for i in range(600)]
    data += [(700 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    data += [(1000, None), (1050, [1.0, None, 2.0]), (1100, [float("nan"), 1.0, 1.0]), (1150, [0.5]), (1200, []), (1250, [1e3, 2e3, -1e3]), (None, [1.0, 2.0, 3.0]), (1300, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert rows(topk.top_k(df.withColumn("label", F.lit(1)).withColumn("split", F.lit("x")))) == sorted(brute.top_k(data), key=str)


@pytest.mark.parametrize("split", [16384, 5])
def test_top_k_repeated_rows(spark, monkeypatch, split):
    monkeypatch.setattr(topk, "SPLIT", split)
    plain = [(0, [10.0, 0.0]), *((i, [float(x), 1.0]) for i, x in enumerate([10, 9, 8, 7, 6, 5, 4], 1))]
    data = [*plain, plain[1]]  # the best candidate twice: the fifth neighbour stays
    data += [plain[2]] * 7 + [plain[0]] * 6  # more often than k; the query too
    data += [(20, plain[2][1]), (21, plain[2][1])]  # other ids of a repeated vector
    data += [(30, [8.0, 3.0]), (30, [8.0, 4.0]), (30, [8.0, 5.0])]  # one id, several vectors, one score
    want = sorted(set(brute.top_k(data)), key=str)
    assert [r[1] for r in want] == [1, 2, 3, 4, 5]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert rows(topk.top_k(df)) == want


def test_top_k_id_of_several_vectors(spark):
    data = [(0, [1.0, 0.0]), *((1, [9.0, float(y)]) for y in range(8)), *((i, [float(9 - i), 0.0]) for i in range(2, 8))]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert rows(topk.top_k(df)) == sorted(set(brute.top_k(data)), key=str)


def test_top_k_small(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert rows(topk.top_k(few)) == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.filter("false")).collect() == []


def trees(queries_, query_ids, points, ids):
    return topk.cover_tree(queries_, query_ids, topk.FEW), topk.cover_tree(points, ids)


def test_large_components_are_exact():
    q, p = np.array([[1 << 40, 3]]), np.array([[1 << 40, 1], [1 << 40, 2], [(1 << 40) - 1, 5]])
    found = topk.Search(*trees(q, np.array([9]), p, np.array([1, 2, 3])), 2)
    assert list(found.rows()) == [(9, 2, (1 << 80) + 6), (9, 1, (1 << 80) + 3)]


def test_tree_covers():
    points = np.random.default_rng(0).normal(size=(800, 6))
    points[100:400] = points[0]
    t = topk.cover_tree(points, np.arange(800))
    assert sorted(t.ids) == list(range(800)) and (points[t.ids] == t.points).all()
    for n in range(len(t.begin)):
        own = t.points[t.begin[n] : t.end[n]]
        assert np.sqrt(((own - t.centres[n]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        assert t.begin[n] <= t.centre[n] < t.end[n]
        if t.children[n]:
            kids = np.arange(t.child[n], t.child[n] + t.children[n])
            assert t.begin[kids].tolist() == [t.begin[n], *t.end[kids][:-1].tolist()] and t.end[kids][-1] == t.end[n]
    assert sum(t.end[t.leaves] - t.begin[t.leaves]) == 800


def test_node_pairs_are_pruned():
    """Grouped vectors: inner query nodes prune, and under half of all pairs are compared."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(64, 32))
    group = r.integers(0, 64, size=8192)
    x = centres[group] + 0.05 * r.normal(size=(8192, 32))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(8192)
    own = np.flatnonzero(ids % 8 == 0)
    found = topk.Search(*trees(x[own], ids[own], x, ids))
    assert found.inner > 0 and found.met < len(own) * len(ids) / 4
    scores = x[own] @ x.T
    scores[np.arange(len(own)), own] = -(1 << 40)
    want = {(int(ids[own[i]]), int(j), int(scores[i, j])) for i in range(len(own)) for j in np.lexsort((ids, -scores[i]))[:5]}
    assert set(found.rows()) == want


# --- licenses

LICENSED = [
    *EDGES, (20, "MIT License mit license MIT-LICENSE"), (21, "x " * 200 + "released under the   MIT thing license"), (22, "general public license apache license"),
    (23, "word " * 100 + licenses.TEMPLATES[1][1] + " word" * 40), (24, "licensed under cc by 4 0"), (25, "license mit"), (26, "general general public license"),
]


def test_licenses(docs):
    want = [(i, *brute.licenses(t, licenses.BASE, licenses.TEMPLATES)) for i, t in LICENSED]
    assert rows(licenses.scan(docs(LICENSED))) == sorted(want, key=str)
    assert licenses.scan(docs([])).collect() == []


def test_license_plan_is_native(docs):
    plan = licenses.scan(docs(LICENSED))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_plan_does_not_grow_with_the_templates(docs):
    r = random.Random(5)
    many = [(f"l{k}", " ".join(f"v{r.randrange(300)}" for _ in range(r.choice([3, 8, 40])))) for k in range(100)]
    data = [(i, " ".join(f"v{r.randrange(300)}" for _ in range(r.randrange(90))) + " " + many[i][1]) for i in range(60)]
    want = [(i, *brute.licenses(t, licenses.BASE, many)) for i, t in data]
    assert rows(licenses.scan(docs(data), many)) == sorted(want, key=str)
    size = [licenses.scan(docs(data), many[:n])._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n") for n in (10, 100)]
    assert size[0] == size[1]


@pytest.mark.parametrize("text", ["", "word " * 5000])
def test_template_without_a_block(docs, text):
    with pytest.raises(ValueError):
        licenses.scan(docs(LICENSED), [("x", text)])


# --- all together


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = [" ".join(f"w{r.randrange(10**5)}" for _ in range(60)) for _ in range(6)]
    data = [(1, None), (2, ""), (3, prose[0]), (3, prose[1]), (4, prose[0]), (5, prose[2] + " " + prose[3]), (6, prose[4]), (6, prose[4]), (None, prose[5]), (7, "card 4111111111111111 here"), (8, "x " * 9000)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in data], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose[3]), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Null and empty are one fingerprint; 4 copies 3, 6 is there twice, 5 holds an item.
    firsts = Counter(x.doc_id for x in out if x.piece == 0)
    assert firsts == Counter({1: 1, 3: 2, 6: 1, None: 1, 7: 1, 8: 1}) and sum(x.length for x in out if x.doc_id == 8) == 9001
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from scriptorium.llm import decontam, simhash

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)
    clean = out["toxicity"](spark, source, sf_dir)
    scores = {r.doc_id: r.predicted for r in toxicity.classify(source, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p} and clean.columns == source.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    first = out["near_duplicates"](spark, clean, sf_dir)
    kept = {d for d, _, c in brute.near_components(left) if d == c}
    assert {r.doc_id for r in first.collect()} == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = brute.contamination([x for x in left if x[0] in kept], items)
    pure = out["decontamination"](spark, first, sf_dir)
    assert {r.doc_id for r in pure.collect()} == {x[0] for x in judged if not x[5]}
    hidden = out["pii"](spark, pure, sf_dir)
    texts = {d: t for d, t in left}
    for r in hidden.collect():
        assert pii.pseudonyms(r.text.encode(), pii.key_of(spark), back=True)[0].decode() == texts[r.doc_id]
    packed = out["packing"](spark, hidden, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in hidden.select("doc_id").collect()}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r)[:5] for r in packed)
    assert decontam.RATIO == 20 and simhash.RADIUS == 2


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert public_tokenizers.path("word_bpe_49k.json")
