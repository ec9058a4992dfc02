"""SimHash, substring and suffix dedup, decontamination against plain versions."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import common, decontam, exchange, simhash, substring, suffix

from . import brute

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "one two three"), (7, "one two three"), (8, "ONE  two\nthree")]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus():
    long = prose(0, 3000)
    rows = [*EDGES, (9, long), (10, long), (11, long.replace("w7 ", "changed ", 2)), (12, prose(1, 49)), (13, prose(1, 49)), (14, prose(2, 50)), (15, prose(2, 50))]
    base = prose(3, 400, 10**6).split()
    r = random.Random(4)
    for i in range(40):
        at, n = r.randrange(300), r.randrange(30, 90)
        rows.append((100 + i, prose(100 + i, r.randrange(30)) + "  " + " ".join(base[at : at + n]) + "\n" + prose(200 + i, r.randrange(30))))
    return rows + [(300, "ha " * 300), (301, "é" * 900), (302, "x" * 400), (303, "x" * 399), (10, long), (None, long)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(df, want):
    assert got(df) == sorted(want, key=str)


def test_repeated_words(docs):
    same(substring.repeated_words(docs(corpus())), brute.repeated_words(corpus()))


@pytest.mark.parametrize("hot", [1024, 3, 0])
def test_repeated_bytes(docs, hot):
    same(suffix.repeated_bytes(docs(corpus()), hot), brute.repeated_bytes(corpus()))


def test_dedup_of_real_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    same(substring.repeated_words(df), brute.repeated_words(rows))
    same(suffix.repeated_bytes(df), brute.repeated_bytes(rows))
    same(simhash.components(df), brute.near_components(rows))


def test_many_batches_agree_with_one(docs, monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 2000)
    same(substring.repeated_words(docs(corpus())), brute.repeated_words(corpus()))
    same(suffix.repeated_bytes(docs(corpus()), 3), brute.repeated_bytes(corpus()))


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_strings_whose_polynomials_agree_stay_apart(docs):
    """A Thue-Morse string and its complement have one hash under every odd base modulo 2**64."""
    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    head = prose(1, 49, 10**6)
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, " ".join(thue_morse(2048, "on", "off"))), (4, " ".join(thue_morse(2048, "off", "on"))), (5, one), (6, two)]
    same(substring.repeated_words(docs(rows)), brute.repeated_words(rows))
    same(suffix.repeated_bytes(docs(rows)), brute.repeated_bytes(rows))
    same(suffix.repeated_bytes(docs(rows), 0), brute.repeated_bytes(rows))


class Plain:
    """The stages of an operator in this process, so that its hashes can be replaced."""

    def __init__(self, rows, width):
        batches = [rows[i : i + width] for i in range(0, len(rows), width)]
        self.blobs = [(k, exchange.pack([i for i, _ in b], [t.encode() for _, t in b])) for k, b in enumerate(batches)]

    def first(self, stage, *more):
        held = pa.RecordBatch.from_arrays([pa.array([k for k, _ in self.blobs]), pa.array([0] * len(self.blobs)), pa.array([x for _, x in self.blobs])], names=["batch", "n_bytes", "blob"])
        return [r for t in stage(iter([held]), *more) for r in t.to_pylist()]

    def each(self, rows, key, stage, schema, *more):
        out, empty = [], exchange.table(schema, [])
        for k in sorted({r[key] for r in rows}):
            out += stage(pa.Table.from_pylist([r for r in rows if r[key] == k], empty.schema), *more).to_pylist()
        return out

    def both(self, rows, answers, stage, schema, other, buckets):
        out = []
        for k in sorted({r["batch"] for r in rows}):
            own = [r for r in rows if r["batch"] == k], [r for r in answers if r["batch"] == k]
            tables = [pa.Table.from_pylist(v, exchange.table(x, []).schema) for v, x in zip(own, (schema, other), strict=True)]
            out += stage(*tables, buckets).to_pylist()
        return out


def few(h):
    return h % np.uint64(3) << np.uint64(40)


def test_equal_hashes_of_unequal_words(monkeypatch):
    monkeypatch.setattr(substring.common, "runs", lambda h, n, runs=substring.common.runs: few(runs(h, n)))
    rows = [(i, t) for i, t in corpus() if i is not None and t]
    p = Plain(rows, 7)
    answers = p.each(p.first(substring._first, 2), "bucket", exchange.answer_repeats, exchange.KEYS)
    dealt = [{"batch": k, "n_bytes": 0, "blob": x} for k, x in p.blobs]
    second = p.both(dealt, answers, substring._second, exchange.DEALT, exchange.ANSWERS, 2)
    keys = [{"bucket": r["bucket"], "batch": r["batch"], "keys": r["blob"]} for r in second if r["kind"] == "keys"]
    less = p.each(keys, "bucket", exchange.answer_least, exchange.KEYS)
    judged = p.both([r for r in second if r["kind"] == "doc"], less, substring._third, substring.SECOND, exchange.ANSWERS, 2)
    found = [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in [*judged, *(r for r in second if r["kind"] == "done")]]
    assert sorted(found) == sorted(brute.repeated_words(rows))


@pytest.mark.parametrize("hot", [1024, 3])
def test_equal_hashes_of_unequal_strings(monkeypatch, hot):
    monkeypatch.setattr(suffix, "string_hashes", lambda data, n, own=suffix.string_hashes: own(data, n) % np.uint64(61) << np.uint64(32))
    rows = [(i, t) for i, t in corpus() if i is not None and t]
    p = Plain(rows, 7)
    answers = p.each(p.first(suffix._first, 2), "bucket", suffix._answer_first, exchange.KEYS, hot)
    dealt = [{"batch": k, "n_bytes": 0, "blob": x} for k, x in p.blobs]
    second = p.both(dealt, answers, suffix._second, exchange.DEALT, exchange.ANSWERS, 2)
    asked = [{k: r[k] for k in ("kind", "batch", "bucket", "blob")} for r in second if r["kind"] not in ("doc", "done")]
    recur = p.each(asked, "bucket", suffix._answer_second, "kind string, batch bigint, bucket int, blob binary")
    judged = p.both([r for r in second if r["kind"] == "doc"], recur, suffix._third, suffix.SENT, suffix.ANSWERS, 2)
    found = [tuple(r[f.split()[0]] for f in suffix.RESULT.split(", ")) for r in [*judged, *(r for r in second if r["kind"] == "done")]]
    assert sorted(found) == sorted(brute.repeated_bytes(rows))


def test_batches_follow_the_texts_and_not_the_plan(spark, docs):
    """A join makes the plan's estimate explode; the texts are as many as before."""
    other = spark.range(5000).withColumnRenamed("id", "other")
    big = docs(corpus()).crossJoin(other.filter("other = 1")).drop("other")
    a, b = exchange.deal(docs(corpus())), exchange.deal(big)
    assert (a.buckets, a.tasks) == (b.buckets, b.tasks)


@pytest.mark.parametrize("operator", [substring.repeated_words, suffix.repeated_bytes, simhash.components, simhash.one_of_each])
def test_empty_table(docs, operator):
    assert operator(docs([(1, "x")]).filter("false")).collect() == []


def test_cover_holds_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_suffix_order_is_right():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(200)]
    group = np.sort(np.array([r.randrange(9) for _ in texts]))
    sizes = np.array([len(t) for t in texts])
    s = suffix.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, group, suffix.BASES[0])
    order = s.order()
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts, strict=True))
    assert (s.neighbours(order) >= -1).all()


def test_wrong_order_is_noticed():
    data = np.frombuffer(b"abcabd", np.uint8)
    s = suffix.Suffixes(data, np.array([0, 3]), np.array([3, 3]), np.array([0, 0]), suffix.BASES[0])
    s.in_order(np.array([0]), np.array([1]), np.array([2]))
    with pytest.raises(suffix.Collision):
        s.in_order(np.array([1]), np.array([0]), np.array([2]))


def test_collision_is_noticed():
    data = np.frombuffer(b"abcabd", np.uint8)
    s = suffix.Suffixes(data, np.array([0, 3]), np.array([3, 3]), np.array([0, 0]), suffix.BASES[0])
    with pytest.raises(suffix.Collision):
        s.verify(np.array([0]), np.array([1]), np.array([3]))
    with pytest.raises(suffix.Collision):
        s.verify(np.array([0]), np.array([1]), np.array([1]))


# --- SimHash


def test_xxh64_matches_the_library():
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(100), 400]]
    sizes = np.array([len(t) for t in texts])
    h = common.xxh64(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, simhash.SEED)
    assert h.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def test_components(docs):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 10]
    same(simhash.components(docs(rows)), brute.near_components(rows))


@pytest.mark.parametrize("segments", [2, 4, 8])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, segments):
    monkeypatch.setattr(simhash, "SEGMENTS", ((1 << 62, segments),))
    r = random.Random(segments)
    prints = {r.getrandbits(64) for _ in range(300)}
    for f in list(prints)[:60]:
        for _ in range(r.randrange(1, 30)):
            prints.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints = sorted(prints)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "f bigint")
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
    links = [(x.src % (1 << 64), x.dst % (1 << 64)) for x in simhash.links(df).collect()]
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(a) == find(b) for a, b in near)
    known = set(near) | {(b, a) for a, b in near}
    assert len(links) < 4 * len(prints) or set(links) <= known


def test_links_in_crowded_classes_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 1)
    r = np.random.default_rng(7)
    bits = [np.argsort(r.random((3000, 32)), axis=1)[:, :k].astype(np.uint64) for k in (2, 2, 3)]
    low, high, more = [np.bitwise_or.reduce(np.uint64(1) << b, axis=1) for b in bits]
    prints = np.unique(np.concatenate([low | high << np.uint64(32), (more | high << np.uint64(32))[:1500]]))
    df = spark.createDataFrame([(int(f),) for f in prints.view(np.int64)], "f bigint")
    found = simhash.links(df).collect()
    x, y = (np.array([getattr(l, c) for l in found], np.int64).view(np.uint64) for c in ("src", "dst"))
    near = np.concatenate([np.argwhere(np.bitwise_count(prints[i : i + 500, None] ^ prints[None, :]) <= 2) + [i, 0] for i in range(0, len(prints), 500)])

    def labels(a, b):
        label = np.arange(len(prints))
        while True:
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                return label
            label = least

    assert (labels(np.searchsorted(prints, x), np.searchsorted(prints, y)) == labels(near[:, 0], near[:, 1])).all()
    assert len(set(labels(near[:, 0], near[:, 1]))) > 100


def test_one_of_each_shuffles_texts_once(docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "other words of a text"), (7, "quite another text here")]
    plan = simhash.one_of_each(docs(rows))._jdf.queryExecution().sparkPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_one_of_each_keeps_columns(docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, "quite another text here"), (None, "z")]
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7]


# --- decontamination


ITEMS = [
    (1, prose(9, 40)), (2, prose(9, 40)), (3, prose(10, 13)), (4, "only four words here"), (5, "lone"), (6, None), (7, "..."), (8, prose(11, 12)), (8, prose(12, 20)),
    (9, "na " * 20), (None, prose(13, 14)),
]


def contaminated():
    rows = list(EDGES)
    for k, (_, text) in enumerate(ITEMS):
        w = (text or "").split()
        rows += [(20 + k, f"before {text} after"), (40 + k, " ".join(w[3:16])), (60 + k, prose(70 + k, 300) + " " + " ".join(w[2:17]).upper() + "."), (80 + k, " ".join(w[:12]))]
    return [*rows, (99, "na " * 50), (98, "the lone word " * 3), (20, "before lone after")]


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    same(decontam.contamination(docs(contaminated()), items), brute.contamination(contaminated(), ITEMS))


def test_blocks_add_up(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(decontam.blocks, "__defaults__", (30,))
    assert len(list(decontam.blocks(items))) > 2
    want = brute.contamination(contaminated(), ITEMS)
    same(decontam.contamination(docs(contaminated()), items), want)
    kept = decontam.keep_clean(docs(contaminated()), items)
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in want if not x[5])


def test_no_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    same(decontam.contamination(docs(EDGES), none), brute.contamination(EDGES, []))
    assert decontam.keep_clean(docs(EDGES), none).count() == len(EDGES)
    assert decontam.contamination(docs([]), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []


def test_repetitive_texts_take_linear_time():
    index = decontam.Index([("1", b"na " * 10_000)])
    began = time.process_time()
    counts, found = index.hits([b"na " * 20_000])
    assert counts == [20_000] and decontam.covered(np.array(found[0][0])) == 20_000 and time.process_time() - began < 5


def test_long_items_in_parts(spark, docs, monkeypatch):
    items = [(1, prose(5, 700)), (2, prose(6, 20))]
    w = items[0][1].split()
    data = [(k, " ".join(w[k : k + 13])) for k in range(0, 687, 7)] + [(900, " ".join(w[100:112]))]
    monkeypatch.setattr(decontam.blocks, "__defaults__", (40,))
    assert len(list(decontam.blocks(spark.createDataFrame(items, "item_id bigint, text string")))) > 9
    same(decontam.contamination(docs(data), spark.createDataFrame(items, "item_id bigint, text string")), brute.contamination(data, items))


CLASHES = ["spans", "spans_", "own", "print", "other", "number", "__spans", "__id", "__f", "__n", "f", "least", "component", "tile", "row", "w", "w_"]


def test_columns_of_any_name_stay(spark, docs):
    from scriptorium.llm import licenses, pii, toxicity

    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    base = docs([(1, prose(20, 30)), (1, prose(21, 30)), (2, prose(20, 30)), (3, ITEMS[0][1])])
    for k, name in enumerate(CLASHES):
        base = base.withColumn(name, F.lit(k))
    for kept in (decontam.keep_clean(base, items), simhash.one_of_each(base), pii.replace_text(base), toxicity.keep_clean(base, spark.createDataFrame([], "doc_id bigint, toxic int"))):
        assert kept.columns == base.columns
        assert all(r[name] == k for r in kept.collect() for k, name in enumerate(CLASHES))
    assert decontam.keep_clean(base, items).count() == 3 and simhash.one_of_each(base).count() == 3
    assert licenses.scan(base).count() == suffix.repeated_bytes(base).count() == substring.repeated_words(base).count() == 4


def test_one_of_each_with_shared_ids(docs):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    near = next(t for k in range(500) if 0 < (brute.fingerprint(t := f"{texts[2]} tail{k}") ^ brute.fingerprint(texts[2])).bit_count() <= simhash.RADIUS)
    data = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (4, texts[2]), (5, texts[3]), (None, texts[3]), (None, texts[0])]
    found = simhash.one_of_each(docs(data))
    assert found.columns == docs(data).columns
    assert sorted(((x.doc_id, x.text) for x in found.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (4, texts[2]), (5, texts[3]), (None, texts[3]), (None, texts[0])], key=str)
    # Of one id's near copies the smallest fingerprint stays, of its equal fingerprints the smallest text.
    copies = [(7, near), (7, texts[2]), (7, texts[2].upper()), (8, near)]
    want = min((brute.fingerprint(t), t) for d, t in copies if d == 7)[1]
    for order in (copies, copies[::-1]):
        assert [(x.doc_id, x.text) for x in simhash.one_of_each(docs(order).repartition(3)).collect()] == [(7, want)]
