"""Boundary proposals and audits, reports, providers, registration."""

import difflib
import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import boundaries as B
from scriptorium.operators import report as R

SOURCE = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions and a very old owl reads books in the northern tower of the castle"
ENTRIES = [(1, SOURCE[:50]), (2, SOURCE[50:92]), (3, SOURCE[92:])]


def plain_best(source, opening, about, low, high):
    wanted, best = opening[:36], None
    for p in range(max(low, about - 70), min(high, len(source), about + 71)):
        part = source[p : p + len(wanted)]
        prefix = 0
        while prefix < min(len(part), len(wanted)) and part[prefix] == wanted[prefix]:
            prefix += 1
        key = (difflib.SequenceMatcher(None, part, wanted, autojunk=False).ratio(), prefix, sum(x == y for x, y in zip(part, wanted)), -abs(p - about), -p)
        best = max(best, key) if best else key
    return -best[4], round(best[0], 6), best[1], best[2]


def test_best_openings(spark):
    rows = [(1, SOURCE, SOURCE[30:60], 45), (2, SOURCE, "seven wizerds quitely", 40), (3, SOURCE, "zzzz", 10), (4, SOURCE, SOURCE[5:20], 140), (5, "aaaa" * 30, "aaaaaa", 50)]
    df = spark.createDataFrame(rows, "k int, s string, o string, at int")
    found = {r.k: (r.place, round(r.ratio, 6), r.prefix, r.equal) for r in B.best_openings(df, "k", "s", "o", "at", F.lit(0), F.char_length("s")).collect()}
    assert found == {k: plain_best(s, o, at, 0, len(s)) for k, s, o, at in rows}
    none = spark.createDataFrame([(1, "", "x", 0), (2, "abc", "", 1)], "k int, s string, o string, at int")
    assert {(r.place, r.ratio, r.prefix, r.equal) for r in B.best_openings(none, "k", "s", "o", "at", F.lit(0), F.char_length("s")).collect()} == {(0, 0.0, 0, 0)}


def test_proposed_places():
    rows = B.proposed(SOURCE, [(o, t, t) for o, t in ENTRIES])
    assert [(r[0], r[1], r[2], r[8]) for r in rows] == [(1, "opening", 0, "high"), (2, "opening", 50, "high"), (3, "opening", 92, "high")]
    assert all(SOURCE.startswith(r[6], r[2]) and SOURCE.count(r[6]) == 1 and r[7] for r in rows)


def test_absent_entry_leaves_and_the_rest_stay():
    rows = B.proposed(SOURCE, [(1, ENTRIES[0][1], ENTRIES[0][1]), (2, "%" * 60, "%" * 60), (3, ENTRIES[1][1], ENTRIES[1][1])])
    assert [(r[0], r[1], r[2]) for r in rows] == [(1, "opening", 0), (2, "absent", None), (3, "opening", 50)]


def test_partial_entry_is_low():
    text = "#" * 40 + SOURCE[50:92]
    rows = B.proposed(SOURCE, [(1, SOURCE[:50], SOURCE[:50]), (2, text, text)])
    assert rows[1][1] == "partial" and rows[1][2] == 50 and rows[1][8] == "low"


def test_repeated_anchor_is_low():
    twice = ENTRIES[0][1] * 4
    assert B.anchor(twice, 0)[1] is False and B.anchor(SOURCE, 50) == (SOURCE[50:62], True)


def test_propose_and_audit(spark):
    chapters = spark.createDataFrame([(1, SOURCE), (2, "ab (c"), (3, None)], "chapter int, source string")
    entries = spark.createDataFrame([(1, o, t, t) for o, t in ENTRIES] + [(3, 1, "x", "x"), (9, 1, "x", "x")], "chapter int, ordinal int, opening string, text string")
    found = B.propose(entries, chapters)
    assert [tuple(r)[1:4] for r in sorted(found.filter("chapter = 1").collect())] == [(1, "opening", 0), (2, "opening", 50), (3, "opening", 92)]
    assert [(r.chapter, r.kind) for r in found.filter("chapter > 1").collect()] == [(3, "absent")]
    errors = {(r.chapter, r.check): r.errors for r in B.audit(found, chapters).collect()}
    assert {k for k, n in errors.items() if n} == {(2, "parentheses")} and len(errors) == 18
    moved = found.withColumn("place", F.when(F.col("ordinal") == 3, F.lit(40)).otherwise(F.col("place"))).withColumn("anchor", F.when(F.col("ordinal") == 2, F.lit("the ")).otherwise(F.col("anchor")))
    errors = {(r.chapter, r.check): r.errors for r in B.audit(moved, chapters).collect()}
    assert errors[1, "entry_not_empty"] == 1 and errors[1, "anchor_once"] == 1 and errors[1, "anchor_in_place"] == 2


def test_report_escapes(spark):
    df = spark.createDataFrame([("b", "x|y\nz"), ("a", None)], "k string, v string")
    lines = [r.line for r in R.markdown_table(df, ["k", "v"], [F.col("k")]).orderBy("n").collect()]
    assert lines == ["| k | v |", "| --- | --- |", "| a |  |", r"| b | x\|y z |"]
    assert len(R.markdown_table(df.filter("false"), ["k"], [F.col("k")]).collect()) == 2


def test_providers(spark):
    with pytest.raises(KeyError):
        R.readings(spark.range(1), "id", "id", "nobody")
    R.provider("twice")(len)
    with pytest.raises(ValueError):
        R.provider("twice")(list)


def test_rate_limit():
    now = [0.0]
    limit = R.RateLimit(2, 10, lambda: now[0])
    assert [limit.allows("a") for _ in range(3)] == [True, True, False] and limit.allows("b")
    now[0] = 10.0
    assert limit.allows("a")


def test_registration(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"a\nb")
    row = R.registered(spark.read.format("binaryFile").load(str(tmp_path / "*.txt"))).first()
    assert tuple(row) == ("one.txt", 3, hashlib.sha256(b"a\nb").hexdigest(), 2)
    (tmp_path / "two.txt").write_bytes(b"x")
    with pytest.raises(Exception, match="payloads: 2"):
        R.registered(spark.read.format("binaryFile").load(str(tmp_path / "*.txt"))).collect()
