import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as X


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("十", 10), ("二十三", 23), ("一百三十", 130), ("廿四", 24), ("二〇三", 203), ("三萬五千", 35000), ("x", None), ("", None)])
def test_han_numeral(text, want):
    assert X.han_numeral(text) == want


def test_ordinals_round_trip(spark):
    n = spark.range(1, 100)
    assert n.select("id", X.han_number(X.ordinal_text(F.col("id"))).alias("again")).filter("id <> again").count() == 0


def test_compact_drops_ideographic_space(spark):
    assert one(spark, X.compact(F.col("t")), t="a　b \t\nc") == "abc"


def test_fold_normalises(spark):
    assert one(spark, X.fold(F.col("t")), t="ＡＢⅣ") == unicodedata.normalize("NFKC", "ＡＢⅣ").lower()
    assert one(spark, X.fold(F.col("t")), t=None) is None


def test_masked_comments_keep_offsets(spark):
    text = "a<!-- x\ny -->b"
    got = one(spark, X.masked_comments(F.col("t")), t=text)
    assert len(got) == len(text) and got[0] == "a" and got[-1] == "b" and got.count("\n") == 1 and "x" not in got


def test_plain_text(spark):
    assert one(spark, X.plain_text(F.col("t"), 7), t=" <b>a &amp; b</b>\r\nlong ") == "a & b \n"


def test_cut_and_unfenced(spark):
    assert one(spark, X.cut(F.col("t"), 4), t="abcdef") == "abc…"
    assert one(spark, X.cut(F.col("t"), 6), t="abcdef") == "abcdef"
    assert one(spark, X.unfenced(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'


def test_text_leaves(spark):
    assert one(spark, X.text_leaves(F.col("t")), t='{"a":["x",{"b":"y"},3],"c":"z"}') == ["x", "y", "z"]
    assert one(spark, X.text_leaves(F.col("t")), t="no json") == []


def test_byte_span_counts_utf8(spark):
    span = one(spark, X.byte_span(F.col("t"), F.lit(1), F.lit(3)), t="é𠮷ab")
    assert (span["start"], span["end"]) == (2, 7)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


@pytest.mark.parametrize("value, want", [("abab", "ab"), ("abababab", "abab"), ("aaa", "aaa"), ("abc", "abc")])
def test_unrepeated_takes_largest_unit(value, want):
    assert X.unrepeated.plain(value) == want


@given(st.text(alphabet="ab c", max_size=8))
def test_ngrams_are_distinct_and_longest_first(value):
    got = X.ngrams(value)
    assert len(set(got)) == len(got) and [len(t) for t in got] == sorted(map(len, got), reverse=True)


def test_ngram_terms_match_plain(spark):
    rows = ["a b c d", "ab", "", "é𠮷x"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", X.ngram_terms(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == {r: X.ngrams(r) for r in rows}
