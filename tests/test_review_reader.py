from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from scriptorium.operators import reader as D
from scriptorium.operators import review as R
from scriptorium.operators import segment as M


def test_leaks_are_found_at_depth(spark):
    df = spark.sql("SELECT named_struct('a', array(named_struct('gold', 1))) AS x")
    with pytest.raises(ValueError, match="gold"):
        R.no_leaks(df, {"gold"})
    assert R.no_leaks(df, {"other"}) is df


def test_schema_errors_are_returned(spark):
    wanted = StructType([StructField("a", IntegerType()), StructField("b", StringType()), StructField("c", StringType())])
    assert R.schema_errors(spark.sql("SELECT 1 AS a, 2 AS b"), wanted) == ["b: int is not string", "c: missing"]


def test_tool_calls():
    assert R.tool_call_errors({"query": "x", "top_k": 5}) == []
    assert R.tool_call_errors({"query": "", "entity_hints": ["a"] * 13, "top_k": True}) == ["query", "entity_hints", "top_k"]


def test_tool_loop_is_bounded():
    calls = []

    def model(messages):
        calls.append(messages[-1]["content"])
        return {"final": {"n": len(calls)}} if messages[-1]["content"] == "finish now" else {"tool": "search", "arguments": {"q": "x"}}

    assert R.tool_loop(model, {"search": lambda q: [q]}, [{"content": "go"}], rounds=3) == {"n": 4}
    replies = iter([{"final": "text"}, {"final": {"ok": 1}}])
    assert R.tool_loop(lambda m: next(replies), {}, [{"content": "go"}]) == {"ok": 1}
    with pytest.raises(ValueError):
        R.tool_loop(lambda m: {"final": "text"}, {}, [{"content": "go"}])


def test_clock_can_be_given():
    assert R.now_iso(lambda: datetime(2024, 1, 2, tzinfo=UTC)) == "2024-01-02T00:00:00+00:00"


def test_typed_targets(spark):
    people, candidates = spark.createDataFrame([("p", "P")], "id string, name string"), spark.createDataFrame([("c", "C")], "id string, name string")
    data = [(1, "p", None, "P"), (2, "p", "c", "P"), (3, None, None, "P"), (4, "q", None, "Q"), (5, None, "c", "X")]
    rows = spark.createDataFrame(data, "k int, person_id string, candidate_id string, name string")
    assert {r.k: r.state for r in R.typed_targets(rows, people, candidates).collect()} == {1: "ok", 2: "both", 3: "neither", 4: "unknown", 5: "name_differs"}


def test_publication_needs_a_round_trip(spark):
    df = spark.createDataFrame([("reviewed", "a, b", "ab"), ("x", "a, b", "ab"), ("reviewed", "a, c", "ab"), ("reviewed", None, "ab")], "s string, p string, c string")
    got = [r[0] for r in df.select(R.publication_state(F.col("s"), F.col("p"), F.col("c"))).collect()]
    assert got == ["production_ready", "preview_ready", "blocked", "blocked"]


def test_insertion_points():
    assert D.insertion_points([(2, 5), (7, 9)], "ab[x]cd[y") == [2, 4]
    with pytest.raises(ValueError):
        D.insertion_points([(0, 3), (2, 4)], "abcdef")


def test_placement():
    assert D.placed([(0, 4, "p"), (0, 4, "p")]) == [(0, 4, "p")]
    assert D.placed([(0, 4, "p"), (0, 2, "p")]) == [(0, 4, "p")]
    assert D.placed([(0, 4, "p"), (1, 2, "q")]) == [(1, 2, "q")]
    with pytest.raises(ValueError):
        D.placed([(0, 4, "p"), (2, 6, "q")])


def test_exploration():
    x = D.Exploration().visit(("story", "s1")).visit(("person", "p")).visit(("person", "p"))
    assert len(x.nodes) == 2 and x.story() == "s1" and x.story({"s2"}) is None
    assert x.back().nodes == (("story", "s1"),) == x.truncate(0).nodes == x.back().back().nodes


def test_report(spark):
    df = spark.createDataFrame([(2, "x|y"), (1, None)], "k int, t string")
    assert D.markdown_table(df, "T", ["k"]) == "# T\n\n| k | t |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |\n"


def test_provider():
    assert D.Provider.fixture({"a": {"x": 1}}).run({"id": "a"}) == {"x": 1}


def test_pattern_spans_count_code_points(spark):
    df = spark.createDataFrame([(1, "𠮷ab")], "k int, t string")
    assert tuple(M.pattern_spans(df, "k", "t", "ab").first()) == (1, 1, 3, "ab")
