import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium import sources, streaming


def test_catalog(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    catalog = sources.Catalog(str(tmp_path), [{"work": "w", "role": "base", "path": "a.txt"}])
    assert catalog.whole_text(spark, "w", "base").first()["text"] == "one\ntwo"
    with pytest.raises(KeyError):
        catalog.path("w", "other")


def test_guard():
    with pytest.raises(ValueError):
        sources.guarded("/a/src/x", "/a/src")
    assert sources.guarded("/a/out", "/a/src") == "/a/out"


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "b int, a string")
    sources.write_json_lines(df, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    assert sources.json_lines(spark, str(tmp_path / "l"), "a string, b int").count() == 2
    (tmp_path / "d.json").write_text('{"stage":"s","records":[{"id":"1","n":2},null]}')
    assert [tuple(r) for r in sources.records(spark, str(tmp_path / "d.json"), "id string, n int").collect()] == [("1", 2)]


def test_epub(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<p xmlns="u"><manifest><item id="b" href="2.html"/><item id="a" href="1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></p>')
        z.writestr("o/1.html", '<h1>T</h1><p class="x">one &amp; two</p>')
        z.writestr("o/2.html", "<p>three</p>")
    (tmp_path / "b.epub").write_bytes(box.getvalue())
    got = [(r.page_no, r.tag, r["class"], r.text) for r in sources.epub(spark, str(tmp_path / "b.epub")).orderBy("page_no", "paragraph_no").collect()]
    assert got == [(0, "h1", "", "T"), (0, "p", "x", "one & two"), (1, "p", "", "three")]


def test_shards(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    sources.write_shards(df, str(tmp_path / "s"), "story", 4)
    assert sources.read_shard(spark, str(tmp_path / "s"), "story", "17", 4).first()["v"] == 34


def test_lock(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "9"), ("z", "3")], "path string, sha256 string")
    assert {r.path: r.state for r in sources.locked(a, b).collect()} == {"x": "changed", "y": "unlisted", "z": "missing"}


def test_json_object():
    assert sources.json_object('```json\n{"a": 1}\n```') == {"a": 1} and sources.json_object("[1]") is None


def test_stream_agrees_with_batch(spark, tmp_path):
    schema = "feedback_id string, fingerprint string, created_at timestamp, closes string"
    data = [("1", "f", "2024-01-01 00:00:00", None), ("2", "f", "2024-01-01 00:01:00", None), ("3", "g", "2024-01-01 00:02:00", None)]
    df = spark.createDataFrame(data, "feedback_id string, fingerprint string, created_at string, closes string").withColumn("created_at", F.to_timestamp("created_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = streaming.submissions(stream).writeStream.format("memory").queryName("submitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {r.feedback_id: (r.status, r.duplicate_of) for r in spark.table("submitted").collect()}
    want = {r.feedback_id: (r.status, r.duplicate_of) for r in streaming.deduplicated(df, "feedback_id", "created_at").collect()}
    assert got == want


def test_review_transitions(spark):
    store = spark.createDataFrame([("1", "new"), ("2", "rejected")], "feedback_id string, status string")
    changes = spark.createDataFrame([("1", "reviewed"), ("2", "exported")], "feedback_id string, to_status string")
    after, refused = streaming.reviewed(store, changes)
    assert {r.feedback_id: r.status for r in after.collect()} == {"1": "reviewed", "2": "rejected"} and [r.feedback_id for r in refused.collect()] == ["2"]
