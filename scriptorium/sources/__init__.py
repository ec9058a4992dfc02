"""Readers and sinks (S and O rows of the survey)."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Paths of works by role, from entries ``{work, role, path}`` relative to a root."""

    def __init__(self, root: str, entries: list[dict]):
        self.root, self.entries = root, entries

    def path(self, work: str, role: str) -> str:
        for e in self.entries:
            if e["work"] == work and e["role"] == role:
                return e["path"] if "://" in e["path"] or e["path"].startswith("/") else posixpath.join(self.root, e["path"])
        raise KeyError(f"no source for work {work!r}, role {role!r}")

    def whole_text(self, spark: SparkSession, work: str, role: str) -> DataFrame:
        """``path, text``: one row a file."""
        out = spark.read.text(self.path(work, role), wholetext=True)
        return out.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def discovered(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``path, length, sha256`` of the files below a folder; contents aren't collected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def guarded(target: str, source_root: str) -> str:
    """The target, unless it lies within the sources."""
    a, b = posixpath.normpath(target), posixpath.normpath(source_root)
    if a == b or a.startswith(b + "/"):
        raise ValueError("refusing to write into the source tree")
    return target


def records(spark: SparkSession, path: str, schema: str, key: str = "records") -> DataFrame:
    """Rows of the list under ``key`` of JSON documents; other entries are skipped."""
    docs = spark.read.schema(f"{key} array<struct<{schema}>>").json(path, multiLine=True)
    return docs.select(F.explode(key).alias("r")).filter("r IS NOT NULL").select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a line that isn't JSON of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact object a line, keys sorted, null ones included."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.text(path)


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.open: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "h3", "h4", "li", "blockquote"):
            self.open.append([tag, dict(attrs).get("class") or "", []])

    def handle_data(self, data):
        if self.open:
            self.open[-1][2].append(data)

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            kind, cls, parts = self.open.pop()
            if text := " ".join("".join(parts).split()):
                self.found.append((kind, cls, text))


def html_paragraphs(text: str) -> list[tuple[str, str, str]]:
    """``(tag, class, text)`` of the block elements in a page."""
    p = _Paragraphs()
    p.feed(text)
    p.close()
    return p.found


def epub_pages(content: bytes) -> list[tuple[str, str]]:
    """``(name, markup)`` of a book's pages in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        root = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        spine = [e.get("idref") for e in root.iter() if e.tag.endswith("}itemref")]
        names = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[i])) for i in spine if i in items]
        return [(n, z.read(n).decode("utf-8", "replace")) for n in names]


def epub(spark: SparkSession, path: str) -> DataFrame:
    """``path, page_no, page, paragraph_no, tag, class, text`` of EPUB files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (name, markup) in enumerate(epub_pages(content)):
                    rows += [(p, i, name, j, *x) for j, x in enumerate(html_paragraphs(markup))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = ["path", "page_no", "page", "paragraph_no", "tag", "class", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(read, "path string, page_no int, page string, paragraph_no int, tag string, class string, text string")


def locked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files and manifest entries that don't agree: missing, unlisted or changed."""
    a = files.select("path", F.col("sha256").alias("now"))
    b = manifest.select("path", F.col("sha256").alias("listed"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("now") != F.col("listed"), "changed")
    return a.join(b, "path", "full_outer").withColumn("state", state).filter("state IS NOT NULL").select("path", "state")


def volume_number(name: str) -> int | None:
    """The first number in a file name."""
    m = re.search(r"\d+", name)
    return int(m[0]) if m else None


def write_shards(df: DataFrame, path: str, kind: str, buckets: int = 64) -> None:
    """Entity shards that a lookup by kind and id reads one file group of."""
    shard = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets))
    df.withColumn("kind", F.lit(kind)).withColumn("shard", shard).repartition("shard").write.partitionBy("kind", "shard").mode("append").parquet(path)


def read_shard(spark: SparkSession, path: str, kind: str, id_: str, buckets: int = 64) -> DataFrame:
    """The entity's row, by partition pruning on kind and shard."""
    shard = F.pmod(F.xxhash64(F.lit(id_)), F.lit(buckets))
    n = spark.range(1).select(shard).first()[0]
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("shard") == n) & (F.col("id").cast("string") == id_))


def json_object(text: str) -> dict | None:
    """The one JSON object of a reply, with or without a code fence."""
    body = re.sub(r"\A\s*```\w*\s*|\s*```\s*\Z", "", text)
    try:
        out = json.loads(body)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None
