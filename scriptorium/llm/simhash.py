"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits, by majority over XXH64 hashes of 3-word shingles.
Equal fingerprints are grouped first. Distinct ones are cut into tiles of
fingerprints with the same population counts in each of ``segments`` equal
parts of the 64 bits. Two fingerprints within the radius have counts whose
absolute differences sum to at most the radius, so only such tile pairs meet;
they are found by an equi-join of tiles on neighbouring counts, and compared
whole with numpy exclusive-or and bit counts. Tiles are bounded, so is the
memory of a pair; a crowded tile class gives more tiles, not larger ones, is
dealt by ranges, and is cut into parts that meet their neighbours apart. The
number of segments follows the number of distinct fingerprints, so that the
tiles of a class stay few while classes stay well filled.

Components are the connected components over all links, by repeated
minimum-label propagation with pointer jumping on tables in the shared folder.

Defined cases: null and empty texts have fingerprint zero; texts of one or two
words hash the whole sequence; rows with the same doc_id are fingerprinted each
and belong to the component of each of their fingerprints; a null doc_id is
passed through and takes no part as a representative unless it is alone; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import common
from scriptorium.operators import graph

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a tile, at most.
TILE = 1024
#: Tiles of a class that one key of the join of tiles holds, about.
PART = 16
#: Crowded classes whose sizes are broadcast, at most; beyond it a plain join.
CROWDED = 1 << 18
#: A fingerprint is crowded if it holds more than one row in so many.
CROWD = 1000
#: Distinct fingerprints up to which so many segments serve.
SEGMENTS = ((1 << 17, 2), (1 << 23, 4), (1 << 33, 8), (1 << 62, 16))

def fingerprints(raws: list[bytes | None]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(raws), np.uint64)
    w = common.Words(raws, common.SPLIT_LOWER)
    counts = np.diff(w.first)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    number = np.maximum(counts[some] - SHINGLE + 1, 1)
    begin = np.cumsum(number) - number
    word = np.arange(number.sum()) - np.repeat(begin - w.first[some], number)
    last = word + np.repeat(np.minimum(counts[some], SHINGLE), number) - 1
    starts = w.starts[word]
    h = common.xxh64(w.data, starts, w.ends[last] - starts, SEED)
    most = 1 << 16
    ones = np.zeros((len(some), 64), np.int64)
    owner = np.repeat(np.arange(len(some)), number)
    for at in range(0, len(h), most):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + most].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + most]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    major = (2 * ones > number[:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]):
    for whole in batches:
        for batch in common.slices(whole, 1, 1 << 20):
            f = fingerprints(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], names=["doc_id", "f"])


def _printed(batches: Iterator[pa.RecordBatch]):
    """Batches whose last column, a text, becomes its fingerprint."""
    for whole in batches:
        for batch in common.slices(whole, whole.num_columns - 1, 1 << 20):
            f = fingerprints(batch.column(batch.num_columns - 1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(f)], names=batch.schema.names)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``(doc_id, f)``: the fingerprint as a signed 64-bit number."""
    return common.texts(docs).mapInArrow(_fingerprints, "doc_id bigint, f bigint")


def _counts(f, segments: int):
    """Population counts of the segments, as one key."""
    width = 64 // segments
    parts = [F.bit_count(F.shiftrightunsigned(f, k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(segments)]
    return F.concat_ws(",", *[p.cast("string") for p in parts])


def _offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Count differences within the radius, one of each opposite pair."""
    out = {(0,) * segments}
    for _ in range(radius):
        out |= {
            tuple(v + (d if i == k else 0) for i, v in enumerate(o))
            for o, k, d in product(out, range(segments), (-1, 1))
        }
    return sorted(o for o in out if o >= (0,) * segments and sum(map(abs, o)) <= radius)


def _spanning(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n links that connect what the links (x, y) connect."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            own = np.flatnonzero(label != np.arange(n))
            return own, label[own]
        label = low


def _compare(batches: Iterator[pa.RecordBatch], radius: int):
    """Links of tile pairs (a, b); within one tile each pair once.

    Where a pair of tiles has more links than members, as in a group of near
    copies, links that span the same components stand for them.
    """
    for batch in batches:
        same = batch.column(0).to_pylist()
        left, right = [], []
        for i in range(batch.num_rows):
            a = np.frombuffer(batch.column(1)[i].as_py(), "<u8")
            b = np.frombuffer(batch.column(2)[i].as_py(), "<u8")
            n_b, found = len(b), []
            for at in range(0, len(a), 256):
                near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
                x, y = np.nonzero(near)
                x += at
                if same[i]:
                    x, y = x[x < y], y[x < y]
                found.append((x, y))
            x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            if len(x) > len(a) + len(b):
                a = b = a if same[i] else np.concatenate([a, b])
                x, y = _spanning(len(a), x, y if same[i] else y + len(a) - n_b)
            left.append(a[x])
            right.append(b[y])
        empty = [np.zeros(0, "<u8")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left or empty).view(np.int64)), pa.array(np.concatenate(right or empty).view(np.int64))], names=["src", "dst"]
        )


def _tile(batches: Iterator[pa.RecordBatch]):
    """Blobs of up to TILE fingerprints of a class, from rows sorted by class."""
    def blobs(key: str, values: np.ndarray):
        for at in range(0, len(values), TILE):
            yield key, values[at : at + TILE].astype("<u8").tobytes()

    def out(rows):
        keys, data = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], names=["counts", "tile"])

    last, kept = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        rows = []
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[a] != last:
                if kept:
                    rows += blobs(last, np.concatenate(kept))
                last, kept = keys[a], []
            kept.append(values[a:b])
            if sum(map(len, kept)) >= TILE:
                whole = np.concatenate(kept)
                full = len(whole) // TILE * TILE
                rows += blobs(last, whole[:full])
                kept = [whole[full:]] if full < len(whole) else []
        yield out(rows)
    if kept:
        yield out(list(blobs(last, np.concatenate(kept))))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)``: links that connect all of ``distinct(f)`` within ``radius``.

    Every two fingerprints within the radius are compared; a crowded tile pair
    gives links that span its components instead of all of them.
    """
    n = distinct.count()
    segments = next(s for most, s in SEGMENTS if n <= most)
    classes = distinct.select(_counts(F.col("f"), segments).alias("counts"), "f")
    tiles = (
        classes.repartitionByRange("counts", "f")  # ranges cut a crowded class
        .sortWithinPartitions("counts", "f")
        .mapInArrow(_tile, "counts string, tile binary")
        .withColumn("tile_id", F.xxhash64("tile"))
    )
    tiles = common.saved(tiles)
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in _offsets(segments, radius)])
    parts = F.split("counts", ",").cast("array<int>")
    home = (
        tiles.withColumn("offset", F.explode(offsets))
        .withColumn("to", F.zip_with(parts, "offset", lambda a, b: a + b))
        .select(
            F.concat_ws(",", F.col("to").cast("array<string>")).alias("counts"),
            F.forall("offset", lambda v: v == 0).alias("own"),
            F.col("tile").alias("a"),
            F.col("tile_id").alias("a_id"),
        )
    )
    # A crowded class is cut into parts of its tiles; tiles that meet it are copied to each part.
    crowded = common.saved(
        tiles.groupBy("counts").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    )
    sizes = F.broadcast(crowded) if crowded.count() <= CROWDED else crowded
    count = F.coalesce("parts", F.lit(1))
    left = home.join(sizes, "counts", "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts")
    right = tiles.join(sizes, "counts", "left").withColumn("part", F.pmod("tile_id", count).cast("int")).drop("parts")
    pairs = left.join(right.withColumnRenamed("tile", "b"), ["counts", "part"]).filter(~F.col("own") | (F.col("a_id") <= F.col("tile_id")))
    spread = pairs.select((F.col("own") & (F.col("a_id") == F.col("tile_id"))).alias("same"), "a", "b")
    return spread.mapInArrow(lambda it: _compare(it, radius), "src bigint, dst bigint")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    prints = common.saved(fingerprinted(docs))
    classes = common.saved(prints.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    near = links(classes.select("f"), radius)
    named = (
        near.join(classes.select(F.col("f").alias("src"), F.col("least").alias("a")), "src")
        .join(classes.select(F.col("f").alias("dst"), F.col("least").alias("b")), "dst")
        .select("a", "b")
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    )
    linked = graph.components(named, "a", "b")
    least = (
        classes.join(linked.withColumnRenamed("node", "least"), "least", "left")
        .select("f", F.coalesce("component", "least").alias("component_id"))
    )
    # Rows of a fingerprint that holds over 1 / CROWD of all rows are spread over
    # salted copies of its class; there are less than CROWD such fingerprints.
    width, total = min(common.shuffle_width(docs.sparkSession), 32), prints.count()
    crowded = classes.filter(F.col("n") * CROWD > total).select("f", F.lit(width).alias("copies"))
    copies, crowded = F.coalesce("copies", F.lit(1)), F.broadcast(crowded)
    salted = least.join(crowded, "f", "left").select("f", "component_id", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    return (
        prints.join(crowded, "f", "left")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), copies).cast("int"))
        .join(salted, ["f", "salt"])
        .select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, the smallest by
    (doc_id, fingerprint, text).

    Rows that share a doc_id are linked by their texts only. All columns stay as
    they were. Rows without a doc_id stay and take no part.
    """
    prints = common.saved(fingerprinted(docs.filter("doc_id IS NOT NULL")))
    classes = common.saved(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    linked = graph.components(links(classes.select("f"), radius), "src", "dst")
    named = classes.join(linked.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    own, print_, other, number = common.unused(docs.columns, "own", "print", "other", "number")
    # Fingerprints are ordered as they are written, that is, unsigned.
    first = F.min(F.struct("least", F.lpad(F.lower(F.hex("f")), 16, "0").alias("print"), "f"))
    keep = common.saved(named.groupBy("component").agg(first.alias("first")).select(F.col("first.least").alias(own), F.col("first.f").alias(other)))
    here = F.col("doc_id") == F.col(own)
    kept = docs.join(keep.select(own).distinct(), here, "left_semi")
    shared = common.saved(prints.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(own)))
    single = kept.join(shared, here, "left_anti")

    # Only rows of a shared doc_id have to be told apart, by their fingerprints.
    # An opaque step, so that it stays above the shuffle that both branches read.
    shape = T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])
    told = kept.join(shared, here, "left_semi").withColumn(print_, F.col("text").cast("binary")).mapInArrow(_printed, shape)
    told = told.join(keep, here & (F.col(print_) == F.col(other)), "left_semi")
    order = Window.partitionBy("doc_id", print_).orderBy("text", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    told = told.withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(told).unionByName(docs.filter("doc_id IS NULL"))
