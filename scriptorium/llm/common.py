"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import storage

#: Bytes of words in the contract's word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
#: stay (A-Z lower-cased first); every other byte becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: A-Z to a-z, all else unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


saved, dropped = storage.saved, storage.dropped


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column (in any case) has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps what a Python worker holds at a time to ``BATCH_ROWS`` texts.

    The setting is read when a plan runs, so it stays for the session. The
    default of 10,000 suits rows of numbers; a smaller one of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text binary)``: what the Arrow kernels read."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text.

    A row is never cut: a very long text makes a run of its own.
    """
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


#: Words as the contract's ``[^\x20\x09-\x0D]+``: white space becomes a space ...
SPLIT_BYTES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: ... and the same with A-Z lower-cased.
SPLIT_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))

# The primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many byte strings of one buffer, those of one size at a time."""
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        for own in np.split(order, cuts) if len(order) else []:
            size, at = int(sizes[own[0]]), starts[own].astype(np.int64)
            left = size
            if size >= 32:
                acc = [np.full(len(own), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
                for _ in range(size // 32):
                    for k in range(4):
                        acc[k] = _turned(acc[k] + eights[at + 8 * k] * P2, 31) * P1
                    at = at + 32
                h = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
                for k in range(4):
                    h = (h ^ (_turned(acc[k] * P2, 31) * P1)) * P1 + P4
                left = size % 32
            else:
                h = np.full(len(own), s + P5, np.uint64)
            h = h + np.uint64(size)
            while left >= 8:
                h = _turned(h ^ (_turned(eights[at] * P2, 31) * P1), 27) * P1 + P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _turned(h ^ (fours[at].astype(np.uint64) * P1), 23) * P2 + P3
                at, left = at + 4, left - 4
            while left:
                h = _turned(h ^ (padded[at].astype(np.uint64) * P5), 11) * P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[own] = h ^ (h >> np.uint64(32))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts, laid out in one buffer.

    ``data`` holds the translated bytes with single spaces between words,
    ``starts`` and ``ends`` the words' places in it, and ``first`` the number of
    the first word of each text (one entry more than there are texts).
    """

    def __init__(self, raws: list[bytes | None], rule: bytes):
        data = np.frombuffer(b" ".join([*(r or b"" for r in raws), b""]).translate(rule), np.uint8)
        sizes = np.array([len(r or b"") + 1 for r in raws], np.int64)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        space = data == 32
        twice = space[1:] & space[:-1]
        if twice.any():
            keep = np.concatenate([[True], ~twice])
            limits = np.concatenate([[0], np.cumsum(keep)])[limits]
            data, space = data[keep], space[keep]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, limits)
        self.first[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return xxh64(self.data, self.starts, self.ends - self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def span(self, i: int, j: int) -> bytes:
        """Words i to j, j excluded, joined by single spaces."""
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes.

    No step is linear over a whole run, so sequences whose differences cancel in
    a polynomial (such as a Thue-Morse word and its complement) stay apart.
    """
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries of ``h``, by joining ever longer runs."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, size = h, 1
    while 2 * size <= n:
        out, size = joined(out[:-size], out[size:]), 2 * size
    return joined(out[: len(h) - n + 1], out[n - size :]) if size < n else out if n > 1 else mixed(out)
