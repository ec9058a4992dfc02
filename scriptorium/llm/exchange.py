"""Which hashes occur elsewhere: an exchange of packed blobs.

Documents are packed into batches of a few megabytes of text where they are
read, and stored once. A batch sends its distinct hashes, one blob for each
bucket of hash values; a bucket answers each blob with one bit for each hash. A
hash is sent once by a batch however often it occurs there, so a passage that a
third of all documents share costs a bucket no more than any other, and nothing
is sent to the driver. Both sides derive the same order of hashes from the same
texts, so answers need not repeat them. Lost tasks are computed again from the
stored batches or the checkpointed answers.

The numbers of buckets and tasks follow the measured size of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

#: Bytes of text in a batch, about, and batches in a task.
BATCH_BYTES = 4 << 20
PER_TASK = 4
#: Batches for one bucket, and buckets of a small table at most.
PER_BUCKET = 4
FEW_BUCKETS = 32

DEALT = "batch bigint, n_bytes bigint, blob binary"
KEYS = "bucket int, batch bigint, keys binary"
ANSWERS = "batch bigint, bucket int, bits binary"


@dataclass
class Dealt:
    """Stored batches of documents; how many buckets and tasks suit their size."""

    docs: DataFrame
    buckets: int
    tasks: int

    def by_batch(self, df: DataFrame):
        return df.repartition(self.tasks, "batch").groupBy("batch")

    def by_bucket(self, df: DataFrame):
        return df.repartition(self.tasks, "bucket").groupBy("bucket")


def pack(ids: list[int | None], raws: list[bytes | None]) -> bytes:
    """Documents as one compressed blob."""
    parts = [
        np.array([len(ids)], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
        np.array([len(r or b"") for r in raws], "<i8").tobytes(), *(r or b"" for r in raws),
    ]
    return squeezed(b"".join(parts))


def unpack(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    raw = unsqueezed(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    null, own, sizes = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, "<i8", n, 8 + n), np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    ends = 8 + 17 * n + np.cumsum(sizes)
    ids = [None if x else i for i, x in zip(own.tolist(), null.tolist(), strict=True)]
    return ids, [raw[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _blobs(batches: Iterator[pa.RecordBatch]):
    first, number = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    raws: list[bytes | None] = []
    held = 0

    def out():
        row = [pa.array([first + number]), pa.array([sum(len(r or b"") for r in raws)], pa.int64()), pa.array([pack(ids, raws)], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=["batch", "n_bytes", "blob"])

    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = raw.as_py()
            ids.append(i)
            raws.append(raw)
            held += len(raw or b"") + 32
            if held >= BATCH_BYTES:
                yield out()
                ids, raws, held, number = [], [], 0, number + 1
    if ids:
        yield out()


def deal(docs: DataFrame) -> Dealt:
    """The documents in stored batches of about ``BATCH_BYTES``, where they lie."""
    stored = common.saved(common.texts(docs).mapInArrow(_blobs, DEALT))
    size = stored.agg(F.sum("n_bytes")).first()[0] or 0
    width = common.shuffle_width(docs.sparkSession)
    # Blobs are as many as batches times buckets: buckets follow the table's size,
    # not the number of shuffle partitions.
    buckets = max(min(width, FEW_BUCKETS), size // (BATCH_BYTES * PER_BUCKET))
    return Dealt(stored, buckets, max(width, size // (BATCH_BYTES * PER_TASK)))


def shares(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of sorted distinct ``keys`` by bucket, in the order of the keys."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(bucket[own[0]]), own


def table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows under the names and types of ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


# --- occurs more than once --------------------------------------------------


def send_repeats(batch: int, keys: np.ndarray, several: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of KEYS: the low halves of sorted distinct keys, and whether the
    batch alone holds a key more than once.

    32 bits besides the bucket let a key pass for repeated by chance in about
    one of 2000 cases; what passes is examined in full later.
    """
    return [
        (b, batch, np.packbits(several[own]).tobytes() + keys[own].astype("<u4").tobytes()) for b, own in shares(keys, buckets)
    ]


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = next(n for n in (len(blob) * 8 // 33,) if (n + 7) // 8 + 4 * n == len(blob))
    head = (n + 7) // 8
    return np.frombuffer(blob, "<u4", offset=head), bits(blob[:head], n)


def answer_repeats(rows: pa.Table) -> pa.Table:
    sent = [(b, *_halves(blob)) for b, blob in zip(rows["batch"].to_pylist(), rows["keys"].to_pylist(), strict=True)]
    keys = np.concatenate([k for _, k, _ in sent])
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
    bucket, out = rows["bucket"][0].as_py(), []
    for batch, own, several in sent:
        at = np.searchsorted(twice, own)
        found = np.zeros(len(own), bool)
        if len(twice):
            found = twice[np.minimum(at, len(twice) - 1)] == own
        if (found | several).any():
            out.append((batch, bucket, np.packbits(found | several).tobytes()))
    return table(ANSWERS, out)


def answered(keys: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers put back in the order of the keys; no answer is a no."""
    out = np.zeros(len(keys), bool)
    for b, own in shares(keys, buckets):
        if b in answers:
            out[own] = bits(answers[b], len(own))
    return out


# --- occurs with a smaller value --------------------------------------------


def send_least(batch: int, keys: np.ndarray, least: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of KEYS: sorted distinct digests (two columns of 64 bits), each with its least value."""
    return [
        (b, batch, keys[own].astype("<u8").tobytes() + least[own].astype("<i8").tobytes()) for b, own in shares(keys[:, 0], buckets)
    ]


def answer_least(rows: pa.Table) -> pa.Table:
    """Rows of ANSWERS: which of a batch's digests another has with a lesser value."""
    sent = []
    for b, blob in zip(rows["batch"].to_pylist(), rows["keys"].to_pylist(), strict=True):
        n = len(blob) // 24
        sent.append((b, np.frombuffer(blob, "<u8", 2 * n).reshape(n, 2), np.frombuffer(blob, "<i8", n, 16 * n)))
    keys = np.concatenate([k for _, k, _ in sent])
    values = np.concatenate([v for _, _, v in sent])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    first = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(1)])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    low = np.minimum.reduceat(values[order], np.flatnonzero(first))
    bucket, out, at = rows["bucket"][0].as_py(), [], 0
    for batch, own, least in sent:
        less = low[group[at : at + len(own)]] < least
        at += len(own)
        if less.any():
            out.append((batch, bucket, np.packbits(less).tobytes()))
    return table(ANSWERS, out)


def by_bucket(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))


def squeezed(blob: bytes) -> bytes:
    """Compressed, for rows that wait in the shared folder."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(blob)


def unsqueezed(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)
