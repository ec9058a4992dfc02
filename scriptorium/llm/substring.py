"""Substring dedup over words by difference-cover anchors.

A window is 50 consecutive words of one document. Words are hashed at anchors
only: positions whose remainder modulo 31 is in a set of 6 that holds every
difference modulo 31. Two equal windows, wherever they start, then have an
anchor at the same distance below 31 from their starts, and the 20 words from
there lie within both. Anchor hashes that occur in two documents mark candidates:
each anchor is extended to all windows that hold it, and an extension counts only
where all 50 words agree, which is decided by 128-bit BLAKE2b digests of the
windows' bytes, never by the anchors' 64-bit hashes. The smallest doc_id that
holds a window decides. Both questions are answered by the exchange of
``exchange.py``: no document meets another, and a passage shared by very many
documents is sent once by each batch of documents.

Defined cases: null and empty texts have no words; texts of fewer than 50 words
lose none; rows with the same doc_id do not count as smaller than each other; a
null doc_id counts as larger than every other; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import common, exchange

WINDOW = 50
# A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SPAN = WINDOW - PERIOD + 1
LAST = np.iinfo(np.int64).max

SECOND = "kind string, batch bigint, bucket int, blob binary, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Batch:
    """The words of a batch of documents, and what is derived from them."""

    def __init__(self, doc_ids: list[int | None], raws: list[bytes | None]):
        self.ids = doc_ids
        self.rank = np.array([LAST if i is None else i for i in doc_ids], np.int64)
        self.words = common.Words(raws, common.SPLIT_BYTES)
        self.counts = np.diff(self.words.first)
        self.hashes = self.words.hashes()
        self.owner = np.repeat(np.arange(len(raws)), self.counts)
        self.place = np.arange(len(self.words)) - self.words.first[self.owner]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors in documents that hold a window, and their hashes."""
        spans = common.runs(self.hashes, SPAN)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        n = len(spans)
        ok = cover[self.place[:n] % PERIOD] & (self.place[:n] + SPAN <= self.counts[self.owner[:n]])
        ok &= self.counts[self.owner[:n]] >= WINDOW
        at = np.flatnonzero(ok)
        return at, spans[at]

    def distinct(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and whether several documents hold them."""
        rank = self.rank[self.owner[at]]
        order = np.argsort(keys, kind="stable")
        keys, rank = keys[order], rank[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return keys, np.zeros(0, bool)
        return keys[first], np.minimum.reduceat(rank, first) < np.maximum.reduceat(rank, first)

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of windows that some anchor of ``at`` lies in, with its span."""
        if not len(at):
            return np.zeros(0, np.int64)
        low = np.maximum(at - (PERIOD - 1), self.words.first[self.owner[at]])
        high = np.minimum(at, self.words.first[self.owner[at] + 1] - WINDOW)
        step = np.zeros(len(self.words) + 1, np.int64)
        some = low <= high
        np.add.at(step, low[some], 1)
        np.add.at(step, high[some] + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Digests of the windows at ``starts``, as two columns of 64 bits."""
        data = memoryview(np.ascontiguousarray(self.words.data))
        low, high = self.words.starts[starts].tolist(), self.words.ends[starts + WINDOW - 1].tolist()
        out = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(low, high, strict=True)])
        return np.frombuffer(out, "<u8").reshape(-1, 2)

    def least(self, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct digests, their least rank here, and where each start's is."""
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        first = np.ones(len(order), bool)
        first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        low = np.full(int(first.sum()), LAST, np.int64)
        np.minimum.at(low, which, self.rank[self.owner[starts]])
        return keys[order[first]], low, which

    def digest(self, i: int, removed: np.ndarray | None = None) -> tuple[int, str]:
        """Number of words removed from document i, and the hash of the rest."""
        a, b = int(self.words.first[i]), int(self.words.first[i + 1])
        if removed is None or not removed.any():
            return 0, hashlib.sha256(self.words.span(a, b)).hexdigest()
        kept = np.flatnonzero(~removed)
        edges = np.flatnonzero(np.diff(kept) > 1)
        runs = zip(np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(kept) - 1]]), strict=True) if len(kept) else ()
        text = b" ".join(self.words.span(a + int(kept[x]), a + int(kept[y]) + 1) for x, y in runs)
        return int(removed.sum()), hashlib.sha256(text).hexdigest()


def _steps(places: np.ndarray) -> bytes:
    """Rising numbers as differences, mostly 1, which compress to little."""
    return np.diff(places, prepend=0).astype("<i4").tobytes()


def _first(batches: Iterator[pa.RecordBatch], buckets: int):
    for rows in batches:
        for batch, blob in zip(rows.column(0).to_pylist(), rows.column(2), strict=True):
            b = Batch(*exchange.unpack(blob.as_py()))
            keys, several = b.distinct(*b.anchors())
            yield from exchange.table(exchange.KEYS, exchange.send_repeats(batch, keys, several, buckets)).to_batches()


def _second(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Finished documents, documents with candidates, and window hashes."""
    out: list[tuple] = []
    for batch, blob in zip(rows["batch"].to_pylist(), rows["blob"], strict=True):
        ids, texts = exchange.unpack(blob.as_py())
        b = Batch(ids, texts)
        starts = np.zeros(0, np.int64)
        if answers.num_rows:
            at, spans = b.anchors()
            keys, _ = b.distinct(at, spans)
            repeated = keys[exchange.answered(keys, buckets, exchange.by_bucket(answers))]
            starts = b.candidates(at[np.isin(spans, repeated)])
        some = set(np.unique(b.owner[starts]).tolist())
        cuts = np.searchsorted(starts, b.words.first)
        for i, doc_id in enumerate(b.ids):
            if i in some:
                own = _steps(starts[cuts[i] : cuts[i + 1]] - b.words.first[i])
                blob = exchange.squeezed(len(own).to_bytes(8, "little") + own + texts[i])
                out.append(("doc", batch, None, blob, doc_id, None, None, None))
            else:
                n, digest = b.digest(i)
                out.append(("done", batch, None, None, doc_id, int(b.counts[i]), n, digest))
        keys, low, _ = b.least(starts, b.windows(starts))
        out += [("keys", batch, bucket, blob, None, None, None, None) for bucket, _, blob in exchange.send_least(batch, keys, low, buckets)]
    return exchange.table(SECOND, out)


def _third(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The documents with candidates, judged."""
    out: list[tuple] = []
    if rows.num_rows:
        raws, places = [], []
        for blob in rows["blob"].to_pylist():
            blob = exchange.unsqueezed(blob)
            n = int.from_bytes(blob[:8], "little")
            places.append(np.cumsum(np.frombuffer(blob, "<i4", n // 4, 8), dtype=np.int64))
            raws.append(blob[8 + n :])
        b = Batch(rows["doc_id"].to_pylist(), raws)
        starts = np.concatenate([p + b.words.first[i] for i, p in enumerate(places)])
        keys, low, which = b.least(starts, b.windows(starts))
        less = exchange.answered(keys[:, 0], buckets, exchange.by_bucket(answers))
        gone = less[which] | (low[which] < b.rank[b.owner[starts]])
        step = np.zeros(len(b.words) + 1, np.int64)
        np.add.at(step, starts[gone], 1)
        np.add.at(step, starts[gone] + WINDOW, -1)
        removed = np.cumsum(step[:-1]) > 0
        for i, doc_id in enumerate(b.ids):
            n, digest = b.digest(i, removed[b.words.first[i] : b.words.first[i + 1]])
            out.append((doc_id, int(b.counts[i]), n, digest))
    return exchange.table(RESULT, out)


def repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``."""
    dealt = exchange.deal(docs)
    buckets = dealt.buckets
    sent = dealt.docs.mapInArrow(lambda it: _first(it, buckets), exchange.KEYS)
    answers = common.saved(dealt.by_bucket(sent).applyInArrow(exchange.answer_repeats, exchange.ANSWERS))
    second = common.saved(
        dealt.by_batch(dealt.docs).cogroup(dealt.by_batch(answers)).applyInArrow(lambda rows, own: _second(rows, own, buckets), SECOND)
    )
    common.dropped(dealt.docs, answers)
    keys = second.filter("kind = 'keys'").selectExpr("bucket", "batch", "blob AS keys")
    less = dealt.by_bucket(keys).applyInArrow(exchange.answer_least, exchange.ANSWERS)
    held = second.filter("kind = 'doc'").select("batch", "doc_id", "blob")
    judged = dealt.by_batch(held).cogroup(dealt.by_batch(less)).applyInArrow(lambda rows, own: _third(rows, own, buckets), RESULT)
    return second.filter("kind = 'done'").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(judged)
