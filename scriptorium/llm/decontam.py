"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (an item of fewer words is
one window). Of every 5 consecutive 9-word hashes the smallest is kept, on both
sides: 13 shared words hold 5 such hashes, so the same one is kept in the
document and in the item, wherever the span lies. Document fingerprints are
joined with the benchmark's, and each meeting is extended word by word in both
directions as far as a window can reach from it; a run of 13 words or more is
hit. Places of the benchmark with the same words around them are one place with
several items, so a text that repeats itself meets each kind of place once, and
the work is in proportion to the document. Items of fewer than 13 words are found
by the hash of all their words, at every place of a document.

The join is a hash join whose benchmark side is broadcast, in blocks of about
``BLOCK_WORDS`` words (a longer item is cut into parts that overlap by a window
less one word); documents pass block after block without a shuffle. Nothing about
documents reaches the driver.

Defined cases: null and empty texts have no words and are not contaminated;
items without words occur nowhere; repeated item_ids count once; null item_ids
count as the string "null"; rows with the same doc_id are judged each; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from scriptorium.llm import common

WINDOW = 13
GRAM = 9
#: A document is contaminated if this many times its hit words reach its words.
RATIO = 20
BLOCK_WORDS = 1 << 20
MASK_BITS = 22


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive hashes."""
    out = grams[: max(0, len(grams) - width + 1)]
    for k in range(1, width):
        out = np.minimum(out, grams[k : k + len(out)])
    return out


class Index:
    """The fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.width = window, gram, window - gram + 1
        self.ids = [i for i, _ in items]
        w = common.Words([t for _, t in items], common.WORD_BYTES)
        hashes = w.hashes()
        around = window - gram
        #: By hash: the words around a fingerprint, its place among them, and the items that have them.
        self.places: dict[int, list[tuple[list[bytes], int, list[int]]]] = {}
        found = defaultdict(lambda: defaultdict(set))
        self.words: dict[int, list[bytes]] = {}
        self.short = defaultdict(lambda: defaultdict(set))
        for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= window:
                words = [w.word(i) for i in range(a, b)]
                grams = common.runs(hashes[a:b], gram)
                kept = np.flatnonzero(np.isin(grams, winnowed(grams, self.width)))
                for at, h in zip(kept.tolist(), grams[kept].tolist(), strict=True):
                    low = max(0, at - around)
                    found[h][(at - low, *words[low : at + gram + around])].add(k)
            elif b > a:
                self.words[k] = [w.word(i) for i in range(a, b)]
                self.short[b - a][int(common.runs(hashes[a:b], b - a)[0])].add(k)
        for h, kinds in found.items():
            self.places[h] = [(list(x[1:]), x[0], sorted(v)) for x, v in kinds.items()]
        self.short = {n: {h: sorted(v) for h, v in x.items()} for n, x in self.short.items()}
        self.mask = self._mask(self.places)
        self.short_mask = {n: self._mask(x) for n, x in self.short.items()}

    @staticmethod
    def _mask(keys) -> np.ndarray:
        mask = np.zeros(1 << MASK_BITS, bool)
        mask[(np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
        return mask

    def hits(self, raws: list[bytes | None]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words of each text; for texts with hits, the word runs and the items."""
        w = common.Words(raws, common.WORD_BYTES)
        first = w.first
        counts = np.diff(first).tolist()
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not len(w) or not (self.places or self.short):
            return counts, found
        hashes = w.hashes()
        owner = np.repeat(np.arange(len(raws)), counts)
        if self.places and len(w) >= self.window:
            grams = common.runs(hashes, self.gram)
            least = winnowed(grams, self.width)
            ok = owner[: len(least)] == owner[self.window - 1 :]
            at = np.flatnonzero(ok & self.mask[(least >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
            near = at[:, None] + np.arange(self.width)
            doc, own = -1, []
            for g in np.unique(near[grams[near] == least[at][:, None]]).tolist():
                for words, p, items in self.places.get(int(grams[g]), ()):
                    if owner[g] != doc:
                        doc = int(owner[g])
                        low = int(first[doc])
                        own = [w.word(i) for i in range(low, int(first[doc + 1]))]
                    self._extend(own, g - low, words, p, items, doc, found)
        for n, wanted in self.short.items():
            if len(w) < n:
                continue
            grams = common.runs(hashes, n)
            ok = owner[: len(grams)] == owner[n - 1 :]
            at = np.flatnonzero(ok & self.short_mask[n][(grams >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
            for j in at.tolist():
                for item in wanted.get(int(grams[j]), ()):
                    if [w.word(i) for i in range(j, j + n)] == self.words[item]:
                        low = int(first[owner[j]])
                        self._note(found, int(owner[j]), j - low, j + n - low, [item])
        return counts, found

    def _extend(self, own: list[bytes], g: int, words: list[bytes], p: int, items: list[int], doc: int, found) -> None:
        """Extends equal grams at place ``g`` of a text and place ``p`` of ``words``."""
        if own[g : g + self.gram] != words[p : p + self.gram]:
            return
        a, b = g, g + self.gram
        while a > 0 and p - (g - a) > 0 and own[a - 1] == words[p - (g - a) - 1]:
            a -= 1
        while b < len(own) and p + (b - g) < len(words) and own[b] == words[p + (b - g)]:
            b += 1
        if b - a >= self.window:
            self._note(found, doc, a, b, items)

    def _note(self, found, doc: int, a: int, b: int, items: list[int]) -> None:
        spans, names = found.setdefault(doc, ([], set()))
        if not spans or spans[-1] != (a, b):
            spans.append((a, b))
        names.update(self.ids[i] for i in items)


def covered(spans: np.ndarray) -> int:
    """Places in the union of half-open spans."""
    total, end = 0, -1
    for a, b in sorted(map(tuple, spans.tolist())):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _pass(batches: Iterator[pa.RecordBatch], held):
    """Adds one block's hits to rows of (doc_id, text, n_words, spans, items)."""
    index = held.value
    for whole in batches:
        for batch in common.slices(whole, 1, 1 << 20):
            counts, found = index.hits(batch.column(1).to_pylist())
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, (s, names) in found.items():
                spans[i] = (spans[i] or b"") + np.array(s, "<i8").tobytes()
                items[i] = sorted({*(items[i] or ()), *names})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )


def _digest(n_words: int, spans: bytes | None, items: list[str] | None) -> tuple:
    n_hit = covered(np.frombuffer(spans, "<i8").reshape(-1, 2)) if spans else 0
    names = hashlib.sha256(",".join(sorted(items or ())).encode()).hexdigest()
    return n_hit, len(items or ()), names, n_hit > 0 and RATIO * n_hit >= n_words


def _digests(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        n_words = batch.column(1).to_pylist()
        rows = [_digest(*x) for x in zip(n_words, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        n_hit, n_items, names, bad = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(names, pa.string()), pa.array(bad, pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes over the items, of a bounded number of words each.

    Items come to the driver one partition at a time and leave it with their
    block; a word takes two bytes at least, which bounds a block.
    """
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")
    ).filter(F.octet_length("text") > 0)
    held, size = [], 0
    for r in rows.toLocalIterator():
        for part in _parts(bytes(r["text"]), most):
            held.append((r["item_id"], part))
            size += len(part)
            if size >= 2 * most:
                yield Index(held)
                held, size = [], 0
    if held:
        yield Index(held)


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """An item as it is, or in parts that hold every window of it, if it alone fills a block."""
    if len(text) <= 2 * most or len(words := text.translate(common.WORD_BYTES).split()) <= max(most, WINDOW):
        yield text
        return
    step = max(most, WINDOW)
    for at in range(0, len(words) - WINDOW + 1, step):
        yield b" ".join(words[at : at + step + WINDOW - 1])


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    schema = "doc_id bigint, text binary, n_words bigint, spans binary, items array<string>"
    out = common.texts(docs).selectExpr("doc_id", "text", "0L AS n_words", "CAST(NULL AS binary) AS spans", "CAST(NULL AS array<string>) AS items")
    used = []
    for k, index in enumerate([Index([])] if benchmark.isEmpty() else blocks(benchmark)):
        held = spark.sparkContext.broadcast(index)
        if k and k % 8 == 0:
            out = common.saved(out)
            while used:
                used.pop().unpersist()
        used.append(held)
        out = out.mapInArrow(lambda it, held=held: _pass(it, held), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` by row."""
    return _hits(docs, benchmark).select("doc_id", "n_words", "spans", "items").mapInArrow(
        _digests, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were.

    One block (the usual case) filters in place. With more, each filter only
    collects that block's spans beside the row, and the last one decides.
    """
    spark = docs.sparkSession
    common.small_batches(docs.sparkSession)
    columns, (spans,) = docs.columns, common.unused(docs.columns, "spans")
    out, used = docs.withColumn(spans, F.lit(None).cast("binary")), []
    for k, index in enumerate([] if benchmark.isEmpty() else blocks(benchmark)):
        held = spark.sparkContext.broadcast(index)
        if k and k % 8 == 0:
            out = common.saved(out)
            while used:
                used.pop().unpersist()
        used.append(held)
        out = out.withColumn(spans, _more_spans(held)(F.col("text").cast("binary"), F.col(spans)))
    return out.filter(~_bad(F.col("text").cast("binary"), F.col(spans))).select(*[F.col(f"`{c}`") for c in columns])


def _more_spans(held):
    @F.arrow_udf("binary")
    def more(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = spans.to_pylist()
        batch = pa.RecordBatch.from_arrays([spans, text], names=["spans", "text"])
        at = 0
        for part in common.slices(batch, 1, 1 << 20):
            for i, (s, _) in held.value.hits(part.column(1).to_pylist())[1].items():
                out[at + i] = (out[at + i] or b"") + np.array(s, "<i8").tobytes()
            at += part.num_rows
        return pa.array(out, pa.binary())

    return more


@F.arrow_udf(BooleanType())
def _bad(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for raw, s in zip(text, spans, strict=True):
        if not s.is_valid:
            out.append(False)
            continue
        n_words = len(common.Words([raw.as_py()], common.WORD_BYTES))
        out.append(_digest(n_words, s.as_py(), None)[3])
    return pa.array(out, pa.bool_())
