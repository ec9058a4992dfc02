"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths, which has at most ``capacity`` rows whatever the corpus holds,
comes to the driver. There each bin's fullest feasible combination is found by
a bitset subset-sum dynamic program over the lengths still available; the
combination is removed, as many times as the stock allows. The resulting table
of patterns is bounded by the capacity too. A piece finds its sequence from its
rank among the pieces of its length, and ranks come from counts by
(length, bucket), so that no length is ever gathered in one task.

Defined cases: null and empty texts are documents of the end token alone;
texts over the capacity are cut, the last piece may be shorter; rows with the
same doc_id are packed each; an empty table gives an empty result; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

# --- tokens ---------------------------------------------------------------

#: Fixed value: the vocabulary's pre-token pattern, for texts without characters
#: outside Latin letters, digits and the signs of ``PLAIN``.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
#: Characters for which ``PRETOKEN`` and the vocabulary's own classes agree.
PLAIN = re.compile("[\t-\r\x20-\x7e¡-©«-±´¶-¸»¿À-ſ‐-‧‹›€]*")


class WordBpe:
    """Ids of the lower-casing byte-pair vocabulary with word ends.

    A merge table with end-of-word marks equals one over bytes in which every
    word carries a trailing space, so a plain byte-pair encoder applies it in
    one call for a whole text. Texts with other characters, or with the strings
    of special tokens, go through the vocabulary's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        self.fast = tiktoken.Encoding("word-bpe", pat_str="[^ ]+ ", mergeable_ranks=self._ranks(), special_tokens={})

    def _ranks(self) -> dict[bytes, int]:
        """The vocabulary as bytes, a word's end as a space."""
        with open(self.path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {}
        for token, i in vocab.items():
            ends = token.endswith("</w>") and token != "</w>"
            ranks[bytes(to_byte[c] for c in (token[:-4] if ends else token)) + b" " * ends] = i
        return ranks

    @cached_property
    def full(self):
        """The vocabulary's own tokenizer, read when a text first needs it; its cache of words is bounded."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.model._resize_cache(1 << 12)
        return out

    def __call__(self, text: str) -> np.ndarray:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        text = unicodedata.normalize("NFC", text)
        if "<|" in text or "İ" in text or not PLAIN.fullmatch(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        words = PRETOKEN.findall(text.lower())
        if not words:
            return np.zeros(0, "<u4")
        return self.fast.encode_to_numpy(" ".join(words) + " ").astype("<u4", copy=False)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for a path and worker process."""
    return WordBpe(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int):
    encode, schema = word_bpe(path), None
    for batch in batches:
        doc, piece, start, length, crc = [], [], [], [], []
        ids = batch.column(0).to_pylist()
        for i, raw in enumerate(batch.column(1)):
            raw = raw.as_py()
            tokens = np.append(encode(raw.decode("utf-8", "replace")) if raw else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4", copy=False)
            for k, at in enumerate(range(0, len(tokens), capacity)):
                part = tokens[at : at + capacity]
                doc.append(ids[i])
                piece.append(k)
                start.append(at)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        schema = schema or pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip((doc, piece, start, length, crc), schema, strict=True)], schema=schema
        )


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids, the end token included."""
    return common.texts(docs).mapInArrow(lambda it: _pieces(it, path, capacity, end_id), PIECES)


# --- plan -----------------------------------------------------------------


def fullest(lengths: list[int], stock: dict[int, int], room: int) -> dict[int, int]:
    """The combination of stocked lengths with the largest sum up to ``room``.

    Subset-sum over a bitset: bit s says that the sum s can be reached. Stocks
    of one length enter as runs of 1, 2, 4, ... copies. ``lengths`` descend, so
    that long pieces are used where either would do.
    """
    reach, mask, goal, steps = 1, (1 << (room + 1)) - 1, 1 << room, []
    for length in lengths[bisect_right(lengths, -room - 1, key=lambda x: -x) :]:
        left, run = min(stock[length], room // length), 1
        while left > 0 and not reach & goal:
            take = min(run, left)
            if (after := reach | (reach << (length * take)) & mask) != reach:
                steps.append((length, take, reach))
                reach = after
            left, run = left - take, run * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``[(bins, {length: pieces in each})]`` that use up the histogram.

    Every bin takes the longest piece left, which some bin must hold, and the
    combination that fills the rest best. A combination is repeated while its
    stock lasts, so the work depends on the capacity and not on the corpus.
    """
    stock = {n: c for n, c in histogram.items() if c > 0}
    lengths, out = sorted(stock, reverse=True), []
    while lengths:
        seed = lengths[0]
        stock[seed] -= 1
        chosen = fullest(lengths, stock, capacity - seed)
        stock[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(stock[n] // k for n, k in chosen.items())
        out.append((times, chosen))
        for n, k in chosen.items():
            stock[n] -= k * times
        lengths = [n for n in lengths if stock[n]] if any(not stock[n] for n in chosen) else lengths
    return out


class Places:
    """Where the r-th piece of a length goes, as sorted arrays by length."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for times, chosen in patterns:
            at = 0
            for n, k in sorted(chosen.items(), reverse=True):
                by_length.setdefault(n, []).append((used.get(n, 0), first, k, at))
                used[n] = used.get(n, 0) + k * times
                at += n * k
            first += times
        self.rows = {n: np.array(v, "i8") for n, v in by_length.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, from their lengths and ranks from 0."""
        sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[own[0]])
            rows = self.rows[n]
            used, first, k, at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
            since = rank[own] - used
            sequence[own], offset[own] = first + since // k, at + since % k * n
        return sequence, offset


def _place(batches: Iterator[pa.RecordBatch], places: Places):
    for batch in batches:
        t = pa.Table.from_batches([batch])
        sequence, offset = places.of(t["length"].to_numpy(), t["rank"].to_numpy())
        t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches()


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of :func:`pieces`.

    ``cut`` should be stored (:func:`common.saved`): it is read three times.
    """
    width = common.shuffle_width(cut.sparkSession)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    )
    return ranked.mapInArrow(lambda it: _place(it, places), f"{PIECES}, sequence_id bigint, offset bigint")


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents packed into as few sequences of ``capacity`` tokens as found."""
    return pack(common.saved(pieces(docs, path, capacity, end_id)), capacity)
