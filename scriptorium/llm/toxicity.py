"""Toxicity: a character n-gram linear classifier on naive Bayes features.

The features of a text are the counts of its hashed character n-grams (bytes,
A-Z lower-cased), divided by the text's length and scaled by the log-count
ratio that naive Bayes gives the n-gram on labelled texts. A logistic
regression over the scaled features gives the score. The model is fitted on a
documented, bounded sample of labelled rows (``SAMPLE_ROWS`` rows, those whose
hashed ids are smallest, of any length). A second model, fitted without every
fifth text of the sample, scores these; the intercept is moved so that the score
0.5 is the least margin at which at most ``MOST_FALSE`` of the label 0 among them
would be taken for label 1, since a text that the classifier merely suspects
scores far below one half otherwise. Every text is scored whole, in one pass
without a shuffle.

Defined cases: null and empty texts have no n-gram and get the model's
intercept; labels that are null or other than 0 and 1 are no labels; without
both labels in the sample every score is the share of label 1 (0.0 without
rows), kept below 0.5 so that nothing is rejected on no evidence; rows with the
same doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

ORDERS = (3, 4, 5)
BITS = 20
SAMPLE_ROWS = 6000
#: Share of label 0 that may reach the score 0.5 in the sample's own check, at most.
MOST_FALSE = 0.01
#: A text's length enters as n-grams per ``PER`` characters.
PER = 50.0
#: Held-out rows: crc32 of the id as text has this remainder.
FOLDS, HELD_OUT = 5, 0


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams at every place of the bytes, order by order."""
    codes = data.astype(np.uint32)
    h = codes
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            x ^= x >> np.uint32(13)
            yield (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _framed(raw: bytes | None) -> bytes:
    return b" " + raw.translate(common.ASCII_LOWER) + b" " if raw else b""


@dataclass
class Model:
    """``weight`` holds log-count ratio times coefficient by hashed n-gram."""

    weight: np.ndarray
    intercept: float

    def score(self, raws: list[bytes | None], most: int = 1 << 20) -> np.ndarray:
        """Probability of label 1 for each text, read whole.

        Texts are laid end to end; sums run over each text's own n-grams, so a
        score does not depend on its neighbours. Texts over ``most`` bytes are
        summed in overlapping runs.
        """
        total = np.zeros(len(raws))
        sizes = np.zeros(len(raws))
        parts, owner = [], []
        for i, raw in enumerate(raws):
            data = _framed(raw)
            sizes[i] = len(data)
            for at in range(0, len(data), most):
                parts.append(data[at : at + most + max(ORDERS) - 1])
                owner.append((i, at + most < len(data)))
        held, group = 0, []
        for k, part in enumerate(parts):
            group.append(k)
            held += len(part)
            if held >= most or k + 1 == len(parts):
                self._add(total, [parts[j] for j in group], [owner[j] for j in group], most)
                held, group = 0, []
        margin = self.intercept + PER * total / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))

    def _add(self, total, parts, owner, most) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        orders = sorted(ORDERS)
        for n, h in zip(orders, _grams(data), strict=False):
            if not len(h):
                continue
            values = self.weight[h]
            # A run that goes on in the next one yields exactly `most` places.
            stops = np.array([s + most if more else e - n + 1 for s, e, (_, more) in zip(starts, ends, owner, strict=True)])
            for s, e, (i, _) in zip(starts.tolist(), stops.tolist(), owner, strict=True):
                if e > s:
                    total[i] += values[s:e].sum(dtype=np.float64)


def _all_grams(raw: bytes | None) -> np.ndarray:
    data = np.frombuffer(_framed(raw), np.uint8)
    return np.concatenate([np.zeros(0, np.uint32), *(_grams(data) if len(data) >= max(ORDERS) else ())])


def fit(rows: list[tuple[bytes | None, int]], alpha: float = 1.0) -> Model:
    """The model of labelled texts, with a checked threshold; deterministic for a given list.

    Texts are gone through twice, for the ratios and for the features that the
    ratios leave, so that no text's n-grams are kept but those.
    """
    y, size = np.array([label for _, label in rows], float), 1 << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), -60.0)
    checked = np.arange(len(y)) % FOLDS == 0
    parts = [np.ones(len(y), bool), ~checked]
    if y[parts[1]].min() == y[parts[1]].max() or (y[checked] == 0).sum() * MOST_FALSE < 1:
        parts = parts[:1]
    seen = np.zeros((len(parts), 2, size), np.float32)
    for i, (raw, label) in enumerate(rows):
        keys = np.unique(_all_grams(raw))
        for k, part in enumerate(parts):
            if part[i]:
                seen[k, int(label), keys] += 1
    ratios = []
    for no, yes in seen:
        p, q = yes + alpha, no + alpha
        ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
        ratio[(yes + no < 3) | (np.abs(ratio) < 0.7)] = 0
        ratios.append(ratio)
    some = np.any([r != 0 for r in ratios], axis=0)
    found = []
    for raw, _ in rows:
        h = _all_grams(raw)
        keys, counts = np.unique(h[some[h]], return_counts=True)
        found.append((keys, (PER * counts / max(1, len(_framed(raw)))).astype(np.float32)))
    models = [_regression([x for x, own in zip(found, part, strict=True) if own], y[part], ratio) for part, ratio in zip(parts, ratios, strict=True)]
    if len(models) < 2:
        return models[0]
    other = models.pop()
    margin = np.sort([other.intercept + float(v @ other.weight[k]) for (k, v), own, label in zip(found, checked, y, strict=True) if own and label == 0])
    bound = min(0.0, float(margin[-1 - int(len(margin) * MOST_FALSE)]) + 1e-9)
    return Model(models[0].weight, models[0].intercept - bound)


def _regression(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ratio: np.ndarray, decay: float = 3e-4, rounds: int = 100) -> Model:
    """Logistic regression over features scaled by ``ratio``, by adaptive steps."""
    row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    col, val = (np.concatenate(v) for v in zip(*found, strict=True))
    own = ratio[col] != 0
    row, col, val = row[own], col[own], val[own] * ratio[col[own]]
    used = np.unique(col)
    col = np.searchsorted(used, col)
    w, b = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = b + np.bincount(row, val * w[col], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y) / len(y)
        g = np.bincount(col, val * error[row], minlength=len(used)) + decay * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    weight = np.zeros(len(ratio), np.float32)
    weight[used] = w * ratio[used]
    return Model(weight, b)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes | None, int]]:
    """Up to ``rows`` labelled texts outside the held-out fold.

    The ids come first, by the order of their hashes; only their texts travel.
    """
    picked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != HELD_OUT))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(rows)
    )
    found = (
        common.texts(docs)
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "toxic", "text")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text")
        .limit(rows)
    )
    return [(r["text"] and bytes(r["text"]), r["toxic"]) for r in found.collect()]


def _score(batches: Iterator[pa.RecordBatch], held):
    model = held.value
    for whole in batches:
        for batch in common.slices(whole):
            s = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return common.texts(docs).mapInArrow(lambda it: _score(it, held), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    return score(docs, fit(sample(docs, labels))).select(
        "doc_id",
        (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels)))
    common.small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(held.value.score(text.to_pylist()))

    return docs.filter(scored(F.col("text").cast("binary")) < 0.5)
