"""Scores of readings by rounds (V rows of the survey)."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block whose vectors meet those of another in one task, about.
BLOCK = 8192

# What a full gain of each kind counts, in order.
GAIN_DIVISORS = (("depth", 3), ("evidence", 3), ("relations", 2), ("uncertainty", 2), ("operations", 2), ("distraction", 2))


def recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted that was found; 1 where nothing was wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(found, wanted)) / n)


def strays(refs: Column, allowed: Column) -> Column:
    return F.size(F.array_except(refs, allowed))


def claims_ok(refs: Column, retrieved: Column, substantive: Column) -> Column:
    """Every ref was retrieved, and a substantive claim has one."""
    return (F.size(F.array_except(refs, retrieved)) == 0) & (~substantive | (F.size(refs) > 0))


def gains(parts: dict[str, Column]) -> dict[str, Column]:
    """Capped gains, and their sum less distraction as ``total``."""
    out = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts[k]) / d) for k, d in GAIN_DIVISORS}
    total = F.lit(0.0)
    for k, _ in GAIN_DIVISORS[:-1]:
        total = total + out[k]
    return out | {"total": total - out["distraction"]}


def question_depth(question: Column, tiers: list[str]) -> Column:
    """The highest tier (from 1) whose pattern occurs; 0 for a question without
    any; null questions have none."""
    out = F.lit(0)
    for k, pattern in enumerate(tiers, 1):
        out = F.when(question.rlike(pattern), k).otherwise(out)
    return F.when(question.isNotNull(), out).otherwise(0)


def against_previous(rows: DataFrame, keys: list[str], round_: str, text: str) -> DataFrame:
    """Adds ``changed``: a round's text differs from that of the round before."""
    before = F.lag(text).over(Window.partitionBy(*keys).orderBy(round_))
    return rows.withColumn("changed", F.when(before.isNull(), F.lit(False)).otherwise(F.col(text) != before))


def exposed(evidence: DataFrame, key: str, round_: str, ref: str) -> DataFrame:
    """Evidence known at each round: all refs up to it; shown twice is flagged."""
    w = Window.partitionBy(key).orderBy(round_)
    each = evidence.groupBy(key, round_).agg(F.array_sort(F.collect_set(ref)).alias("new_refs"))
    upto = F.array_sort(F.array_distinct(F.flatten(F.collect_list("new_refs").over(w.rowsBetween(Window.unboundedPreceding, 0)))))
    before = F.flatten(F.collect_list("new_refs").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return each.withColumn("known_refs", upto).withColumn("shown_twice", F.size(F.array_intersect("new_refs", before)) > 0)


def epistemic(status: Column, refs_status: Column) -> Column:
    """A conflicted ref makes a claim conflicted; an uncertain one, or a conflict
    that only the model claims, makes it uncertain."""
    return (
        F.when(F.array_contains(refs_status, "conflicted"), "conflicted")
        .when((status == "conflicted") | (F.array_contains(refs_status, "uncertain") & status.isin("attested", "inference")), "uncertain")
        .otherwise(status)
    )


def role_slots(stories: DataFrame, roles: list[str], candidates: DataFrame) -> DataFrame:
    """Every story and role: the best supported candidate is selected, else abstained."""
    slots = stories.select("story_id").distinct().withColumn("role", F.explode(F.array(*map(F.lit, roles))))
    w = Window.partitionBy("story_id", "role").orderBy(F.desc("n_evidence"), "candidate_id")
    best = candidates.filter("n_evidence > 0").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("story_id", "role", "candidate_id")
    return slots.join(best, ["story_id", "role"], "left").withColumn("status", F.when(F.col("candidate_id").isNotNull(), "selected").otherwise("abstained"))


def deltas(summary: DataFrame, channel: str, metrics: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Right less left of each metric, for stated pairs of channels."""
    out = None
    for left, right in pairs:
        a, b = summary.filter(F.col(channel) == left), summary.filter(F.col(channel) == right)
        one = a.select(*[F.col(m).alias(f"l_{m}") for m in metrics]).join(F.broadcast(b.select(*[F.col(m).alias(f"r_{m}") for m in metrics])))
        one = one.select(F.lit(left).alias("left"), F.lit(right).alias("right"), *[(F.col(f"r_{m}") - F.col(f"l_{m}")).alias(m) for m in metrics])
        out = one if out is None else out.unionByName(one)
    return out


def _whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def nearest(asked: np.ndarray, asked_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places of each query and its ``k`` points of the largest products, those of
    its own id left out, and the products; the smaller id wins ties."""
    order = np.argsort(ids, kind="stable")
    n, k = len(ids), min(k, len(ids))
    most = max([1, *(int(abs(x).max()) for x in (asked, points) if x.size)])
    # Product and place make one number, so that no two are alike; it is exact below 2**53.
    exact = (most * most * max(1, points.shape[1]) + 1) * n < 1 << 52
    own, late = points[order], n - 1 - np.arange(n)
    left, right, scores = [], [], []
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        same = ids[order][None, :] == asked_ids[at : at + 256, None]
        if exact:
            keys = (part.astype(float) @ own.T.astype(float)) * n + late
            keys[same] = -np.inf
            top = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        else:
            products = part.astype(object) @ own.astype(object).T
            top = np.array([sorted(range(n), key=lambda j: (same[i, j], -products[i, j], j))[:k] for i in range(len(part))])  # noqa: B023
        i, j = np.repeat(np.arange(len(part)), k), top.ravel()
        i, j = i[~same[i, j]], j[~same[i, j]]
        left.append(i + at)
        right.append(order[j])
        scores += ((part[i] * own[j]).sum(1) if exact else products[i, j]).tolist()
    return np.concatenate(left), np.concatenate(right), scores


def label_overlap(rows: DataFrame, key: str, label: str, vector: str, k: int = 5) -> DataFrame:
    """``key, same_label``: how many of the ``k`` nearest by product carry the row's label.

    Every row is a query and every other a candidate. Rows are dealt to blocks of
    bounded size and each pair of blocks is one task; the nearest of a row's tasks
    merge. Ids are unique; rows without an id or a vector take no part.
    """
    valid = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<bigint>").alias("v"))
    blocks = -(-valid.count() // BLOCK) or 1
    block, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = valid.withColumn("a", block).withColumn("b", other)
    points = valid.withColumn("b", block).withColumn("a", other)

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.decimal128(38), pa.bool_())], names=["id", "other", "score", "same"])
        width = max(len(v) for t in (x, y) for v in t["v"].to_pylist())
        i, j, scores = nearest(_whole(x["v"], width), x["id"].to_numpy(), _whole(y["v"], width), y["id"].to_numpy(), k)
        same = pc.fill_null(pc.equal(x["label"].take(pa.array(i)), y["label"].take(pa.array(j))), False)
        return pa.table([x["id"].take(pa.array(i)), y["id"].take(pa.array(j)), pa.array(list(map(Decimal, scores)), pa.decimal128(38)), same], names=["id", "other", "score", "same"])

    found = asked.groupBy("a", "b").cogroup(points.groupBy("a", "b")).applyInArrow(meet, "id bigint, other bigint, score decimal(38,0), same boolean")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("n") <= k)
    return top.groupBy(F.col("id").alias(key)).agg(F.count_if("same").alias("same_label"))
