"""Allocation, sampling and greedy selection (K rows of the survey)."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIOS = (("graph", "0.40"), ("coverage", "0.30"), ("random", "0.15"), ("counter", "0.15"))


def allocate(size: int, ratios=RATIOS) -> dict[str, int]:
    """Largest-remainder shares of ``size``; leftovers by fraction, then order."""
    exact = [(name, Fraction(r) * size) for name, r in ratios]
    out = {name: math.floor(x) for name, x in exact}
    by_rest = sorted(range(len(exact)), key=lambda i: (-(exact[i][1] - math.floor(exact[i][1])), i))
    for i in by_rest[: size - sum(out.values())]:
        out[exact[i][0]] += 1
    return out


def hash_order(seed: int, channel: str, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(channel), key.cast("string")), 256)


def round_robin(rows: DataFrame, stratum: Column, key: str, count: int, seed: int, channel: str = "random") -> DataFrame:
    """``count`` rows taken in turns from the strata.

    Within a stratum rows come by their hashes, strata by theirs. Only the first
    ``count`` of a stratum can be taken, which bounds what is sorted at the end.
    """
    dealt = rows.withColumn("stratum", stratum)
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(seed, channel, F.col(key)), key))
    top = dealt.withColumn("turn", turn).filter(F.col("turn") <= count)
    return top.orderBy("turn", F.sha2(F.concat_ws("|", F.lit(str(seed)), "stratum"), 256), "stratum").limit(count)


def channels(pool: DataFrame, key: str, order: dict[str, list[Column]], sizes: dict[str, int]) -> DataFrame:
    """Channels filled one after the other, each from what the others left."""
    out, rest = None, pool
    for name, by in order.items():
        own = rest.orderBy(*by, key).limit(sizes[name]).withColumn("channel", F.lit(name))
        own = own.withColumn("channel_rank", F.row_number().over(Window.orderBy(*by, key)))
        rest = rest.join(F.broadcast(own.select(key)), key, "left_anti")  # at most the channel's size
        out = own if out is None else out.unionByName(own)
    return out


def lower_half(rank: Column, partition: list[str]) -> Column:
    """Whether the rank is at or below the middle of the pool."""
    return rank >= F.ceil(F.max(rank).over(Window.partitionBy(*partition)) * 0.5)


def tier(score: Column, risk: Column) -> Column:
    return (
        F.when((score >= 60) & (risk <= 0.35), "A").when((score >= 40) & (risk <= 0.60), "B").when((score >= 20) & (risk <= 0.80), "C").otherwise("deferred")
    )


def reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that fail, sorted; unknown fails."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests.items()]
    return F.array_sort(F.array_compact(F.array(*failed)))


def cover_candidates(rows: DataFrame, key: str, score: str, group: str, members: str, wanted: list, count: int) -> DataFrame:
    """The rows among which ``greedy_cover`` finds its choices of all ``rows``.

    Rows of one group that cover the same wanted member get the same bonuses, so
    only the first ``count`` of each such class, and of each group, can be chosen;
    both orders in which the choice breaks ties count. That is a number of rows
    bounded by groups, wanted members and ``count``.
    """
    own = F.array_intersect(F.coalesce(members, F.array().cast("array<bigint>")), F.array(*map(F.lit, wanted)).cast("array<bigint>"))
    classes = rows.withColumn("__class", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), own)))
    by = Window.partitionBy(group, "__class")
    first = F.row_number().over(by.orderBy(F.desc(score), key))
    by_text = F.row_number().over(by.orderBy(F.desc(score), F.concat(F.col(key).cast("string"), F.lit("~"))))
    near = classes.withColumn("__a", first).withColumn("__b", by_text).filter((F.col("__a") <= count) | (F.col("__b") <= count))
    return near.drop("__class", "__a", "__b").dropDuplicates([key])


def greedy_cover(candidates: list[dict], wanted: set, count: int, group_bonus: float = 1.6, cover_bonus: float = 2.0) -> list[dict]:
    """One choice after another: first one candidate for each wanted member, then
    by score with a bonus for groups not seen and for members not covered.

    Each choice changes the scores of the rest, so this runs over a bounded
    candidate list on the driver.
    """
    left = sorted(candidates, key=lambda c: (-c["score"], c["id"]))
    out: list[dict] = []
    covered: set = set()
    groups: set = set()

    def take(c: dict) -> None:
        left.remove(c)
        out.append(c)
        covered.update(c["members"])
        groups.add(c["group"])

    for w in sorted(wanted):
        if w not in covered and len(out) < count and (own := next((c for c in left if w in c["members"]), None)):
            take(own)
    while left and len(out) < count:
        open_ = wanted - covered
        take(
            max(
                left,
                key=lambda c: (
                    c["score"] + group_bonus * (c["group"] not in groups) + cover_bonus * bool(open_ & set(c["members"])),
                    [-ord(x) for x in str(c["id"])],
                ),
            )
        )
    return out


def picked(n: int, draw: float, exclude: int | None = None) -> int | None:
    """Index floor(draw * n) with the draw kept in [0, 1); the excluded one only
    if it is the only one."""
    if n <= 0:
        return None
    own = [i for i in range(n) if i != exclude] if exclude is not None and n > 1 else list(range(n))
    return own[min(len(own) - 1, int(max(0.0, min(draw, 1.0)) * len(own)))]


def review_sample(rows: DataFrame, group: str, confidence: str, order: list[str]) -> DataFrame:
    """Everything of medium and low confidence, and of high the first, middle and last."""
    w = Window.partitionBy(group, confidence)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    return (
        rows.withColumn("__n", n).withColumn("__at", at)
        .filter((F.col(confidence) != "high") | (F.col("__at") == 0) | (F.col("__at") == F.floor(F.col("__n") / 2)) | (F.col("__at") == F.col("__n") - 1))
        .drop("__n", "__at")
    )


def extremes(rows: DataFrame, group: str, size: str, richness: str, key: str) -> DataFrame:
    """The shortest and the richest member of each group."""
    return rows.groupBy(group).agg(
        F.min_by(key, F.struct(F.col(size), F.col(key))).alias("shortest"),
        F.max_by(key, F.struct(F.col(richness), -F.col(key))).alias("richest"),
    )
