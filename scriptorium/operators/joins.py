"""Joins with the survey's semantics (J rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import storage


def full_outer_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with ``side``: both, left_only or right_only.

    The sides should be one row a key (aggregated before).
    """
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").withColumn("side", side).drop("__l", "__r")


def with_anomalies(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without any reason against them, and the others with their reasons."""
    listed = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in reasons.items()])))
    marked = rows.withColumn("reasons", listed)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def pairs_within(members: DataFrame, group: str, member: str) -> DataFrame:
    """Unordered pairs (a < b) of the distinct members of each group."""
    m = members.select(group, member).distinct()
    a, b = m.withColumnRenamed(member, "a"), m.withColumnRenamed(member, "b")
    return a.join(b, group).filter(F.col("a") < F.col("b"))


def nearest_in_band(left: DataFrame, right: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """For each left row the nearest right row of the same key within ``gap``.

    An equi-join on key and band keeps the candidates to common bands: a left
    row stands in all bands of its range, a right row in those within the gap of
    its range, and a pair counts in the first band that both have. The gap is the
    distance between the ranges, 0 where they meet; the first of equal gaps by
    (left start, right start) is kept.
    """
    band = lambda c: F.floor(c / F.lit(gap)).cast("bigint")
    at, low, high, number = "__band", "__low", "__high", "__n"
    a = left.withColumn(low, band(F.col(start))).withColumn(at, F.explode(F.sequence(F.col(low), band(F.col(end)))))
    b = right.select(*[F.col(c).alias(f"r_{c}") if c != key else F.col(c) for c in right.columns])
    b = b.withColumn(high, band(F.col(f"r_{start}") - F.lit(gap))).withColumn(at, F.explode(F.sequence(F.col(high), band(F.col(f"r_{end}") + F.lit(gap)))))
    met = a.join(b, [key, at]).filter(F.col(at) == F.greatest(low, high)).withColumn(
        "gap", F.greatest(F.col(f"r_{start}") - F.col(end), F.col(start) - F.col(f"r_{end}"), F.lit(0))
    )
    met = met.filter(F.col("gap") <= gap).drop(at, low, high)
    order = Window.partitionBy(key, *[c for c in left.columns if c != key]).orderBy("gap", start, f"r_{start}", *[f"r_{c}" for c in right.columns if c != key])
    return met.withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).drop(number)


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """Each point with the last mark at or before it.

    Marks and points are one sorted stream by key, and the mark's value is
    carried forward, so no inequality join is planned.
    """
    columns = points.columns
    p = points.withColumn("__at", F.col(at)).withColumn("__mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__kind", F.lit(1))
    m = marks.select(key, F.col(mark_at).alias("__at"), F.col(value).alias("__mark")).withColumn("__kind", F.lit(0))
    both = p.unionByName(m, allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__mark", ignorenulls=True).over(frame)).filter("__kind = 1").select(*columns, value)


def may_overlap(start: Column, end: Column, low: Column | int, high: Column | int) -> Column:
    """Whether an interval with open ends may meet [low, high].

    One unknown bound is open; two unknown bounds are unknown, never an overlap.
    """
    known = start.isNotNull() | end.isNotNull()
    return known & (start.isNull() | (start <= high)) & (end.isNull() | (end >= low))


def intersection(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The common part of each key's intervals; none is null with a conflict flag."""
    out = intervals.groupBy(*keys).agg(F.max(start).alias("lo"), F.min(end).alias("hi"))
    conflict = F.coalesce(F.col("lo") > F.col("hi"), F.lit(False))
    return out.select(*keys, F.when(~conflict, F.col("lo")).alias(start), F.when(~conflict, F.col("hi")).alias(end), conflict.alias("conflict"))


def not_contained(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans that no other span of their key strictly contains.

    In the order (start, longest first) a span is contained exactly if a span
    before it reaches as far and isn't the same range.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct(F.col(end).alias("end"), (-F.col(start)).alias("back"))).over(w)
    marked = spans.withColumn("__b", furthest)
    inside = (F.col("__b.end") > F.col(end)) | ((F.col("__b.end") == F.col(end)) & (-F.col("__b.back") < F.col(start)))
    return marked.filter(~F.coalesce(inside, F.lit(False))).drop("__b")


def both_ways(edges: DataFrame, a: str, b: str, a_role: str, b_role: str) -> DataFrame:
    """Each edge as seen from either end, roles swapped; no edges to oneself."""
    rest = [c for c in edges.columns if c not in (a, b, a_role, b_role)]
    own = edges.filter(F.col(a) != F.col(b))

    def seen(x, y, xr, yr):
        return own.select(F.col(x).alias("me"), F.col(y).alias("other"), F.col(xr).alias("my_role"), F.col(yr).alias("other_role"), *rest)

    return seen(a, b, a_role, b_role).unionByName(seen(b, a, b_role, a_role))


def surface_states(aliases: DataFrame, surface: str, person: str, known: DataFrame) -> DataFrame:
    """Persons of each surface and what it can be used for.

    conflict: known for another person; ambiguous: several persons; existing:
    known for this one; new: one person, not known.
    """
    own = aliases.groupBy(surface).agg(F.array_sort(F.collect_set(person)).alias("persons"))
    old = known.groupBy(surface).agg(F.array_sort(F.collect_set(person)).alias("known"))
    both = own.join(old, surface, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    state = (
        F.when(F.size("persons") > 1, "ambiguous")
        .when((F.size("known") > 0) & ~F.arrays_overlap("known", "persons"), "conflict")
        .when(F.size("known") > 0, "existing")
        .otherwise("new")
    )
    return both.withColumn("state", state)


def lineage_paths(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, path``: from each of ``ids(child)`` over ``edges(child, parent)`` to a node without a parent.

    A node has one parent at most and edges make no cycle. Every round doubles
    the steps of a path, so rounds follow the logarithm of its length; they stop
    when every path has come to its root.
    """
    # What lies beyond a node: its ancestors in order, and the last of them.
    beyond = storage.saved(edges.select("child", F.col("parent").alias("last"), F.array("parent").alias("rest")))
    while True:
        nxt = beyond.select(F.col("child").alias("last"), F.col("last").alias("__to"), F.col("rest").alias("__more"))
        grown = beyond.join(nxt, "last", "left")
        beyond = storage.saved(
            grown.select("child", F.coalesce("__to", "last").alias("last"), F.when(F.col("__to").isNull(), F.col("rest")).otherwise(F.concat("rest", "__more")).alias("rest"), F.col("__to").isNotNull().alias("__moved"))
        )
        moved = beyond.filter("__moved").limit(1).count()
        beyond = beyond.drop("__moved")
        if not moved:
            break
    none = F.array().cast(beyond.schema["rest"].dataType)
    return ids.join(beyond, "child", "left").select(F.col("child").alias("id"), F.concat(F.array("child"), F.coalesce("rest", none)).alias("path"))
