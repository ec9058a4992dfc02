"""Intervals of years with unknown bounds (H rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.joins import may_overlap


def state(start: Column, end: Column, relative: Column | None = None) -> Column:
    rel = F.coalesce(relative, F.lit(False)) if relative is not None else F.lit(False)
    return (
        F.when(start.isNotNull() & end.isNotNull(), "bounded")
        .when(start.isNotNull() | end.isNotNull(), "one_sided")
        .when(rel, "relative_only")
        .otherwise("unknown")
    )


def slice_(edges: DataFrame, start: str, end: str, low, high, include_unknown: bool = False) -> DataFrame:
    """Edges that may hold in [low, high]; unknown ones only as a bucket of their own."""
    meets = may_overlap(F.col(start), F.col(end), low, high)
    bucket = F.when(meets, "potential").when(F.col(start).isNull() & F.col(end).isNull(), "unknown")
    out = edges.withColumn("bucket", bucket)
    return out.filter(F.col("bucket").isNotNull() if include_unknown else F.col("bucket") == "potential")


def cutoff_view(start: Column, end: Column, cutoff) -> Column:
    """pre: known to end by the cutoff; post: known to begin after it;
    potentially_active: neither; unknown bounds apart."""
    return (
        F.when(start.isNull() & end.isNull(), "unknown").when(end <= cutoff, "pre").when(start > cutoff, "post").otherwise("potentially_active")
    )


def age_range(story_start: Column, story_end: Column, birth_start: Column, birth_end: Column) -> Column:
    """(least, greatest) age; null if a bound is missing; an error if inverted."""
    low, high = story_start - birth_end, story_end - birth_start
    missing = story_start.isNull() | story_end.isNull() | birth_start.isNull() | birth_end.isNull()
    bad = (story_start > story_end) | (birth_start > birth_end)
    return F.when(~missing, F.when(bad, F.raise_error(F.lit("inverted interval")).cast("struct<low:bigint,high:bigint>")).otherwise(
        F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))))


def precision_errors(precision: Column, start: Column, end: Column) -> Column:
    """What is wrong with an anchor's bounds for its stated precision; null if nothing."""
    return (
        F.when(start > end, "inverted")
        .when((precision == "exact_year") & ~(start.isNotNull() & start.eqNullSafe(end)), "exact_year_needs_equal_bounds")
        .when(precision.isin("year_range", "event", "reign") & (start.isNull() | end.isNull()), "bounds_missing")
        .when(precision.isin("phase_only", "unknown") & (start.isNotNull() | end.isNotNull()), "bounds_not_allowed")
    )


def phase(volume: Column, bands=((36, "one"), (43, "two"), (55, "three"), (68, "four")), rest: str = "five") -> Column:
    """The band that a number falls in."""
    out = F.lit(rest)
    for most, name in reversed(bands):
        out = F.when(volume <= most, name).otherwise(out)
    return F.when(volume.isNotNull(), out)


def first_known(*rules: Column) -> Column:
    """The value of the first rule that gives one."""
    return F.coalesce(*rules)
