"""Ranks, fills, islands and normalisation (W rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import storage


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based place of each row in a total order, without a one-task window.

    Rows are dealt by ranges of the order and sorted there; a range's first
    place is the number of rows in the ranges before it.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = storage.saved(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = dealt.withColumn("__within", within).join(F.broadcast(starts), "__part")
    return ranked.withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def average_rank(score: Column, partition: list[str]) -> Column:
    """Rank by descending score in which ties share the mean of their places."""
    by = Window.partitionBy(*partition)
    first = F.rank().over(by.orderBy(F.desc(score)))
    return first + (F.count("*").over(Window.partitionBy(*partition, score)) - 1) / F.lit(2.0)


def forward_filled(value: Column, partition: list[str], order: list[Column | str]) -> Column:
    """The last value that isn't null, up to the row."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(frame)


def islands(df: DataFrame, partition: list[str], first: str, second: str) -> DataFrame:
    """Runs in which both numbers advance by one from row to row."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(first, second))
    marked = df.withColumn("__a", F.col(first) - n).withColumn("__b", F.col(second) - n)
    return marked.groupBy(*partition, "__a", "__b").agg(
        F.min(first).alias("first_from"), F.max(first).alias("first_to"),
        F.min(second).alias("second_from"), F.max(second).alias("second_to"), F.count("*").alias("n"),
    ).drop("__a", "__b")


def overlaps_previous(start: str, end: str, partition: list[str], key: str) -> Column:
    """Whether a range begins before the furthest end of those before it."""
    w = Window.partitionBy(*partition).orderBy(start, end, key).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(start) < F.max(end).over(w), F.lit(False))


def delta(value: Column, partition: list[str], order: str) -> Column:
    """Change against the previous row; a missing one counts as 0."""
    return value - F.lag(value, 1, 0).over(Window.partitionBy(*partition).orderBy(order))
