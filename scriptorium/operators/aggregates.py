"""Grouped measures (A rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(mentions: DataFrame) -> DataFrame:
    """One link for each (person_id, entry_id) of mentions.

    Any mention of high confidence makes the link reviewed, else it is a
    candidate of medium confidence. Its resolution is deterministic if all
    mentions are high, contextual if none is, mixed otherwise.
    """
    high = F.col("confidence") == "high"
    out = mentions.filter(F.col("person_id").isNotNull()).groupBy("person_id", "entry_id").agg(
        F.bool_or(high).alias("any_high"), F.bool_and(high).alias("all_high"),
        F.array_sort(F.collect_set(F.when(high, F.col("mention_id")))).alias("supporting"),
        F.array_sort(F.collect_set(F.when(~high, F.col("mention_id")))).alias("candidates"),
        F.array_sort(F.collect_set("section")).alias("sections"), F.count("*").alias("n_mentions"),
    )
    return out.select(
        "person_id", "entry_id", "supporting", "candidates", "sections", "n_mentions",
        F.when(F.col("any_high"), "reviewed").otherwise("candidate").alias("review_status"),
        F.when(F.col("any_high"), "high").otherwise("medium").alias("confidence"),
        F.when(F.col("all_high"), "deterministic").when(F.col("any_high"), "mixed").otherwise("contextual").alias("resolution_status"),
    )


def distribution(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def concentration(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """Share of the commonest item in each group, to 8 places."""
    counted = df.groupBy(*group, item).agg(F.count("*").alias("__n"))
    return counted.groupBy(*group).agg(
        F.sum("__n").alias("total"), F.max("__n").alias("top"), F.round(F.max("__n") / F.sum("__n"), 8).alias("top_share")
    )


def mean_or_zero(c: Column, places: int = 6) -> Column:
    return F.coalesce(F.round(F.avg(c), places), F.lit(0.0))


def degrees(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct neighbours of every node, 0 for nodes without edges."""
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a)))
    known = ends.filter("node <> other").groupBy("node").agg(F.countDistinct("other").alias("degree"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).join(known, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def inverted_index(blocks: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Token to the sorted ids that hold it."""
    return blocks.select(key, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(
        F.array_sort(F.collect_set(key)).alias("ids")
    )


def prefix_families(df: DataFrame, value: str, number: str, prefixes: list[str]) -> DataFrame:
    """Rows by the first prefix that their value begins with; range of numbers."""
    family = F.coalesce(*[F.when(F.startswith(F.col(value), F.lit(p)), F.lit(p)) for p in prefixes])
    return df.withColumn("family", family).filter("family IS NOT NULL").groupBy("family").agg(
        F.countDistinct(number).alias("n_numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n")
    )


def semantic_key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def duplicate_bytes(df: DataFrame, value: Column, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Bytes of all values and of distinct ones; the groups that repeat most bytes."""
    size = F.octet_length(value)
    groups = df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("copies"), F.max(size).alias("size"))
    totals = groups.agg(
        F.sum(F.col("copies") * F.col("size")).alias("total_bytes"), F.sum("size").alias("unique_bytes"),
        F.sum("copies").alias("occurrences"), F.count("*").alias("unique_values"),
    )
    most = groups.withColumn("repeated_bytes", (F.col("copies") - 1) * F.col("size")).filter("copies > 1")
    return totals, most.orderBy(F.desc("repeated_bytes"), F.sha2("value", 256)).limit(top)


def field_bytes(df: DataFrame, fields: list[str]) -> DataFrame:
    """Serialised bytes of each field and its share of all."""
    sums = df.agg(*[F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(f)))), F.lit(0)).alias(f) for f in fields])
    long = sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "n_bytes"))
    return long.withColumn("share", F.round(F.col("n_bytes") / F.sum("n_bytes").over(Window.partitionBy()), 8))


def tree_hash(files: DataFrame, group: str, path: str, content: Column) -> DataFrame:
    """SHA-256 over path, NUL and raw content digest, in path order."""
    line = F.concat(F.encode(F.col(path), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.sha2(content, 256)))
    parts = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.hex(line).alias("h")))).alias("x"))
    return parts.select(group, F.sha2(F.unhex(F.array_join(F.transform("x", lambda e: e["h"]), "")), 256).alias("tree_sha256"))


def yields(items: DataFrame, channels: DataFrame, channel: str, unit: str) -> DataFrame:
    """Units of each channel, those without any included, and units per item."""
    own = items.groupBy(channel).agg(F.count("*").alias("n_items"), F.sum(unit).alias("units"))
    out = channels.select(channel).distinct().join(own, channel, "left").fillna(0, ["n_items", "units"])
    return out.withColumn("per_item", F.when(F.col("n_items") > 0, F.round(F.col("units") / F.col("n_items"), 8)).otherwise(F.lit(0.0)))


def rebalanced(per_item: dict[str, float]) -> dict[str, float]:
    """Shares of the next batch: coverage gains where it yields clearly more."""
    more = per_item.get("coverage", 0.0) > 1.10 * per_item.get("graph", 0.0)
    return dict(zip(("graph", "coverage", "random", "counter"), (0.30, 0.40, 0.15, 0.15) if more else (0.40, 0.30, 0.15, 0.15), strict=True))
