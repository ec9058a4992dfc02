"""Access to the shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; only the columns a plan uses are read."""
    if name not in NAMES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
