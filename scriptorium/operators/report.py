"""Deterministic reports, providers of readings, and registration (O5, O10, O11, P17 of the survey)."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.windows import global_rank

Provider = Callable[[list], list]
_providers: dict[str, Provider] = {}


def markdown_table(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """``n, line``: a Markdown table of the rows in order, numbered from 0; null is empty.

    Signs that Markdown reads are escaped, and line ends become spaces.
    """
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), r"([|\\])", r"\\$1")
    ranked = global_rank(df.select(*columns), order, "n")
    body = ranked.select((F.col("n") + 1).cast("bigint").alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    head = [f"| {' | '.join(columns)} |", f"|{'|'.join([' --- '] * len(columns))}|"]
    top = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("n", "line")).select(F.col("n").cast("bigint").alias("n"), "line")
    return top.unionByName(body)


def provider(name: str) -> Callable[[Provider], Provider]:
    """Registers a function from a list of payloads to a list of readings."""

    def add(f: Provider) -> Provider:
        if _providers.setdefault(name, f) is not f:
            raise ValueError(f"provider {name} exists already")
        return f

    return add


def readings(df: DataFrame, key: str, payload: str, name: str) -> DataFrame:
    """``key, reading`` of every row, by the named provider, a batch of payloads at a time."""
    if name not in _providers:
        raise KeyError(f"no provider {name}")
    read, kind = _providers[name], dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            found = read(batch.column(1).to_pylist())
            if len(found) != batch.num_rows:
                raise ValueError(f"provider {name} gave {len(found)} readings of {batch.num_rows}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "reading"])

    return df.select(key, payload).mapInArrow(run, f"{key} {kind}, reading string")


class RateLimit:
    """At most ``most`` calls of a key in any ``seconds``; the clock is an argument."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.calls: dict[str, deque[float]] = {}

    def allows(self, key: str) -> bool:
        now, own = self.clock(), self.calls.setdefault(key, deque())
        while own and own[0] <= now - self.seconds:
            own.popleft()
        if len(own) >= self.most:
            return False
        own.append(now)
        return True


def with_known_conflicts(conflicts: DataFrame, texts: DataFrame, key: str, text: str, surfaces: dict[str, str]) -> DataFrame:
    """``key, surface, person``: the conflicts, and one for each known surface that a
    text holds, appended where the text has none of that surface yet."""
    known = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(p).alias("person")) for s, p in sorted(surfaces.items())])
    held = texts.select(key, F.inline(F.filter(known, lambda x: F.contains(F.col(text), x["surface"]))))
    return conflicts.select(key, "surface", "person").unionByName(held.join(conflicts, [key, "surface"], "left_anti"))


def registered(payloads: DataFrame) -> DataFrame:
    """``name, n_bytes, sha256, n_lines`` of the one payload among rows of Spark's
    ``binaryFile`` source; none or several are an error, raised by the job."""
    name = F.element_at(F.split("path", "/"), -1)
    own = payloads.select(name.alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.size(F.split(F.col("content").cast("string"), "\n")).alias("n_lines"))
    one = own.agg(F.count("*").alias("n"), F.first("name").alias("name"), F.first("n_bytes").alias("n_bytes"), F.first("sha256").alias("sha256"), F.first("n_lines").alias("n_lines"))
    checked = F.when(F.col("n") == 1, F.col("n_bytes")).otherwise(F.raise_error(F.concat(F.lit("payloads: "), F.col("n").cast("string"))).cast("bigint"))
    return one.select("name", checked.alias("n_bytes"), "sha256", "n_lines")
