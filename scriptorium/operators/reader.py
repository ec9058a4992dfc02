"""What a reader shows: segments, layout, exploration, bundles (L10-L12, H19, H20, O rows)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.alignment import reading_segments


def insertion_points(ranges: list[tuple[int, int]], text: str) -> list[int]:
    """Where annotations cut out of a text belong in what is left: the number of
    significant characters before each that lie in no earlier range."""
    out, gone, last = [], 0, 0
    for a, b in sorted(ranges):
        if a < last:
            raise ValueError("overlapping annotations")
        out.append(sum(not c.isspace() for c in text[:a]) - gone)
        gone += sum(not c.isspace() for c in text[a:b])
        last = b
    return out


def placed(mentions: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Mentions that can be shown: longest first; one range and one target once; a
    shorter one inside another replaces it if its target differs; partial overlap
    is an error."""
    out: list[tuple[int, int, str]] = []
    for a, b, target in sorted(set(mentions), key=lambda m: (m[0] - m[1], m[0], m[2])):
        keep = True
        for x in list(out):
            if b <= x[0] or x[1] <= a:
                continue
            if x[0] <= a and b <= x[1]:
                if x[2] == target:
                    keep = False
                else:
                    out.remove(x)
            else:
                raise ValueError("mentions overlap in part")
        if keep:
            out.append((a, b, target))
    return sorted(out)


def segments(texts: DataFrame, mentions: DataFrame, key: str, text: str) -> DataFrame:
    """``key, seq, kind, piece``: each text cut at its mentions ``(start, end, target)``.

    A text and its mentions are one group, put together they are the text.
    """
    kind = dict(texts.dtypes)[key]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        marks = list(zip(right["start"].to_pylist(), right["end"].to_pylist(), right["target"].to_pylist(), strict=True))
        for k, t in zip(left[key].to_pylist(), left[text].to_pylist(), strict=True):
            rows += [(k, i, *s) for i, s in enumerate(reading_segments(t or "", placed(marks)))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [left.schema.field(key).type, pa.int32(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "seq", "kind", "piece"])

    grouped = mentions.select(key, "start", "end", "target").groupBy(key)
    return texts.select(key, text).groupBy(key).cogroup(grouped).applyInArrow(cut, f"{key} {kind}, seq int, kind string, piece string")


def ego_layout(neighbours: DataFrame, place: str, count: str, radius: float = 100.0) -> DataFrame:
    """Neighbours on a circle, the first at the top, clockwise."""
    angle = F.lit(2 * math.pi) * F.col(place) / F.col(count) - F.lit(math.pi / 2)
    return neighbours.withColumn("x", F.round(F.cos(angle) * radius, 4)).withColumn("y", F.round(F.sin(angle) * radius, 4))


class Exploration:
    """A stack of visited nodes ``(kind, id)``."""

    def __init__(self, nodes: tuple[tuple[str, str], ...] = ()):
        self.nodes = nodes

    def visit(self, node: tuple[str, str]) -> Exploration:
        """With the node on top; visiting the top again changes nothing."""
        return self if self.nodes[-1:] == (node,) else Exploration((*self.nodes, node))

    def back(self) -> Exploration:
        return Exploration(self.nodes[:-1]) if len(self.nodes) > 1 else self

    def truncate(self, index: int) -> Exploration:
        return Exploration(self.nodes[: max(0, index) + 1])

    def story(self, valid: set[str] | None = None) -> str | None:
        """The last story visited that is valid."""
        return next((i for kind, i in reversed(self.nodes) if kind == "story" and (valid is None or i in valid)), None)


def markdown_table(df: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """A deterministic report of at most ``most`` rows."""
    rows = df.orderBy(*order).limit(most).collect()
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(show, r)) + " |" for r in rows), ""])


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a projection as Parquet below one folder."""
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def size_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bytes by asset before and after, and the change in percent."""
    a, b = before.select("asset", F.col("n_bytes").alias("before")), after.select("asset", F.col("n_bytes").alias("after"))
    both = a.join(b, "asset", "full_outer").fillna(0, ["before", "after"])
    share = F.when(F.col("before") > 0, F.round((F.col("after") - F.col("before")) * 100.0 / F.col("before"), 4))
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", share)


class Provider:
    """A pluggable reader of payloads; the fixture one answers from a table."""

    def __init__(self, run: Callable[[dict], dict]):
        self.run = run

    @classmethod
    def fixture(cls, answers: dict[str, dict]) -> Provider:
        return cls(lambda payload: answers[payload["id"]])

    @classmethod
    def module(cls, name: str) -> Provider:
        import importlib

        return cls(importlib.import_module(name).run_reading)
