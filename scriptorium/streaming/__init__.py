"""Feedback as an append log, in batches and as a stream (O8, O9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN = ("new", "reviewed")
TRANSITIONS = {"new": {"reviewed", "rejected", "duplicate"}, "reviewed": {"exported", "rejected", "duplicate"}, "rejected": {"new"}, "duplicate": {"new"}}
STATE = "first_id string"
OUT = "feedback_id string, fingerprint string, status string, duplicate_of string"


def fingerprint(*parts: str) -> Column:
    """What makes two submissions the same."""
    return F.sha2(F.concat_ws("\u001f", *[F.lower(F.trim(F.coalesce(F.col(p).cast("string"), F.lit("")))) for p in parts]), 256)


def deduplicated(log: DataFrame, key: str, at: str, mark: str = "fingerprint") -> DataFrame:
    """Each submission's status: the first of a fingerprint is new, later ones
    are duplicates of it."""
    w = Window.partitionBy(mark)
    first = F.min(F.struct(F.col(at), F.col(key))).over(w)[key]
    return log.withColumn("duplicate_of", F.when(F.col(key) != first, first)).withColumn(
        "status", F.when(F.col("duplicate_of").isNull(), "new").otherwise("duplicate")
    )


def _submit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One fingerprint's submissions; a rejected or closed first one reopens it."""
    first = state.get[0] if state.exists else None
    for frame in frames:
        rows = []
        for r in frame.sort_values(["created_at", "feedback_id"]).itertuples():
            if getattr(r, "closes", None):
                if r.closes == first:
                    first = None
                continue
            rows.append((r.feedback_id, key[0], "duplicate" if first else "new", first))
            first = first or r.feedback_id
        yield pd.DataFrame(rows, columns=["feedback_id", "fingerprint", "status", "duplicate_of"])
    if first:
        state.update((first,))
    elif state.exists:
        state.remove()


def submissions(stream: DataFrame) -> DataFrame:
    """The same over a stream of ``feedback_id, fingerprint, created_at, closes``.

    State is one id for each open fingerprint. A row whose ``closes`` names the
    open submission ends it, so that the next one is new again.
    """
    return stream.groupBy("fingerprint").applyInPandasWithState(_submit, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def distinct_within(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """First submission of each fingerprint, with state bounded by a watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def reviewed(store: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with allowed status changes applied, and the changes refused.

    ``changes(feedback_id, to_status)`` holds an id once.
    """
    allowed = F.lit(False)
    for a, to in TRANSITIONS.items():
        allowed = allowed | ((F.col("status") == a) & F.col("to_status").isin(*to))
    met = store.join(changes, "feedback_id", "left").withColumn("__ok", F.col("to_status").isNotNull() & allowed)
    out = met.withColumn("status", F.when(F.col("__ok"), F.col("to_status")).otherwise(F.col("status"))).drop("to_status", "__ok")
    refused = changes.join(met.filter("__ok").select("feedback_id"), "feedback_id", "left_anti")
    return out, refused


def listed(store: DataFrame, story_id: str, target_type: str | None = None) -> DataFrame:
    out = store.filter(F.col("story_id") == story_id)
    return (out.filter(F.col("target_type") == target_type) if target_type else out).orderBy("created_at", "feedback_id")


def exported(store: DataFrame, fields: list[str]) -> DataFrame:
    """Reviewed submissions, listed fields only."""
    return store.filter("status = 'reviewed'").select(*[f for f in fields if f in store.columns]).orderBy(fields[0])
