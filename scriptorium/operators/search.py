"""Transparent lexical search (T rows of the survey)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from scriptorium.functions import text as X

PHRASE, PER_CHAR, TERM, ENTITY, LINKED = 100, 3, 4, 12, 20
MAX_K, MAX_EVIDENCE_K = 50, 5


def checked_k(k: int, most: int = MAX_K) -> int:
    """``k`` if it is a whole number from 1 to ``most``."""
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= most:
        raise ValueError(f"top k must be from 1 to {most}")
    return k


def offsets(text: Column, needle: str, overlapping: bool = False) -> Column:
    """Code-point offsets of ``needle``; a hit is passed over whole unless overlapping."""
    step = 1 if overlapping else len(needle)

    @F.arrow_udf(ArrayType(IntegerType()))
    def found(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            hits, at = [], -1 if not v or not needle else v.find(needle)
            while at >= 0:
                hits.append(at)
                at = v.find(needle, at + step)
            out.append(hits)
        return pa.array(out, pa.list_(pa.int32()))

    return F.when(F.contains(text, F.lit(needle)), found(text))


def snippet(text: Column, start: Column, context: int) -> Column:
    """``text[start - context : start + context]``; the needle's length isn't added."""
    low = F.greatest(start - context, F.lit(0))
    return F.substring(text, low + 1, F.least(start + context, F.char_length(text)) - low)


def occurrences(units: DataFrame, key: str, text: str, needle: str, context: int = 100) -> DataFrame:
    """One row a hit: key, offset, snippet."""
    hits = units.filter(F.contains(F.col(text), F.lit(needle))).withColumn("offset", F.explode(offsets(F.col(text), needle)))
    return hits.select(key, "offset", snippet(F.col(text), F.col("offset"), context).alias("snippet"))


def layer_score(text: Column, query: str, entity_terms=(), linked: Column | None = None) -> Column:
    """Score of a folded, compact text.

    The whole query counts 100 and 3 a character, else each of its n-grams of
    two characters or more counts 4. Entity terms add 12 each and a link 20,
    where anything matched.
    """
    whole = "".join(query.split()).lower()
    terms = [t for t in X.ngrams(whole) if len(t) > 1]
    parts = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))) * TERM if terms else F.lit(0)
    score = F.when(F.contains(text, F.lit(whole)), F.lit(PHRASE + PER_CHAR * len(whole))).otherwise(parts) if whole else F.lit(0)
    for term in entity_terms:
        score = score + F.when(F.contains(text, F.lit(term.lower())), F.lit(ENTITY)).otherwise(F.lit(0))
    bonus = F.when(F.coalesce(linked, F.lit(False)), F.lit(LINKED)).otherwise(F.lit(0)) if linked is not None else F.lit(0)
    return F.when(score > 0, score + bonus).otherwise(F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters and projections don't compute again.

    Catalyst copies an expression into every filter above it; the row generator
    stops that, so the expression is evaluated once a row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def ranked(hits: DataFrame, score: str, keys: list[str], k: int) -> DataFrame:
    """The k best by score and then by keys, with their ranks and the number of matches."""
    checked_k(k)
    total = hits.select(F.count("*").alias("raw_match_count"))
    top = hits.orderBy(F.desc(score), *keys).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *keys))).join(F.broadcast(total))


def evidence_score(text: Column, query: str, hints=()) -> Column:
    """Phrase 20; each term 4, or 2 up to two characters; each hint 8."""
    whole = "".join(query.split()).lower()
    score = F.when(F.contains(text, F.lit(whole)), 20).otherwise(0)
    for t in X.ngrams(whole):
        score = score + F.when(F.contains(text, F.lit(t)), 2 if len(t) <= 2 else 4).otherwise(0)
    for h in hints:
        score = score + F.when(F.contains(text, F.lit(h.lower())), 8).otherwise(0)
    return score


def excerpt(text: Column, terms=(), limit: int = 110, lead: int = 24) -> Column:
    """``limit`` characters without white space from 24 before the first term."""
    value = X.compact(text)
    places = F.filter(F.array(*[F.locate(t, value) for t in terms] or [F.lit(0)]), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(1)) - 1 - lead)
    start = F.least(start, F.greatest(F.lit(0), F.char_length(value) - limit))
    return F.substring(value, start + 1, F.lit(limit))


def best_status(status: Column) -> Column:
    """Of a group's statuses: reviewed, else candidate, else the first by name."""
    order = F.when(status == "reviewed", 0).when(status == "candidate", 1).otherwise(2)
    return F.min_by(status, F.struct(order, status))


def within_budget(ordered: DataFrame, size: str, order: list[Column], budget: int) -> DataFrame:
    """Rows in order until their sizes exceed the budget, which ends it."""
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("total_size", total).filter(F.col("total_size") <= budget)


def keep_best(hits: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in rank order, with how many it stands for."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    copies = F.count("*").over(Window.partitionBy(*key))
    return hits.withColumn("copies", copies).withColumn("__n", first).filter("__n = 1").drop("__n")


class OpenedEvidence:
    """A session that opens only what it has returned, within a budget of characters."""

    def __init__(self, evidence: DataFrame, key: str, text: str, budget: int = 24_000, quote: int = 6_000):
        self.evidence, self.key, self.text = evidence, key, text
        self.left, self.quote, self.allowed = budget, quote, set()

    def returned(self, refs) -> None:
        self.allowed |= set(refs)

    def open(self, ref) -> str:
        if ref not in self.allowed:
            raise PermissionError(f"{ref!r} was not returned by a search")
        row = self.evidence.filter(F.col(self.key) == ref).select(F.substring(self.text, 1, self.quote)).first()
        if row is None:
            raise KeyError(ref)
        if len(row[0]) > self.left:
            raise ValueError("the session's budget is used up")
        self.left -= len(row[0])
        return row[0]
