"""Mentions, their resolution and relations between them (E rows of the survey)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 120
PAIR_GAP = 96


def dictionary_matches(docs: DataFrame, key: str, text: str, surfaces: list[str], most: int = 100_000) -> DataFrame:
    """``key, surface, start, end``: every surface searched by itself, so nested
    ones survive; hits of one surface don't overlap each other.

    The dictionary is a stated list of checked size; all surfaces are found in
    one scan by an automaton.
    """
    surfaces = sorted({s for s in surfaces if s})
    if len(surfaces) > most:
        raise ValueError(f"over {most} surfaces: match in several dictionaries")
    kind = dict(docs.dtypes)[key]

    def match(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s in surfaces:
            automaton.add_word(s, s)
        if surfaces:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                free: dict[str, int] = {}
                for last, s in automaton.iter(t) if surfaces and t else ():
                    start = last - len(s) + 1
                    if start >= free.get(s, 0):
                        free[s] = last + 1
                        rows.append((k, s, start, last + 1))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "surface", "start", "end"])

    return docs.select(key, text).mapInArrow(match, f"{key} {kind}, surface string, start int, end int")


def contextual(mentions: DataFrame, strong: DataFrame, key: str, radius: int = CONTEXT) -> DataFrame:
    """Persons whose strong names stand within ``radius`` of a weak mention.

    One makes it resolved with medium confidence, several ambiguous, none leaves
    it unresolved. Mentions and names meet by text and band.
    """
    band = lambda c: F.floor(c / F.lit(radius)).cast("bigint")
    near = strong.select(key, F.col("person_id").alias("near_id"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    near = near.withColumn("__band", F.explode(F.sequence(band(F.col("s2")) - 2, band(F.col("e2")) + 2)))
    m = mentions.withColumn("__band", band(F.col("start")))
    hits = m.join(near, [key, "__band"], "left").withColumn("ok", (F.col("e2") >= F.col("start") - radius) & (F.col("s2") <= F.col("end") + radius))
    out = hits.groupBy(*mentions.columns).agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("near_id")))).alias("candidate_ids"))
    n = F.size("candidate_ids")
    return out.withColumn("person_id", F.when(n == 1, F.col("candidate_ids")[0])).withColumn(
        "resolution", F.when(n == 1, "medium").when(n > 1, "ambiguous").otherwise("unresolved")
    )


def longest_spans(spans: DataFrame, key: str) -> DataFrame:
    """Greedy choice of spans that don't overlap, longest first, then leftmost.

    Sequential within a text, so a text's spans are one group.
    """
    kinds = dict(spans.dtypes)

    def choose(rows: pa.Table) -> pa.Table:
        order = sorted(range(rows.num_rows), key=lambda i: (rows["start"][i].as_py() - rows["end"][i].as_py(), rows["start"][i].as_py(), str(rows["surface"][i].as_py())))
        taken: list[tuple[int, int]] = []
        keep = []
        for i in order:
            a, b = rows["start"][i].as_py(), rows["end"][i].as_py()
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                keep.append(i)
        return rows.take(sorted(keep))

    return spans.groupBy(key).applyInArrow(choose, ", ".join(f"{c} {kinds[c]}" for c in spans.columns))


def effective(spans: DataFrame, key: str) -> DataFrame:
    """Persons of chosen spans: a full name resolves, a short form only after its
    person was named in the text, a collision never."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    named = F.collect_set(F.when((F.col("form") == "full") & (F.size("person_ids") == 1), F.col("person_ids")[0])).over(w)
    known = F.array_intersect("person_ids", named)
    own = F.when((F.col("form") == "full") & (F.size("person_ids") == 1), F.col("person_ids")[0])
    return spans.withColumn("person_id", F.coalesce(own, F.when((F.col("form") == "short") & (F.size(known) == 1), known[0])))


def nearest_pairs(hits: DataFrame, key: str, gap: int = PAIR_GAP) -> DataFrame:
    """For every two persons of a text their nearest mentions, at most ``gap`` apart.

    The first of equal gaps by (first start, second start). Mentions meet by
    text and band; a band is as wide as the gap.
    """
    band = lambda c: F.floor(c / F.lit(gap)).cast("bigint")
    a = hits.select(key, F.col("person_id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).withColumn("__band", band(F.col("a_start")))
    b = hits.select(key, F.col("person_id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    b = b.withColumn("__band", F.explode(F.sequence(band(F.col("b_start")) - 2, band(F.col("b_end")) + 2)))
    met = a.join(b, [key, "__band"]).filter("a < b").drop("__band").distinct()
    met = met.withColumn("gap", F.greatest(F.col("b_start") - F.col("a_end"), F.col("a_start") - F.col("b_end"), F.lit(0))).filter(F.col("gap") <= gap)
    first, second = F.least("a_start", "b_start"), F.greatest("a_start", "b_start")
    order = Window.partitionBy(key, "a", "b").orderBy("gap", first, second, "a_start", "a_end", "b_end")
    return met.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def relations(pairs: DataFrame, texts: DataFrame, key: str, text: str, families: dict[str, tuple[int, str]]) -> DataFrame:
    """Families whose cue stands between two mentions that are near enough.

    ``families`` maps a family to (most gap, pattern). Standing together alone
    is no relation: without a cue a pair gives no row.
    """
    low = F.least("a_end", "b_end")
    high = F.greatest("a_start", "b_start")
    met = pairs.join(texts.select(key, text), key).withColumn("between", F.substring(F.col(text), low + 1, F.greatest(high - low, F.lit(0))))
    found = F.array_compact(
        F.array(*[F.when((F.col("gap") <= most) & F.col("between").rlike(cue), F.lit(name)) for name, (most, cue) in sorted(families.items())])
    )
    return met.withColumn("family", F.explode(found)).select(key, "a", "b", "gap", "family")


def fact_types(text: Column, rules: dict[str, str], rest: str = "historical_context") -> Column:
    """Names of all rules whose pattern occurs, sorted; the default if none does."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.items()])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(rest)))


def cue_alias(text: Column, name: Column, marker: str, within: int = 1800) -> Column:
    """The one or two Han characters that follow ``name`` and the marker."""
    head = F.regexp_replace(F.substring(text, 1, within), r"(?U)\s", "")
    at = F.position(F.concat(name, F.lit(marker)), head)
    found = F.regexp_extract(F.substring(head, at + F.char_length(name) + len(marker), F.lit(4)), "^([㐀-鿿]{1,2})", 1)
    return F.when((at > 0) & (found != ""), found)


def migrated(df: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Ids rewritten in every listed column; ids without an entry stay.

    ``mapping(old_id, new_id)`` holds each old id once.
    """
    for c in columns:
        own = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        df = df.join(own, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df


def person_score(parts: dict[str, Column]) -> Column:
    """The weighted profile score, 0 to 100."""
    # Weights of the components.
    weights = {
        "story_coverage": 0.22, "unlock": 0.22, "network": 0.16, "corpus": 0.12, "identity": 0.12,
        "clan": 0.06, "naming": 0.05, "depth": 0.05, "ambiguity": -0.15,
    }
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.coalesce(parts.get(name, F.lit(0.0)).cast("double"), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100)), 4)


#: Weights of the experience ranking.
EXPERIENCE = {
    "main": 0.24, "unlock": 0.14, "bridge": 0.13, "dead_end": 0.18, "sketch": 0.08, "relation": 0.05,
    "scene": 0.06, "identity": 0.16, "naming": 0.06, "citation": -0.20,
}


def experience_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of components between 0 and 1; missing ones count 0."""
    total = F.lit(0.0)
    for name, w in EXPERIENCE.items():
        if name in parts:
            total = total + F.lit(w) * F.coalesce(parts[name], F.lit(0.0))
    return F.round(total, 6)


def gap_audit(occurrences: DataFrame, effective: DataFrame, key: str) -> DataFrame:
    """Occurrences by what covers them: resolved, ambiguous or uncovered.

    Both sides are spans of the same texts; they meet by text and overlap, so a
    text's own spans are the only candidates.
    """
    e = effective.select(key, F.col("start").alias("s2"), F.col("end").alias("e2"), "person_id")
    met = occurrences.join(e, key, "left").withColumn("over", (F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start")))
    out = met.groupBy(*occurrences.columns).agg(
        F.coalesce(F.bool_or(F.col("over")), F.lit(False)).alias("covered"), F.count_distinct(F.when(F.col("over"), F.col("person_id"))).alias("n_persons")
    )
    status = F.when(F.col("n_persons") == 1, "resolved").when(F.col("covered"), "ambiguous").otherwise("uncovered")
    return out.withColumn("status", status).drop("covered", "n_persons")
