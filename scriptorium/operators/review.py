"""Gates, review decisions and materialisation (P, E15-E19 and A21 rows)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def reviewed(df: DataFrame, direct_only: bool = False) -> DataFrame:
    out = df.filter(F.col("review_status") == "reviewed")
    return out.filter(F.col("basis") == "direct") if direct_only else out


def whitelisted(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, value`` of the listed fields that are present and not empty."""
    own = [f for f in fields if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in own])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value").filter("value IS NOT NULL AND value <> ''")


def publication_state(punctuation: Column, punctuated: Column, canonical: Column) -> Column:
    """production_ready: reviewed and the marks come off again; preview_ready:
    they come off; blocked otherwise."""
    from scriptorium.operators.alignment import stripped

    whole = F.coalesce(stripped(punctuated) == stripped(canonical), F.lit(False))
    return F.when(whole & (punctuation == "reviewed"), "production_ready").when(whole, "preview_ready").otherwise("blocked")


def readiness(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds ``ready`` and, in the order of the tests, what is missing."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]))
    return df.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def typed_targets(df: DataFrame, people: DataFrame, candidates: DataFrame) -> DataFrame:
    """State of rows that name a person or a candidate: ok, both, neither, unknown
    or name_differs. ``people`` and ``candidates`` are ``(id, name)``."""
    p = people.select(F.col("id").alias("person_id"), F.col("name").alias("__p"))
    c = candidates.select(F.col("id").alias("candidate_id"), F.col("name").alias("__c"))
    known = F.coalesce("__p", "__c")
    state = (
        F.when(F.col("person_id").isNotNull() & F.col("candidate_id").isNotNull(), "both")
        .when(F.col("person_id").isNull() & F.col("candidate_id").isNull(), "neither")
        .when(known.isNull(), "unknown").when(known != F.col("name"), "name_differs").otherwise("ok")
    )
    return df.join(p, "person_id", "left").join(c, "candidate_id", "left").withColumn("state", state).drop("__p", "__c")


def decided(facts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with the decision and reason of their rule; without one, unresolved.

    ``rules`` is a curated table with a row a key.
    """
    out = facts.join(rules, keys, "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("unresolved"))).withColumn("reason", F.coalesce("reason", F.lit("no rule")))


def merged(hits: DataFrame, key: list[str], evidence: str) -> DataFrame:
    """One candidate a key, with its sorted evidence; two or more refs make it strong."""
    out = hits.groupBy(*key).agg(F.array_sort(F.collect_set(evidence)).alias("refs"), F.count("*").alias("n_hits"))
    return out.withColumn("disposition", F.when(F.size("refs") > 1, "strong").otherwise("needs_attention"))


def preferred(hits: DataFrame, key: list[str], priority: Column) -> DataFrame:
    """One hit a key: that of the highest priority (the last basis wins)."""
    w = Window.partitionBy(*key).orderBy(F.desc("__p"), *[c for c in hits.columns if c not in key])
    return hits.withColumn("__p", priority).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__p", "__n")


def materialised(candidates: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Approved candidates as relations, with the reviewer's note."""
    approved = decisions.filter("decision = 'approved'").select(*key, "note")
    return candidates.join(approved, key, "inner").withColumn("review_status", F.lit("reviewed"))


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """``check, n_violations, passed``: one row for each query of violations."""
    out = None
    for name, rows in sorted(named.items()):
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("n_violations")).withColumn("passed", F.col("n_violations") == 0)
        out = one if out is None else out.unionByName(one)
    return out


def schema_keys(schema) -> set[str]:
    """All field names of a schema, at any depth."""
    if isinstance(schema, StructType):
        return {f.name for f in schema.fields} | {k for f in schema.fields for k in schema_keys(f.dataType)}
    if isinstance(schema, ArrayType):
        return schema_keys(schema.elementType)
    if isinstance(schema, MapType):
        return schema_keys(schema.keyType) | schema_keys(schema.valueType)
    return set()


def no_leaks(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """``df``, unless a forbidden field is anywhere in its schema."""
    if found := schema_keys(df.schema) & forbidden:
        raise ValueError(f"forbidden fields: {sorted(found)}")
    return df


def schema_errors(df: DataFrame, wanted: StructType) -> list[str]:
    """Missing fields and fields of another type; nothing is raised."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return sorted(
        f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}"
        for f in wanted.fields
        if have.get(f.name) != f.dataType
    )


def tool_call_errors(arguments: dict, most_query: int = 240, most_hints: int = 12, most_layers: int = 8, most_k: int = 5) -> list[str]:
    """What is wrong with the arguments of a search call."""
    out = []
    query = arguments.get("query")
    if not isinstance(query, str) or not 0 < len(query.strip()) or len(query) > most_query:
        out.append("query")
    for name, most in (("entity_hints", most_hints), ("source_layers", most_layers)):
        value = arguments.get(name, [])
        if not isinstance(value, list) or len(value) > most or not all(isinstance(v, str) for v in value):
            out.append(name)
    k = arguments.get("top_k", most_k)
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= most_k:
        out.append("top_k")
    return out


def now_iso(clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> str:
    """The time in UTC; the clock can be given."""
    return clock().astimezone(UTC).isoformat(timespec="seconds")


def tool_loop(model: Callable[[list[dict]], dict], tools: dict[str, Callable[..., object]], messages: list[dict], rounds: int = 6) -> dict:
    """Calls the model and the tools it asks for, at most ``rounds`` times, then
    makes it finish. A reply is ``{"tool": name, "arguments": {...}}`` or
    ``{"final": ...}``; a final that is no object is repaired once."""
    messages = list(messages)
    for _ in range(rounds):
        reply = model(messages)
        if "final" in reply:
            break
        name = reply.get("tool")
        result = tools[name](**reply.get("arguments", {})) if name in tools else {"error": f"no tool {name!r}"}
        messages.append({"role": "tool", "name": name, "content": result})
    else:
        messages.append({"role": "user", "content": "finish now"})
        reply = model(messages)
    if not isinstance(reply.get("final"), dict):
        messages.append({"role": "user", "content": "reply with one JSON object"})
        reply = model(messages)
    if not isinstance(reply.get("final"), dict):
        raise ValueError("no final object")
    return reply["final"]
