"""Typed, layered graphs (H rows of the survey)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import storage
from scriptorium.operators.windows import average_rank


def edge_key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def project(facts: DataFrame, edge_type: str, src_type: str, src: str, dst_type: str, dst: str, layers: list[str]) -> DataFrame:
    """Edges from facts, one for each semantic key, with their fact ids."""
    typed = facts.select(
        F.lit(edge_type).alias("edge_type"), F.lit(src_type).alias("src_type"), F.col(src).cast("string").alias("src_id"),
        F.lit(dst_type).alias("dst_type"), F.col(dst).cast("string").alias("dst_id"), F.col("fact_id").cast("string").alias("fact_id"),
    )
    key = edge_key("edge_type", "src_type", "src_id", "dst_type", "dst_id")
    out = typed.groupBy("edge_type", "src_type", "src_id", "dst_type", "dst_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))
    return out.withColumn("semantic_key", key).withColumn("edge_id", F.sha2("semantic_key", 256)).withColumn("layers", F.array(*map(F.lit, sorted(layers))))


def layer_view(edges: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Edges in any of the kept layers, or with a layer besides the dropped ones."""
    if keep is not None:
        return edges.filter(F.arrays_overlap("layers", F.array(*map(F.lit, keep))))
    return edges.filter(F.size(F.array_except("layers", F.array(*map(F.lit, drop or [])))) > 0)


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected adjacency without loops, each neighbour once."""
    own = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    return own.union(own.select("other", "node")).toDF("node", "other").filter("node <> other").distinct()


#: So many memberships make a block of sets; two blocks meet in one task.
BLOCK = 2**21


def one_hop(members: DataFrame, group: str, member: str) -> DataFrame:
    """How many others each member meets in some group, 0 included.

    Rows without a group are no memberships; a member that is null meets nobody
    and is met by nobody. Members of the same set of groups are counted once, and
    pairs of members are never made: sets meet block by block, and only the count
    of each set leaves a task.
    """
    m = members.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g IS NOT NULL")
    sets = storage.saved(m.groupBy("m").agg(F.array_sort(F.collect_set("g")).alias("groups")))
    alike = sets.groupBy("groups").agg(F.count("m").alias("size"))
    alike = storage.saved(alike.withColumn("id", F.monotonically_increasing_id()))  # stored, so ids stay
    total = alike.agg(F.sum(F.size("groups"))).first()[0] or 0
    blocks = max(-(-total // BLOCK), min(4, 1 + total // 2**15))
    dealt = alike.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("id", "groups", "size", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = tiles.groupBy("low", "high").applyInArrow(_met, "id bigint, met bigint").groupBy("id").agg(F.sum("met").alias("met"))
    counts = sets.join(alike.select("id", "groups").join(met, "id"), "groups")
    return counts.select(F.col("m").alias(member), F.when(F.col("m").isNull(), 0).otherwise(F.col("met") - 1).alias("reachable"))


def _met(rows: pa.Table) -> pa.Table:
    """For each set of one block the members of the other block's sets that share a
    group with it, and the other way round.

    A walk over the sets in order, their groups from the most to the least common,
    takes what each group adds; sets with the same first groups share those steps.
    """
    groups = rows["groups"].combine_chunks()
    codes = pc.dictionary_encode(groups.flatten()).indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(groups)), pc.list_value_length(groups).to_numpy())
    block, size, ids = (rows[c].to_numpy() for c in ("block", "size", "id"))
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    kinds = int(codes.max()) + 1
    out_ids, out_met = [], []
    for mine, others in {(low, high), (high, low)}:
        theirs = block[owner] == others
        count = np.bincount(codes[theirs], minlength=kinds)
        place = np.empty(kinds, np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(kinds)
        codes_by_place = place[codes]
        order = np.argsort(codes_by_place[theirs], kind="stable")
        holders = np.split(owner[theirs][order], np.cumsum(np.sort(count)[::-1])[:-1])

        own = np.flatnonzero(block[owner] == mine)
        own = own[np.lexsort((codes_by_place[own], owner[own]))]
        ends = np.flatnonzero(np.diff(owner[own], append=-1)) + 1
        steps, start, walk = codes_by_place[own].tolist(), 0, []
        for end in ends.tolist():
            walk.append((steps[start:end], int(owner[own[start]])))
            start = end
        walk.sort()

        left, taken, sums, path = size.copy(), [], [0], []
        for steps, at in walk:
            same = next((i for i, (x, y) in enumerate(zip(steps, path, strict=False)) if x != y), min(len(steps), len(path)))
            while len(taken) > same:
                held, values = taken.pop()
                left[held] = values
                sums.pop()
            for step in steps[same:]:
                held = holders[step]
                values = left[held]
                left[held] = 0
                taken.append((held, values))
                sums.append(sums[-1] + int(values.sum()))
            path = steps
            out_ids.append(ids[at])
            out_met.append(sums[-1])
    return pa.table({"id": pa.array(out_ids, pa.int64()), "met": pa.array(out_met, pa.int64())})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``; the least node names a component.

    Large-star and small-star steps alternate until nothing changes, in a number
    of rounds that follows the logarithm of the largest component. Rounds are
    grouped minima written to the shared folder.
    """
    own = storage.saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())  # computed once
    pairs, loops = own.filter("u <> v"), own.filter("u = v").select(F.col("u").alias("node"))
    last = None
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        star = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("low"))
        small = star.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.toDF("u", "v"))
        pairs = storage.saved(small.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    named = pairs.groupBy("u").agg(F.min("v").alias("component")).toDF("node", "component")
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    out = named.union(roots)
    alone = loops.distinct().join(out.select("node"), "node", "left_anti")
    return out.union(alone.select("node", F.col("node").alias("component")))


def articulation_points(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes whose removal splits their component, by depth-first low points.

    A component is one task's group: meant for graphs of persons and stories,
    not for one giant component.
    """
    adjacent = neighbours(edges, a, b)
    named = adjacent.join(components(edges, a, b), "node")

    def points(rows: pa.Table) -> pa.Table:
        near: dict = {}
        for u, v in zip(rows["node"].to_pylist(), rows["other"].to_pylist(), strict=True):
            near.setdefault(u, []).append(v)
        for v in near.values():
            v.sort()
        seen: dict = {}
        low: dict = {}
        found = set()
        for root in sorted(near):
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack, children = [(root, None, iter(near[root]))], 0
            while stack:
                u, parent, rest = stack[-1]
                for v in rest:
                    if v not in seen:
                        seen[v] = low[v] = len(seen)
                        stack.append((v, u, iter(near[v])))
                        break
                    if v != parent:
                        low[u] = min(low[u], seen[v])
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[u])
                        if parent == root:
                            children += 1
                        elif low[u] >= seen[parent]:
                            found.add(parent)
            if children > 1:
                found.add(root)
        return pa.table({"node": pa.array(sorted(found), rows["node"].type)})

    kind = dict(named.dtypes)["node"]
    return named.groupBy("component").applyInArrow(points, f"node {kind}")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of dangling ends, repeated ids, repeated keys and reversed repeats."""
    known = nodes.select(F.col("node_id").alias("id")).distinct()
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    dangling = ends.join(known, "id", "left_anti").agg(F.lit("dangling_end").alias("issue"), F.count("*").alias("n"))

    def repeats(df: DataFrame, key: str, issue: str) -> DataFrame:
        return df.groupBy(key).count().filter("count > 1").agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))

    back = edges.select("edge_type", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")).filter("src_id < dst_id")
    reverse = edges.join(back.distinct(), ["edge_type", "src_id", "dst_id"], "left_semi").agg(F.lit("reverse_repeat").alias("issue"), F.count("*").alias("n"))
    return dangling.unionByName(repeats(nodes, "node_id", "repeated_node")).unionByName(repeats(edges, "semantic_key", "repeated_key")).unionByName(reverse)


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids added, removed or kept between two builds."""
    a, b = old.select(key).distinct().withColumn("__a", F.lit(True)), new.select(key).distinct().withColumn("__b", F.lit(True))
    change = F.when(F.col("__a") & F.col("__b"), "kept").when(F.col("__a"), "removed").otherwise("added")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def holdout(edges: DataFrame, key: str, share: tuple[int, int], seed: int) -> DataFrame:
    """Edges marked ``held_out`` by the order of their hashes, an exact share of them."""
    total = edges.count()
    n = total * share[0] // share[1]
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    chosen = edges.select(key).distinct().orderBy(order, key).limit(n).withColumn("held_out", F.lit(True))
    return edges.join(chosen, key, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def ranking_metrics(scores: DataFrame, query: str, score: str, positive: str, at: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Mean rank, mean reciprocal rank and hits, ties sharing their mean rank."""
    ranked = scores.withColumn("__rank", average_rank(F.col(score), [query]).cast("double")).filter(F.col(positive))
    return ranked.agg(
        F.count("*").alias("n"), F.round(F.avg("__rank"), 6).alias("mean_rank"), F.round(F.avg(1 / F.col("__rank")), 6).alias("mrr"),
        *[F.round(F.avg((F.col("__rank") <= k).cast("double")), 6).alias(f"hits_at_{k}") for k in at],
    )


def message_pass(edges: DataFrame, states: DataFrame, size: int) -> DataFrame:
    """One relation-aware round: per node and edge type, the mean of the neighbours' states."""
    met = edges.select("edge_type", F.col("src_id").alias("node_id"), F.col("dst_id").alias("__other")).union(
        edges.select("edge_type", F.col("dst_id"), F.col("src_id"))
    ).join(states.withColumnRenamed("node_id", "__other"), "__other")
    means = met.groupBy("node_id", "edge_type").agg(*[F.avg(F.col("state")[i]).alias(f"x{i}") for i in range(size)])
    return means.select("node_id", "edge_type", F.array(*[F.col(f"x{i}") for i in range(size)]).alias("message"))
