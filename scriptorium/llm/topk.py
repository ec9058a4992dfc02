"""Exact top-k search by inner product with dual cover trees.

Rows are dealt to splits, queries to blocks, both of bounded size, and each gets
one cover tree, which is stored; every pair of a split's and a block's tree is
one task's row. A node holds points within its covering radius of its centre,
which is one of them; its children are centres more than half that radius apart
that cover them. For a query node with centre q, radius s and longest vector
length m and a candidate node with centre c, radius r and longest vector length
l, no inner product exceeds the least of

    q.c + |q| r + |c| s + s r,    (m m + l l - max(0, |q - c| - r - s) ** 2) / 2.

Each query leaf first meets the candidate leaf of the nearest centre, which gives
worst kth scores to begin with. Then both trees are descended together: at every
level the node pairs of a query group whose bound is below its worst kth score
go, and the rest are opened. Leaves that stay are compared exactly, best bound
first, many at a time by one matrix product.

Of equal vectors of a split the k + 1 smallest distinct ids count, which is all
that any query can need of them.

Components are whole numbers, floor(256 x). Scores are exact: floating-point
products serve only where every sum is below 2**53, Python integers elsewhere.

Defined cases: null vectors and vectors with null or non-finite components take
no part, nor do rows without an id; shorter vectors count as filled up with
zeros; rows with the query's id are not its candidates; a repeated row ranks
once; fewer candidates than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

SCALE = 256
K = 5
EVERY = 50
#: Rows of a split and queries of a block, about, and children of a node at most.
SPLIT, BLOCK, FAN = 4096, 4096, 16
#: Points of a leaf at most: of candidates, and of queries, which share their bounds.
LEAF, FEW = 64, 16
#: Points that a leaf of queries meets at a time.
TILE = 4096
#: Room for rounding in float bounds, as a share of their size.
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min


@dataclass
class Tree:
    """A cover tree. Points lie so that a node's are ``begin`` to ``end``; a
    node's children are the nodes ``child`` to ``child + children``."""

    points: np.ndarray
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    child: np.ndarray
    children: np.ndarray

    def __post_init__(self):
        own = self.points[self.centre].astype(float)
        self.centres, self.square = own, (own * own).sum(1)
        self.norm = np.sqrt(self.square)

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.children == 0)


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over all points, by repeated covers with halved radii."""
    x = points.astype(float)
    length = np.sqrt((x * x).sum(1))
    order = np.arange(len(x))
    nodes = []  # begin, end, centre, radius, longest, first child, children

    def add(begin: int, end: int, centre: int) -> None:
        own = order[begin:end]
        reach = float(np.sqrt(((x[own] - x[centre]) ** 2).sum(1).max()))
        nodes.append([begin, end, centre, reach, float(length[own].max()), 0, 0])

    if len(x):
        add(0, len(x), 0)
    at = 0
    while at < len(nodes):
        begin, end, centre, radius = nodes[at][:4]
        if end - begin > leaf and radius > 0:
            own = order[begin:end].copy()
            centres, best, scale, fan = [centre], np.zeros(len(own), np.int64), radius / 2, min(FAN, -(-len(own) // leaf))
            nearest = ((x[own] - x[centre]) ** 2).sum(1)
            # Farthest points first: centres are more than the scale apart, and
            # all points within it of one, unless the fan is full before.
            while len(centres) < 2 or len(centres) < fan and nearest.max() > scale * scale:
                c = int(own[np.argmax(nearest)])
                d = ((x[own] - x[c]) ** 2).sum(1)
                best[d < nearest] = len(centres)
                nearest = np.minimum(nearest, d)
                centres.append(c)
            order[begin:end] = own[np.argsort(best, kind="stable")]
            cuts = begin + np.searchsorted(np.sort(best), np.arange(len(centres) + 1))
            nodes[at][5] = len(nodes)
            for k, c in enumerate(centres):
                if cuts[k + 1] > cuts[k]:
                    add(int(cuts[k]), int(cuts[k + 1]), c)
                    nodes[at][6] += 1
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    columns = [np.array(c) for c in zip(*nodes, strict=True)] if nodes else [np.zeros(0, np.int64)] * 7
    columns[2] = place[columns[2].astype(np.int64)]
    return Tree(points[order], ids[order], *columns)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` consecutive numbers from each start."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class Search:
    """Best k candidates for each query of a block among one split's vectors.

    ``met`` counts compared pairs of vectors, ``bounded`` and ``pruned`` pairs of
    nodes, ``inner`` those pruned while the query side was an inner node.
    """

    def __init__(self, asked: Tree, own: Tree, k: int = K):
        self.k, self.a, self.b = k, asked, own
        self.met = self.bounded = self.pruned = self.inner = 0
        n = len(asked.ids)
        most = max([1, *(int(abs(x).max()) for x in (asked.points, own.points) if x.size)])
        dims = max(1, asked.points.shape[1] if n else 1)
        self.exact = most * most * dims < 1 << 53
        kind = float if self.exact else object
        self.q, self.p = asked.points.astype(kind), own.points.astype(kind)
        self.scores = np.full((n, k), LEAST, np.int64 if self.exact else object)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        if n and len(own.ids):
            leaves, mine = own.leaves, asked.leaves
            near = asked.square[mine][:, None] + own.square[leaves] - 2 * asked.centres[mine] @ own.centres[leaves].T
            self.first = dict(zip(mine.tolist(), leaves[near.argmin(1)].tolist(), strict=True))
            for q, c in self.first.items():
                self._meet(q, np.array([c]))
            self._descend(0, np.zeros(1, np.int64))

    def _bounds(self, q: int, nodes: np.ndarray) -> np.ndarray:
        a, b = self.a, self.b
        dot, r, s = b.centres[nodes] @ a.centres[q], b.radius[nodes], a.radius[q]
        one = dot + a.norm[q] * r + b.norm[nodes] * s + s * r
        apart = np.sqrt(np.maximum(a.square[q] + b.square[nodes] - 2 * dot, 0))
        size = a.longest[q] ** 2 + b.longest[nodes] ** 2
        other = (size - np.maximum(apart * (1 - SLACK) - r - s - 1e-6, 0) ** 2) / 2
        self.bounded += len(nodes)
        return np.minimum(one, other) + SLACK * (1 + size)

    def _worst(self, q: int) -> float:
        """The worst kth score of a query group."""
        return float(self.scores[self.a.begin[q] : self.a.end[q], -1].min())

    def _kept(self, q: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = self._bounds(q, nodes)
        ok = bounds >= self._worst(q)
        self.pruned += int((~ok).sum())
        self.inner += int((~ok).sum()) if self.a.children[q] else 0
        return nodes[ok], bounds[ok]

    def _opened(self, nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes, and leaves as they are."""
        n = self.b.children[nodes]
        return np.concatenate([nodes[n == 0], _ranges(self.b.child[nodes].astype(np.int64), n)])

    def _descend(self, q: int, nodes: np.ndarray) -> None:
        nodes, bounds = self._kept(q, nodes)
        if self.a.children[q]:
            nodes = self._kept(q, self._opened(nodes))[0]
            for child in range(int(self.a.child[q]), int(self.a.child[q] + self.a.children[q])):
                self._descend(child, nodes)
            return
        while self.b.children[nodes].any():
            nodes, bounds = self._kept(q, self._opened(nodes))
        own = nodes != self.first[q]
        order = np.argsort(-bounds[own], kind="stable")
        nodes, bounds, size, best = nodes[own][order], bounds[own][order], self.b.end - self.b.begin, True
        while len(nodes):
            to = max(1, int(np.searchsorted(np.cumsum(size[nodes]), TILE, "right")))
            self._meet(q, nodes[:to])
            nodes, bounds = nodes[to:], bounds[to:]
            ok = bounds >= self._worst(q)  # lower ones can't hold a better candidate
            nodes, bounds = nodes[ok], bounds[ok]
            if best:  # the best bounds came first; the others come as they lie
                order, best = np.argsort(self.b.begin[nodes], kind="stable"), False
                nodes, bounds = nodes[order], bounds[order]

    def _meet(self, q: int, leaves: np.ndarray) -> None:
        """Compares a query leaf with candidate leaves, all pairs of points."""
        a, b = slice(int(self.a.begin[q]), int(self.a.end[q])), self.b
        low, high = b.begin[leaves].astype(int), b.end[leaves].astype(int)
        order = np.argsort(low)
        low, high = low[order], high[order]
        whole = (low[1:] == high[:-1]).all()
        at = slice(low[0], high[-1]) if whole else _ranges(low, high - low)
        own, ids = self.a.ids[a], b.ids[at]
        self.met += len(own) * len(ids)
        scores = self.q[a] @ self.p[at].T
        hit = (scores >= self.scores[a, -1][:, None]) & (ids != own[:, None])
        for i in np.flatnonzero(hit.any(1)).tolist():
            j = np.flatnonzero(hit[i])
            s = scores[i, j]
            if len(j) > 4 * self.k:  # ties of the kth stay
                few = s >= (np.partition(s, -self.k)[-self.k] if self.exact else sorted(s)[-self.k])
                # An id of several vectors takes one place for each of its scores.
                if len(np.unique(ids[j[few]])) >= self.k:
                    j, s = j[few], s[few]
            i += a.start
            pairs = {(-int(x), int(v)) for x, v in zip(s, ids[j], strict=True)} | {(-int(x), int(v)) for x, v in zip(self.scores[i], self.found[i], strict=True)}
            best = sorted(pairs)[: self.k]
            best += [(-LEAST, np.iinfo(np.int64).max)] * (self.k - len(best))
            self.scores[i] = [-x for x, _ in best]
            self.found[i] = [v for _, v in best]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query, scores, ids in zip(self.a.ids.tolist(), self.scores.tolist(), self.found.tolist(), strict=True):
            yield from ((query, v, s) for s, v in zip(scores, ids, strict=True) if s != LEAST)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _tree(rows: pa.Table, part: str, k: int | None) -> pa.Table:
    """One row: the number of the part and its tree."""
    points, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
    order = np.lexsort((ids, *points.T[::-1]))
    points, ids = points[order], ids[order]
    equal = np.zeros(len(ids), bool)
    equal[1:] = (points[1:] == points[:-1]).all(1)
    fresh = ~equal
    fresh[1:] |= ids[1:] != ids[:-1]  # a repeated row takes no place of another id
    points, ids, equal = points[fresh], ids[fresh], equal[fresh]
    if k is not None:
        first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(ids))))
        few = np.arange(len(ids)) - first <= k
        points, ids = points[few], ids[few]
    tree = pickle.dumps(cover_tree(points, ids, FEW if k is None else LEAF), protocol=5)
    return pa.table({part: rows[part][:1], "tree": pa.array([tree], pa.binary())})


def _padded(tree: Tree, width: int) -> Tree:
    tree.points = np.pad(tree.points, ((0, 0), (0, width - tree.points.shape[1])))
    tree.__post_init__()
    return tree


def _search(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for own, asked in zip(batch.column(0), batch.column(1), strict=True):
            trees = [pickle.loads(x.as_buffer()) for x in (asked, own)]
            width = max(t.points.shape[1] for t in trees)
            found = list(Search(*[_padded(t, width) for t in trees], k).rows())
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id divides by ``every``."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v")
    )
    asked = valid.filter(F.col("vec_id") % every == 0)
    counts = valid.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    splits, blocks = -(-counts["n"] // SPLIT) or 1, -(-counts["q"] // BLOCK) or 1

    def grown(rows: DataFrame, part: str, into: int, seed: int, most: int | None) -> DataFrame:
        dealt = rows.withColumn(part, F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(into)).cast("int")).repartition(into, part)
        return common.saved(dealt.groupBy(part).applyInArrow(lambda t: _tree(t, part, most), f"{part} int, tree binary"))

    left = grown(valid, "split", splits, 1, k).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = grown(asked, "block", blocks, 2, None).withColumnRenamed("tree", "asked")
    pairs = left.join(right, "block").select("split", "block", "tree", "asked").repartition(splits * blocks, "split", "block")
    found = pairs.select("tree", "asked").mapInArrow(lambda it: _search(it, k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
