"""Repeated byte strings by a hash-compared suffix sort.

A byte goes if a 400-byte string that covers it also starts anywhere else.

*Which suffixes.* Of every 151 consecutive places the one whose 150-byte hash is
smallest is an anchor: two equal strings of 300 bytes or more have the same
anchors at the same distances from their starts. Anchors whose 150 bytes occur
once are done; the exchange of ``exchange.py`` tells which occur more often.

*The sort.* The anchors left send their surroundings (150 bytes before, 400 from
the anchor on, cut at the text's ends; equal ones of a batch once) to a bucket
of their hash. There the suffixes of one anchor hash are sorted by a merge sort
whose comparisons find the common extension of two suffixes by binary search
over prefix polynomial hashes (modulo 2**31 - 1); the reversed prefixes before the
anchors are sorted the same way. Neighbours' extensions and their order are
verified byte by byte; if a hash has collided the sort is repeated with another
base. A group's distinct extensions cut the sorted suffixes into classes; within
a class the neighbours in the order of the reversed prefixes tell how far the
match goes to the left. That gives every start whose 400 bytes occur elsewhere,
exactly.

*Hot anchors.* An anchor hash with over ``HOT`` surroundings, those of a batch
counted once where they are equal, is not sorted in one place: its at most 151 strings of 400 bytes go to the exchange, one for each
distinct string and batch, and are told apart by 128-bit BLAKE2b digests of all
their bytes. So no task holds an unbounded group, and no pairs are listed. Both
ways give the same answers; equality never rests on the anchors' 64-bit hashes.

*Shorter repeats.* Passages of 300 to 399 bytes stay, but they can be told:
``repeats_earlier`` is 1 if a text holds a 300-byte string that also starts in a
text with a smaller doc_id. The same classes tell it, by the smallest doc_id of
each run of neighbours whose common part has 300 bytes.

Defined cases: null and empty texts have no bytes; texts under 400 bytes lose
none; rows with the same doc_id are texts of their own, and equal texts remove
each other but none of them is the earlier; a null doc_id counts as larger than every
other; matches never cross texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scriptorium.llm import common, exchange

LENGTH = 400
GRAM = 150
REACH = 150
#: Strings of so many bytes share their anchors.
SPAN = GRAM + REACH
HOT = 1024
LAST = np.iinfo(np.int64).max
#: Bytes of surroundings sorted at a time, and of text hashed at a time.
CHUNK = 1 << 20
STEP = 1 << 15
#: The modulus of the prefix hashes, and their bases, tried one by one.
PRIME_BITS = 31
PRIME = np.uint64((1 << PRIME_BITS) - 1)
BASES = random.Random(0).sample(range(1 << 20, (1 << PRIME_BITS) - 1), 64)

ANSWERS = "batch bigint, bucket int, kind string, bits binary"
SENT = "kind string, batch bigint, bucket int, blob binary, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, repeats_earlier int, kept_sha256 string"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, repeats_earlier int, kept_sha256 string"


def string_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every ``n`` (at least 8) consecutive bytes, joined from eights."""
    size = len(data) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.empty(size, np.uint64)
    for at in range(0, size, STEP):
        h, own = common.mixed(eights[at : at + STEP + n - 8]), 8
        while 2 * own <= n:
            h, own = common.joined(h[:-own], h[own:]), 2 * own
        last = min(STEP, size - at)
        out[at : at + STEP] = common.joined(h[:last], h[n - own : n - own + last]) if own < n else h
    return out


def _slid(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive entries."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of texts of ``SPAN`` bytes or more."""
    owners, places, keys = [], [], []
    group, held = [], 0
    for i, raw in enumerate(raws):
        group.append(i)
        held += len(raw)
        if held < CHUNK and i + 1 < len(raws):
            continue
        data = np.frombuffer(b"".join(raws[j] for j in group), np.uint8)
        ends = np.cumsum([len(raws[j]) for j in group])
        grams = string_hashes(data, GRAM)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = _slid(short, REACH + 1, np.minimum)
        for e in ends[:-1]:  # windows that cross into the next text don't count
            least[max(0, e - SPAN + 1) : e] = 0
        pad = np.zeros(REACH, np.uint32)
        at = np.flatnonzero(_slid(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == short)
        # A gram that crosses texts may equal nothing: its windows are all 0, so
        # only a hash of 0 could; the bounds below settle that.
        own = np.searchsorted(ends, at, "right")
        start = ends[own] - np.array([len(raws[j]) for j in group])[own]
        ok = at + GRAM <= ends[own]
        owners.append(np.array(group)[own[ok]])
        places.append((at - start)[ok])
        keys.append(grams[at[ok]])
        group, held = [], 0
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(places), np.concatenate(keys)


# --- the sort ---------------------------------------------------------------


class Collision(Exception):
    """Two different strings have the same hash under this base."""


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainders of numbers below 2**62 by the prime 2**31 - 1."""
    x = (x & PRIME) + (x >> np.uint64(PRIME_BITS))
    x = (x & PRIME) + (x >> np.uint64(PRIME_BITS))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(n: int, base: int) -> np.ndarray:
    """``base ** i`` for i up to ``n``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, _rest(out * np.uint64(pow(base, len(out), int(PRIME))))])
    return out[: n + 1]


class Suffixes:
    """Strings of a buffer, in groups, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, base: int):
        self.data, self.starts, self.sizes, self.group = data, starts, sizes, group
        n = len(data)
        power, total = _powers(n, base), np.zeros(n + 1, np.uint64)
        np.cumsum(_rest((data.astype(np.uint64) + np.uint64(1)) * power[:n]), out=total[1:])
        self.total, self.up = _rest(total), power[::-1].copy()
        self.bytes = data.tobytes()

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` bytes at a and b have the same hash: sums brought to
        one power by what they lack to the largest."""
        left = (self.total[a + n] + PRIME - self.total[a]) * self.up[a]
        return _rest(left) == _rest((self.total[b + n] + PRIME - self.total[b]) * self.up[b])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings x and y, by binary search."""
        a, b = self.starts[x], self.starts[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        whole = self._same(a, b, high)
        low[whole] = high[whole]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            same = self._same(a[open_], b[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        return self._next(x, n) < self._next(y, n)

    def order(self) -> np.ndarray:
        """Strings sorted within their groups (which are contiguous), stably.

        Bottom-up merge sort, all groups and all pairs of runs at a time: a
        string's place after a merge is its place in its run plus the number of
        strings before it in the sibling run, found by binary search.
        """
        n = len(self.starts)
        order = np.arange(n)
        if not n:
            return order
        first = np.searchsorted(self.group, self.group)  # where one's group begins
        size = np.searchsorted(self.group, self.group, "right") - first
        run = 1
        while True:
            act = np.flatnonzero(size > run)
            if not len(act):
                return order
            at = act - first[act]
            other = (at // run ^ 1) * run
            have = np.clip(size[act] - other, 0, run)
            right = at // run % 2 == 1
            low, high = np.zeros(len(act), np.int64), have.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                x = order[act[open_]]
                y = order[first[act[open_]] + other[open_] + mid]
                # In the left run only lesser strings of the sibling come before, in the right run equal ones too.
                swap = right[open_]
                before = self.less(np.where(swap, x, y), np.where(swap, y, x)) ^ swap
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            place = first[act] + at // (2 * run) * (2 * run) + at % run + low
            merged = order.copy()
            merged[place] = order[act]
            order = merged
            run *= 2

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Verified common extension of each string with the next of its group, else -1."""
        out = np.full(len(order), -1, np.int64)
        if len(order) < 2:
            return out
        same = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]])
        out[same] = self.extension(order[same], order[same + 1])
        self.verify(order[same], order[same + 1], out[same])
        self.in_order(order[same], order[same + 1], out[same])
        return out

    def verify(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        data = self.bytes
        a, b = self.starts[x], self.starts[y]
        m = np.minimum(self.sizes[x], self.sizes[y])
        for i, j, k, most in zip(a.tolist(), b.tolist(), n.tolist(), m.tolist(), strict=True):
            if data[i : i + k] != data[j : j + k] or k < most and data[i + k] == data[j + k]:
                raise Collision

    def in_order(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Neighbours with the verified common extension ``n`` stand in order."""
        if (self._next(x, n) > self._next(y, n)).any():
            raise Collision

    def _next(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after ``n``, -1 at the end."""
        out = self.data[np.minimum(self.starts[x] + n, len(self.data) - 1)].astype(np.int64)
        out[n == self.sizes[x]] = -1
        return out


def recurring(contexts: list[bytes], lefts: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (context, a1, a2): strings that start a1 to a2 bytes before the
    context's anchor occur with another context of the same key. And for each
    context the least rank of those that share a string of ``SPAN`` bytes with it.

    ``keys`` are sorted; a context is its ``lefts`` bytes before the anchor and
    the rest from the anchor on.
    """
    for base in BASES:
        try:
            return _recurring(contexts, lefts, keys, ranks, base)
        except Collision:
            continue
    raise RuntimeError("hash collisions under every base")


def _recurring(contexts: list[bytes], lefts: np.ndarray, keys: np.ndarray, ranks: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    anchor = ends - sizes + lefts
    data = np.frombuffer(b"".join(contexts), np.uint8)
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    right = Suffixes(data, anchor, sizes - lefts, group, base)
    order = right.order()
    extent = right.neighbours(order)
    left = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - anchor, lefts, group, base)
    left_order = left.order()
    left.neighbours(left_order)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    # Distinct extensions of each group, longest first; only those that can reach.
    least = ranks.copy()
    linked = np.flatnonzero(extent >= SPAN - REACH)
    pairs = np.unique(np.stack([group[order[linked]], -extent[linked]], 1), axis=0) if len(linked) else np.zeros((0, 2), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(pairs))
    level = np.zeros(int(group[-1]) + 1 if n else 0, np.int64)
    found = []
    step = 0
    while len(begin):
        live = begin + step < stop
        begin, stop = begin[live], stop[live]
        if not len(begin):
            break
        level[:] = 0
        level[pairs[begin + step, 0]] = -pairs[begin + step, 1]
        act = np.flatnonzero(level[group[order]] > 0)  # places in the order, groups whole
        reach = level[group[order[act]]]
        new = np.ones(len(act), bool)
        new[1:] = (extent[act[1:] - 1] < reach[1:]) | (act[1:] - 1 != act[:-1])
        cls = np.cumsum(new)
        by = np.lexsort((rank[order[act]], cls))
        own, need = order[act[by]], reach[by]
        x, y, r = own[:-1], own[1:], need[:-1]
        far = np.full(len(x), -1, np.int64)
        both = np.flatnonzero(cls[by[:-1]] == cls[by[1:]])
        far[both] = left.extension(x[both], y[both])
        left.verify(x[both], y[both], far[both])
        ok = (far >= 0) & (far >= LENGTH - r)
        for one in (x, y):
            found.append(np.stack([one[ok], np.maximum(LENGTH - r[ok], 0), far[ok]], 1))
        fresh = np.concatenate([[True], (far < 0) | (far < SPAN - r)])  # runs that share SPAN bytes
        low = np.minimum.reduceat(ranks[own], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        alone = fresh & np.append(fresh[1:], True)
        least[own[~alone]] = np.minimum(least[own[~alone]], low[~alone])
        step += 1
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return np.unique(rows, axis=0), least


# --- batches ----------------------------------------------------------------


class Batch:
    """The anchors of a batch of texts and their surroundings."""

    def __init__(self, raws: list[bytes], ranks: np.ndarray):
        self.raws, self.ranks = raws, ranks
        self.owner, self.place, self.keys = anchors(raws)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, and for each how many different
        surroundings it has here, up to 127, plus 128 if it occurs more than once."""
        keys, counts = np.unique(self.keys, return_counts=True)
        several = counts > 1
        kinds = np.ones(len(keys), np.int64)
        if several.any():
            entries = self.contexts(keys[several])[1]
            own, n = np.unique(np.array([e[0] for e in entries], np.uint64), return_counts=True)
            kinds[np.searchsorted(keys, own)] = np.minimum(n, 127)
        return keys, kinds + 128 * several

    def least(self, owners: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """The least rank of the texts that have each of ``n`` things."""
        out = np.full(n, LAST, np.int64)
        np.minimum.at(out, which, self.ranks[owners])
        return out

    def contexts(self, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bytes]], np.ndarray, np.ndarray]:
        """Distinct surroundings of anchors with wanted (sorted) hashes.

        The anchors; ``(hash, bytes before the anchor, bytes)`` in a fixed order;
        which of them each anchor has; how many anchors have each.
        """
        at = np.flatnonzero(np.isin(self.keys, wanted))
        number: dict[tuple[int, int, bytes], int] = {}
        which = np.zeros(len(at), np.int64)
        for k, (i, p, h) in enumerate(zip(self.owner[at].tolist(), self.place[at].tolist(), self.keys[at].tolist(), strict=True)):
            low = max(0, p - REACH)
            which[k] = number.setdefault((h, p - low, self.raws[i][low : p + LENGTH]), len(number))
        entries = sorted(number)
        new = np.empty(len(entries), np.int64)
        for k, e in enumerate(entries):
            new[number[e]] = k
        which = new[which]
        return at, entries, which, np.bincount(which, minlength=len(entries))

    def strings(self, wanted: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and digest (two columns) of the strings of ``size`` bytes around wanted anchors."""
        at = np.flatnonzero(np.isin(self.keys, wanted))
        owners, starts, hashes = [], [], []
        for i in np.unique(self.owner[at]).tolist():
            p = self.place[at[self.owner[at] == i]]
            n = len(self.raws[i])
            step = np.zeros(n + 1, np.int64)
            low, high = np.maximum(p - REACH, 0), np.minimum(p, n - size)
            np.add.at(step, low[low <= high], 1)
            np.add.at(step, high[low <= high] + 1, -1)
            s = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            owners.append(np.full(len(s), i))
            starts.append(s)
            data = memoryview(self.raws[i])
            hashes += [hashlib.blake2b(data[a : a + size], digest_size=16).digest() for a in s.tolist()]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(owners or none), np.concatenate(starts or none), np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _long(blob: bytes) -> tuple[list[int], list[int | None], list[bytes], Batch]:
    """Numbers of the long texts, all ids and texts, and the long ones' anchors."""
    ids, texts = exchange.unpack(blob)
    long = [i for i, t in enumerate(texts) if len(t) >= SPAN]
    ranks = np.array([LAST if ids[i] is None else ids[i] for i in long], np.int64)
    return long, ids, texts, Batch([texts[i] for i in long], ranks)


def _first(batches: Iterator[pa.RecordBatch], buckets: int):
    for rows in batches:
        for batch, blob in zip(rows.column(0).to_pylist(), rows.column(2), strict=True):
            keys, counts = _long(blob.as_py())[-1].distinct()
            out = [(b, batch, keys[own].astype("<u4").tobytes() + counts[own].astype(np.uint8).tobytes()) for b, own in exchange.shares(keys, buckets)]
            yield from exchange.table(exchange.KEYS, out).to_batches()


def _answer_first(rows: pa.Table, hot: int) -> pa.Table:
    """0 for a key that occurs once, 1 for more often, 2 for over ``hot`` surroundings."""
    blobs, sources = rows["keys"].to_pylist(), rows["batch"].to_pylist()
    sent = [(np.frombuffer(x, "<u4", len(x) // 5), np.frombuffer(x, np.uint8, len(x) // 5, 4 * (len(x) // 5))) for x in blobs]
    keys, counts = np.concatenate([k for k, _ in sent]), np.concatenate([c for _, c in sent])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = (np.add.reduceat(counts >> 7, begin) > 0) | (np.diff(np.append(begin, len(keys))) > 1)
    state = several.astype(np.uint8) + (several & (np.add.reduceat(counts & 127, begin) > hot))
    known, bucket, out = keys[begin], rows["bucket"][0].as_py(), []
    for batch, (own, _) in zip(sources, sent, strict=True):
        s = state[np.searchsorted(known, own)]
        if s.any():
            out.append((batch, bucket, np.packbits(s > 0).tobytes() + np.packbits(s > 1).tobytes()))
    return exchange.table(exchange.ANSWERS, out)


def _states(keys: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    for b, own in exchange.shares(keys, buckets):
        if b in answers:
            half = len(answers[b]) // 2
            out[own] = exchange.bits(answers[b][:half], len(own)).astype(int) + exchange.bits(answers[b][half:], len(own))
    return out


def _digest(raw: bytes, removed: np.ndarray | None = None, earlier: int = 0) -> tuple[int, int, int, int, str]:
    if removed is None or not removed.any():
        return len(raw), 0, 0, earlier, hashlib.sha256(raw).hexdigest()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
    return len(raw), int(removed.sum()), len(edge) // 2, earlier, hashlib.sha256(kept).hexdigest()


def _packed(entries: list[tuple[int, int, bytes]], least: np.ndarray) -> bytes:
    head = np.array([len(entries)], "<i8").tobytes()
    body = np.array([e[0] for e in entries], "<u8").tobytes() + np.array([(e[1], len(e[2])) for e in entries], "<u2").tobytes()
    return exchange.squeezed(head + body + least.astype("<i8").tobytes() + b"".join(e[2] for e in entries))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Hashes, bytes before the anchor, least ranks and surroundings."""
    raw = exchange.unsqueezed(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    keys = np.frombuffer(raw, "<u8", n, 8)
    pair = np.frombuffer(raw, "<u2", 2 * n, 8 + 8 * n).reshape(n, 2).astype(np.int64)
    least = np.frombuffer(raw, "<i8", n, 8 + 12 * n)
    ends = 8 + 20 * n + np.cumsum(pair[:, 1])
    return keys, pair[:, 0], least, [raw[e - s : e] for e, s in zip(ends.tolist(), pair[:, 1].tolist(), strict=True)]


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct digests, which of them each is, and how often each occurs."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (digests[order[1:]] != digests[order[:-1]]).any(1)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    return digests[order[first]], which, np.bincount(which, minlength=int(first.sum()))


def _second(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Finished texts, texts with repeated anchors, surroundings and hot strings."""
    out: list[tuple] = []
    rest = (None,) * 6
    for batch, blob in zip(rows["batch"].to_pylist(), rows["blob"], strict=True):
        some: dict[int, bytes] = {}
        if answers.num_rows:
            long, ids, texts, b = _long(blob.as_py())
            keys, _ = b.distinct()
            state = _states(keys, buckets, exchange.by_bucket(answers))
            own = state[np.searchsorted(keys, b.keys)]
            for i in np.unique(b.owner[own > 0]).tolist():
                mine = (b.owner == i) & (own > 0)
                at, hot = b.place[mine].astype("<i8"), (own[mine] > 1).astype(np.uint8)
                held = len(at).to_bytes(8, "little") + at.tobytes() + hot.tobytes() + b.keys[mine].astype("<u8").tobytes()
                some[long[i]] = exchange.squeezed(held + texts[long[i]])
            at, entries, which, _ = b.contexts(keys[state == 1])
            least = b.least(b.owner[at], which, len(entries))
            where = _by_bucket(np.array([e[0] for e in entries], np.uint64), buckets)
            for k in np.unique(where).tolist():
                pick = np.flatnonzero(where == k)
                out.append(("context", batch, k, _packed([entries[j] for j in pick], least[pick]), *rest))
            distinct, _, counts = _distinct(b.strings(keys[state == 2])[2])
            for k, mine in exchange.shares(distinct[:, 0], buckets):
                held = distinct[mine].astype("<u8").tobytes() + np.minimum(counts[mine], 255).astype(np.uint8).tobytes()
                out.append(("string", batch, k, held, *rest))
            owners, _, digests = b.strings(keys[state == 2], SPAN)
            distinct, which, _ = _distinct(digests)
            least = b.least(owners, which, len(distinct))
            out += [("short", batch, k, held, *rest) for k, _, held in exchange.send_least(batch, distinct, least, buckets)]
        else:
            ids, texts = exchange.unpack(blob.as_py())
        for i, doc_id in enumerate(ids):
            if i in some:
                out.append(("doc", batch, None, some[i], doc_id, *rest[1:]))
            else:
                out.append(("done", batch, None, None, doc_id, *_digest(texts[i])))
    return exchange.table(SENT, out)


def _answer_second(rows: pa.Table) -> pa.Table:
    kinds = rows["kind"].to_pylist()
    bucket, out = rows["bucket"][0].as_py(), []
    sources, blobs = rows["batch"].to_pylist(), rows["blob"].to_pylist()
    sent = [(s, _unpacked(x)) for k, s, x in zip(kinds, sources, blobs, strict=True) if k == "context"]
    if sent:
        keys = np.concatenate([x[0] for _, x in sent])
        lefts = np.concatenate([x[1] for _, x in sent])
        ranks = np.concatenate([x[2] for _, x in sent])
        texts = [t for _, x in sent for t in x[3]]
        begin = np.cumsum([0, *(len(x[0]) for _, x in sent)])
        order = np.argsort(keys, kind="stable")
        group = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        cuts, held = [0], 0
        for j, i in enumerate(order.tolist()):
            if held >= CHUNK and group[j]:
                cuts.append(j)
                held = 0
            held += len(texts[i])
        cuts.append(len(order))
        found, least = [], ranks.copy()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:z]
            r, least[own] = recurring([texts[i] for i in own], lefts[own], keys[own], ranks[own])
            r[:, 0] = own[r[:, 0]]
            found.append(r)
        rows_ = np.concatenate(found)
        rows_ = rows_[np.argsort(rows_[:, 0], kind="stable")]
        at = np.searchsorted(rows_[:, 0], begin)
        for k, (source, _) in enumerate(sent):
            part = rows_[at[k] : at[k + 1]] - [begin[k], 0, 0]
            if len(part):
                out.append((source, bucket, "context", part.astype("<i4").tobytes()))
            less = (least < ranks)[begin[k] : begin[k + 1]]
            if less.any():
                out.append((source, bucket, "earlier", np.packbits(less).tobytes()))
    strings = [(s, np.frombuffer(x, "<u8", len(x) // 17 * 2).reshape(-1, 2), np.frombuffer(x, np.uint8, offset=len(x) // 17 * 16)) for k, s, x in zip(kinds, sources, blobs, strict=True) if k == "string"]
    if strings:
        known, which, _ = _distinct(np.concatenate([x[1] for x in strings]))
        total = np.bincount(which, np.concatenate([x[2] for x in strings]), len(known))
        at = 0
        for source, own, _ in strings:
            yes = total[which[at : at + len(own)]] > 1
            at += len(own)
            if yes.any():
                out.append((source, bucket, "string", np.packbits(yes).tobytes()))
    if "short" in kinds:
        short = exchange.answer_least(rows.filter(pc.equal(rows["kind"], "short")).rename_columns(["kind", "batch", "bucket", "keys"]))
        out += [(source, bucket, "short", found) for source, found in zip(short["batch"].to_pylist(), short["bits"].to_pylist(), strict=True)]
    return exchange.table(ANSWERS, out)


def _third(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The texts with repeated anchors, judged."""
    out: list[tuple] = []
    if not rows.num_rows:
        return exchange.table(RESULT, out)
    raws, owner, place, hot, keys = [], [], [], [], []
    for i, blob in enumerate(rows["blob"].to_pylist()):
        blob = exchange.unsqueezed(blob)
        n = int.from_bytes(blob[:8], "little")
        place.append(np.frombuffer(blob, "<i8", n, 8))
        hot.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n))
        keys.append(np.frombuffer(blob, "<u8", n, 8 + 9 * n))
        owner.append(np.full(n, i))
        raws.append(blob[8 + 17 * n :])
    b = Batch([], np.array([LAST if i is None else i for i in rows["doc_id"].to_pylist()], np.int64))
    b.raws, b.owner, b.place, b.keys = raws, np.concatenate(owner), np.concatenate(place), np.concatenate(keys)
    hot = np.concatenate(hot) > 0
    given: dict[str, dict[int, bytes]] = {"context": {}, "earlier": {}, "string": {}, "short": {}}
    for k, bucket, blob in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        given[k][bucket] = blob
    spans = []  # owner, first start, last start of recurring strings
    at, entries, which, times = b.contexts(np.unique(b.keys[~hot]))
    left = np.array([e[1] for e in entries], np.int64)
    size = np.array([len(e[2]) for e in entries], np.int64)
    several = np.flatnonzero(times > 1)
    ranges = [np.stack([several, np.maximum(LENGTH - (size - left)[several], 0), left[several]], 1)]
    where = _by_bucket(np.array([e[0] for e in entries], np.uint64), buckets)
    for k, blob in given["context"].items():
        part = np.frombuffer(blob, "<i4").reshape(-1, 3).astype(np.int64)
        part[:, 0] = np.flatnonzero(where == k)[part[:, 0]]
        ranges.append(part)
    r = np.concatenate(ranges)
    r = r[(r[:, 1] <= r[:, 2])]
    r = r[np.argsort(r[:, 0], kind="stable")]
    low, high = np.searchsorted(r[:, 0], which), np.searchsorted(r[:, 0], which, "right")
    number = high - low
    if number.sum():
        j = np.repeat(at, number)
        k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)
        spans.append(np.stack([b.owner[j], b.place[j] - r[k, 2], b.place[j] - r[k, 1]], 1))
    owners, starts, hashes = b.strings(np.unique(b.keys[hot]))
    if len(hashes):
        distinct, of, _ = _distinct(hashes)
        yes = exchange.answered(distinct[:, 0], buckets, given["string"])[of]
        spans.append(np.stack([owners[yes], starts[yes], starts[yes]], 1))
    all_spans = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
    all_spans = all_spans[np.argsort(all_spans[:, 0], kind="stable")]
    cuts = np.searchsorted(all_spans[:, 0], np.arange(len(raws) + 1))
    earlier = np.zeros(len(raws), bool)
    less = np.zeros(len(entries), bool)
    for k, blob in given["earlier"].items():
        mine = np.flatnonzero(where == k)
        less[mine] = exchange.bits(blob, len(mine))
    earlier[b.owner[at[less[which] | (b.least(b.owner[at], which, len(entries))[which] < b.ranks[b.owner[at]])]]] = True
    owners, _, hashes = b.strings(np.unique(b.keys[hot]), SPAN)
    distinct, of, _ = _distinct(hashes)
    less = exchange.answered(distinct[:, 0], buckets, given["short"])
    earlier[owners[less[of] | (b.least(owners, of, len(distinct))[of] < b.ranks[owners])]] = True
    for i, doc_id in enumerate(rows["doc_id"].to_pylist()):
        own = all_spans[cuts[i] : cuts[i + 1]]
        step = np.zeros(len(raws[i]) + 1, np.int64)
        np.add.at(step, own[:, 1], 1)
        np.add.at(step, own[:, 2] + LENGTH, -1)
        out.append((doc_id, *_digest(raws[i], np.cumsum(step[:-1]) > 0, int(earlier[i]))))
    return exchange.table(RESULT, out)


def repeated_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, repeats_earlier, kept_sha256`` of every row."""
    dealt = exchange.deal(docs)
    buckets = dealt.buckets
    sent = dealt.docs.mapInArrow(lambda it: _first(it, buckets), exchange.KEYS)
    answers = common.saved(dealt.by_bucket(sent).applyInArrow(lambda rows: _answer_first(rows, hot), exchange.ANSWERS))
    second = common.saved(
        dealt.by_batch(dealt.docs).cogroup(dealt.by_batch(answers)).applyInArrow(lambda rows, own: _second(rows, own, buckets), SENT)
    )
    common.dropped(dealt.docs, answers)
    asked = second.filter("kind IN ('context', 'string', 'short')").select("kind", "batch", "bucket", "blob")
    recur = dealt.by_bucket(asked).applyInArrow(_answer_second, ANSWERS)
    held = second.filter("kind = 'doc'").select("batch", "doc_id", "blob")
    judged = dealt.by_batch(held).cogroup(dealt.by_batch(recur)).applyInArrow(lambda rows, own: _third(rows, own, buckets), RESULT)
    done = second.filter("kind = 'done'").select("doc_id", "n_bytes", "n_removed", "n_spans", "repeats_earlier", "kept_sha256")
    return done.unionByName(judged)
