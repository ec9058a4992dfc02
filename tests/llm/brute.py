"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

CONTRACT_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return CONTRACT_WORDS.findall((text or "").translate(UPPER))


def spaced(text):
    return SPACED_WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    found |= windows[g]
                    hit[k : k + n] = [True] * n
        n_hit = sum(hit)
        out.append((doc, len(w), n_hit, len(found), sha(",".join(sorted(found))), n_hit > 0 and 20 * n_hit >= len(w)))
    return out


def fingerprint(text):
    w = spaced((text or "").translate(UPPER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near_components(docs, radius=2):
    prints = [(d, fingerprint(t)) for d, t in docs]
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[i + 1 :]:
            if (f ^ g).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, f"{f:016x}", find(d)) for d, f in prints]


def repeated_bytes(docs, n=400, shorter=300):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[s : s + n] for _, r in raws for s in range(len(r) - n + 1))
    least = {}
    for d, r in raws:
        for s in range(len(r) - shorter + 1):
            g = r[s : s + shorter]
            least[g] = min(least.get(g, math.inf), math.inf if d is None else d)
    out = []
    for d, r in raws:
        earlier = any(least[r[s : s + shorter]] < (math.inf if d is None else d) for s in range(len(r) - shorter + 1))
        gone = [False] * len(r)
        for s in range(len(r) - n + 1):
            if seen[r[s : s + n]] > 1:
                gone[s : s + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, int(earlier), sha(bytes(c for c, g in zip(r, gone, strict=True) if not g))))
    return out


def repeated_words(docs, n=50):
    split = [(d, spaced(t)) for d, t in docs]
    least = {}
    for d, w in split:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            least[g] = min(least.get(g, math.inf), math.inf if d is None else d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < (math.inf if d is None else d):
                gone[k : k + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def top_k(rows, k=5, every=50):
    whole = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in whole:
        if q % every == 0:
            best = sorted({(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q})[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def licenses(text, base, templates, threshold=0.8):
    w = words(text)
    starts, own = [], set()
    for phrase, label in base:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                own.add(label)
    labels, score = set(own), 0.0
    for label, text_ in templates:
        t = set(text_.split())
        stride = next(n for n in (64, 256, 1024) if len(text_.split()) <= n)
        for s in range(0, max(1, len(w)), stride):
            b = set(w[s : s + 2 * stride])
            if len(b & t) >= math.ceil(threshold * len(t) - 1e-9):
                labels.add(label)
                score = max(score, len(b & t) / len(t))
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(w), len(starts), *ends, ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if starts else score


def token_count(word, pieces):
    """Tokens of the best segmentation of one pre-token, by plain Viterbi."""
    s = "▁" + word
    best = [(0.0, 0)] + [None] * len(s)
    for i in range(1, len(s) + 1):
        for j in range(i):
            score = pieces.scores.get(s[j:i])
            if score is not None:
                reach = (best[j][0] + score, best[j][1] - 1)
            elif i - j == 1:
                cost, n = pieces.char(s[j])
                reach = (best[j][0] + cost, best[j][1] - n)
            else:
                continue
            if best[i] is None or reach > best[i]:
                best[i] = reach
    return -best[-1][1]


def toxic_score(raw, model, orders, bits, per):
    """The classifier's score, n-gram by n-gram."""
    data = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in raw) + b" " if raw else b""
    m, total = (1 << 32) - 1, 0.0
    for n in orders:
        for i in range(len(data) - n + 1):
            h = data[i]
            for c in data[i + 1 : i + n]:
                h = (h * 0x01000193 + c) & m
            x = (h ^ h >> 15) * (0x85EBCA6B + 2 * n) & m
            x ^= x >> 13
            total += float(model.weight[(x * 0xC2B2AE35 & m) >> 32 - bits])
    return 1 / (1 + math.exp(-min(60, max(-60, model.intercept + per * total / max(1, len(data))))))


def card(digits):
    double = [int(c) * (1 + (i % 2)) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def iban(value):
    number = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return int(number) % 97 == 1


def personal(text):
    """Values of four kinds, each sought alone by a plain rule: (kind, value)."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", text):
        out.append(("email", m[1]))
    for m in re.finditer(r"(?<![A-Za-z0-9.+-])[0-9]{13,19}(?![A-Za-z0-9]|[.-][0-9])", text):
        if card(m[0]):
            out.append(("card", m[0]))
    for m in re.finditer(r"(?<![A-Za-z0-9.+-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![A-Za-z0-9]|[.-][0-9])", text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            out.append(("ssn", m[0]))
    for m in re.finditer(r"(?<![A-Za-z0-9.+-])[0-9]{1,3}(\.[0-9]{1,3}){3}(?![A-Za-z0-9]|[.-][0-9])", text):
        if all(str(int(p)) == p and int(p) < 256 for p in m[0].split(".")):
            out.append(("ipv4", m[0]))
    return out
