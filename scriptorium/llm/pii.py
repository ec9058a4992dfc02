"""Format-preserving Feistel pseudonyms for personal data.

Numbers and dates that pass their kind's validation are replaced by a keyed
permutation of their format: a card number becomes another card number with a
right check digit, a date another date in the same notation. Each kind is a
finite domain ``0 .. n-1``; a balanced Feistel network over the next even power
of two, with cycle walking, permutes it. The same value under the same key gives
the same pseudonym in every document, so records stay linked, and the key
reverses it. Separators, letter case and lengths stay.

The key is an argument or the setting ``spark.scriptorium.pii.key`` of the
session. Where neither is given, an application draws a random key of its own:
its pseudonyms are linked with each other and can't be reversed afterwards. No
key stands in the source.

Kinds: e-mail addresses (the letters and digits before the @), bank account
numbers (IBAN, check digits right), payment cards (13 to 19 digits, check digit
right), telephone numbers with a country prefix, social security numbers, IPv4
addresses, calendar dates, and quoted secrets after words such as token or
password (letters and digits).

Defined cases: null stays null, empty stays empty; a value whose kind's
validation fails is left alone; rows are independent, so ties and repeated rows
change nothing; texts are read whole, in one pass without a shuffle; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import secrets
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache, lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import common

ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ssn", "ipv4", "date", "secret")


@cache
def _drawn() -> bytes:
    return secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or the application's random one; at most 64 bytes count."""
    own = spark.conf.get("spark.scriptorium.pii.key", None)
    return blake2b(own.encode()).digest() if own else _drawn()


@lru_cache(maxsize=1 << 14)
def permuted(x: int, n: int, key: bytes, kind: str, back: bool = False) -> int:
    """The keyed permutation of ``0 .. n-1`` at ``x``, or its inverse."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    rounds = range(ROUNDS)

    def f(r: int, v: int) -> int:
        out = b""
        while len(out) < size:
            out += blake2b(v.to_bytes(size, "big") + bytes([r, len(out) & 255]) + n.to_bytes((n.bit_length() + 7) // 8, "big"), key=key[:64], person=kind.encode()[:16], digest_size=64).digest()
        return int.from_bytes(out[:size], "big") & mask

    while True:
        a, b = x >> half, x & mask
        for r in reversed(rounds) if back else rounds:
            a, b = (b ^ f(r, a), a) if back else (b, a ^ f(r, b))
        x = a << half | b
        if x < n:
            return x


LOWER, UPPER, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_OF = {c: kind for kind in (LOWER, UPPER, DIGITS) for c in kind}


def _signs(value: bytes, key: bytes, kind: str, back: bool, hexadecimal: bool = False) -> bytes:
    """Letters and digits permuted as one number, each place in its own class."""
    classes = [
        (DIGITS + (UPPER if value.isupper() else LOWER)[:6]) if hexadecimal and c in _OF else _OF.get(c) for c in value
    ]
    x, n = 0, 1
    for c, own in zip(value, classes, strict=True):
        if own:
            x, n = x * len(own) + own.index(c), n * len(own)
    x = permuted(x, n, key, kind, back)
    out = bytearray(value)
    for i in range(len(value) - 1, -1, -1):
        if own := classes[i]:
            x, r = divmod(x, len(own))
            out[i] = own[r]
    return bytes(out)


def _digits(value: bytes, key: bytes, kind: str, back: bool, valid: Callable[[str], bool] = lambda d: True) -> bytes:
    """Digits permuted among those strings of their number that are valid."""
    d = re.sub(rb"[^0-9]", b"", value).decode()
    n, x = 10 ** len(d), int(d)
    while True:
        x = permuted(x, n, key, kind, back)
        if valid(f"{x:0{len(d)}d}"):
            return _written(value, f"{x:0{len(d)}d}")


def _written(value: bytes, digits: str) -> bytes:
    rest = iter(digits.encode())
    return bytes(next(rest) if 48 <= c <= 57 else c for c in value)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def _card(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    d = re.sub(rb"[^0-9]", b"", value).decode()
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    body = permuted(int(d[:-1]), 10 ** (len(d) - 1), key, f"card{len(d)}", back)
    body = f"{body:0{len(d) - 1}d}"
    return "card", _written(value, body + str(luhn(body)))


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    plain = value.replace(b" ", b"").decode()
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _signs(plain[4:].encode(), key, "iban" + plain[:2], back).decode()
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    rest = iter((plain[:2] + f"{check:02d}" + body).encode())
    return "iban", bytes(c if c == 32 else next(rest) for c in value)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    if not _ssn_valid(value.replace(b"-", b"").decode()):
        return None
    return "ssn", _digits(value, key, "ssn", back, _ssn_valid)


def _ipv4(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    parts = [int(p) for p in value.split(b".")]
    if max(parts) > 255:
        return None
    # Octets keep their number of digits: 0-9, 10-99 or 100-255.
    ranges = [(0, 10) if p < 10 else (10, 90) if p < 100 else (100, 156) for p in parts]
    if any(len(p) != len(str(int(p))) for p in value.split(b".")):
        return None  # leading zeros are no address
    x, n = 0, 1
    for p, (low, size) in zip(parts, ranges, strict=True):
        x, n = x * size + p - low, n * size
    x = permuted(x, n, key, "ipv4", back)
    out = []
    for low, size in reversed(ranges):
        x, r = divmod(x, size)
        out.append(low + r)
    return "ipv4", ".".join(map(str, reversed(out))).encode()


#: Dates of these years are permuted among themselves, others among the others.
_FROM, _TO, _ALL = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal(), date(9999, 12, 31).toordinal()


def _permuted_day(x: int, key: bytes, kind: str, back: bool) -> int:
    if _FROM <= x < _TO:
        return _FROM + permuted(x - _FROM, _TO - _FROM, key, kind, back)
    x = x - 1 if x < _FROM else x - 1 - (_TO - _FROM)
    x = permuted(x, _ALL - (_TO - _FROM), key, kind, back) + 1
    return x + (_TO - _FROM) if x >= _FROM else x


def _date(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    parts = re.split(rb"([-/.])", value)
    year_first = len(parts[0]) == 4
    a, b, c = (int(parts[i]) for i in (0, 2, 4))
    orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)]
    for k, (y, m, d) in enumerate(orders):
        try:
            x = date(y, m, d).toordinal()
        except ValueError:
            continue
        while True:
            x = _permuted_day(x, key, f"date{k}", back)
            new = date.fromordinal(x)
            own = (new.year, new.month, new.day) if year_first else (new.day, new.month, new.year) if k == 0 else (new.month, new.day, new.year)
            out = [p if i % 2 else b"%0*d" % (len(p), own[i // 2]) for i, p in enumerate(parts)]
            # Lengths stay, and a month-first date stays one that can't be day-first.
            if all(len(a) == len(b) for a, b in zip(out, parts, strict=True)) and (k == 0 or new.day > 12):
                return "date", b"".join(out)
    return None


_EDGE, _STOP = rb"(?<![A-Za-z0-9.+\-])", rb"(?![A-Za-z0-9]|[.\-][0-9])"
#: What may be personal data, most specific first.
FINDERS: tuple[tuple[re.Pattern[bytes], Callable], ...] = (
    (
        re.compile(rb"(?i)(?P<before>\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"'])(?P<value>[A-Za-z0-9+/_\-]{8,200})(?=[\"'])"),
        lambda v, k, b: ("secret", _signs(v, k, "secret", b, re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", v) is not None)),
    ),
    (
        re.compile(rb"(?P<value>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})(?=@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24})"),
        lambda v, k, b: ("email", _signs(v, k, "email", b)),
    ),
    (re.compile(rb"(?<![A-Za-z0-9])(?P<value>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"), _iban),
    (
        re.compile(rb"(?P<value>(?<![A-Za-z0-9])\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4})(?![0-9])"),
        lambda v, k, b: _phone(v, k, b),
    ),
    (re.compile(_EDGE + rb"(?P<value>[0-9]{4}([ \-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ \-])[0-9]{6}\3[0-9]{5}|[0-9]{13,19})" + _STOP), _card),
    (re.compile(_EDGE + rb"(?P<value>[0-9]{3}-[0-9]{2}-[0-9]{4})" + _STOP), _ssn),
    (re.compile(_EDGE + rb"(?P<value>[0-9]{1,3}(?:\.[0-9]{1,3}){3})" + _STOP), _ipv4),
    (
        re.compile(_EDGE + rb"(?P<value>[0-9]{4}([-/.])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\3[0-9]{4})" + _STOP),
        _date,
    ),
)


def _phone(value: bytes, key: bytes, back: bool) -> tuple[str, bytes] | None:
    """Digits after the country prefix, permuted as one number."""
    head = re.match(rb"\+[0-9]{1,3}(?=[^0-9])", value)
    prefix = head.group() if head else value[:2]
    rest = value[len(prefix) :]
    if not 7 <= sum(48 <= c <= 57 for c in rest) <= 14:
        return None
    return "phone", prefix + _digits(rest, key, "phone" + prefix.decode(), back)


_DIGIT = re.compile(rb"[0-9]")


def pseudonyms(raw: bytes | None, key: bytes, back: bool = False) -> tuple[bytes | None, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind."""
    counts: dict[str, int] = {}
    if not raw or not (b"@" in raw or b"=" in raw or b":" in raw or _DIGIT.search(raw)):
        return raw, counts
    digits = _DIGIT.search(raw) is not None
    taken: list[tuple[int, int, bytes]] = []
    for k, (finder, change) in enumerate(FINDERS):
        if k == 1 and b"@" not in raw or k > 1 and not digits:
            continue
        for m in finder.finditer(raw):
            a, b = m.span("value")
            at = bisect_right(taken, (a, b))  # taken spans are disjoint: only the next ones could overlap
            if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
                continue
            if out := change(m["value"], key, back):
                insort(taken, (a, b, out[1]))
                counts[out[0]] = counts.get(out[0], 0) + 1
    if not taken:
        return raw, counts
    parts, at = [], 0
    for a, b, new in taken:
        parts += [raw[at:a], new]
        at = b
    return b"".join([*parts, raw[at:]]), counts


def _replace(batches: Iterator[pa.RecordBatch], key: bytes):
    for whole in batches:
        for batch in common.slices(whole):
            new, kinds, total = [], [], []
            for raw in batch.column(1).to_pylist():
                text, counts = pseudonyms(raw, key)
                new.append(text)
                kinds.append(",".join(f"{k}:{counts[k]}" for k in KINDS if k in counts))
                total.append(sum(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.binary()), pa.array(total, pa.int64()), pa.array(kinds, pa.string())],
                names=["doc_id", "text", "n_found", "kinds"],
            )


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id, text, n_found, kinds`` of every row."""
    key = key or key_of(docs.sparkSession)
    out = common.texts(docs).mapInArrow(lambda it: _replace(it, key), "doc_id bigint, text binary, n_found bigint, kinds string")
    return out.withColumn("text", F.col("text").cast("string"))


def replace_text(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with its ``text`` replaced, all other columns as they were.

    An integer column ``n_chars`` follows the new text.
    """
    key = key or key_of(docs.sparkSession)

    common.small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def replaced(text: pa.Array) -> pa.Array:
        return pa.array([pseudonyms(raw, key)[0] for raw in text.to_pylist()], pa.binary())

    out = docs.withColumn("text", replaced(F.col("text").cast("binary")).cast("string"))
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kinds["n_chars"]))
    return out
