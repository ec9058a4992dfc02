"""Text scalars. JVM expressions wherever Catalyst has them; the few that it
lacks are Arrow-batched. Offsets are code points, 0-based and half-open."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: All white space of Unicode, as plain ranges, which match faster than the property.
SPACE = "[\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
# Numerals and their worth.
NUMERALS = {"〇": 0, "零": 0, "○": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "元": 1}
UNITS = {"十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000}
PREFIX_TENS = {"廿": 20, "卅": 30}


def _mapped(kind):
    """An Arrow scalar function from a Python function of one value."""

    def wrap(f):
        @F.arrow_udf(kind)
        def apply(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else f(v) for v in values.to_pylist()], type=_ARROW[type(kind)])

        apply.plain = f
        return apply

    return wrap


_ARROW = {StringType: pa.string(), IntegerType: pa.int32(), ArrayType: pa.list_(pa.string())}


@_mapped(StringType())
def fold(value: str) -> str:
    """Compatibility-normalised and lower-cased."""
    return unicodedata.normalize("NFKC", value).lower()


def fold_ascii(c: Column) -> Column:
    """The folding of texts that are compatibility-normalised already."""
    return F.lower(c)


def compact(c: Column) -> Column:
    """Without any white space, the ideographic space included."""
    return F.regexp_replace(c, SPACE, "")


def source_text(c: Column) -> Column:
    """Without comments, white space and slashes."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?U)[\s/]+", "")


@_mapped(StringType())
def masked_comments(value: str) -> str:
    """Comments blanked character by character; line ends and offsets stay."""
    return re.sub(r"(?s)<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m.group()), value)


_MYRIAD = "".join(c for c, n in UNITS.items() if n == 10000)
_SMALL = "".join(c for c, n in UNITS.items() if n < 10000)
_DIGITS, _TENS = "".join(NUMERALS), "".join(PREFIX_TENS)
_MYRIADS = re.compile(f"[{_MYRIAD}]")
#: A digit with its unit (either may lack the other), or a sign for several tens.
_STEP = re.compile(f"([{_DIGITS}]?)([{_SMALL}])|([{_TENS}])|([{_DIGITS}])$")
_SIGNS = re.compile(f"[{_DIGITS}{_SMALL}{_TENS}{_MYRIAD}]+")


def _below_myriad(part: str) -> int:
    """Worth of a numeral without the sign for ten thousand; a bare unit is one."""
    steps = _STEP.findall(part)
    return sum((NUMERALS.get(d) or 1) * UNITS[u] if u else PREFIX_TENS[t] if t else NUMERALS[last] for d, u, t, last in steps)


def han_numeral(value: str) -> int | None:
    """Worth of a numeral up to 99,999,999; null where a sign is none.

    Digits alone are read place by place. Otherwise the numeral is a sum of
    parts, each but the last multiplied by ten thousand.
    """
    if not value or not _SIGNS.fullmatch(value):
        return None
    if all(c in NUMERALS for c in value):
        return int("".join(str(NUMERALS[c]) for c in value))
    *myriads, rest = _MYRIADS.split(value)
    return sum((_below_myriad(p) or 1) * 10000 for p in myriads) + _below_myriad(rest)


han_number = _mapped(IntegerType())(han_numeral)


def ordinal_text(n: Column) -> Column:
    """1 to 99 as a numeral: the inverse of ``han_number`` for ordinals."""
    digits = F.array(*map(F.lit, "一二三四五六七八九"))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    return F.concat(
        F.when(tens > 1, F.get(digits, tens - 1)).otherwise(F.lit("")),
        F.when(tens > 0, F.lit("十")).otherwise(F.lit("")),
        F.when(ones > 0, F.get(digits, ones - 1)).otherwise(F.lit("")),
    )


def log_norm(value: Column, maximum: Column, places: int = 8) -> Column:
    """log1p(value) / log1p(maximum), within 0 and 1; 0 where either is not positive."""
    share = F.log1p(value.cast("double")) / F.log1p(maximum.cast("double"))
    return F.when((value > 0) & (maximum > 0), F.round(F.least(share, F.lit(1.0)), places)).otherwise(F.lit(0.0))


def bounded(value: Column, places: int = 8) -> Column:
    """Within 0 and 1, rounded."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double"))), places)


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null parts are empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


@_mapped(StringType())
def unescaped(value: str) -> str:
    return html.unescape(value)


def plain_text(c: Column, limit: int) -> Column:
    """Tags to spaces, entities read, controls dropped, line ends unified, trimmed and cut."""
    text = unescaped(F.regexp_replace(c, r"<[^>]*>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.substring(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 1, limit)


def one_line(c: Column) -> Column:
    """Runs of line ends, with the blanks around them, become one space."""
    return F.trim(F.regexp_replace(c, r"[ \t]*[\r\n]+[ \t]*", " "))


def is_han(c: Column) -> Column:
    return F.coalesce(c.rlike("^[㐀-鿿]+$"), F.lit(False))


def han_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^㐀-鿿]", "")


def cut(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def unfenced(c: Column) -> Column:
    """The body of a fenced code block, or the text itself, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


@_mapped(ArrayType(StringType()))
def text_leaves(value: str) -> list[str]:
    """All strings of a JSON document, in document order; not JSON gives none."""
    try:
        todo = [json.loads(value)]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]
    return out


def byte_span(text: Column, start: Column, end: Column) -> Column:
    """UTF-8 offsets of the characters from ``start`` to ``end``."""
    before = F.octet_length(F.substring(text, F.lit(1), start.cast("int")))
    return F.struct(before.alias("start"), (before + F.octet_length(F.substring(text, start.cast("int") + 1, (end - start).cast("int")))).alias("end"))


def ngrams(value: str) -> list[str]:
    """The whole compact query, its 3-grams and 2-grams, longest first, each once."""
    whole = "".join(value.split())
    found = [whole] if whole else []
    for n in (3, 2):
        found += [whole[i : i + n] for i in range(len(whole) - n + 1)]
    return sorted(dict.fromkeys(found), key=lambda t: (-len(t), t))


def ngram_terms(c: Column) -> Column:
    """:func:`ngrams` of a column, in the JVM."""
    whole = compact(c)

    def of(n: int) -> Column:
        last = F.char_length(whole) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(whole, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    terms = F.array_distinct(F.filter(F.concat(F.array(whole), of(3), of(2)), lambda t: t != ""))
    keyed = F.array_sort(F.transform(terms, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda k: k["t"])


@_mapped(StringType())
def unrepeated(value: str) -> str:
    """The largest unit of two characters or more that repeats to the whole value."""
    for n in range(len(value) // 2, 1, -1):
        if len(value) % n == 0 and value == value[:n] * (len(value) // n):
            return value[:n]
    return value


# --- sets --------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the union; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sorted_unique(a: Column) -> Column:
    """Non-empty strings, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both ends in order."""
    return F.least(a, b), F.greatest(a, b)


def present_terms(text: Column, terms) -> Column:
    """Those lexicon terms that the text holds, sorted."""
    return F.filter(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.contains(text, t))
