"""Lines, sections and layered text (S and G rows of the survey)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MARK = r"<pb:([^>]+)>"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, start, end, line``: code-point offsets, line ends excluded.

    Texts split in their own rows; offsets accumulate within a text.
    """
    parts = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    size = F.char_length("line")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size + 1).over(w) - 1
    return parts.select(key, F.col("line_no"), (end - size).cast("bigint").alias("start"), end.cast("bigint").alias("end"), "line")


def physical_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a marked-up witness: header lines, page marks and body lines.

    A header is ``#+NAME: value`` or ``# ...``; one pilcrow at a line's end goes;
    nothing else is normalised. Page marks carry forward.
    """
    own = lines(docs, key, text)
    header = F.regexp_extract("line", r"^#\+([A-Z_]+):\s*(.*)$", 1)
    page = F.regexp_extract("line", PAGE_MARK, 1)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return own.select(
        key, "line_no", "start", "end",
        F.when(header != "", header).alias("header"), F.when(header != "", F.regexp_extract("line", r"^#\+[A-Z_]+:\s*(.*)$", 1)).alias("value"),
        F.last(F.when(page != "", page), ignorenulls=True).over(w).alias("page"),
        F.when((header == "") & ~F.startswith("line", F.lit("#")), F.regexp_replace(F.regexp_replace("line", PAGE_MARK, ""), "¶$", "")).alias("body"),
    )


def line_of(offsets: DataFrame, line_table: DataFrame, key: str, offset: str) -> DataFrame:
    """The line that each offset falls in: the last that begins at or before it."""
    from scriptorium.operators.joins import as_of

    return as_of(offsets, line_table, key, offset, "start", "line_no")


def classified(c: Column, rules: list[tuple[str, list[str]]], rest: str = "unknown") -> Column:
    """The name of the first rule of which a term is contained."""
    out = F.lit(rest)
    for name, terms in reversed(rules):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(c, F.lit(t))
        out = F.when(hit, name).otherwise(out)
    return out


def sections(line_table: DataFrame, key: str, heading: Column) -> DataFrame:
    """Spans from each heading to the line before the next, or to the end."""
    marked = line_table.withColumn("__h", heading)
    total = marked.groupBy(key).agg((F.max("line_no") + 1).alias("__end"))
    heads = marked.filter("__h IS NOT NULL")
    nxt = F.lead("line_no").over(Window.partitionBy(key).orderBy("line_no"))
    return heads.withColumn("__next", nxt).join(total, key).select(
        key, F.col("__h").alias("heading"), F.col("line_no").alias("from_line"), F.coalesce("__next", "__end").alias("to_line")
    )


def unit_slice(units: DataFrame, start: int, end: int) -> DataFrame:
    """Units that overlap the half-open span."""
    return units.filter((F.col("end") > start) & (F.col("start") < end))


def blocks(text: str, opening: str = "(", closing: str = ")") -> tuple[list[tuple[int, int, str]], list[str]]:
    """``(start, end, layer)`` of main text and outermost bracketed blocks, and
    what is wrong: unopened, unclosed, or nested brackets."""
    out, issues = [], []
    depth = begin = most = 0
    for i, c in enumerate(text):
        if c == opening:
            if depth == 0:
                if i > begin:
                    out.append((begin, i, "main_text"))
                begin = i
            depth += 1
            most = max(most, depth)
        elif c == closing:
            if depth == 0:
                issues.append("unopened")
                continue
            depth -= 1
            if depth == 0:
                out.append((begin, i + 1, "annotation"))
                begin = i + 1
    if depth:
        issues.append("unclosed")
        out.append((begin, len(text), "unresolved"))
    elif begin < len(text):
        out.append((begin, len(text), "main_text"))
    if most > 1:
        issues.append("nested")
    return out, sorted(set(issues))


def layered(docs: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Layered units of each text; a strict split raises on unmatched brackets.

    The units of a text, end to end, are the text.
    """
    kind = dict(docs.dtypes)[key]

    def split(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, issues = blocks(t or "")
                if strict and {"unopened", "unclosed"} & set(issues):
                    raise ValueError(f"unmatched brackets in {k!r}")
                rows += [(k, n, a, b, layer, t[a:b], ",".join(issues)) for n, (a, b, layer) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "unit_no", "start", "end", "layer", "text", "issues"]
            )

    schema = f"{key} {kind}, unit_no int, start int, end int, layer string, text string, issues string"
    return docs.select(key, text).mapInArrow(split, schema)


def unique_anchors(anchors: DataFrame, bodies: DataFrame, key: str, order: str, anchor: str, text: str) -> DataFrame:
    """Offset of each anchor and its state: ok, missing, repeated or out_of_order.

    Hits may overlap; an anchor is good if it occurs once and after the one before.
    """
    met = anchors.join(bodies.select(key, text), key)
    rest = F.col(text)
    first = F.position(F.col(anchor), rest) - 1
    second = F.position(F.col(anchor), F.expr(f"substring({text}, position({anchor}, {text}) + 1)"))
    last = F.max(F.when(first >= 0, first)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return met.select(
        key, order, anchor, F.when(first >= 0, first).alias("offset"),
        F.when(first < 0, "missing").when(second > 0, "repeated").when(first <= last, "out_of_order").otherwise("ok").alias("state"),
    )


def headings(line_table: DataFrame, key: str, most: int = 16) -> DataFrame:
    """Short lines without punctuation that the next written line takes up.

    high: that line begins with the heading; medium: with its last character.
    """
    written = line_table.filter(F.trim("line") != "").withColumn("t", F.trim("line"))
    nxt = F.lead("t").over(Window.partitionBy(key).orderBy("line_no"))
    short = (F.char_length("t") <= most) & ~F.col("t").rlike(r"\p{P}")
    level = F.when(F.startswith(F.col("next"), F.col("t")), "high").when(
        F.startswith(F.col("next"), F.expr("right(t, 1)")), "medium"
    )
    return written.withColumn("next", nxt).filter(short).withColumn("confidence", level).filter("confidence IS NOT NULL").select(
        key, "line_no", F.col("t").alias("heading"), "confidence"
    )


def front_matter(text: str) -> tuple[dict, str]:
    """The scalar, list and nested keys of a leading ``---`` block, and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text

    def scalar(raw: str):
        raw = raw.strip()
        if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
            return raw[1:-1]
        if raw in ("null", "~", ""):
            return None
        if raw in ("true", "false"):
            return raw == "true"
        if re.fullmatch(r"-?\d+", raw):
            return int(raw)
        if raw.startswith("[") and raw.endswith("]"):
            return [scalar(x) for x in raw[1:-1].split(",") if x.strip()]
        return raw

    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while len(stack) > 1 and indent < stack[-1][0]:
            stack.pop()
        level, own, last = stack[-1]
        if body.startswith("- "):
            if last is not None:
                if not isinstance(own.get(last), list):
                    own[last] = []
                own[last].append(scalar(body[2:]))
            continue
        if indent > level and level >= 0 and last is not None and own.get(last) is None:
            own[last] = {}
            stack.append((indent, own[last], None))
            own = own[last]
        name, _, value = body.partition(":")
        own[name.strip()] = scalar(value)
        stack[-1] = (indent, own, name.strip())
    return root, text[m.end() :]


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, body`` for each ``## name`` part of a Markdown text."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+", -1)
    own = docs.select(key, F.posexplode(parts).alias("n", "part")).filter("n > 0")
    return own.select(key, F.trim(F.substring_index("part", "\n", 1)).alias("section"), F.trim(F.expr("substring(part, position('\n', part) + 1)")).alias("body"))


def exact_source(text: Column, marker: str) -> Column:
    """What follows the first marker; null without it."""
    at = F.position(F.lit(marker), text)
    return F.when(at > 0, F.substring(text, at + len(marker), F.char_length(text)))


def templates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """``(start, end, name, fields)`` of the outermost ``{{...}}``; an unclosed one ends it."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two == "{{":
            begin = i if depth == 0 else begin
            depth, i = depth + 1, i + 2
        elif two == "}}" and depth:
            depth, i = depth - 1, i + 2
            if depth == 0:
                fields, level, last, body = [], 0, 0, text[begin + 2 : i - 2]
                for j, c in enumerate(body):
                    level += (c in "{[") - (c in "}]")
                    if c == "|" and level == 0:
                        fields.append(body[last:j])
                        last = j + 1
                fields.append(body[last:])
                out.append((begin, i, fields[0].strip(), fields[1:]))
        else:
            i += 1
    return out


def template_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, name, n_fields, fields`` of each text's templates; fields are joined by U+001F."""
    kind = dict(docs.dtypes)[key]

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts are Python strings at a time
                part = batch.slice(at, 64)
                found = [
                    (r, n, name, len(fields), "\x1f".join(fields))
                    for r, t in enumerate(part.column(1).to_pylist())
                    for n, (_, _, name, fields) in enumerate(templates(t or ""))
                ]
                rows, *columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[key, "n", "name", "n_fields", "fields"]
                )

    return docs.select(key, text).mapInArrow(read, f"{key} {kind}, n int, name string, n_fields int, fields string")


def front_matters(docs: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """``key`` and the listed top-level scalars of each text's front matter, as strings."""
    kind = dict(docs.dtypes)[key]

    def read(batches):
        for batch in batches:
            found = [front_matter(t or "")[0] for t in batch.column(1).to_pylist()]
            columns = [pa.array([None if f.get(n) is None else str(f[n]) for f in found], pa.string()) for n in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *fields])

    return docs.select(key, text).mapInArrow(read, f"{key} {kind}, " + ", ".join(f"{f} string" for f in fields))


def pattern_spans(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, start, end, surface`` of a pattern's matches, in code points."""
    kind = dict(docs.dtypes)[key]

    def find(batches):
        compiled = re.compile(pattern)
        for batch in batches:
            rows = [
                (k, m.start(), m.end(), m.group())
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for m in compiled.finditer(t or "")
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "start", "end", "surface"])

    return docs.select(key, text).mapInArrow(find, f"{key} {kind}, start int, end int, surface string")
