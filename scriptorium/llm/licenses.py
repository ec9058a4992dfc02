"""License scans: an exact set-similarity join of text blocks with templates.

Templates are a table. A template of up to 64 words is looked for in blocks of
128 words that begin at every 64th word of a text, one of up to 256 words in
blocks of 512 at every 256th, and so on (``STRIDES``): every passage as long as
the template lies in some block. A block meets a template if at least
``THRESHOLD`` of the template's distinct words are among the block's. Template
words are ordered by how many documents hold them, rarest first, counted over the
whole table. With that order a block can meet a template of n words, of which it
needs k, only if

- it holds one of the n - k + 1 rarest (prefix filter): blocks are joined with
  the templates on these words;
- it has k distinct words at least (length filter);
- from the first shared word on, the template has k words left (positional); a
  pair is judged at its first shared word only, so once.

What passes is verified by the intersection. Only blocks that hold a prefix word
leave their text's row. The templates' side of the join is broadcast up to
``BROADCAST_WORDS`` words; beyond that Spark chooses the join. Everything is
DataFrame expressions, and the plan does not grow with the templates.

Places of the base phrases are counted in the same words. A base phrase gives
its label and the score 1; the method's labels are added to it.

Defined cases: null and empty texts have no words, no places, empty labels and
score 0; rows with the same doc_id are scanned each; an empty table gives an
empty result; a template without words, or longer than the longest stride, is an
error.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words up to which a template is looked for in blocks of twice as many.
STRIDES = (64, 256, 1024, 4096)
BROADCAST_WORDS = 1 << 20

# Base phrases of the contract, and notices of public licenses.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """``(doc_id, w)``: the words of each whole text."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_remove(F.split(text, SEPARATORS), "").alias("w"))


def _words(values) -> Column:
    """A constant array of words."""
    return F.split(F.lit(" ".join(values)), " ")


def needed(n: int, threshold: float) -> int:
    """How many of a template's ``n`` distinct words a block needs."""
    return max(1, math.ceil(threshold * n - 1e-9))


def stride(text: str) -> int:
    """The least stride that the template fits in."""
    n = len(text.split())
    if not n or n > STRIDES[-1]:
        raise ValueError(f"a template of {n} words")
    return next(s for s in STRIDES if n <= s)


def frequency_order(worded: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, those in the fewest documents first.

    One row for each template word comes to the driver, whatever the corpus.
    """
    vocabulary = sorted({t for _, text in templates for t in text.split()})
    held = worded.select(F.explode(F.array_intersect(_words(vocabulary), "w")).alias("t"))
    n = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (n.get(t, 0), t))


def prefixes(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """A row for each template and word of its prefix: ``head, step, label, need, ts``."""
    rank, out = {t: i for i, t in enumerate(order)}, []
    for label, text in templates:
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(own), threshold)
        out += [{"head": t, "step": stride(text), "label": label, "need": need, "ts": own} for t in own[: len(own) - need + 1]]
    return out


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The prefix rows as a table, broadcast while it is small."""
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<head:string,step:int,label:string,need:int,ts:array<string>>>")
    out = spark.range(1).select(F.inline(made))
    return F.broadcast(out) if sum(len(r["ts"]) for r in rows) <= BROADCAST_WORDS else out


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    steps = sorted({stride(text) for _, text in templates})
    worded = words(docs)
    rows = prefixes(frequency_order(worded, templates), templates, threshold)
    heads = _words(sorted({r["head"] for r in rows}))
    w = F.col("w")

    def begins(phrase: str):
        parts = phrase.split()
        return lambda i: F.slice(w, i + 1, len(parts)) == _words(parts)

    last_words = _words(sorted({p.split()[-1] for p, _ in BASE}))
    numbers = F.sequence(F.lit(0), F.size(w) - 1)
    none = F.array().cast("array<int>")
    places = F.when(F.arrays_overlap(w, last_words), F.array(*[F.filter(numbers, begins(p)) for p, _ in BASE])).otherwise(F.array(*[none for _ in BASE]))

    def blocks(step: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(step)), lambda s: F.slice(w, s, 2 * step))
        found = F.transform(cut, lambda b: F.struct(F.lit(step).alias("step"), b.alias("words"), F.array_intersect(b, heads).alias("heads")))
        return F.filter(found, lambda b: F.size(b["heads"]) > 0)

    kind = "array<struct<step:int,words:array<string>,heads:array<string>>>"
    counted = worded.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size(w).cast("bigint").alias("n_words"), places.alias("places"),
        F.when(F.arrays_overlap(w, heads), F.concat(*map(blocks, steps))).otherwise(F.array().cast(kind)).alias("blocks"),
    )
    starts = F.flatten("places")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    based = counted.select(
        "row", "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base"), F.explode_outer("blocks").alias("block"),
    )
    headed = based.select(*own, F.col("block.step").alias("step"), F.col("block.words").alias("words"), F.explode_outer("block.heads").alias("head"))
    joined = headed.join(_table(docs.sparkSession, rows), ["head", "step"], "left")
    n = F.size("ts")
    possible = (F.size(F.array_distinct("words")) >= F.col("need")) & (n - F.array_position("ts", F.col("head")) + 1 >= F.col("need"))
    judged = joined.select(*own, "label", "need", n.alias("n"), F.when(possible & (F.array_intersect("ts", "words")[0] == F.col("head")), F.size(F.array_intersect("ts", "words"))).alias("shared"))
    met = F.col("shared") >= F.col("need")
    out = judged.groupBy(*own).agg(F.collect_set(F.when(met, F.col("label"))).alias("found"), F.max(F.when(met, F.col("shared") / F.col("n"))).alias("best"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
