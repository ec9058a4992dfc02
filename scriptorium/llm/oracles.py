"""DuckDB SQL for those queries of the package that SQL can express.

The others (tokenizer, pseudonyms, classifier, packing, XXH64) are tested
against plain versions in tests/llm.
"""

from __future__ import annotations

from scriptorium.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, 13 AS n, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS k FROM b WHERE len(w) >= 13)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP6 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP7 = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
x AS (SELECT doc_id, k, md5(raw[k:k + 399]) AS h FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 398)) AS k FROM t WHERE octet_length(raw) >= 400)),
c AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
y AS (SELECT doc_id, md5(raw[k:k + 299]) AS h FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 298)) AS k FROM t WHERE octet_length(raw) >= 300)),
e AS (SELECT DISTINCT doc_id, 1 AS earlier FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM y) WHERE least < doc_id),
g AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM
  (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 400 THEN 0 ELSE 1 END AS fresh FROM c)),
r AS (SELECT doc_id, min(k) AS a, max(k) + 399 AS b FROM g GROUP BY doc_id, run),
n AS (SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(hex(raw)[2 * a - 1:2 * b], '' ORDER BY a) AS kept FROM
  (SELECT doc_id, raw, s.a, s.b FROM t JOIN (SELECT doc_id, coalesce(lag(b) OVER w + 1, 1) AS a, a - 1 AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)
     UNION ALL SELECT doc_id, max(b) + 1, 2147483647 FROM r GROUP BY doc_id) s USING (doc_id)) GROUP BY 1)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CAST(coalesce(earlier, 0) AS INTEGER) AS repeats_earlier, sha256(CASE WHEN n_removed IS NULL THEN raw ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id)"""

OP9 = f"""
WITH t AS (SELECT doc_id, {_SPACED} AS w FROM documents),
x AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM t WHERE len(w) >= 50)),
c AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS least FROM x) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM c),
words AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM t)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _places() -> str:
    parts = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        parts.append(f"SELECT doc_id, k - 1 AS pos, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p) - 2})) AS k FROM d) WHERE w[k:k + {len(p) - 1}] = {_list(p)}")
    return " UNION ALL ".join(parts)


def _templates() -> str:
    rows = []
    for label, text in licenses.TEMPLATES:
        words = sorted(set(text.split()))
        rows.append(f"('{label}', {_list(words)}, {licenses.needed(len(words), licenses.THRESHOLD)}, {licenses.stride(text)})")
    return ", ".join(rows)


OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS ({_places()}), t(label, words, need, step) AS (VALUES {_templates()}),
b AS (SELECT doc_id, step, list_distinct(w[s + 1:s + 2 * step]) AS block FROM (SELECT doc_id, w, step, unnest(range(0, greatest(len(w), 1), step)) AS s FROM d, (SELECT DISTINCT step FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(block, words)) / len(words) AS containment FROM b JOIN t USING (step) WHERE len(list_intersect(block, words)) >= need),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY 1),
best AS (SELECT doc_id, max(containment) AS score FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""

SQL = {
    "op5_decontamination": OP5, "op6_cover_tree_search": OP6, "op7_suffix_dedup": OP7, "op9_substring_dedup": OP9, "op10_license_scan": OP10,
}
