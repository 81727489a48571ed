"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_RULES = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
b AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS fails FROM f GROUP BY source),
m AS (SELECT (sum(fails) + 0.5e0) / (sum(n) + 1e0) AS mean, sum(n) AS n, avg(1e0 / n) AS inverse,
             coalesce(var_samp(fails * 1e0 / n), 0) AS spread FROM h),
p AS (SELECT mean, n, mean * (1 - mean) AS base, spread, spread - mean * (1 - mean) * inverse AS own FROM m),
q AS (SELECT mean, least(CASE WHEN own > 0 THEN greatest((base - spread) / own, 1) ELSE n END, n) AS weight FROM p),
v AS (SELECT source, (fails + mean * weight) / (h.n + weight) > 0.5 AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

BLOCK_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p
         FROM (SELECT s.doc_id, unnest(generate_series(i, i + 12)) AS p FROM s JOIN m USING (g) WHERE s.doc_id > m.least)),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
      FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w)
      ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_BENCH_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = rf"""
WITH t AS (SELECT item_id, {_BENCH_WORDS} AS words FROM benchmark),
q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(words[i:i + size - 1], ' ') AS g
      FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(generate_series(1, greatest(len(words) - 9, least(len(words), 1)))) AS i
            FROM t)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS words FROM documents),
s AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS g
      FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i
            FROM d, (SELECT DISTINCT size FROM q))),
h AS (SELECT doc_id, i, size, item FROM s JOIN q USING (size, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, base, substr(h, 2 * base + 1, 910) AS part
      FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 200, 256)) AS base FROM d)),
s AS (SELECT doc_id, base + k AS i, md5(substr(part, 2 * k + 1, 400)) AS g
      FROM (SELECT doc_id, base, part, unnest(generate_series(0, least(255, length(part) // 2 - 200))) AS k FROM c)),
o AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS head
      FROM s SEMI JOIN o USING (g)),
e AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b
      FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
x AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM e),
y AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front,
             sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last
      FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN y.doc_id IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op7_decontaminate": DECONTAMINATE,
    "op8_host_rules": HOST_RULES,
    "op10_block_dedup": BLOCK_DEDUP,
}
