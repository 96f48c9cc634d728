"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import WINDOW as BENCH_WINDOW
from .lines import LINE_WORDS, NEAR_WORDS
from .quality import BASE_PERCENT, BASE_WINDOW, BASE_WORDS, REPEATED, REPEATED_LINES, SYMBOLS_A_WORD
from .substring import WINDOW

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT win.doc_id, unnest(range(i, i + {WINDOW})) AS j FROM win JOIN least USING (k) WHERE m < win.doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, p: NOT list_contains(coalesce(js, []), p)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def _share(n: int) -> tuple[str, str]:
    """CTE and column of the share of word characters inside windows of n words that occurred before."""
    cte = f"""
a{n} AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, k ORDER BY p) AS r FROM (SELECT doc_id, p, array_to_string(ws[p:p + {n - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(p))),
c{n} AS (SELECT doc_id, sum(length(ws[j])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS j FROM a{n} WHERE r > 1) JOIN w USING (doc_id) GROUP BY doc_id)"""
    return cte, f"coalesce(c{n}.chars, 0) / greatest(b.word_chars, 1)::DOUBLE AS repeated_{n}"


_SHARES = {n: _share(n) for n in REPEATED}
QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, i, line, {_WORDS.format("line")} AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w)),
d AS (SELECT doc_id, count(*) AS n, sum(list_sum(list_transform(lw, lambda x: length(x)))) AS chars FROM l WHERE r > 1 AND len(lw) > 0 GROUP BY doc_id),
t AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, p, array_to_string(ws[p:p + {BASE_WINDOW - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {BASE_WINDOW - 2})) AS t(p))),
u AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + {BASE_WINDOW})) AS j FROM t WHERE n > 1) GROUP BY doc_id),{",".join(c for c, _ in _SHARES.values())},
m AS (SELECT b.*, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words, {", ".join(c for _, c in _SHARES.values())}, coalesce(d.chars, 0) / greatest(b.word_chars, 1)::DOUBLE AS repeated_lines
      FROM b LEFT JOIN d USING (doc_id) LEFT JOIN u USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in REPEATED)}),
f AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR repeated_lines > {REPEATED_LINES} OR n_symbols > {SYMBOLS_A_WORD}::DOUBLE * n_words OR {" OR ".join(f"repeated_{n} > {most}" for n, most in REPEATED.items())}) AS kept FROM f
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_BENCH_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS k FROM (SELECT *, least({BENCH_WINDOW}, len(ws)) AS m FROM i WHERE len(ws) > 0), unnest(range(1, len(ws) - m + 2)) AS t(s)),
w AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
h AS (SELECT doc_id, s, p.m, item_id FROM (SELECT doc_id, z.m, s, array_to_string(ws[s:s + z.m - 1], ' ') AS k FROM w, (SELECT DISTINCT m FROM p) AS z, unnest(range(1, len(ws) - z.m + 2)) AS t(s)) AS x JOIN p ON p.m = x.m AND p.k = x.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS j FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)
"""

LINES = f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, array_to_string({_WORDS.format("line")}, ' ') AS k, {_WORDS.format("line")} AS ws, row_number() OVER (ORDER BY doc_id, i) AS age FROM s),
r AS (SELECT *, len(ws) >= {LINE_WORDS} AND row_number() OVER (PARTITION BY k ORDER BY age) > 1 AS same FROM l),
f AS (SELECT age, k, ws, len(ws) AS n FROM r WHERE NOT same AND len(ws) >= {NEAR_WORDS}),
v AS (SELECT age, j, array_to_string(list_concat(ws[1:j - 1], ws[j + 1:]), ' ') AS rest FROM f, unnest(range(1, n + 1)) AS t(j)),
near AS (SELECT age FROM (SELECT age, min(age) OVER (PARTITION BY j, rest) AS best FROM v) WHERE best < age
         UNION SELECT f.age FROM f JOIN v ON v.rest = f.k WHERE v.age < f.age
         UNION SELECT v.age FROM f JOIN v ON v.rest = f.k WHERE f.age < v.age),
g AS (SELECT r.*, near.age IS NOT NULL AS close FROM r LEFT JOIN near USING (age)),
t AS (SELECT doc_id, count(*) AS n, sum((same OR close)::INT) AS gone, sum(close::INT) AS near, string_agg(line, chr(10) ORDER BY i) FILTER (NOT (same OR close)) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(near, 0)::BIGINT AS n_near, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents AS d LEFT JOIN t USING (doc_id)
"""

SQL = {"op1_substring_dedup": SUBSTRING, "op5_quality_rules": QUALITY, "op8_decontamination": DECONTAMINATION, "op9_line_dedup": LINES}
