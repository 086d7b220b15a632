"""DuckDB SQL with the rows of those queries that SQL can express, from their definitions."""

from __future__ import annotations

from . import licenses, urls
from .common import WORD

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * i >= 90 * (sa.n + sb.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a)
SELECT doc_id, n AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sizes.doc_id) AS component_id FROM sizes"""

OP3 = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('17|' || doc_id) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
fill AS (SELECT *, row_number() OVER (ORDER BY 3 * s / w, source) AS k, sum(3 * s) OVER o - 3 * s AS fixed, (SELECT sum(w) FROM src) - (sum(w) OVER o - w) AS rest, (SELECT sum(s) FROM src) AS total
  FROM src WINDOW o AS (ORDER BY 3 * s / w, source)),
level AS (SELECT CAST(total - fixed AS DOUBLE) / CAST(rest AS DOUBLE) AS l FROM fill WHERE (total - fixed) * w <= 3 * s * rest ORDER BY k LIMIT 1),
t AS (SELECT source, s, CASE WHEN CAST(3 * s AS DOUBLE) <= l * w THEN CAST(3 * s AS DOUBLE) ELSE l * w END AS target FROM src, level),
p AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT d.*, s, target, whole, target - whole * s AS part, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS e FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT *, part - coalesce(max(e) FILTER (WHERE e <= part) OVER (PARTITION BY source), 0) AS gap FROM q),
best AS (SELECT arg_min(doc_id, (abs(size - gap), h)) AS doc_id FROM g WHERE e > part AND size > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, s AS source_size, target, CAST((whole + CASE WHEN e <= part OR doc_id IN (FROM best) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM g"""


def _op5() -> str:
    sites = " UNION ALL ".join(f"SELECT '{r.host}' AS h, '{r.path}' AS p, '{r.verdict}' AS v" for r in urls.SITE_RULES)
    when = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in sorted(urls.PATTERN_RULES, key=lambda r: r.name))
    lower = _LOWER.format("{0}")
    return rf"""WITH u AS (SELECT page_id, {lower.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
low AS (SELECT *, {lower.format("host || path")} AS low FROM u), rules AS ({sites}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM low JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
hit AS (SELECT page_id, CASE {when} END AS name FROM low)
SELECT low.page_id, host, path, rule, coalesce(v, CASE WHEN name IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN name END AS pattern
FROM low LEFT JOIN fit USING (page_id) JOIN hit USING (page_id)"""


OP5 = _op5()

OP7 = r"""WITH m0 AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM m0),
z AS (SELECT conv_id, arg_max(turn, (turn, k)) AS turn, arg_max(k, (turn, k)) AS k, arg_max(text, (turn, k)) AS text FROM n0 WHERE role = 'assistant' GROUP BY 1),
paired AS (SELECT a.conv_id AS pair_id, a.turn, a.k, b.text FROM z a JOIN z b ON b.conv_id = a.conv_id + 1),
s0 AS (SELECT conv_id AS pair_id, true AS chosen, n0.turn, role, n0.text FROM n0 JOIN paired ON conv_id = pair_id
  UNION ALL SELECT conv_id, false, n0.turn, role, CASE WHEN n0.turn = paired.turn AND n0.k = paired.k THEN paired.text ELSE n0.text END FROM n0 JOIN paired ON conv_id = pair_id),
c AS (SELECT *, {'t': turn, 'k': row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role, text)} AS pl FROM (SELECT DISTINCT * FROM s0)),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pl, b.pl) AS pl, a.role AS ar, a.text AS atext, b.role AS br, b.text AS bt
  FROM (SELECT * FROM c WHERE chosen) a FULL JOIN (SELECT * FROM c WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.pl = b.pl),
f AS (SELECT pair_id, min(pl) FILTER (WHERE (ar, atext) IS DISTINCT FROM (br, bt)) AS first FROM m GROUP BY 1),
r AS (SELECT pair_id, pl, first IS NULL OR pl < first AS common, ar, br, length(atext) + length('<|im_end|>') + 1 AS an, length(bt) + length('<|im_end|>') + 1 AS bn,
  '<|im_start|>' || ar || chr(10) || atext || '<|im_end|>' || chr(10) AS a, '<|im_start|>' || br || chr(10) || bt || '<|im_end|>' || chr(10) AS b FROM m JOIN f USING (pair_id)),
o AS (SELECT pair_id, count(*) FILTER (WHERE common) AS n_prompt_turns, bool_and(common) AS identical,
  coalesce(string_agg(a, '' ORDER BY pl) FILTER (WHERE common), '') AS prompt, coalesce(string_agg(a, '' ORDER BY pl) FILTER (WHERE NOT common), '') AS chosen, coalesce(string_agg(b, '' ORDER BY pl) FILTER (WHERE NOT common), '') AS rejected,
  CAST(coalesce(sum(an) FILTER (WHERE NOT common AND ar = 'assistant'), 0) AS BIGINT) AS chosen_trained, CAST(coalesce(sum(bn) FILTER (WHERE NOT common AND br = 'assistant'), 0) AS BIGINT) AS rejected_trained FROM r GROUP BY 1)
SELECT pair_id, n_prompt_turns, identical, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256,
  CAST(length(prompt) AS BIGINT) AS prompt_chars, CAST(length(chosen) AS BIGINT) AS chosen_chars, CAST(length(rejected) AS BIGINT) AS rejected_chars, chosen_trained, rejected_trained FROM o"""


def _kept(scale: int, also: str) -> str:
    return f"""kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {also} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


_APART = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: Division of whole numbers rounds to zero in SQL, so the rest is taken off first.
_FLOOR_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _op11(k: int = 16, rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT kept.*, c{i}.c, {_APART.format("kept.v", f"c{i}.w")} AS d FROM kept, c{i}) GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS (SELECT c, coalesce(m.w, c{i}.w) AS w FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY j) AS w
  FROM (SELECT c, j, {_FLOOR_MEAN} AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) m USING (c))"""
            )
    return f"""WITH {_kept(64, "len(embedding) = 64")}, c0 AS (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM
  (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v AS w FROM kept ORDER BY h, w LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (SELECT r, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT cut.*, b{i}.e, {_APART.format("cut.v", f"b{i}.w")} AS d FROM cut JOIN b{i} USING (p)) GROUP BY r, p)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS (SELECT p, e, coalesce(m.w, b{i}.w) AS w FROM b{i} LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS w
  FROM (SELECT p, e, j, {_FLOOR_MEAN} AS x FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e) m USING (p, e))"""
            )
    return f"""WITH {_kept(4096, "embedding IS NOT NULL")}, cut AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT {entries}), b0 AS (SELECT p, e, v AS w FROM cut JOIN first USING (r)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (r)"""


OP11, OP12 = _op11(), _op12()


def _op13() -> str:
    templates = [licenses.words_of(t.text.encode()) for t in licenses.TEMPLATES]
    sets = [sorted({w.decode() for w in ws}) for ws in templates]
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    known = ", ".join(f"({i}, '{t.label}', {licenses.step_of(len(ws))}, {licenses.needed(len(s), licenses.PERCENT)}, {quoted(s)})" for i, (t, ws, s) in enumerate(zip(licenses.TEMPLATES, templates, sets)))
    phrases = ", ".join(f"('{p.label}', {quoted([w.decode() for w in licenses.words_of(p.text.encode())])})" for p in licenses.PHRASES)
    return rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases(label, p) AS (VALUES {phrases}),
place AS (SELECT r, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(p)] = p)) AS i FROM w JOIN phrases ON len(list_intersect(ws, p)) = len(p)),
templates(t, label, step, need, s) AS (VALUES {known}),
steps AS (SELECT step, list_distinct(flatten(list(s))) AS vocabulary FROM templates GROUP BY step),
cut AS (SELECT r, step, vocabulary, ws, unnest(range(0, len(ws), step)) AS first FROM w, steps),
blocks AS (SELECT r, step, first, list_intersect(list_distinct(ws[first + 1 : first + 2 * step]), vocabulary) AS b FROM cut),
met AS (SELECT r, t, label, s, first, first + 2 * step AS stop, len(list_intersect(b, s)) / len(s) AS share FROM blocks JOIN templates USING (step) WHERE len(b) >= need AND len(list_intersect(b, s)) >= need),
left_over AS (SELECT * FROM met a WHERE NOT EXISTS (FROM met b WHERE a.r = b.r AND a.label <> b.label AND len(a.s) < len(b.s) AND list_has_all(b.s, a.s) AND b.first < a.stop AND a.first < b.stop)),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION SELECT r, label FROM left_over) GROUP BY r),
scored AS (SELECT r, max(share) AS score, count(*) AS n_blocks FROM left_over GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM w LEFT JOIN based USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)"""


OP13 = _op13()
