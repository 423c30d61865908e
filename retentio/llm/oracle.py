"""DuckDB SQL of the queries that SQL can express.

Not here, and tested against brute force instead: sharding (its CRC-32 over
whole texts is too slow in SQL), the learned and sampled operators, the
randomness battery, approximate search, packing.
"""

from __future__ import annotations

from retentio.llm.license_scan import PHRASES, WORD, templates_of
from retentio.llm.line_dedup import MIN_CHARS, MIN_DOCS as LINE_MIN_DOCS
from retentio.llm.quality_rules import MIN_DOCS, MIN_LEFT

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}

_ESCAPED = r"regexp_replace(replace({c}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<?/?SYS>)', '\1\\\2', 'g')"
_ROLE, _TEXT = _ESCAPED.format(c="role"), _ESCAPED.format(c="text")
ORACLE["op2_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
per AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
         sum(length('<|turn|>' || {_ROLE} || '<|text|>' || {_TEXT} || '<|end|>')) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM per"""

ORACLE["op6_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '{_WORD}') AS words FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
gram AS (SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM gram WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
named AS (SELECT doc_id, source, line, p, regexp_extract_all(line, '{_WORD}') AS lw FROM line),
held AS (SELECT doc_id, source, line, p, len(lw) AS n, translate(array_to_string(lw, ' '), {_LOWER}) AS k FROM named WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS r FROM held)
        WHERE r > 1 GROUP BY doc_id),
often AS (SELECT source, k FROM held GROUP BY source, k HAVING count(DISTINCT doc_id) > {MIN_DOCS}),
gone AS (SELECT h.doc_id, sum(h.n) AS n_removed_words FROM held h JOIN often o ON h.source IS NOT DISTINCT FROM o.source AND h.k = o.k GROUP BY h.doc_id),
base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept FROM base"""

ORACLE["op7_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
keyed AS (SELECT doc_id, line, p, translate(trim(line, {_SPACE}), {_LOWER}) AS k FROM line),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LINE_MIN_DOCS}),
marked AS (SELECT keyed.*, last IS NOT NULL AND doc_id < last AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

# The dual is solved here by bisection instead of Newton steps; the targets by
# the water level, the copies by the same rounding rule (it decides the result).
ORACLE["op8_mixing"] = f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
        FROM d GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][k % 3 + 1] AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM src),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
           FROM weighed WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT level FROM levels WHERE w * level <= cap ORDER BY cap / w, k LIMIT 1),
goal AS (SELECT source, k AS id, source_size, CAST(source_size AS DOUBLE) / n AS mean, least(cap, w * (SELECT level FROM water)) AS target FROM weighed),
hist AS (SELECT id, target, size, mean, count(*) AS c FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source GROUP BY ALL),
packed AS (SELECT id, target, list(CAST(size AS DOUBLE) / mean ORDER BY size) AS xs, list(CAST(c * size AS DOUBLE) ORDER BY size) AS ts
           FROM hist WHERE size > 0 GROUP BY id, target),
half AS (SELECT id, target, xs, ts, -1e5::DOUBLE AS lo, 1e5::DOUBLE AS hi, 0 AS i FROM packed
  UNION ALL
  SELECT id, target, xs, ts, CASE WHEN got < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN got < target THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(1, len(xs) + 1), lambda j: ts[j] * CASE WHEN (lo + hi) / 2 * xs[j] >= ln(2) THEN 2
                                          ELSE exp((lo + hi) / 2 * xs[j]) END)) AS got FROM half WHERE i < 130)),
tilt AS (SELECT id, (lo + hi) / 2 AS tau FROM half WHERE i = 130),
rated AS (SELECT h.id, h.target, size, c, CASE WHEN size = 0 THEN 1.0::DOUBLE WHEN h.target >= 2 * source_size OR tau * (size / h.mean) >= ln(2) THEN 2.0::DOUBLE
                 ELSE exp(tau * (size / h.mean)) END AS rate
          FROM hist h JOIN goal USING (id) LEFT JOIN tilt USING (id)),
summed AS (SELECT *, coalesce(sum(rate * c) OVER (PARTITION BY id ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rated),
dealt AS (SELECT *, least(CAST(floor(before + rate * c + 0.5) - floor(before + 0.5) AS BIGINT), 2 * c) AS k,
                 row_number() OVER (PARTITION BY id ORDER BY size DESC) AS j FROM summed),
lack AS (SELECT id, CAST(round(max(target)) AS BIGINT) - CAST(sum(k * size) AS BIGINT) AS missing FROM dealt WHERE size > 0 GROUP BY id),
fill AS (SELECT id, CAST(0 AS BIGINT) AS j, missing, CAST(0 AS BIGINT) AS more FROM lack
  UNION ALL
  SELECT id, j, missing - more * size, more FROM (
    SELECT f.id, q.j, f.missing, q.size, CASE WHEN f.missing > 0 THEN least(f.missing // q.size, 2 * q.c - q.k) ELSE -least((-f.missing) // q.size, q.k) END AS more
    FROM fill f JOIN dealt q ON q.id = f.id AND q.j = f.j + 1 WHERE q.size > 0)),
settled AS (SELECT dealt.*, CAST(k + coalesce(more, 0) AS DOUBLE) AS copies FROM dealt LEFT JOIN fill USING (id, j)),
placed AS (SELECT d.doc_id, d.size, g.id, g.source_size, g.target, row_number() OVER (PARTITION BY g.id, d.size ORDER BY d.doc_id) - 1 AS r
           FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, p.size, source_size, p.target, CAST(floor((r + 1) * copies / c) - floor(r * copies / c) AS BIGINT) * p.size AS taken
FROM placed p JOIN settled f ON p.id = f.id AND p.size = f.size"""

# Lines by regular expression, cuts by list slices.
ORACLE["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || substr(hx, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(hx, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(hx, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


def _vector_codes_sql(rounds: int) -> str:
    """Product codes by plain squared distances: every round is a pair of steps."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), e := c.e)) AS best
  FROM part p JOIN book{r} c ON p.part = c.part GROUP BY p.r, p.part)""")
        if r < rounds:
            steps.append(f"""
sum{r} AS (SELECT part, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p.part, best.e AS e, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i
  FROM part p JOIN near{r} n ON p.r = n.r AND p.part = n.part) GROUP BY part, e, i),
mean{r} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM (SELECT part, e, i, CAST(s AS BIGINT) AS s, n FROM sum{r}) GROUP BY part, e),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.e = m.e)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x,
                     row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) - 1 AS r
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
part AS MATERIALIZED (SELECT r, p AS part, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM kept, range(4) t(p)),
book0 AS (SELECT part, r AS e, x FROM part WHERE r < 256),{",".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
           FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


ORACLE["op12_vector_codes"] = _vector_codes_sql(4)


def _license_sql() -> str:
    """Every block that holds any template word, against every template with that word."""
    templates = templates_of()
    words = ", ".join(f"({t.number}, '{t.label}', '{w}', {len(t.words)}, {t.needed}, {t.stride})" for t in templates for w in t.words)
    phrases = ", ".join(f"('{label}', {[*phrase.split(' ')]})" for phrase, label in PHRASES)
    return f"""
WITH tw(template, label, word, m, needed, stride) AS (VALUES {words}),
ph(label, phrase) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{WORD}') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
place AS (SELECT p.doc_id, p.i, ph.label FROM pos p JOIN ph ON p.word = ph.phrase[1] JOIN d ON d.doc_id = p.doc_id
          WHERE d.w[p.i + 1:p.i + len(ph.phrase)] = ph.phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY doc_id),
held AS (SELECT doc_id, template, label, m, needed, i // stride - k AS block, count(DISTINCT pos.word) AS shared
         FROM pos JOIN tw ON pos.word = tw.word, (VALUES (0), (1)) t(k) WHERE i // stride - k >= 0 GROUP BY ALL HAVING count(DISTINCT pos.word) >= needed),
lab AS (SELECT doc_id, label, true AS base FROM place UNION ALL SELECT doc_id, label, false FROM held),
labs AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels
         FROM lab GROUP BY doc_id),
best AS (SELECT doc_id, max(CAST(shared AS DOUBLE) / m) AS best FROM held GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labs USING (doc_id) LEFT JOIN best USING (doc_id)"""


ORACLE["op11_license_scan"] = _license_sql()
