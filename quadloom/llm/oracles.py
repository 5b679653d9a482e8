"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quadloom.llm.mixing import BITS, ROUNDS
from quadloom.llm.quality import CLASS_DISTANCE, WORD_DISTANCE

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def bits(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


_rounds = ["e0 AS (SELECT CAST(0.0 AS DOUBLE) AS low, CAST(1.0 AS DOUBLE) AS width)"]
for _r in range(ROUNDS):
    _rounds.append(
        f"""e{_r + 1} AS (SELECT low + greatest(coalesce(min(CASE WHEN most <= 2.0 * least THEN k END), {1 << BITS}) - 1, 0) * width / {1 << BITS} AS low, width / {1 << BITS} AS width
  FROM (SELECT low, width, k, max(w / p) AS most, min(w / p) AS least FROM (
    SELECT low, width, k, p, pow(p, low + k * (width / {1 << BITS})) AS w FROM (SELECT CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM src) AS p FROM src WHERE tokens > 0), e{_r}, range({(1 << BITS) + 1}) g(k))
  GROUP BY low, width, k) GROUP BY low, width)"""
    )
MIXING = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len({WORDS}) AS BIGINT) AS tokens, CAST({bits("'block:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} % 128 AS INTEGER) AS block FROM documents),
b AS (SELECT source, block, sum(tokens) AS tokens FROM d GROUP BY ALL),
src AS (SELECT source, sum(tokens) AS tokens FROM b GROUP BY ALL),
{', '.join(_rounds)},
w AS (SELECT source, tokens, pow(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM src), (SELECT low + width FROM e{ROUNDS})) AS w FROM src WHERE tokens > 0),
t AS (SELECT source, tokens, w * (SELECT max(tokens / w) FROM w) AS target FROM w),
s AS (SELECT source, epochs, CAST(greatest(floor(target - epochs * tokens + 1e-6), 0) AS BIGINT) AS rest FROM (SELECT *, CAST(floor(target / tokens + 1e-9) AS BIGINT) AS epochs FROM t)
  UNION ALL SELECT source, 1, -1 FROM src WHERE tokens = 0),
v AS (SELECT b.source, block, tokens, epochs, rest, unnest(range(epochs + 1)) AS epoch FROM b JOIN s ON b.source = s.source),
r AS (SELECT *, row_number() OVER o AS block_rank, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS so_far FROM (SELECT *, {bits("'visit:' || source || ':' || block || ':' || epoch")} AS shuffled FROM v)
  WINDOW o AS (PARTITION BY source, epoch ORDER BY shuffled, block))
SELECT doc_id, d.source, epoch, CAST(block_rank AS INTEGER) AS block_rank, {bits("'place:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || epoch")} AS order_key
FROM d JOIN r ON d.source = r.source AND d.block = r.block WHERE epoch < epochs OR so_far <= rest
"""

CHAT = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
f AS (
  SELECT *, regexp_matches(role || text, '<\\|im_(start|esc|end)\\|>') OR contains(role, chr(10)) AS odd FROM c),
e AS (
  SELECT *, CASE WHEN odd THEN replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A') ELSE role END AS er,
    CASE WHEN odd THEN replace(replace(text, '%', '%25'), '<|', '%3C|') ELSE text END AS et FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + CASE WHEN odd THEN 10 ELSE 12 END + 12) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
x AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) GROUP BY doc_id),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS j FROM (SELECT doc_id, unnest(starts) AS s FROM x)) GROUP BY doc_id),
k AS (SELECT doc_id, array_to_string(list(v ORDER BY i), ' ') AS kept FROM
  (SELECT d.doc_id, i, w[i] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d
   LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS hit FROM g) y USING (doc_id, i) WHERE hit IS NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _distance(p: str, q: str) -> str:
    def part(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2, 0))"


def _shares(counts: str) -> str:
    return f"list_transform({counts}, lambda x: x / CAST(greatest(list_sum({counts}), 1) AS DOUBLE))"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, {WORDS} AS w FROM documents),
c AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM d) GROUP BY ALL),
k AS (SELECT lang, list(x ORDER BY n DESC, x)[:24] AS common FROM c GROUP BY lang),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t WHERE (doc_id, g) IN (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) > 1)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
h AS (SELECT doc_id, lang, i, count(*) AS n FROM (SELECT doc_id, d.lang, list_position(common, unnest(w)) AS i FROM d JOIN k ON k.lang = d.lang) WHERE i IS NOT NULL GROUP BY ALL),
m AS (SELECT d.doc_id, d.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  [len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')), len(regexp_extract_all(text, '[^\x00-\x7F]')), length(text) - length(array_to_string(w, ''))] AS cl, length(text) AS chars,
  list_transform(range(1, coalesce(len(common), 0) + 1), lambda j: coalesce(hits[j], 0)) AS wo
  FROM d LEFT JOIN k ON k.lang = d.lang LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN (SELECT doc_id, map_from_entries(list((i, n))) AS hits FROM h GROUP BY doc_id) x USING (doc_id)),
v AS (SELECT * REPLACE (list_append(cl, chars - list_sum(cl)) AS cl, list_append(wo, n_words - coalesce(list_sum(wo), 0)) AS wo) FROM m),
f AS (SELECT lang, {_shares('cl')} AS class_shares, {_shares('wo')} AS word_shares FROM (SELECT lang, sum(n_words) AS n,
  [{', '.join(f'sum(cl[{i}])' for i in range(1, 7))}] AS cl, [{', '.join(f'sum(coalesce(wo[{i}], 0))' for i in range(1, 26))}][:max(len(wo))] AS wo FROM v GROUP BY lang) WHERE n >= 2000),
j AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words >= 50 AND class_shares IS NOT NULL THEN {_distance(_shares('cl'), 'class_shares')} ELSE 0 END AS cd, CASE WHEN n_words >= 50 AND word_shares IS NOT NULL THEN {_distance(_shares('wo'), 'word_shares')} ELSE 0 END AS wd FROM v LEFT JOIN f ON f.lang = v.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND cd <= {CLASS_DISTANCE} * sqrt(greatest(1.0, 100.0 / greatest(n_words, 1))) AND wd <= {WORD_DISTANCE} * sqrt(greatest(1.0, 100.0 / greatest(n_words, 1))) AS kept FROM j
"""
