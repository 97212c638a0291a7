"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = f"translate(coalesce(text, ''), '{UP}', '{LOW}')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {FOLD} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def line_dedup(chars: int) -> str:
    """Windows of lines compared as text, without fingerprints: shortest runs of ``chars`` characters, grown forwards or backwards."""
    trim = "trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
kept AS (SELECT doc_id, pos, {trim} AS norm FROM raw WHERE length({trim}) > 0),
seq AS (
  SELECT doc_id, pos, norm, length(norm) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p,
    sum(length(norm)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM kept),
ls AS (SELECT doc_id, list(norm ORDER BY p) AS t FROM seq GROUP BY doc_id),
span AS (
  SELECT a.doc_id, a.p AS s, b.p AS e FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {chars}
  WHERE b.upto - a.upto + a.c >= {chars} AND (b.upto - b.c - a.upto + a.c < {chars} OR b.upto - a.upto < {chars})),
win AS (SELECT doc_id, s, e, array_to_string(t[s:e], chr(10)) AS key FROM span JOIN ls USING (doc_id)),
first AS (SELECT key, min(struct_pack(d := doc_id, a := s)) AS f FROM win GROUP BY key),
later AS (SELECT win.* FROM win JOIN first USING (key) WHERE struct_pack(d := win.doc_id, a := win.s) > first.f),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS p FROM later),
dead AS (SELECT seq.doc_id, seq.pos FROM seq JOIN gone USING (doc_id, p)),
n AS (SELECT doc_id, count(*) AS n_lines FROM seq GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_dropped FROM dead GROUP BY doc_id),
clean AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.pos) AS t FROM raw ANTI JOIN dead ON raw.doc_id = dead.doc_id AND raw.pos = dead.pos GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN clean USING (doc_id)
"""


CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2\3', 'g') AS body FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, least(i + 4, len(w))), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY ALL
"""


def decontamination(window: int) -> str:
    words = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item, list_slice(w, i, least(i + {window - 1}, len(w))) AS p
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {window - 1}))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(p) AS k FROM pat),
win AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)),
occ AS (SELECT DISTINCT doc_id, i, k, item FROM win JOIN pat USING (p)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2 AS cap FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
    CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights FROM w),
v AS (SELECT *, (total - before) / weights AS lvl FROM f),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT lvl FROM v WHERE lvl * w <= cap ORDER BY cap / w, lvl LIMIT 1) * w, CAST(cap AS DOUBLE))) AS target FROM v),
h AS (
  SELECT d.*, t.source_size, t.target, size * 1000 > t.source_size AS large,
    CAST(('0x' || substr(md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u,
    CAST(('0x' || substr(md5('mix-1#' || coalesce(d.source, 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS z,
    CASE WHEN size < 8 THEN size ELSE (length(bin(size)) - 1) * 8 + (size >> (length(bin(size)) - 4)) - 8 END AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, row_number() OVER (PARTITION BY source, large ORDER BY CASE WHEN large THEN -size ELSE -c END, CASE WHEN large THEN 0 ELSE CAST(floor(u * (SELECT greatest(1, CAST(ceil(count(*) / 2000000.0) AS BIGINT)) FROM d)) AS BIGINT) END, u, doc_id, size) AS k FROM h),
fold AS (
  SELECT source, CAST(0 AS BIGINT) AS k, target AS lft, source_size AS rst, 0.0::DOUBLE AS upto, CAST(0 AS BIGINT) AS copies FROM t
  UNION ALL
  SELECT source, nk, lft - cp * size, rst - size, upto + e, cp FROM (
    SELECT *, CAST(floor(upto + e + z) - floor(upto + z) AS BIGINT) AS cp FROM (
      SELECT f.source, o.k AS nk, f.lft, f.rst, f.upto, o.size, o.z, least(2.0::DOUBLE, greatest(0.0::DOUBLE, f.lft / f.rst)) AS e
      FROM fold f JOIN o ON o.large AND o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1) x) y),
s2 AS (
  SELECT f.source, f.upto, CASE WHEN f.rst > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, f.lft / f.rst)) WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e
  FROM fold f JOIN t ON f.source IS NOT DISTINCT FROM t.source
  WHERE f.k = (SELECT max(k) FROM fold g WHERE g.source IS NOT DISTINCT FROM f.source))
SELECT doc_id, size, source_size, target, copies * size AS taken FROM o JOIN fold ON o.large AND fold.k = o.k AND fold.source IS NOT DISTINCT FROM o.source
UNION ALL
SELECT doc_id, size, source_size, target, CAST(floor(upto + k * e + z) - floor(upto + (k - 1) * e + z) AS BIGINT) * size
FROM o JOIN s2 ON s2.source IS NOT DISTINCT FROM o.source WHERE NOT o.large
"""
