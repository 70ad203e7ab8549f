"""DuckDB SQL of the operators that SQL can express, over whole tables."""

OP3_LINE_FREQUENCY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT rid, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars FROM w),
v AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM v),
a AS (SELECT rid, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM m WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS norm FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
q AS (SELECT * FROM l WHERE norm <> ''),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM q GROUP BY rid),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
b AS (SELECT q.source, norm FROM q JOIN h ON q.source IS NOT DISTINCT FROM h.source GROUP BY q.source, norm, docs HAVING count(DISTINCT rid) > greatest(5, 0.05 * docs)),
x AS (SELECT rid, count(*) AS n_frequent_lines, CAST(sum(length(q.norm) - length(replace(q.norm, ' ', '')) + 1) AS BIGINT) AS cut FROM q JOIN b ON q.norm = b.norm AND q.source IS NOT DISTINCT FROM b.source GROUP BY rid),
j AS (SELECT d.doc_id, n_words, word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_frequent_lines, 0) AS n_frequent_lines, n_words - coalesce(cut, 0) AS n_words_left FROM d JOIN n USING (rid) LEFT JOIN u USING (rid) LEFT JOIN a USING (rid) LEFT JOIN x USING (rid)),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_frequent_lines > 0 AND (n_words_left < 10 OR n_words_left < 0.3 * n_words)) AS kept, n_frequent_lines, n_words_left FROM e
"""

OP6_FIXED_BLOCK_ANCHORS = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT rid, i, md5(array_to_string(ws[i : i + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM v) WHERE c > 1),
x AS (SELECT DISTINCT rid, i + o AS p FROM m, range(0, 35) r(o)),
t AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT t.rid, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS kept FROM t ANTI JOIN x ON t.rid = x.rid AND t.p = x.p GROUP BY t.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
"""

OP7_WATER_FILLING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
t AS (SELECT 1.5 * CAST(sum(size) AS DOUBLE) AS total FROM d),
f AS (SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM s),
c AS (SELECT source, source_size, weight, weight * (total - below) / above > 2.0 * source_size AS capped FROM f, t),
r AS (SELECT coalesce(sum(2.0 * source_size) FILTER (capped), 0) AS held, sum(weight) FILTER (NOT capped) AS free FROM c),
g AS (SELECT source, source_size, CAST(CASE WHEN capped THEN 2.0 * source_size ELSE weight * CAST(total - held AS DOUBLE) / CAST(free AS DOUBLE) END AS DOUBLE) AS target FROM c, r, t),
p AS (SELECT d.*, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  floor(g.target / g.source_size) AS whole FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN (whole + CASE WHEN target - whole * source_size > 0 AND start + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM p
"""
