"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK, CIRCLE, GOLDEN_STEP

WORD = "'[^\\x20\\x09-\\x0D]+'"

LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i:i + 4] AS g, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)
),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM win WHERE c > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, {WORD}) GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         len(list_filter(list_zip(w[:-2], w[2:]), lambda z: z[1] = z[2])) AS n_echoes, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN line USING (doc_id)
),
r AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (10 * n_dup_lines > 6 * n_lines)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT
         + 32 * (2 * word_chars < 3 * n_words)::BIGINT + 64 * (2 * n_upper > word_chars)::BIGINT + 128 * (3 * n_echoes > n_words)::BIGINT AS rule_mask FROM m
)"""

OP1 = f"""{LEDGER}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (rule_mask & 3) <> 0 AS base_failed, (rule_mask & 255) = 0 AS kept, rule_mask::BIGINT AS rule_mask
FROM r
"""

ABLATION = f"""{LEDGER},
rules AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'duplicate_lines', 'long_words', 'short_words', 'capitals', 'echoes']) AS rule, unnest(range(8)) AS bit)
SELECT rule, count(*) FILTER (WHERE rule_mask >> bit & 1 = 1)::BIGINT AS n_failed, count(*) FILTER (WHERE rule_mask = 1 << bit)::BIGINT AS n_only,
       count(*) FILTER (WHERE rule_mask IN (0, 1 << bit))::BIGINT AS n_kept_without FROM r CROSS JOIN rules GROUP BY rule
"""

OP2 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0)::BIGINT AS size, CASE WHEN doc_id IS NULL THEN md5(text) END AS own FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
),
g AS (SELECT *, level * weight >= 3 * source_size AS capped FROM l),
goal AS (
  SELECT source, rank, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
         ELSE (SELECT level FROM g WHERE NOT capped ORDER BY source_size / weight, rank LIMIT 1) * weight END AS target FROM g
),
words AS (
  SELECT *, least(upto - lag(upto, 1, 0) OVER (ORDER BY rank), 3 * source_size) AS words FROM
  (SELECT *, round(sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto FROM goal)
),
placed AS (
  SELECT doc_id, size, rank, source_size, target, words,
         (sum(size) OVER (PARTITION BY rank ORDER BY coalesce(md5(doc_id::VARCHAR), own, ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM d JOIN words ON d.source IS NOT DISTINCT FROM words.source
),
total AS (SELECT ((coalesce(sum(size), 0) + {BLOCK - 1}) // {BLOCK})::BIGINT AS n FROM d),
ends AS (SELECT rank, sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM goal WHERE target > 0),
rounded AS (SELECT rank, round(upto / max(upto) OVER () * {CIRCLE})::BIGINT AS upto FROM ends),
shares AS (SELECT rank, lag(upto, 1, 0) OVER (ORDER BY rank) AS since, upto FROM rounded),
points AS (SELECT slot, slot * {GOLDEN_STEP} % {CIRCLE} AS point FROM (SELECT unnest(range(n)) AS slot FROM total)),
dealt AS (SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS k FROM points JOIN shares ON point >= since AND point < upto),
lacks AS (
  SELECT rank, coalesce(had, 0) AS had, greatest((words + {BLOCK - 1}) // {BLOCK} - coalesce(had, 0), 0)::BIGINT AS lack
  FROM words LEFT JOIN (SELECT rank, count(*) AS had FROM dealt GROUP BY rank) USING (rank)
),
later AS (SELECT *, coalesce(sum(lack) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM lacks),
slots AS (
  SELECT slot, rank, k FROM dealt
  UNION ALL SELECT n + earlier + i, rank, had + i FROM (SELECT *, unnest(range(lack)) AS i FROM later), total
),
lines AS (
  SELECT rank, start, pass * source_size + start AS since, least(pass * source_size + start + size, words) AS upto
  FROM placed, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND pass * source_size + start < words
),
spread AS (
  SELECT l.rank, l.start, sum((upto - 1) // {BLOCK} - since // {BLOCK} + 1) AS pieces, min(a.slot) AS first_slot, max(b.slot) AS last_slot
  FROM lines l JOIN slots a ON a.rank = l.rank AND a.k = since // {BLOCK} JOIN slots b ON b.rank = l.rank AND b.k = (upto - 1) // {BLOCK} GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (words // source_size) + greatest(0, least(size, words % source_size - p.start)) END::BIGINT AS taken,
       CASE WHEN size = 0 THEN 0 ELSE coalesce(pieces, 0) END::BIGINT AS pieces,
       CASE WHEN size > 0 THEN first_slot END AS first_slot, CASE WHEN size > 0 THEN last_slot END AS last_slot
FROM placed p LEFT JOIN spread s ON s.rank = p.rank AND s.start = p.start
"""

ITEM_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, {ITEM_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, {ITEM_WORD}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP8 = """
WITH t AS (
  SELECT conv_id AS pair_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations
),
s AS (SELECT pair_id, max(i) AS last, arg_min(text, i) AS said FROM t WHERE role = 'assistant' GROUP BY pair_id),
r AS (
  SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS i FROM
  (SELECT pair_id, turn, role, CASE WHEN t.i = last THEN said ELSE text END AS text FROM t JOIN s USING (pair_id) WHERE t.i <= last)
),
diff AS (
  SELECT pair_id, min(i) FILTER (WHERE t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text) AS cut, max(i) AS n
  FROM t FULL JOIN r USING (pair_id, i) GROUP BY pair_id
),
n AS (SELECT pair_id, coalesce(cut - 1, n) AS n_common FROM diff),
tc AS (SELECT pair_id, i, role, i <= n_common AS shared, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS tail FROM t JOIN n USING (pair_id)),
rc AS (SELECT pair_id, i, role, i <= n_common AS shared, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS tail FROM r JOIN n USING (pair_id)),
tp AS (SELECT *, sum(length(head || tail)) OVER (PARTITION BY pair_id ORDER BY i) AS upto FROM tc WHERE NOT shared),
rp AS (SELECT *, sum(length(head || tail)) OVER (PARTITION BY pair_id ORDER BY i) AS upto FROM rc WHERE NOT shared),
p AS (SELECT pair_id, string_agg(head || tail, '' ORDER BY i) AS prompt FROM tc WHERE shared GROUP BY pair_id),
c AS (SELECT pair_id, string_agg(head || tail, '' ORDER BY i) AS chosen,
      string_agg((upto - length(tail))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS chosen_loss FROM tp GROUP BY pair_id),
j AS (SELECT pair_id, string_agg(head || tail, '' ORDER BY i) AS rejected,
      string_agg((upto - length(tail))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS rejected_loss FROM rp GROUP BY pair_id)
SELECT pair_id, n_common::BIGINT AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_loss, '') AS chosen_loss, coalesce(rejected_loss, '') AS rejected_loss,
       coalesce(chosen, '') = '' OR coalesce(rejected, '') = '' AS degenerate
FROM n LEFT JOIN p USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN j USING (pair_id)
"""

OP11 = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
good AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS failed
  FROM w JOIN least USING (text) LEFT JOIN good ON good.doc_id = w.doc_id
),
h AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
masks AS (SELECT DISTINCT failed FROM h),
told AS (
  SELECT filter_order, step, letter, failed, contains(failed, letter) AS fails, failed = letter AS alone,
         length(translate(failed, before, '')) < length(failed) AS gone FROM steps CROSS JOIN masks
),
o AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM told JOIN h USING (failed) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM o
"""

ORACLES = {"op1_quality": OP1, "quality_ablation": ABLATION, "op2_mixing": OP2, "op7_decontamination": OP7, "op8_chat": OP8, "op11_filteraudit": OP11}
