"""Queries and SQL of phrase mining and conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm.conversations import repair
from folium.llm.phrases import phrases
from folium.llm.queries_native import documents


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, range(1, 4) a(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
j AS MATERIALIZED (
  SELECT lang, k, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM c, range(1, 3) t(j) WHERE j < k),
s AS MATERIALIZED (
  SELECT j.lang, j.phrase, j.f AS a, x.f AS l, y.f AS r, j, CAST(1000000::HUGEINT * j.f * j.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM j JOIN g x ON x.lang = j.lang AND x.phrase = head JOIN g y ON y.lang = j.lang AND y.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY j.lang, j.phrase ORDER BY score, j) = 1),
h AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
o AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM s LEFT JOIN h ON h.lang = s.lang AND h.part = s.phrase WHERE h.most IS NULL OR 100 * h.most < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

#: crc32 bit by bit; then the cheapest edits by dynamic programming, a row of all conversations a step.
OP13_SQL = r"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(k AS BIGINT) for k in range(8)]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)) AS c
  FROM conversations),
y AS (SELECT conv_id, turn, role, text, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS code FROM x),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM y, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
o AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, again,
    left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, left(role, 1) AS r1, lag(left(role, 1)) OVER w AS r0
  FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again)),
f AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', 'user:' || chr(10)), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 5, 'I', 'user:' || chr(10)), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, 0, '', ''), (2, 3, 5, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 5, 'I', 'user:' || chr(10)), (2, 2, 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))) t(p, q, cost, audit, lines)),
step AS (SELECT * FROM (VALUES (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (2, 'a', 3, 'K'), (3, 'u', 2, 'K'), (0, 'user', 2, 'R'), (1, 'user', 2, 'R'), (2, 'assistant', 3, 'R'), (3, 'user', 2, 'R')) t(p, r, q, edit)),
e AS (
  SELECT conv_id, i, 0 AS p, 0 AS q, 'D' AS edit, 2 AS cost, '' AS line FROM f
  UNION ALL SELECT conv_id, i, 1, 1, 'D', 2, '' FROM f UNION ALL SELECT conv_id, i, 2, 2, 'D', 2, '' FROM f UNION ALL SELECT conv_id, i, 3, 3, 'D', 2, '' FROM f
  UNION ALL
  SELECT conv_id, i, p, q, edit, CASE edit WHEN 'R' THEN 1 ELSE 0 END + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, CASE edit WHEN 'R' THEN r ELSE role END || ':' || text || chr(10)
  FROM f JOIN step ON edit = 'R' OR ini = r WHERE fault IN ('', 'truncated')),
go AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM n
  UNION ALL
  (WITH t AS (
    SELECT g.conv_id, e.i, e.q, g.cost + ins.cost + e.cost AS cost, g.audit || ins.audit || e.edit AS audit, g.lines || ins.lines || e.line AS lines
    FROM go g JOIN ins ON ins.p = g.q JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.i = g.i + 1 AND e.p = ins.q)
   SELECT conv_id, i, q, cost, audit, lines FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1)),
done AS (
  SELECT g.conv_id, g.cost + ins.cost AS cost, g.audit || ins.audit AS audit, g.lines || ins.lines AS lines
  FROM go g JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = n.n JOIN ins ON ins.p = g.q WHERE ins.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY g.conv_id ORDER BY g.cost + ins.cost, g.audit || ins.audit) = 1),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r0 IS NOT NULL AND r0 || r1 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
"""
