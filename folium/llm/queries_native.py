"""Queries and SQL of exact dedup and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm.exact_dedup import exact_dedup
from folium.llm.mixing import mix
from folium.session import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

OP4_SQL = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM slim GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3 AS cap, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
fill AS (
  SELECT 0 AS step, CAST(sum(source_size) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS share FROM w
  UNION ALL
  SELECT f.step + 1,
    (SELECT CAST(sum(source_size) - sum(CASE WHEN cap < weight * f.share THEN cap ELSE 0 END) AS DOUBLE)
       / CAST(sum(CASE WHEN cap < weight * f.share THEN 0 ELSE weight END) AS DOUBLE) FROM w)
  FROM fill f WHERE f.step < 64),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(share) FROM fill)) AS target FROM w),
r AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
x AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, k.seed,
    CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(CAST('0x' || substr(md5(k.seed || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM slim s JOIN r ON s.source IS NOT DISTINCT FROM r.source, range(16) k(seed)),
y AS (SELECT source, target, seed, abs(sum(size * copies) - target) AS miss FROM x GROUP BY source, target, seed),
z AS (SELECT source, seed FROM y QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1)
SELECT x.doc_id, x.size, x.source_size, x.target, CAST(x.size * x.copies AS BIGINT) AS taken
FROM x JOIN z ON x.source IS NOT DISTINCT FROM z.source AND x.seed = z.seed
"""
