"""Query and SQL of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm.url_filters import filter_urls, parse_rules
from folium.session import spread

#: The rules that the query's contract fixes.
RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return filter_urls(pages, parse_rules(RULES)).select("page_id", "host", "path", "rule", "verdict", "template")


_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM p),
j AS (
  SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS label,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$') AND length(s) >= 8 THEN '#' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END), '/') AS shape FROM r),
s AS (
  SELECT host, coalesce(shape, '') AS shape, count(*) AS n, count(*) FILTER (label = 'block') AS nb, count(*) FILTER (label = 'allow') AS na
  FROM j GROUP BY 1, 2),
@TREE@
o AS (SELECT (coalesce(sum(nb), 0) + 1.0::DOUBLE) / (coalesce(sum(nb) + sum(na), 0) + 2.0::DOUBLE) AS overall FROM t),
h AS (SELECT host, template, sum(nb) AS nb, sum(na) AS na FROM t GROUP BY ALL),
x AS (SELECT template, (sum(nb) + 4.0::DOUBLE * (SELECT overall FROM o)) / (sum(nb) + sum(na) + 4.0::DOUBLE) AS prior FROM h GROUP BY ALL),
v AS (SELECT host, template, (nb + 4.0::DOUBLE * prior) / (nb + na + 4.0::DOUBLE) AS purity FROM h JOIN x USING (template))
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.label, CASE WHEN v.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM j LEFT JOIN t ON j.host = t.host AND coalesce(j.shape, '') = t.shape LEFT JOIN v ON t.host = v.host AND t.template = v.template
"""


def _tree_sql(deepest: int) -> str:
    """The tree, depth by depth: x<d> has the shapes of at least d segments with the template of the first d. Deeper shapes would be missing."""
    out = ["x0 AS (SELECT host, shape, n, nb, na, '' AS template, string_split(shape, '/') AS parts FROM s)"]
    for d in range(deepest):
        path = "l.label" if d == 0 else "x.template || '/' || l.label"
        out += [
            f"n{d} AS MATERIALIZED (SELECT host, template, parts[{d + 1}] AS segment, sum(n) AS n, sum(nb) AS nb, sum(na) AS na FROM x{d} WHERE len(parts) > {d} GROUP BY ALL)",
            f"f{d} AS MATERIALIZED (SELECT host, template, count(*) AS kids, sum(n) AS pn, sum(nb) AS pb, sum(na) AS pa FROM n{d} GROUP BY ALL)",
            f"""l{d} AS MATERIALIZED (
  SELECT n.host, n.template, n.segment, CASE
    WHEN contains(segment, '#') THEN segment
    WHEN kids >= 8 AND n * kids <= 2 * pn THEN '*'
    WHEN nb + na >= 5 AND pb + pa - nb - na >= 5 AND
      abs(CAST(nb AS DOUBLE) / (nb + na) - CAST(pb - nb AS DOUBLE) / (pb + pa - nb - na))
      <= sqrt(CAST(pb AS DOUBLE) / (pb + pa) * (1 - CAST(pb AS DOUBLE) / (pb + pa)) * (1.0::DOUBLE / (nb + na) + 1.0::DOUBLE / (pb + pa - nb - na))) THEN '*'
    ELSE segment END AS label
  FROM n{d} n JOIN f{d} f ON n.host = f.host AND n.template = f.template)""",
            f"x{d + 1} AS MATERIALIZED (SELECT x.host, x.shape, x.n, x.nb, x.na, {path} AS template, x.parts FROM x{d} x JOIN l{d} l ON x.host = l.host AND x.template = l.template AND x.parts[{d + 1}] = l.segment WHERE len(x.parts) > {d})",
        ]
    ends = " UNION ALL ".join(f"SELECT host, shape, nb, na, template FROM x{d} WHERE len(parts) = {d}" for d in range(1, deepest + 1))
    return ",\n".join([*out, f"t AS ({ends})"]) + ","


OP1_SQL = _SQL.replace("@TREE@", _tree_sql(16))
