"""Queries over document structure, on sequences and tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.catalog.values import table
from folium.functions import model as M
from folium.operators import layout as L
from folium.operators import styles as S
from folium.session import grouped


def style_cascade(spark, sf_dir):
    """Customer over nation over region, as direct over named over default properties."""
    c = table(spark, sf_dir, "customer").withColumn("direct", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END"))
    n = table(spark, sf_dir, "nation").withColumn("named", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_name END"))
    r = table(spark, sf_dir, "region")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select("c_custkey", S.cascade(F.col("direct"), F.col("named"), F.col("r_name")).alias("font"))


STYLE_CASCADE_SQL = """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS font
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def style_chains(spark, sf_dir):
    """Parts as styles: each based on the part of half its key; every 97th closes a cycle."""
    p = table(spark, sf_dir, "part").select(
        F.expr("p_partkey % 10 AS doc_id"), F.expr("cast(p_partkey div 10 AS INT) AS style_id"), F.expr("CASE WHEN p_partkey div 10 = 0 THEN NULL WHEN (p_partkey div 10) % 97 = 5 THEN cast(p_partkey div 10 AS INT) ELSE cast((p_partkey div 10) div 2 AS INT) END AS based_on"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN p_brand END AS font"), F.expr("CASE WHEN p_size % 7 = 0 THEN cast(p_size AS INT) END AS size"),
    )
    return S.style_chains(p, ["doc_id"], "style_id", "based_on", ["font", "size"])


STYLE_CHAINS_SQL = """
WITH RECURSIVE s AS (SELECT p_partkey % 10 AS doc_id, CAST(p_partkey // 10 AS INT) AS style_id,
  CASE WHEN p_partkey // 10 = 0 THEN NULL WHEN (p_partkey // 10) % 97 = 5 THEN CAST(p_partkey // 10 AS INT) ELSE CAST((p_partkey // 10) // 2 AS INT) END AS based_on,
  CASE WHEN p_size % 4 = 0 THEN p_brand END AS font, CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS INT) END AS size FROM part),
c AS (SELECT doc_id, style_id, based_on AS up, font, size, [style_id] AS seen FROM s
  UNION ALL SELECT c.doc_id, c.style_id, s.based_on, coalesce(c.font, s.font), coalesce(c.size, s.size), list_append(c.seen, s.style_id)
  FROM c JOIN s ON c.doc_id = s.doc_id AND c.up = s.style_id WHERE NOT list_contains(c.seen, s.style_id))
SELECT doc_id, style_id, arg_max(font, len(seen)) AS font, arg_max(size, len(seen)) AS size FROM c GROUP BY doc_id, style_id
"""

ITEM_COLUMNS = (
    "l_orderkey AS doc_id",
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity) AS ord",
    "CAST(CAST(l_quantity AS INT) % 3 AS INT) AS ilvl",
)
ITEMS = ", ".join(ITEM_COLUMNS)


def _items(spark, sf_dir):
    """Lines of orders as items, dealt by order as all windows over them are."""
    return grouped(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr(*ITEM_COLUMNS)


def list_numbering(spark, sf_dir):
    return L.list_numbers(_items(spark, sf_dir), ["doc_id"], ["ord"], "ilvl", F.col("ilvl") + 1)


LIST_NUMBERING_SQL = f"""
WITH i AS (SELECT {ITEMS} FROM lineitem),
e AS (SELECT *, coalesce(CASE ilvl WHEN 0 THEN 0
    WHEN 1 THEN max(CASE WHEN ilvl < 1 THEN ord END) OVER w ELSE max(CASE WHEN ilvl < 2 THEN ord END) OVER w END, 0) AS epoch
  FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT doc_id, ord, ilvl, CAST(ilvl + row_number() OVER (PARTITION BY doc_id, ilvl, epoch ORDER BY ord) AS INT) AS number FROM e
"""


def list_nesting(spark, sf_dir):
    return L.list_parents(_items(spark, sf_dir), ["doc_id"], ["ord"], "ilvl", "ord", "parent_ord")


LIST_NESTING_SQL = f"""
WITH i AS (SELECT {ITEMS} FROM lineitem)
SELECT a.doc_id, a.ord, a.ilvl, max(b.ord) AS parent_ord FROM i a LEFT JOIN i b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.ilvl < a.ilvl GROUP BY ALL
"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "event_type", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(length(event_type) % 3 AS INT) END AS num_id")


def list_runs(spark, sf_dir):
    return L.list_runs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "num_id").select("user_id", "event_id", "num_id", "run_no")


LIST_RUNS_SQL = """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(length(event_type) % 3 AS INT) END AS num_id FROM events),
s AS (SELECT *, CASE WHEN num_id IS NOT NULL AND num_id IS DISTINCT FROM lag(num_id) OVER w THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, num_id, CASE WHEN num_id IS NOT NULL THEN CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) END AS run_no FROM s
"""


def section_split(spark, sf_dir):
    ends = F.col("event_type") == F.lit("purchase")
    return L.split_sections(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ends).groupBy("user_id", "sec").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


SECTION_SPLIT_SQL = """
WITH s AS (SELECT user_id, event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS sec FROM events)
SELECT user_id, sec, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, sec
"""


def page_break_split(spark, sf_dir):
    parts = L.split_at_breaks(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_id") % 5 == 0)
    return parts.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))


PAGE_BREAK_SPLIT_SQL = """
WITH s AS (SELECT user_id, event_id, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS part FROM events)
SELECT user_id, part, count(*) AS n FROM s WHERE event_id % 5 <> 0 GROUP BY user_id, part
"""

#: Orders as tables of three columns: cells by line, spans and merges from quantities.
CELLS = """doc_id, CAST((ord - 1) // 3 AS INT) AS row, CAST((ord - 1) % 3 AS INT) AS ord, CASE WHEN qty % 5 = 0 THEN 2 ELSE 1 END AS span,
  CASE WHEN qty % 3 = 0 THEN 'restart' WHEN qty % 3 = 1 AND ord > 3 THEN 'continue' END AS merge, CASE WHEN qty % 4 = 0 THEN NULL ELSE qty * 100 END AS width, CAST(qty % 3 + 1 AS INT) AS height"""
CELLS_BASE = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity) AS ord, CAST(l_quantity AS INT) AS qty FROM lineitem"


def _cells(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem")
    numbered = base.selectExpr(
        "l_orderkey AS doc_id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity) AS ord", "CAST(l_quantity AS INT) AS qty"
    )
    return numbered.selectExpr(*[x.replace("//", "div") for x in (
        "doc_id", "CAST((ord - 1) // 3 AS INT) AS row", "CAST((ord - 1) % 3 AS INT) AS ord", "CASE WHEN qty % 5 = 0 THEN 2 ELSE 1 END AS span",
        "CASE WHEN qty % 3 = 0 THEN 'restart' WHEN qty % 3 = 1 AND ord > 3 THEN 'continue' END AS merge", "CASE WHEN qty % 4 = 0 THEN NULL ELSE qty * 100 END AS width", "CAST(qty % 3 + 1 AS INT) AS height")])


CELLS_SQL = f"WITH b AS ({CELLS_BASE}), cells AS (SELECT {CELLS} FROM b), placed AS (SELECT *, CAST(coalesce(sum(span) OVER (PARTITION BY doc_id, row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS col FROM cells)"


def rowspan_reconstruct(spark, sf_dir):
    return L.row_spans(_cells(spark, sf_dir), ["doc_id"], "row", "ord", "span", "merge").select("doc_id", "row", "ord", "col", "row_span")


ROWSPAN_RECONSTRUCT_SQL = CELLS_SQL + """,
g AS (SELECT *, sum(CASE WHEN merge = 'restart' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, col ORDER BY row ROWS UNBOUNDED PRECEDING) AS island FROM placed)
SELECT doc_id, row, ord, col, CAST(CASE WHEN merge = 'restart' THEN 1 + count(*) FILTER (merge = 'continue') OVER (PARTITION BY doc_id, col, island) ELSE 1 END AS INT) AS row_span FROM g
"""


def rowspan_expand(spark, sf_dir):
    placed = L.start_columns(_cells(spark, sf_dir), ["doc_id", "row"], "ord", "span")
    return L.spanned_places(placed, "row", "height").groupBy("doc_id", "at_row").agg(F.count(F.lit(1)).alias("cells"), F.count_if("is_continue").alias("continued"), F.sum("col").alias("cols"))


ROWSPAN_EXPAND_SQL = CELLS_SQL + """,
x AS (SELECT doc_id, row, col, row + k.i AS at_row, k.i > 0 AS is_continue FROM placed, range(3) k(i) WHERE k.i < height)
SELECT doc_id, CAST(at_row AS INT) AS at_row, count(*) AS cells, count(*) FILTER (is_continue) AS continued, CAST(sum(col) AS BIGINT) AS cols FROM x GROUP BY ALL
"""


def grid_columns(spark, sf_dir):
    return L.grid_columns(_cells(spark, sf_dir), ["doc_id"], "row", "ord", "span", "width")


GRID_COLUMNS_SQL = CELLS_SQL + """,
x AS (SELECT doc_id, row, ord, span, width, CAST(col + k.i AS INT) AS col FROM placed, range(2) k(i) WHERE k.i < span),
n AS (SELECT doc_id, max(col) AS last FROM x WHERE row = 0 GROUP BY doc_id)
SELECT x.doc_id, x.col AS "column", CAST(coalesce(arg_min(width, row * 10 + ord) FILTER (span = 1 AND width IS NOT NULL), arg_min(width // span, row * 10 + ord) FILTER (span > 1 AND width IS NOT NULL), 2000) AS INT) AS width_twips
FROM x JOIN n ON x.doc_id = n.doc_id AND x.col <= n.last GROUP BY x.doc_id, x.col
"""


def column_widths(spark, sf_dir):
    first = _cells(spark, sf_dir).filter("row = 0")
    shared = L.share_columns(first, ["doc_id"], "width")
    return L.share_first_row(shared.withColumn("pct", F.expr("CASE WHEN ord = 1 THEN 1000 END")), ["doc_id"], "width", "pct").select("doc_id", "ord", "width_twips", "balanced_pct")


COLUMN_WIDTHS_SQL = CELLS_SQL + """,
f AS (SELECT doc_id, ord, width, CASE WHEN ord = 1 THEN 1000 END AS pct FROM placed WHERE row = 0),
t AS (SELECT doc_id, count(width) AS known, count(*) FILTER (width IS NULL) AS missing, sum(width) AS total, count(*) FILTER (width IS NULL AND pct IS NULL) AS bare, coalesce(sum(pct), 0) AS claimed FROM f GROUP BY doc_id)
SELECT f.doc_id, f.ord, CAST(CASE WHEN known = 0 THEN NULL ELSE coalesce(width, greatest(720, floor(greatest(0, 9000 - total) / missing))) END AS INT) AS width_twips,
  CAST(CASE WHEN width IS NULL AND pct IS NULL AND floor(greatest(0, 5000 - claimed) / bare) > 0 THEN floor(greatest(0, 5000 - claimed) / bare) ELSE pct END AS INT) AS balanced_pct
FROM f JOIN t ON f.doc_id = t.doc_id
"""


def paper_size(spark, sf_dir):
    w = "element_at(array(11906, 16838, 12240, 16840, 9000), CAST(p_partkey % 5 + 1 AS INT))"
    h = "element_at(array(16838, 11906, 15840, 23811, 9000), CAST(p_partkey % 5 + 1 AS INT))"
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey", f"CAST({w} + p_size % 80 AS INT) AS w", f"CAST({h} + p_size % 60 AS INT) AS h")
    return L.detect_paper(pages, "w", "h", ["p_partkey"])


PAPER_SIZE_SQL = """
WITH p AS (SELECT p_partkey, CAST(list_extract([11906, 16838, 12240, 16840, 9000], CAST(p_partkey % 5 + 1 AS INT)) + p_size % 80 AS INT) AS w,
  CAST(list_extract([16838, 11906, 15840, 23811, 9000], CAST(p_partkey % 5 + 1 AS INT)) + p_size % 60 AS INT) AS h FROM part),
k(ord, paper, a, b) AS (VALUES (0, 'A3', 16838, 23811), (1, 'A4', 11906, 16838), (2, 'A5', 8391, 11906), (3, 'Letter', 12240, 15840), (4, 'Legal', 12240, 20160))
SELECT p_partkey, w, h, arg_min(paper, ord) AS paper FROM p LEFT JOIN k ON abs(greatest(w, h) - b) < 50 AND abs(least(w, h) - a) < 50 GROUP BY p_partkey, w, h
"""


def page_geometry(spark, sf_dir):
    k = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 5 AS INT) AS k", "CASE WHEN p_size % 2 = 0 THEN 'landscape' ELSE 'portrait' END AS o", "CASE WHEN p_size % 7 = 0 THEN CAST(p_size * 100 AS INT) END AS own")
    joined = k.join(F.broadcast(M.papers(spark)), F.col("k") == F.col("ord"))
    size = ("width", "height", "o", "own", "own")
    w = M.page_width(*[F.col(c) for c in size])
    return joined.select("p_partkey", w.alias("page_width"), M.page_height(*[F.col(c) for c in size]).alias("page_height"), (w - 1700).alias("content_width"))


PAGE_GEOMETRY_SQL = """
WITH k(ord, a, b) AS (VALUES (0, 16838, 23811), (1, 11906, 16838), (2, 8391, 11906), (3, 12240, 15840), (4, 12240, 20160)),
p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 AND p_size > 0 THEN CAST(p_size * 100 AS INT) END AS own, p_size % 2 = 0 AS flat, a, b FROM part JOIN k ON p_partkey % 5 = ord)
SELECT p_partkey, CAST(coalesce(own, CASE WHEN flat THEN b ELSE a END) AS INT) AS page_width, CAST(coalesce(own, CASE WHEN flat THEN a ELSE b END) AS INT) AS page_height, CAST(coalesce(own, CASE WHEN flat THEN b ELSE a END) - 1700 AS INT) AS content_width FROM p
"""


def relationship_ids(spark, sf_dir):
    """Ids within a document: an order's lines in their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return S.relationship_ids(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "rid")


RELATIONSHIP_IDS_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, 'rId' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rid FROM lineitem"


def relationship_lookup(spark, sf_dir):
    rels = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "concat('rId', cast(o_orderkey % 3 AS STRING)) AS rid", "o_orderkey AS ord", "o_orderpriority AS target")
    refs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "concat('rId', cast(c_custkey % 3 AS STRING)) AS rid")
    return S.resolve_relationships(refs, rels, ["doc_id"], "rid", "ord", "target")


RELATIONSHIP_LOOKUP_SQL = """
WITH r AS (SELECT o_custkey AS doc_id, 'rId' || o_orderkey % 3 AS rid, arg_min(o_orderpriority, o_orderkey) AS target FROM orders GROUP BY ALL)
SELECT c.c_custkey AS doc_id, 'rId' || c.c_custkey % 3 AS rid, r.target FROM customer c LEFT JOIN r ON r.doc_id = c.c_custkey AND r.rid = 'rId' || c.c_custkey % 3
"""


def numbering_levels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    docs = "o_custkey AS doc_id"
    nums = o.selectExpr(docs, "CAST(o_orderkey AS INT) AS num_id", "CAST(o_orderkey % 5 AS INT) AS abstract_id")
    kinds = nums.select("doc_id").distinct().selectExpr("doc_id", "explode(sequence(0, 4)) AS abstract_id")
    abstract = kinds.selectExpr("doc_id", "abstract_id", "explode(sequence(0, 2)) AS ilvl").selectExpr("doc_id", "abstract_id", "ilvl", "element_at(array('decimal','bullet','lowerRoman'), (abstract_id + ilvl) % 3 + 1) AS fmt", "ilvl + 1 AS start_at", "concat('%', cast(ilvl + 1 AS STRING), '.') AS level_text")
    own = nums.filter("num_id % 3 = 0").selectExpr("doc_id", "num_id", "num_id % 3 AS ilvl", "num_id % 7 AS start_override", "CAST(NULL AS STRING) AS fmt", "CAST(NULL AS INT) AS start_at", "CAST(NULL AS STRING) AS level_text")
    found = S.numbering_levels(nums, abstract, own)
    items = nums.select("doc_id", "num_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ilvl"))
    return S.level_lookup(items, found).select("doc_id", "num_id", "ilvl", "format", "start_at", "ordered")


NUMBERING_LEVELS_SQL = """
WITH n AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS num_id, CAST(o_orderkey % 5 AS INT) AS a FROM orders),
i AS (SELECT n.*, CAST(k.l AS INT) AS ilvl, CASE WHEN k.l <= 2 THEN k.l ELSE 0 END AS eff FROM n, range(5) k(l))
SELECT doc_id, num_id, ilvl, list_extract(['decimal','bullet','lowerRoman'], (a + eff) % 3 + 1) AS format,
  CAST(CASE WHEN num_id % 3 = 0 AND eff = 0 THEN num_id % 7 ELSE eff + 1 END AS INT) AS start_at, list_extract(['decimal','bullet','lowerRoman'], (a + eff) % 3 + 1) <> 'bullet' AS ordered FROM i
"""


def numbering_instances(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS ord", "element_at(array('bullet','decimal','lowerLetter'), CAST(o_orderkey % 3 + 1 AS INT)) AS fmt", "CAST(o_orderkey % 2 + 1 AS INT) AS start")
    return S.numbering_instances(lists, "doc_id", "ord", "fmt", "start").select("doc_id", "ord", "num_id")


NUMBERING_INSTANCES_SQL = """
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, list_extract(['bullet','decimal','lowerLetter'], CAST(o_orderkey % 3 + 1 AS INT)) AS fmt, CAST(o_orderkey % 2 + 1 AS INT) AS start FROM orders),
f AS (SELECT doc_id, fmt, start, min(ord) AS first FROM l WHERE fmt <> 'bullet' AND NOT (fmt = 'decimal' AND start = 1) GROUP BY ALL),
d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) + 2 AS num FROM f)
SELECT l.doc_id, l.ord, CAST(CASE WHEN l.fmt = 'bullet' THEN 1 WHEN l.fmt = 'decimal' AND l.start = 1 THEN 2 ELSE d.num END AS INT) AS num_id FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.fmt = d.fmt AND l.start = d.start
"""


def effective_headers(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderstatus AS kind", "o_orderkey AS sec", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS part")
    return L.effective_parts(s, "doc_id", "kind", "sec", "part").select("doc_id", "kind", "sec", "effective")


EFFECTIVE_HEADERS_SQL = """
SELECT o_custkey AS doc_id, o_orderstatus AS kind, o_orderkey AS sec, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS effective FROM orders
"""


def template_variables(spark, sf_dir):
    text = "concat('Dear {{ name.', c_mktsegment, ' }}, ${id_', cast(c_custkey % 7 AS STRING), '} and %seg_', lower(substr(c_mktsegment, 1, 2)), '% {{name.', c_mktsegment, '}} {but not} 100%')"
    return S.text_variables(table(spark, sf_dir, "customer").selectExpr("c_custkey div 8 AS doc_id", "c_custkey AS ord", f"{text} AS text").withColumnRenamed("ord", "par"), "doc_id", ["par"], "text")


TEMPLATE_VARIABLES_SQL = """
WITH t AS (SELECT c_custkey // 8 AS doc_id, c_custkey AS par, [
  {'name': 'name.' || c_mktsegment, 'placeholder': '{{ name.' || c_mktsegment || ' }}'}, {'name': 'id_' || c_custkey % 7, 'placeholder': '${id_' || c_custkey % 7 || '}'},
  {'name': 'seg_' || lower(substr(c_mktsegment, 1, 2)), 'placeholder': '%seg_' || lower(substr(c_mktsegment, 1, 2)) || '%'}] AS v FROM customer),
p AS (SELECT doc_id, par, k.i AS place, v[k.i].name AS name, v[k.i].placeholder AS placeholder FROM t, range(1, 4) k(i)),
f AS (SELECT doc_id, name, min(par * 10 + place) AS first, arg_min(placeholder, par * 10 + place) AS placeholder FROM p GROUP BY doc_id, name)
SELECT doc_id, name, placeholder, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INT) AS ord FROM f
"""


def custom_patterns(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "CAST(1 AS INT) AS par", "concat('Hello [[', lower(c_mktsegment), ']]! [[]] [[x', cast(c_nationkey AS STRING), ']]') AS text")
    return S.text_variables(t, "doc_id", ["par"], "text", [r"\[\[([a-z0-9]+)\]\]"])


CUSTOM_PATTERNS_SQL = r"""
WITH t AS (SELECT c_custkey AS doc_id, regexp_extract_all(concat('Hello [[', lower(c_mktsegment), ']]! [[]] [[x', CAST(c_nationkey AS VARCHAR), ']]'), '\[\[([a-z0-9]+)\]\]', 1) AS v FROM customer)
SELECT doc_id, v[k.i] AS name, '[[' || v[k.i] || ']]' AS placeholder, CAST(k.i AS INT) AS ord FROM t, range(1, 3) k(i) WHERE k.i <= len(v)
"""


def fidelity_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rendered = d.select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, ' the ', ' ') ELSE text END").alias("html"))
    return S.missing_lines(lines, rendered, "doc_id", "line", "html").groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))


FIDELITY_MISSING_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN replace(text, ' the ', ' ') ELSE text END, '[ \t\n\r\f\v]+', '', 'g') AS whole FROM documents),
l AS (SELECT doc_id, whole, unnest(lines) AS line FROM d)
SELECT doc_id, count(*) AS missing FROM l WHERE NOT contains(whole, regexp_replace(line, '[ \t\n\r\f\v]+', '', 'g')) GROUP BY doc_id
"""

CATALOG = [
    ("style_cascade", style_cascade, STYLE_CASCADE_SQL), ("style_chains", style_chains, STYLE_CHAINS_SQL), ("list_numbering", list_numbering, LIST_NUMBERING_SQL), ("list_nesting", list_nesting, LIST_NESTING_SQL),
    ("list_runs", list_runs, LIST_RUNS_SQL), ("section_split", section_split, SECTION_SPLIT_SQL), ("page_break_split", page_break_split, PAGE_BREAK_SPLIT_SQL), ("rowspan_reconstruct", rowspan_reconstruct, ROWSPAN_RECONSTRUCT_SQL),
    ("rowspan_expand", rowspan_expand, ROWSPAN_EXPAND_SQL), ("grid_columns", grid_columns, GRID_COLUMNS_SQL), ("column_widths", column_widths, COLUMN_WIDTHS_SQL), ("paper_size", paper_size, PAPER_SIZE_SQL),
    ("page_geometry", page_geometry, PAGE_GEOMETRY_SQL), ("relationship_ids", relationship_ids, RELATIONSHIP_IDS_SQL), ("relationship_lookup", relationship_lookup, RELATIONSHIP_LOOKUP_SQL),
    ("numbering_levels", numbering_levels, NUMBERING_LEVELS_SQL), ("numbering_instances", numbering_instances, NUMBERING_INSTANCES_SQL), ("effective_headers", effective_headers, EFFECTIVE_HEADERS_SQL),
    ("template_variables", template_variables, TEMPLATE_VARIABLES_SQL), ("custom_patterns", custom_patterns, CUSTOM_PATTERNS_SQL), ("fidelity_missing", fidelity_missing, FIDELITY_MISSING_SQL),
]
