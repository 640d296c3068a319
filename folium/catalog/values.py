"""Queries over CSS values, text and naming functions. Their inputs are derived from the tables by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import css as C
from folium.functions import model as M
from folium.functions import text as T
from folium.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UNITS = "element_at(array('pt','px','cm','mm','em','in','rem','dxa','%','','auto','vh',' PX'), CAST(p_partkey % 13 + 1 AS INT))"
UNITS_SQL = "list_extract(['pt','px','cm','mm','em','in','rem','dxa','%','','auto','vh',' PX'], CAST(p_partkey % 13 + 1 AS INT))"
LENGTH = f"concat(CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END, cast(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END, {UNITS})"
LENGTH_SQL = f"concat(CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END, {UNITS_SQL})"
TWIPS_SQL = """CASE list_extract(['pt','px','cm','mm','em','in','rem','dxa','%','','auto','vh',' PX'], CAST(p_partkey % 13 + 1 AS INT))
    WHEN 'pt' THEN 20.0 WHEN 'px' THEN 15.0 WHEN ' PX' THEN 15.0 WHEN '' THEN 15.0 WHEN 'cm' THEN 567.0 WHEN 'mm' THEN 56.6929 WHEN 'in' THEN 1440.0
    WHEN 'em' THEN 200.0 WHEN 'rem' THEN 200.0 WHEN 'dxa' THEN 1.0 END"""
NUMBER_SQL = "CAST(concat(CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END) AS DOUBLE)"


def css_length(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr(LENGTH).alias("value"))
    return v.select("p_partkey", "value", C.twips(F.col("value")).alias("twips"), C.half_points(F.col("value")).alias("half_points"), C.emu(F.col("value")).alias("emu"), C.percent(F.col("value")).alias("percent"), C.percent_to_pct(C.percent(F.col("value"))).alias("pct"))


CSS_LENGTH_SQL = f"""
WITH v AS (SELECT p_partkey, {LENGTH_SQL} AS value, {NUMBER_SQL} AS n, CAST({TWIPS_SQL} AS DOUBLE) AS f FROM part),
t AS (SELECT p_partkey, value, n, CAST(round(n * f) AS INT) AS twips FROM v)
SELECT p_partkey, value, twips, CAST(round(twips / 10.0::DOUBLE) AS INT) AS half_points, CAST(twips AS BIGINT) * 635 AS emu,
  CASE WHEN value LIKE '%\\%' ESCAPE '\\' THEN n END AS percent, CASE WHEN value LIKE '%\\%' ESCAPE '\\' THEN CAST(round(n * 50) AS INT) END AS pct
FROM t
"""

COLOR = """CASE p_partkey % 7
  WHEN 0 THEN concat('#', substr(md5(p_name), 1, 3)) WHEN 1 THEN concat(' #', upper(substr(md5(p_name), 1, 6)))
  WHEN 2 THEN concat('rgb(', cast(p_size * 7 AS STRING), ', ', cast(p_size AS STRING), ',0)')
  WHEN 3 THEN element_at(array('Red','teal','orange','grey'), CAST(p_size % 4 + 1 AS INT)) WHEN 4 THEN 'transparent' WHEN 5 THEN concat('#', p_brand)
  ELSE concat('rgba(1 2 ', cast(p_size AS STRING), ', 0.5)') END"""
COLOR_SQL = COLOR.replace("AS STRING", "AS VARCHAR").replace("element_at(array('Red','teal','orange','grey'),", "list_extract(['Red','teal','orange','grey'],")
COLOR_OUT = """CASE p_partkey % 7
  WHEN 0 THEN concat(repeat(substr(md5(p_name), 1, 1), 2), repeat(substr(md5(p_name), 2, 1), 2), repeat(substr(md5(p_name), 3, 1), 2)) WHEN 1 THEN substr(md5(p_name), 1, 6)
  WHEN 2 THEN concat(printf('%02x', least(255, CAST(p_size AS BIGINT) * 7)), printf('%02x', least(255, CAST(p_size AS BIGINT))), '00')
  WHEN 3 THEN list_extract(['ff0000','008080','ffa500','808080'], CAST(p_size % 4 + 1 AS INT)) WHEN 6 THEN concat('0102', printf('%02x', CAST(p_size AS BIGINT))) END"""


def css_color(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr(COLOR).alias("value"))
    return v.select("p_partkey", "value", C.color(F.col("value")).alias("color"))


CSS_COLOR_SQL = f"SELECT p_partkey, {COLOR_SQL} AS value, {COLOR_OUT} AS color FROM part"

BORDER = """CASE p_partkey % 5
  WHEN 0 THEN concat(cast(p_size AS STRING), 'px dashed #', substr(md5(p_name), 1, 6)) WHEN 1 THEN concat('double RED ', cast(p_size AS STRING), '.25pt')
  WHEN 2 THEN 'none' WHEN 3 THEN concat('0 solid #', substr(md5(p_name), 1, 6)) ELSE concat('#', substr(md5(p_name), 1, 3), ' thick') END"""


def css_border(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", C.border(F.expr(BORDER)).alias("b"))
    return v.select("p_partkey", "b.style", "b.size", "b.color", T.border_css(F.col("b")).alias("css"))


CSS_BORDER_SQL = """
WITH b AS (SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN 'dashed' WHEN 1 THEN 'double' WHEN 2 THEN 'none' WHEN 3 THEN 'none' ELSE 'thick' END AS style,
  CAST(CASE p_partkey % 5 WHEN 0 THEN greatest(2, p_size * 6) WHEN 1 THEN p_size * 8 + 2 ELSE 4 END AS INT) AS size,
  CASE p_partkey % 5 WHEN 0 THEN substr(md5(p_name), 1, 6) WHEN 1 THEN 'ff0000' WHEN 4 THEN
    concat(repeat(substr(md5(p_name), 1, 1), 2), repeat(substr(md5(p_name), 2, 1), 2), repeat(substr(md5(p_name), 3, 1), 2)) ELSE '000000' END AS color FROM part)
SELECT *, CASE WHEN style = 'none' THEN 'none' ELSE concat(printf('%.2f', greatest(0.1::DOUBLE, size / 8.0::DOUBLE)), 'pt ', CASE WHEN style IN ('dashed', 'double') THEN style ELSE 'solid' END, ' #', color) END AS css FROM b
"""

STYLE = """concat('color: red; Margin:', cast(p_size AS STRING), 'pt 10px; COLOR : #', substr(md5(p_name), 1, 6), ';bad;font-weight:', cast(p_size * 20 AS STRING),
  CASE WHEN p_partkey % 2 = 0 THEN '; margin-left: 5pt' ELSE ';' END, CASE WHEN p_partkey % 3 = 0 THEN ';text-align: RIGHT;line-height:1.5' ELSE ';line-height:150%' END,
  ';font-family: ''Times New'', serif; text-decoration: underline', CASE WHEN p_partkey % 4 = 0 THEN ' line-through' ELSE '' END, '; font-size:', cast(p_size AS STRING), 'pt;padding:1pt 2pt 3pt;width:', cast(p_size AS STRING), '%')"""
STYLE_SQL = STYLE.replace("AS STRING", "AS VARCHAR")


def css_declarations(spark, sf_dir):
    v = spread(table(spark, sf_dir, "part")).select("p_partkey", C.declarations(F.expr(STYLE)).alias("m"))
    return v.select("p_partkey", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("p_partkey", "ord", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


CSS_DECLARATIONS_SQL = f"""
WITH s AS (SELECT p_partkey, list_filter(string_split({STYLE_SQL}, ';'), lambda x: contains(x, ':')) AS parts FROM part),
e AS (SELECT p_partkey, i, parts[i] AS p FROM s, range(1, 30) r(i) WHERE i <= len(parts)),
n AS (SELECT p_partkey, i, lower(trim(substr(p, 1, instr(p, ':') - 1))) AS name, trim(substr(p, instr(p, ':') + 1)) AS value FROM e),
g AS (SELECT p_partkey, name, min(i) AS first, arg_max(value, i) AS value FROM n GROUP BY p_partkey, name)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY first) - 1 AS INT) AS ord, name, value FROM g
"""


def css_run_style(spark, sf_dir):
    v = spread(table(spark, sf_dir, "part")).select("p_partkey", C.declarations(F.expr(STYLE)).alias("css")).select("p_partkey", C.run_style(F.col("css")).alias("s"))
    return v.select("p_partkey", "s.size_half_points", "s.color", "s.font_family", "s.bold", "s.italic", "s.underline", "s.strike", "s.letter_spacing")


CSS_RUN_STYLE_SQL = """
SELECT p_partkey, CAST(p_size * 2 AS INT) AS size_half_points, substr(md5(p_name), 1, 6) AS color, 'Times New' AS font_family, p_size * 20 >= 600 AS bold,
  CAST(NULL AS BOOLEAN) AS italic, true AS underline, p_partkey % 4 = 0 AS strike, CAST(NULL AS INT) AS letter_spacing FROM part
"""


def css_paragraph_style(spark, sf_dir):
    v = spread(table(spark, sf_dir, "part")).select("p_partkey", C.declarations(F.expr(STYLE)).alias("css")).select("p_partkey", C.paragraph_style(F.col("css")).alias("s"))
    css = T.paragraph_css(F.col("s").withField("line_rule", F.lit(None).cast("string")))
    return v.select("p_partkey", "s.alignment", "s.space_before", "s.space_after", "s.indent_left", "s.indent_right", "s.line_spacing", css.alias("css"))


CSS_PARAGRAPH_STYLE_SQL = """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'end' END AS alignment, CAST(p_size * 20 AS INT) AS space_before, CAST(p_size * 20 AS INT) AS space_after,
  CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 150 END AS indent_left, 150 AS indent_right, 360 AS line_spacing, p_size FROM part)
SELECT p_partkey, alignment, space_before, space_after, indent_left, indent_right, line_spacing,
  concat(CASE WHEN alignment = 'end' THEN 'text-align:right;' ELSE '' END, 'margin-left:', CASE WHEN indent_left = 100 THEN '5' ELSE '7.5' END, 'pt;margin-right:7.5pt;line-height:1.8',
    CASE WHEN p_size = 0 THEN '' ELSE concat(';margin-top:', p_size, 'pt;margin-bottom:', p_size, 'pt') END) AS css FROM s
"""


def css_cell_style(spark, sf_dir):
    attrs = F.create_map(F.lit("colspan"), F.expr("cast(p_size % 4 AS STRING)"), F.lit("width"), F.lit("30"), F.lit("valign"), F.lit("middle"), F.lit("bgcolor"), F.lit("#abc"))
    v = spread(table(spark, sf_dir, "part")).select("p_partkey", C.declarations(F.expr(STYLE)).alias("css"), attrs.alias("attrs")).select("p_partkey", C.cell_style(F.col("css"), F.col("attrs")).alias("s"))
    return v.select("p_partkey", *[f"s.{c}" for c in ("width_twips", "width_pct", "pad_top", "pad_right", "pad_bottom", "pad_left", "valign", "background", "grid_span", "row_span")])


CSS_CELL_STYLE_SQL = """
SELECT p_partkey, CAST(NULL AS INT) AS width_twips, CAST(p_size * 50 AS INT) AS width_pct, 20 AS pad_top, 40 AS pad_right, 60 AS pad_bottom, 40 AS pad_left,
  'center' AS valign, 'aabbcc' AS background, CAST(greatest(1, p_size % 4) AS INT) AS grid_span, 1 AS row_span FROM part
"""


def css_table_style(spark, sf_dir):
    attrs = F.create_map(F.lit("border"), F.expr("cast(p_size % 3 AS STRING)"), F.lit("align"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'center' ELSE 'justify' END"))
    css = F.expr("concat('table-layout:fixed;margin-left:', cast(p_size AS STRING), 'mm', CASE WHEN p_partkey % 3 = 0 THEN ';width:50%' ELSE ';width:10cm' END)")
    v = spread(table(spark, sf_dir, "part")).select("p_partkey", C.declarations(css).alias("css"), attrs.alias("attrs")).select("p_partkey", C.table_style(F.col("css"), F.col("attrs")).alias("s"))
    return v.select("p_partkey", "s.width_twips", "s.width_pct", "s.alignment", "s.fixed", F.col("s.border.style").alias("border_style"), F.col("s.border.size").alias("border_size"), "s.indent")


CSS_TABLE_STYLE_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 5670 END AS width_twips, CASE WHEN p_partkey % 3 = 0 THEN 2500 END AS width_pct,
  CASE WHEN p_partkey % 2 = 0 THEN 'center' ELSE 'start' END AS alignment, true AS fixed,
  'single' AS border_style, CAST(greatest(2, (p_size % 3) * 6) AS INT) AS border_size, CAST(round(p_size * 56.6929::DOUBLE) AS INT) AS indent FROM part
"""


def css_line_height(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_quantity", F.expr("cast(cast(l_quantity / 10 AS DECIMAL(9,1)) AS STRING)").alias("n")).distinct()
    line = lambda s: C.line_height(s)
    return v.select("l_quantity", line(F.col("n")).alias("plain"), line(F.concat("n", F.lit("%"))).alias("percent"), line(F.concat("n", F.lit("pt"))).alias("points"), line(F.lit("normal")).alias("normal"))


CSS_LINE_HEIGHT_SQL = """
SELECT DISTINCT l_quantity, CAST(round(l_quantity / 10 * 240) AS INT) AS plain, CAST(round(l_quantity / 10 / 100 * 240) AS INT) AS percent,
  CAST(round(l_quantity / 10 * 20) AS INT) AS points, CAST(NULL AS INT) AS normal FROM lineitem
"""

SPACED = "replace(replace(text, ' the ', concat(' ', chr(160), 'the  ')), 'on', concat('o', chr(9), 'n'))"


def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.expr(SPACED)).alias("text"))


TEXT_NORMALIZE_SQL = f"SELECT doc_id, regexp_replace({SPACED}, '[\\t-\\r\\x{{85}}\\pZ]+', ' ', 'g') AS text FROM documents"

MARKED = "replace(replace(replace(text, ' of ', ' <of> '), ' is ', ' & '), 'nd', concat('n', chr(39), 'd', chr(34), chr(1)))"


def markup_escape(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED).alias("t"))
    return v.select("doc_id", F.md5(T.html_escape(F.col("t"))).alias("html"), F.md5(T.xml_escape(F.col("t"))).alias("xml"))


MARKUP_ESCAPE_SQL = f"""
WITH t AS (SELECT doc_id, {MARKED} AS t FROM documents),
h AS (SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') AS h FROM t)
SELECT doc_id, md5(h) AS html, md5(replace(h, chr(1), '')) AS xml FROM h
"""


def bookmark_names(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE '' END, p_name, ' é ', p_type, ' ', p_name)").alias("raw"))
    return v.select("p_partkey", T.bookmark_name(F.col("raw")).alias("name"))


BOOKMARK_NAMES_SQL = """
WITH v AS (SELECT p_partkey, regexp_replace(replace(concat(CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE '' END, p_name, ' é ', p_type, ' ', p_name), 'é', '__'), '[^A-Za-z0-9_]', '_', 'g') AS n FROM part)
SELECT p_partkey, substr(CASE WHEN regexp_matches(n, '^[A-Za-z_]') THEN n ELSE '_' || n END, 1, 40) AS name FROM v
"""


def run_text_split(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", T.run_parts(F.expr("replace(text, ' the ', concat(' ', chr(9), 'the', chr(13), chr(10), chr(12)))")).alias("p"))
    count = lambda kind: F.size(F.filter("p", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    return v.select("doc_id", count("text"), count("tab"), count("br"), count("page"))


RUN_TEXT_SPLIT_SQL = r"""
WITH v AS (SELECT doc_id, replace(text, ' the ', concat(' ', chr(9), 'the', chr(13), chr(10), chr(12))) AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[^\t\r\n\x0B\x0C]+')) AS INT) AS n_text, CAST(len(regexp_extract_all(t, '\t')) AS INT) AS n_tab,
  CAST(len(regexp_extract_all(t, '\r\n|\r|\n|\x0B')) AS INT) AS n_br, CAST(len(regexp_extract_all(t, '\x0C')) AS INT) AS n_page FROM v
"""


def mergefield_names(spark, sf_dir):
    instr = F.expr("concat(CASE WHEN p_partkey % 4 = 3 THEN 'PAGEREF ' ELSE ' mergefield  ' END, CASE WHEN p_partkey % 4 = 1 THEN '\"' ELSE '' END, replace(p_brand, '#', '.'), CASE WHEN p_partkey % 4 = 1 THEN '\"' ELSE '' END, CASE WHEN p_partkey % 4 = 2 THEN ' \\\\* MERGEFORMAT' ELSE '' END)")
    v = table(spark, sf_dir, "part").select("p_partkey", instr.alias("instr"))
    return v.select("p_partkey", T.merge_name(F.col("instr")).alias("name"), T.field_html(F.col("instr")).alias("html"))


MERGEFIELD_NAMES_SQL = """
WITH v AS (SELECT p_partkey, replace(p_brand, '#', '.') AS b, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 3 THEN NULL ELSE regexp_extract(b, '^[A-Za-z0-9_.]+') END AS name,
  CASE k WHEN 3 THEN '<page-number/>' WHEN 1 THEN concat('<var data-instr=\"', ' mergefield  &quot;', b, '&quot;', '\"></var>')
    WHEN 2 THEN concat('<var data-instr=\"', ' mergefield  ', b, ' \\* MERGEFORMAT', '\"></var>') ELSE concat('<var data-instr=\"', ' mergefield  ', b, '\"></var>') END AS html FROM v
"""


def heading_levels(spark, sf_dir):
    ids = F.expr("element_at(array('Heading1','heading6','Heading7','HEADING3','Title','Heading 2',''), CAST(p_partkey % 7 + 1 AS INT))")
    on = F.expr("element_at(array('false','0','off','1','true','OFF',''), CAST(p_partkey % 7 + 1 AS INT))")
    return table(spark, sf_dir, "part").select("p_partkey", T.heading_level(ids).alias("level"), T.toggle(on).alias("on"), T.toggle(F.lit(None).cast("string")).alias("bare"))


HEADING_LEVELS_SQL = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 3 THEN 3 END AS level, p_partkey % 7 IN (3, 4, 6) AS "on", true AS bare FROM part
"""


def resolve_targets(spark, sf_dir):
    target = F.expr("element_at(array('media/a.png','../x/./b.xml','/word/c.xml','../../../d','e//f'), CAST(p_partkey % 5 + 1 AS INT))")
    return table(spark, sf_dir, "part").select("p_partkey", T.resolve_target(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'word/document.xml' ELSE '' END"), target).alias("path"))


RESOLVE_TARGETS_SQL = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'word/media/a.png' ELSE 'media/a.png' END WHEN 1 THEN 'x/b.xml' WHEN 2 THEN 'word/c.xml' WHEN 3 THEN 'd'
  ELSE CASE WHEN p_partkey % 2 = 0 THEN 'word/e/f' ELSE 'e/f' END END AS path FROM part
"""


def image_formats(spark, sf_dir):
    path = F.expr("element_at(array('a.PNG','b.jpg','c','d.bin','e.tif'), CAST(p_partkey % 5 + 1 AS INT))")
    data = F.unhex(F.expr("element_at(array('89504E470D0A1A0A00','FFD8FFE0','474946383961','424D00','00'), CAST(p_size % 5 + 1 AS INT))"))
    v = table(spark, sf_dir, "part").select("p_partkey", T.image_format(path, data).alias("format"))
    return v.select("p_partkey", "format", T.image_facts(F.col("format")).alias("f")).select("p_partkey", "format", "f.mime", "f.extension", "f.web_safe")


IMAGE_FORMATS_SQL = """
WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 4 THEN 'tiff' ELSE list_extract(['png','jpeg','gif','bmp',NULL], CAST(p_size % 5 + 1 AS INT)) END AS format FROM part)
SELECT p_partkey, format, 'image/' || format AS mime, CASE WHEN format = 'jpeg' THEN 'jpg' ELSE format END AS extension, format IN ('png', 'jpeg', 'gif') AS web_safe FROM f
"""


def list_formats(spark, sf_dir):
    kind = F.expr("element_at(array('a','A','i','I','1','x'), CAST(p_partkey % 6 + 1 AS INT))")
    name = F.expr("element_at(array('page','total','date','time','author','title'), CAST(p_partkey % 6 + 1 AS INT))")
    fmt = F.expr("CASE WHEN p_size % 2 = 0 THEN 'yyyy' END")
    v = table(spark, sf_dir, "part").select("p_partkey", T.list_format(kind, F.expr("p_size % 3 > 0")).alias("format"), T.field_instruction(name, fmt).alias("instr"))
    return v.withColumn("html", T.field_html(F.col("instr")))


LIST_FORMATS_SQL = """
WITH v AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'bullet' ELSE list_extract(['lowerLetter','upperLetter','lowerRoman','upperRoman','decimal','decimal'], CAST(p_partkey % 6 + 1 AS INT)) END AS format,
  CASE p_partkey % 6 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'NUMPAGES' WHEN 2 THEN concat('DATE \\@ "', CASE WHEN p_size % 2 = 0 THEN 'yyyy' ELSE 'dd.MM.yyyy' END, '"')
    WHEN 3 THEN concat('TIME \\@ "', CASE WHEN p_size % 2 = 0 THEN 'yyyy' ELSE 'HH:mm' END, '"') WHEN 4 THEN 'AUTHOR' ELSE 'TITLE' END AS instr FROM part)
SELECT p_partkey, format, instr, CASE p_partkey % 6 WHEN 0 THEN '<page-number/>' WHEN 1 THEN '<page-total/>' WHEN 2 THEN concat('<current-date format="', regexp_extract(instr, '"([^"]+)"', 1), '"/>')
  WHEN 3 THEN '<current-time/>' ELSE concat('<var data-instr="', instr, '"></var>') END AS html FROM v
"""


def run_html(spark, sf_dir):
    s = F.struct(
        F.expr("p_size % 2 = 0").alias("bold"), F.expr("p_size % 3 = 0").alias("italic"), F.expr("p_size % 5 = 0").alias("underline"), F.lit(False).alias("strike"), F.lit(False).alias("superscript"),
        F.lit(False).alias("subscript"), F.expr("CASE WHEN p_size % 7 = 0 THEN 'yellow' END").alias("highlight"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'ff0000' END").alias("color"),
        F.lit(None).cast("string").alias("background"), F.lit(None).cast("string").alias("font_family"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN cast(p_size AS INT) END").alias("size_half_points"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.run_html(F.col("p_name"), s).alias("html"))


RUN_HTML_SQL = """
WITH r AS (SELECT p_partkey, p_size, replace(p_name, '&', '&amp;') AS t FROM part),
m AS (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 THEN '<mark>' || t || '</mark>' ELSE t END AS t FROM r),
u AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN '<u>' || t || '</u>' ELSE t END AS t FROM m),
i AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN '<em>' || t || '</em>' ELSE t END AS t FROM u),
b AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN '<strong>' || t || '</strong>' ELSE t END AS t FROM i),
c AS (SELECT *, concat_ws(';', CASE WHEN p_partkey % 2 = 0 THEN 'color:#ff0000' END,
  CASE WHEN p_partkey % 3 = 0 THEN concat('font-size:', CAST(CAST(p_size AS INT) // 2 AS VARCHAR), CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '' END, 'pt') END) AS css FROM b)
SELECT p_partkey, CASE WHEN css <> '' THEN concat('<span style="', css, '">', t, '</span>') ELSE t END AS html FROM c
"""


def builder_lengths(spark, sf_dir):
    v = F.col("p_retailprice") / 100
    return table(spark, sf_dir, "part").select("p_partkey", *[T.length_to_twips(v, u).alias(u) for u in ("pt", "mm", "cm", "inch", "px", "twips")], M.px_to_emu(F.col("p_size")).alias("emu"), T.points(F.col("p_size")).alias("css"))


BUILDER_LENGTHS_SQL = """
SELECT p_partkey, CAST(round(p_retailprice / 100 * 20.0::DOUBLE) AS INT) AS pt, CAST(round(p_retailprice / 100 * 56.6929133858::DOUBLE) AS INT) AS mm, CAST(round(p_retailprice / 100 * 566.929133858::DOUBLE) AS INT) AS cm,
  CAST(round(p_retailprice / 100 * 1440.0::DOUBLE) AS INT) AS inch, CAST(round(p_retailprice / 100 * 15.0::DOUBLE) AS INT) AS px, CAST(round(p_retailprice / 100) AS INT) AS twips, CAST(p_size AS BIGINT) * 9525 AS emu,
  regexp_replace(regexp_replace(CAST(CAST(p_size AS DECIMAL(10,2)) / 20 AS DECIMAL(10,2))::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || 'pt' AS css FROM part
"""


def style_updates(spark, sf_dir):
    base = F.struct(F.col("c_mktsegment").alias("font"), F.lit(True).alias("bold"), F.col("c_nationkey").alias("size"))
    changed = M.updated(F.col("s"), {"font": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Arial' END"), "size": F.expr("CASE WHEN c_custkey % 3 = 0 THEN 99 END")})
    v = table(spark, sf_dir, "customer").withColumn("s", base).select("c_custkey", changed.alias("s"), M.core_is_empty(F.expr("CASE WHEN c_custkey % 2 = 0 THEN '' END"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'x' END")).alias("empty"))
    return v.select("c_custkey", "s.font", "s.bold", "s.size", "empty")


STYLE_UPDATES_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Arial' ELSE c_mktsegment END AS font, true AS bold, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END AS size, c_custkey % 5 <> 0 AS empty FROM customer
"""


def anchor_origins(spark, sf_dir):
    origin = F.expr("element_at(array('page','leftMargin','column','insideMargin','x','paragraph'), CAST(p_partkey % 6 + 1 AS INT))")
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.axis(origin, ("page", "margin", "column", "character"), "column").alias("horizontal"), M.axis(origin, ("page", "margin", "paragraph", "line"), "paragraph").alias("vertical"),
        M.is_external(F.expr("CASE p_size % 3 WHEN 0 THEN 'External' WHEN 1 THEN 'Internal' END")).alias("external"), M.is_internal_link(F.expr("CASE WHEN p_size % 2 = 0 THEN 'a' END")).alias("internal"),
    )


ANCHOR_ORIGINS_SQL = """
SELECT p_partkey, list_extract(['page','margin','column','margin','column','column'], CAST(p_partkey % 6 + 1 AS INT)) AS horizontal,
  list_extract(['page','margin','paragraph','margin','paragraph','paragraph'], CAST(p_partkey % 6 + 1 AS INT)) AS vertical, p_size % 3 = 0 AS external, p_size % 2 = 0 AS internal FROM part
"""

CATALOG = [
    ("css_length", css_length, CSS_LENGTH_SQL), ("css_color", css_color, CSS_COLOR_SQL), ("css_border", css_border, CSS_BORDER_SQL), ("css_declarations", css_declarations, CSS_DECLARATIONS_SQL),
    ("css_run_style", css_run_style, CSS_RUN_STYLE_SQL), ("css_paragraph_style", css_paragraph_style, CSS_PARAGRAPH_STYLE_SQL), ("css_cell_style", css_cell_style, CSS_CELL_STYLE_SQL),
    ("css_table_style", css_table_style, CSS_TABLE_STYLE_SQL), ("css_line_height", css_line_height, CSS_LINE_HEIGHT_SQL), ("text_normalize", text_normalize, TEXT_NORMALIZE_SQL),
    ("markup_escape", markup_escape, MARKUP_ESCAPE_SQL), ("bookmark_names", bookmark_names, BOOKMARK_NAMES_SQL), ("run_text_split", run_text_split, RUN_TEXT_SPLIT_SQL),
    ("mergefield_names", mergefield_names, MERGEFIELD_NAMES_SQL), ("heading_levels", heading_levels, HEADING_LEVELS_SQL), ("resolve_targets", resolve_targets, RESOLVE_TARGETS_SQL),
    ("image_formats", image_formats, IMAGE_FORMATS_SQL), ("list_formats", list_formats, LIST_FORMATS_SQL), ("run_html", run_html, RUN_HTML_SQL), ("builder_lengths", builder_lengths, BUILDER_LENGTHS_SQL),
    ("style_updates", style_updates, STYLE_UPDATES_SQL), ("anchor_origins", anchor_origins, ANCHOR_ORIGINS_SQL),
]
