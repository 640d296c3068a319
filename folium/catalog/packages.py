"""Queries over packages made of ready markup: the kernels that read real parts, held against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.catalog.values import table
from folium.session import spread
from folium.sources import documents as D

#: Namespaces and relationship types of the format.
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _text(s: str) -> str:
    return f"<w:r><w:t>{s}</w:t></w:r>"


def _mark(kind: str) -> str:
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def _filled(template: str, **columns: str):
    """The template with @name@ replaced by columns, as one Column."""
    pieces = [F.lit("")]
    for k, piece in enumerate(template.split("@")):
        pieces.append(F.expr(f"CAST({columns[piece]} AS STRING)") if k % 2 else F.lit(piece))
    return F.concat(*pieces)


FORM = (
    f'<w:p><w:fldSimple w:instr=" MERGEFIELD Segment \\* MERGEFORMAT ">{_text("«@seg@»")}</w:fldSimple></w:p>'
    f'<w:p>{_mark("begin")}<w:r><w:instrText>MERGEF</w:instrText></w:r><w:r><w:instrText>IELD Nation_@mod@ </w:instrText></w:r>{_mark("separate")}{_text("@nation@")}{_mark("end")}</w:p>'
    f'<w:sdt><w:sdtPr><w:alias w:val="Other"/><w:tag w:val="Owner@mod@"/></w:sdtPr><w:sdtContent><w:p>{_text("@name@")}</w:p></w:sdtContent></w:sdt>'
    f'<w:sdt><w:sdtPr><w:tag w:val="Watermark"/></w:sdtPr><w:sdtContent><w:p>{_text("none")}</w:p></w:sdtContent></w:sdt>'
    f"<w:p>{_text('{{')}{_text('due.@mod@x')}{_text('}} or ')}{_text('${due_@mod@}')}</w:p><w:p>{_text('{{seen}} {{seen}}')}</w:p>"
)


def docx_form_variables(spark, sf_dir):
    """Merge fields, content controls and text patterns of customers' forms; the pattern's name may be cut into runs."""
    c = spread(table(spark, sf_dir, "customer"))
    body = _filled(FORM, seg="c_mktsegment", mod="c_custkey % 4", nation="c_nationkey", name="c_name")
    packed = D.assemble(c.select("c_custkey", body.alias("body")), "c_custkey", "body")
    return D.variables(packed, "doc_id", "content").select("doc_id", "ord", "source", "name", "placeholder", "sample_value")


DOCX_FORM_VARIABLES_SQL = r"""
WITH c AS (SELECT c_custkey AS doc_id, c_mktsegment AS seg, CAST(c_custkey % 4 AS VARCHAR) AS k, nullif(CAST(c_nationkey AS VARCHAR), '0') AS nation, c_name AS name FROM customer),
v AS (SELECT doc_id, 0 AS ord, 'mergeField' AS source, 'Segment' AS name, 'MERGEFIELD Segment \* MERGEFORMAT' AS placeholder, '«' || seg || '»' AS sample_value FROM c
  UNION ALL SELECT doc_id, 1, 'mergeField', 'Nation_' || k, 'MERGEFIELD Nation_' || k, nation FROM c
  UNION ALL SELECT doc_id, 2, 'contentControl', 'Owner' || k, 'Owner' || k, name FROM c
  UNION ALL SELECT doc_id, 4, 'textPattern', 'due_' || k, '${due_' || k || '}', NULL FROM c
  UNION ALL SELECT doc_id, 5, 'textPattern', 'seen', '{{seen}}', NULL FROM c
  UNION ALL SELECT doc_id, 3, 'textPattern', 'due.' || k || 'x', '{{due.' || k || 'x}}', NULL FROM c)
SELECT doc_id, CAST(ord AS INT) AS ord, source, name, placeholder, sample_value FROM v
"""

_CELL = '<w:tc><w:tcPr>{}</w:tcPr><w:p>{}</w:p></w:tc>'
LETTER = (
    f'<w:p><w:bookmarkStart w:id="1" w:name="at@key@"/>{_text("Part @key@")}<w:bookmarkEnd w:id="1"/><w:hyperlink r:id="h1">{_text("@type@")}</w:hyperlink>'
    f'<w:hyperlink w:anchor="at@size@">{_text("see")}</w:hyperlink><w:hyperlink r:id="lost">{_text("plain")}</w:hyperlink></w:p>'
    f'<w:p>{_mark("begin")}<w:r><w:instrText>PA</w:instrText></w:r><w:r><w:instrText>GE</w:instrText></w:r>{_mark("separate")}{_text("9")}{_mark("end")}'
    f'{_text("of")}<w:r><w:footnoteReference w:id="2"/></w:r><w:fldSimple w:instr="NUMPAGES">{_text("9")}</w:fldSimple></w:p>'
    "<w:tbl>"
    f"<w:tr>{_CELL.format('<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>', _text('@brand@'))}{_CELL.format('<w:gridSpan w:val=' + chr(34) + '@span@' + chr(34) + '/>', _text('wide'))}</w:tr>"
    f"<w:tr>{_CELL.format('<w:vMerge/>', '')}{_CELL.format('', _text('a'))}</w:tr><w:tr>{_CELL.format('<w:vMerge/>', '')}{_CELL.format('', _text('b'))}</w:tr></w:tbl>"
    '<w:sectPr><w:headerReference w:type="default" r:id="d1"/></w:sectPr>'
)
RELS = f'<Relationship Id="h1" Type="{REL}/hyperlink" Target="http://parts/@size@" TargetMode="External"/>'


def _letters(spark, sf_dir, then):
    p = spread(table(spark, sf_dir, "part"))
    given = {"key": "p_partkey", "type": "p_type", "size": "p_size", "brand": "p_brand", "span": "p_size % 3 + 2"}
    note = f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:footnoteRef/></w:r>{_text(" on  @type@")}</w:p></w:footnote></w:footnotes>'
    columns = {"body": _filled(LETTER, **given), "rels": _filled(RELS, **given), "notes": _filled(note, **given), "head": _filled(f"<w:hdr {W}><w:p>{_text('Head @size@')}</w:p></w:hdr>", **given)}
    ready = p.select("p_partkey", *[c.alias(name) for name, c in columns.items()])
    return D.assemble(ready, "p_partkey", "body", "rels", {"d1": ("header", "head"), "d2": ("footnotes", "notes")}, then)


STRUCTURES = ("doc_id", "part", "kind", "ord", "text", "href", "anchor", "name", "instr", "row_span", "grid_span", "is_continue")


def docx_structures(spark, sf_dir):
    """Tables with merged cells, fields, links, bookmarks, footnotes and headers, read from packages."""
    n = _letters(spark, sf_dir, D.nodes_reader("docx", kinds=("bookmark", "link", "field", "footnote", "cell", "p"), columns=STRUCTURES)).filter("kind IN ('bookmark', 'link', 'field', 'footnote', 'cell') OR part <> 'body' AND kind = 'p'")
    return n.select(F.col("doc_id").alias("p_partkey"), "part", "kind", "ord", "text", "href", "anchor", "name", "instr", "row_span", "grid_span", "is_continue")


DOCX_STRUCTURES_SQL = """
WITH n AS (
  SELECT p_partkey, 'body' AS part, 'bookmark' AS kind, 0 AS ord, 'Part ' || p_partkey AS text, NULL AS href, NULL AS anchor, 'at' || p_partkey AS name, NULL AS instr, NULL AS row_span, NULL AS grid_span, NULL AS is_continue FROM part
  UNION ALL SELECT p_partkey, 'body', 'link', 1, p_type, 'http://parts/' || p_size, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'body', 'link', 2, 'see', NULL, 'at' || p_size, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'body', 'field', 0, NULL, NULL, NULL, NULL, 'PAGE', NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'body', 'footnote', 2, 'on ' || p_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'body', 'field', 3, NULL, NULL, NULL, NULL, 'NUMPAGES', NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'body', 'cell', 0, p_brand, NULL, NULL, NULL, NULL, 3, 1, false FROM part
  UNION ALL SELECT p_partkey, 'body', 'cell', 1, 'wide', NULL, NULL, NULL, NULL, 1, p_size % 3 + 2, false FROM part
  UNION ALL SELECT p_partkey, 'body', 'cell', 0, '', NULL, NULL, NULL, NULL, 1, 1, true FROM part, range(2)
  UNION ALL SELECT p_partkey, 'body', 'cell', 1, t.x, NULL, NULL, NULL, NULL, 1, 1, false FROM part, (VALUES ('a'), ('b')) t(x)
  UNION ALL SELECT p_partkey, 'header:default', 'p', 0, 'Head ' || p_size, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part)
SELECT p_partkey, part, kind, CAST(ord AS INT) AS ord, text, href, anchor, name, instr, CAST(row_span AS INT) AS row_span, CAST(grid_span AS INT) AS grid_span, is_continue FROM n
"""


def docx_to_html(spark, sf_dir):
    """The same packages as HTML: body and header."""
    return _letters(spark, sf_dir, D.html_reader()).select(F.col("doc_id").alias("p_partkey"), "body", "header")


DOCX_TO_HTML_SQL = """
SELECT p_partkey, concat('<p><a id="at', p_partkey, '">Part ', p_partkey, '</a><a href="http://parts/', p_size, '">', p_type, '</a><a href="#at', p_size, '">see</a>plain</p>',
  '<p><page-number/>of<span class="footnote">on ', p_type, '</span><page-total/></p>',
  '<table style="border-collapse:collapse"><tr><td rowspan="3"><p>', p_brand, '</p></td><td colspan="', p_size % 3 + 2, '"><p>wide</p></td></tr><tr><td><p>a</p></td></tr><tr><td><p>b</p></td></tr></table>') AS body,
  '<p>Head ' || p_size || '</p>' AS header FROM part
"""

STYLES = (
    f"<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val=\"20\"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after=\"100\"/></w:pPr></w:pPrDefault></w:docDefaults>"
    '<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:pPr><w:spacing w:after="@after@"/></w:pPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="A"><w:basedOn w:val="B"/><w:rPr><w:b/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:i/><w:sz w:val="@size@"/></w:rPr></w:style></w:styles>'
)
STYLED = f'<w:p><w:pPr><w:pStyle w:val="@style@"/></w:pPr>{_text("first")}<w:r><w:rPr><w:b w:val="@off@"/></w:rPr><w:t>second</w:t></w:r></w:p>'


def docx_cascade(spark, sf_dir):
    """Runs under document defaults, the default style, a chain of styles (that is a cycle) and direct toggles, read from packages."""
    p = spread(table(spark, sf_dir, "part"))
    given = {"after": "p_size * 20", "size": "p_size + 10", "style": "CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'N' END", "off": "p_partkey % 2"}
    n = D.assemble(p.select("p_partkey", _filled(STYLED, **given).alias("body"), _filled(STYLES, **given).alias("styles")), "p_partkey", "body", None, {"d1": ("styles", "styles")}, D.nodes_reader("docx", kinds=("p", "run"))).filter("kind IN ('p', 'run')")
    return n.select(F.col("doc_id").alias("p_partkey"), "kind", "text", "bold", "italic", F.expr("CAST(style['size'] AS INT)").alias("size"), F.expr("CAST(style['after'] AS INT)").alias("after"))


DOCX_CASCADE_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 3 < 2 AS styled, p_partkey % 2 = 1 AS direct, CASE WHEN p_partkey % 3 < 2 THEN p_size + 10 ELSE 20 END AS size, p_size * 20 AS after FROM part)
SELECT p_partkey, 'p' AS kind, 'firstsecond' AS text, CAST(NULL AS BOOLEAN) AS bold, CAST(NULL AS BOOLEAN) AS italic, CAST(NULL AS INT) AS size, CAST(after AS INT) AS after FROM p
UNION ALL SELECT p_partkey, 'run', 'first', styled, styled, CAST(size AS INT), NULL FROM p
UNION ALL SELECT p_partkey, 'run', 'second', direct, styled, CAST(size AS INT), NULL FROM p
"""

def _level(k: int, start: str, kind: str) -> str:
    return f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="%{k + 1}."/></w:lvl>'


def _item(text: str, num: int, level: int = 0) -> str:
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>{_text(text)}</w:p>'


NUMBERING = (
    f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{_level(0, "@start@", "decimal")}{_level(1, "1", "lowerLetter")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{_level(0, "1", "bullet")}</w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="@own@"/></w:lvlOverride></w:num></w:numbering>'
)
LISTED = "".join([_item("@brand@", 1), _item("below", 1, 1), _item("also", 1, 1), _item("next", 1), "<w:p/>", _item("on", 1), _item("dot", 2), _item("own", 3), _item("none", 9)])


def docx_lists(spark, sf_dir):
    """Lists of packages: nesting, numbers that run on after a paragraph, a start of an instance's own, bullets, an unknown instance."""
    p = spread(table(spark, sf_dir, "part"))
    given = {"start": "p_size % 4 + 1", "own": "p_size + 10", "brand": "p_brand"}
    read = D.nodes_reader("docx", kinds=("list", "p"), columns=("doc_id", "kind", "ord", "depth", "ordered", "format", "start_at"))
    n = D.assemble(p.select("p_partkey", _filled(LISTED, **given).alias("body"), _filled(NUMBERING, **given).alias("numbers")), "p_partkey", "body", None, {"d1": ("numbering", "numbers")}, read).filter("kind IN ('list', 'p')")
    return n.select(F.col("doc_id").alias("p_partkey"), "kind", "ord", "depth", "ordered", "format", "start_at")


DOCX_LISTS_SQL = """
WITH n AS (SELECT p_partkey, 'list' AS kind, 0 AS ord, 0 AS depth, true AS ordered, 'decimal' AS format, p_size % 4 + 1 AS start_at FROM part
  UNION ALL SELECT p_partkey, 'list', 1, 2, true, 'lowerLetter', 1 FROM part
  UNION ALL SELECT p_partkey, 'p', 1, 0, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'list', 2, 0, true, 'decimal', p_size % 4 + 3 FROM part
  UNION ALL SELECT p_partkey, 'list', 3, 0, false, 'bullet', 1 FROM part
  UNION ALL SELECT p_partkey, 'list', 4, 0, true, 'decimal', p_size + 10 FROM part
  UNION ALL SELECT p_partkey, 'p', 5, 0, NULL, NULL, NULL FROM part)
SELECT p_partkey, kind, CAST(ord AS INT) AS ord, CAST(depth AS INT) AS depth, ordered, format, CAST(start_at AS INT) AS start_at FROM n
"""

CATALOG = [
    ("docx_lists", docx_lists, DOCX_LISTS_SQL),
    ("docx_form_variables", docx_form_variables, DOCX_FORM_VARIABLES_SQL), ("docx_structures", docx_structures, DOCX_STRUCTURES_SQL),
    ("docx_to_html", docx_to_html, DOCX_TO_HTML_SQL), ("docx_cascade", docx_cascade, DOCX_CASCADE_SQL),
]
