"""Labels against the document reader's own, borders against plain competition of cells."""

import random

import pytest
from pyspark.sql import functions as F

from folium.functions import labels as L
from folium.kernels import html_read, html_write
from folium.kernels.nodes import Node
from folium.operators import borders as B
from folium.operators.labels import labels_of_items, list_depths, marker_sheets, nodes_css
from folium.operators.markup import nodes_to_docx, nodes_to_html
from folium.sources import documents as D

TEXTS = [None, "", "%1", "%1.", "%2.", "%1.%2", "%1.%2.", "%1.%2/%3", "%2%1", "%1%2%3", "§ %1-%2-%3 ", "100% of %1", "%%1%", "%0 %1", 'say "%1"\\', "{%1;%2}", "%1 \n %2", "a/*%1*/", "%1.%1", "x", "é%1…"]


def test_tokens_and_contents(spark):
    rows = [(t, d, f) for t in TEXTS for d in range(4) for f in ("decimal", "upperRoman", None)]
    df = spark.createDataFrame(rows, "text string, depth int, format string").withColumn("tokens", L.tokens(F.col("text")))
    df = df.withColumn("content", L.content(F.col("tokens"), F.col("depth"), F.col("format"))).withColumn("back", L.level_text(F.col("content"), F.col("depth")))
    found = df.withColumn("same", L.text_of(F.col("tokens"))).collect()
    for r in found:
        assert r["same"] == r["text"]
        assert r["content"] == html_write.marker_content(Node("list", {"level_text": r["text"], "format": r["format"]}), r["depth"]), r
        assert r["content"] is None or r["back"] == r["text"].rstrip() == html_read.level_text(r["content"], r["depth"]), r
    assert [tuple(t) for t in next(r["tokens"] for r in found if r["text"] == "100% of %1")] == [("100% of ", None), (None, 1)]


def test_contents_from_elsewhere(spark):
    texts = ['"a" "b"', 'counter( list-item )', 'counters(list-item,"\\"",decimal)', "counter(other)", '"open', "none", "", '" "', 'counter(list-item) x', 'counters(list-item)', None, '"' + '\\"' * 100_000 + '"', '"' + "y" * 500_000 + '"']
    rows = spark.createDataFrame([(i, t, d) for i, t in enumerate(texts) for d in (0, 2)], "i int, text string, depth int")
    for r in rows.withColumn("back", L.level_text(F.col("text"), F.col("depth"))).collect():
        assert r["back"] == (html_read.level_text(r["text"], r["depth"]) if r["text"] is not None else None), r["text"][:40]
    beyond = spark.createDataFrame([("counter(list-item)", d) for d in (-1, 8, 9, None)], "text string, depth int")
    assert [r[0] for r in beyond.select(L.level_text(F.col("text"), F.col("depth"))).collect()] == [None, "%9", None, None]


def test_sheets(spark):
    css = '/* .z::marker { content: "z" } */ .a::marker { color: red; CONTENT : "}/*;*/" counter(list-item) } p { margin: 0 } .b::marker{content:"1";content:"2"} .c::marker { color: red }'
    got = spark.createDataFrame([(css,), (None,), ("",)], "css string").select(L.marker_rules(F.col("css"))).collect()
    assert [tuple(r) for r in got[0][0]] == [("a", '"}/*;*/" counter(list-item)'), ("b", '"2"')] and got[1][0] is None and got[2][0] == []


def test_sheets_of_documents(spark):
    levels = spark.createDataFrame([(None, "w0", "(%1)", 0, "decimal"), (None, "w0", "(%1)", 0, "decimal"), (None, "w1", "%1.%2", 1, "lowerRoman"), (1, "w0", "%1.", 0, "decimal"), (1, None, "(%1)", 0, "decimal"), (2, "w0", None, 0, None)], "doc int, class string, level_text string, depth int, format string")
    sheets = marker_sheets(levels, ["doc"])
    assert [(r["doc"], r["css"]) for r in sheets.collect()] == [(None, '.w0::marker { content: "(" counter(list-item) ") " }\n.w1::marker { content: counters(list-item, ".", lower-roman) " " }\n')]
    items = spark.createDataFrame([(None, ["x", "w1"], 1, 7), (None, ["w0", "w1"], 0, 7), (None, None, 0, 7), (None, [], 0, 7), (1, ["w0"], 0, 7)], "doc int, classes array<string>, depth int, rule int")
    got = labels_of_items(items, sheets, ["doc"])
    assert got.columns == ["doc", "classes", "depth", "rule", "level_text"]
    assert sorted((str(r["doc"]), r["level_text"] or "") for r in got.collect()) == [("1", ""), ("None", ""), ("None", ""), ("None", "%1.%2"), ("None", "(%1)")]
    assert labels_of_items(items, sheets.limit(0), ["doc"]).filter("level_text IS NOT NULL").count() == 0


def test_labels_of_node_tables(spark):
    """Node tables keep the labels of packages: the same classes and rules as the writer's, and the same level texts after another package."""
    page = """<style>.a::marker { content: "4." counter(list-item) ") " } .b::marker { content: counters(list-item, ".") ". " }</style>
    <ol><li class="a">one<ol><li class="b">two<ol type="i"><li>three</li></ol></li></ol></li></ol><ul><li>dot</li></ul><p>x</p>"""
    packed = D.to_docx(spark.createDataFrame([(1, page), (2, "<ol><li>plain</li></ol>"), (3, "<p>none</p>")], "id long, html string"), "id", "html")
    nodes = D.nodes(packed, "doc_id", "content", "docx")
    texts = lambda n: {(r["doc_id"], r["list_depth"], r["t"]) for r in n.filter("kind = 'list' AND ordered").join(list_depths(n), ["doc_id", "node_id"]).selectExpr("doc_id", "list_depth", "style['level_text'] AS t").collect()}
    said = texts(nodes)
    assert {(1, 0, "4.%1)"), (1, 1, "%1.%2.")} <= said and {d for k, d, _ in said if k == 1} == {0, 1, 2}
    wanted = {r["doc_id"]: (r["body"], r["css"]) for r in D.to_html(packed, "doc_id", "content").collect()}
    css = {r["doc_id"]: r["css"] for r in nodes_css(nodes).collect()}
    for r in nodes_to_html(nodes).collect():
        assert r["body"] == wanted[r["doc_id"]][0] and css.get(r["doc_id"], "") == wanted[r["doc_id"]][1]
    assert texts(D.nodes(nodes_to_docx(nodes), "doc_id", "content", "docx")) == said
    assert nodes_css(nodes.limit(0)).count() == 0


CELL = f"t int, row int, col int, row_span int, col_span int, {', '.join(f'{s} {B.BORDER}' for s in B.SIDES)}"


def beats(a, b):
    """Whether border a, of the earlier cell, stays against b."""
    if b is None or (a is None and b is None):
        return True
    if a is None or (a[0] == "none") != (b[0] == "none"):
        return a is not None and a[0] != "none"
    if a[0] == "none":
        return True
    weight = lambda x: {"single": 1, "thick": 2, "double": 6, "dotted": 4, "dashed": 5}[x[0]]
    light = lambda x: (int(x[2][:2], 16) + int(x[2][4:], 16) + 2 * int(x[2][2:4], 16), int(x[2][4:], 16) + 2 * int(x[2][2:4], 16), int(x[2][2:4], 16))
    return (-weight(a), -a[1], light(a)) <= (-weight(b), -b[1], light(b))


def test_edges_against_plain_competition(spark):
    rng = random.Random(5)
    one = lambda: rng.choice([None, None, ("none", 4, "000000"), *[(s, rng.choice([2, 4]), rng.choice(["000000", "ff0000", "0000ff", "00ff00"])) for s in ("single", "thick", "double", "dotted", "dashed")]])
    cells, want = [], {}
    for t in (None, 1, 2):
        for r in range(6):
            for c in range(5):
                cells.append((t, r, c, rng.choice([None, 1]), rng.choice([0, 1]), *[one() for _ in range(4)]))
    for t, r, c, _, _, top, left, bottom, right in sorted(cells, key=lambda x: (str(x[0]), x[1], x[2])):
        for edge, border in ((("h", r, c), top), (("v", c, r), left), (("h", r + 1, c), bottom), (("v", c + 1, r), right)):
            key = (t, *edge)
            if key not in want or not beats(want[key], border):
                want[key] = border
    got = B.edges(spark.createDataFrame(cells, CELL), ["t"]).collect()
    assert {(r["t"], r["axis"], r["line"], r["place"]): r["border"] and tuple(r["border"]) for r in got} == want
    assert {r["inner"] for r in got if r["line"] == 0} == {False} and all(r["inner"] for r in got if r["line"] in (1, 2, 3, 4))


def test_spans_and_strokes(spark):
    thin, thick = ("single", 4, "000000"), ("double", 4, "000000")
    cells = [(1, 0, 0, 2, 2, thin, thin, thin, thin), (1, 0, 2, 1, 1, thin, thick, None, None), (1, 1, 2, 1, 1, ("none", 4, "000000"), None, None, None)]
    df = spark.createDataFrame(cells, CELL)
    tables = spark.createDataFrame([(1, *[thin] * 4, thick, None)], "t int, " + ", ".join(f"{s} {B.BORDER}" for s in (*B.SIDES, "inside_h", "inside_v")))
    edges = B.edges(df, ["t"], tables)
    runs = {(r["axis"], r["line"], r["first"], r["last"], r["border"]["style"]) for r in B.edge_runs(edges, ["t"]).collect()}
    assert runs == {("h", 0, 0, 2, "single"), ("h", 2, 0, 2, "single"), ("v", 0, 0, 1, "single"), ("v", 2, 0, 0, "double"), ("v", 2, 1, 1, "single"), ("v", 3, 0, 1, "single")}
    drawn = {(r["row"], r["col"]): (r["css"], r["mixed"]) for r in B.cell_borders(df, edges, ["t"]).collect()}
    s, d = "0.50pt solid #000000", "0.50pt double #000000"
    assert drawn == {(0, 0): (f"border-top:{s};border-left:{s};border-bottom:{s};border-right:{d}", True), (0, 2): (f"border-top:{s};border-right:{s}", False), (1, 2): (f"border-bottom:{s};border-right:{s}", False)}


@pytest.mark.parametrize("with_tables", [False, True])
def test_no_cells(spark, with_tables):
    empty = spark.createDataFrame([], CELL)
    tables = spark.createDataFrame([], "t int, " + ", ".join(f"{s} {B.BORDER}" for s in (*B.SIDES, "inside_h", "inside_v"))) if with_tables else None
    edges = B.edges(empty, ["t"], tables)
    assert edges.count() == 0 and B.edge_runs(edges, ["t"]).count() == 0 and B.cell_borders(empty, edges, ["t"]).count() == 0
