"""One small test for each finding of round 4 that was mended."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium import queries
from folium.build import bulk
from folium.catalog import documents, values
from folium.functions import css
from folium.kernels import docx_read, docx_stream, html_read, package, styles
from folium.kernels.docx_write import esc, write_docx
from folium.kernels.html_write import escape
from folium.kernels.nodes import told_once
from folium.kernels.package import open_package
from folium.operators import borders, content, labels
from folium.operators.markup import nodes_to_docx
from folium.session import grouped, partitions
from folium.sources import documents as sources


def test_outline_keeps_unended_references(spark, tmp_path):
    spark.createDataFrame([(1, "", "<h1>a &amp;&amp</h1>"), (2, "", "<h1>&quot;b&quot; &quo</h1>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = documents.html_outline(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["text"]) for r in found) == [(1, "a &&amp"), (2, '"b" &quo')]


def test_content_models_do_not_travel_with_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(content, "cut", lambda df, name, f=content.cut: written.append(set(df.columns)) or f(df, name))
    children = [(k, "w:rPr", p, n) for k in range(3) for p, n in enumerate(["w:i", "w:b", "w:zz"] * (1 + 5 * k), 1)]
    df = spark.createDataFrame(children, "k long, parent string, pos int, name string")
    whole = sorted(map(tuple, content.violations(df, ["k"]).collect()))
    assert written == [{"k", "parent", "chunk", "items"}]
    assert sorted(map(tuple, content.violations(df, ["k"], chunk=4).collect())) == whole
    assert (0, "w:rPr", 2, "w:b", "misplaced") in whole and (0, "w:rPr", 3, "w:zz", "unknown") in whole and (2, "w:rPr", 4, "w:i", "repeated") in whole


def test_elements_are_walked_where_they_lie(spark):
    df = spark.createDataFrame([(1, "<a><b/><c><!-- <x> --></c></a></q><d>"), (2, None)], "k long, xml string")
    found = content.xml_elements(df, ["k"], "xml")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["node_id"], r["end_id"], r["parent"], r["pos"], r["depth"], r["name"]) for r in found.collect()) == [(0, 4, None, 1, 0, "a"), (1, 1, "a", 1, 1, "b"), (2, 3, "a", 2, 1, "c"), (6, None, None, 2, -1, "d")]


def _bordered(spark):
    rows = [(k, r, c, 2 if (r, c) == (0, 0) else 1, 1, *[None if (r + c + i) % 3 == 0 else (("none", "single", "double")[(r * c + i) % 3], 4 + c, "ff0000") for i in range(4)]) for k in (1, None) for r in range(3) for c in range(2) if (r, c) != (1, 0)]
    border = "struct<style:string,size:int,color:string>"
    cells = spark.createDataFrame(rows, f"k long, row int, col int, row_span int, col_span int, top {border}, left {border}, bottom {border}, right {border}")
    tables = spark.createDataFrame([(1, *[("dotted", 8, "000000")] * 6), (None, *[("single", 2, "00ff00")] * 6)], "k long, " + ", ".join(f"{s} {border}" for s in (*borders.SIDES, "inside_h", "inside_v")))
    return cells, tables


def test_cells_are_dealt_once(spark):
    cells, tables = _bordered(spark)
    edges = borders.edges(cells, ["k"], tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, apart in ((borders.strokes(cells, ["k"], tables), borders.edge_runs(edges, ["k"])), (borders.drawn_borders(cells, ["k"], tables), borders.cell_borders(cells, edges, ["k"]))):
            assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # cells and tables
            assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_borders_of_a_table_may_follow_from_its_key_without_a_join(spark):
    cells, tables = _bordered(spark)
    frame = lambda *b: F.struct(*[F.struct(F.lit(b[0]).alias("style"), F.lit(b[1]).alias("size"), F.lit(b[2]).alias("color")).alias(s) for s in (*borders.SIDES, "inside_h", "inside_v")])
    own = F.when(F.col("k").isNull(), frame("single", 2, "00ff00")).otherwise(frame("dotted", 8, "000000"))
    dealt = grouped(cells, "k", each=borders.EACH)
    for made in (borders.strokes, borders.drawn_borders):
        found = made(dealt, ["k"], own)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the caller's
        assert sorted(map(str, found.collect())) == sorted(map(str, made(cells, ["k"], tables).collect()))


def test_partitions_grow_with_the_files_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "id % 1000 AS k").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert partitions(df, 1 << 40) == cores and partitions(df, 1 << 10) > 500
    assert grouped(df.groupBy("k").count(), "k", each=1 << 10).rdd.getNumPartitions() == partitions(df, 1 << 10)
    assert partitions(spark.createDataFrame([(1,)], "k long"), 1 << 20) == cores


def test_strokes_of_tables_that_have_no_key(spark):
    cells, tables = _bordered(spark)
    found = borders.strokes(cells, ["k"], tables)
    assert {r["border"]["style"] for r in found.filter("k IS NULL").collect()} >= {"single"}
    assert found.columns == ["k", "axis", "line", "first", "last", "border"]


def test_markup_of_nodes_is_dealt_out_before_packages_are_made(spark):
    page = '<style>.a::marker { content: "7." counter(list-item) ") " }</style><ol><li class="a">x</li></ol>'
    made = sources.to_docx(spark.createDataFrame([(k, page) for k in range(8)], "id long, html string"), "id", "html")
    nodes = sources.nodes(made, "doc_id", "content", "docx")
    packed = nodes_to_docx(nodes)
    assert packed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sources.nodes(packed, "doc_id", "content", "docx").filter("style['level_text'] = '7.%1)'").count() == 8


def test_equal_parts_are_parsed_once_and_watermarks_stay():
    doc = html_read.from_html("<ol><li>x</li></ol>", watermark="DRAFT")
    data = write_docx(doc)
    first, second = open_package(data), open_package(data)
    assert first.parts["styles"] is second.parts["styles"] and first.shared >= {"styles", "numbering"}
    assert [docx_read.read_docx(data).watermark for _ in range(2)] == ["DRAFT", "DRAFT"]


def test_packages_of_any_size_are_read_as_a_stream(monkeypatch):
    monkeypatch.setattr(package, "PART", 4096)
    data = write_docx(html_read.from_html("<table>" + "".join(f"<tr><td>a &amp; {k}</td></tr>" for k in range(400)) + "</table>"))
    with pytest.raises(package.PackageError):
        docx_read.read_docx(data)
    assert docx_stream.text_and_rows(data) == (hashlib.md5("".join(f"a & {k}" for k in range(400)).encode()).hexdigest(), 400)
    with pytest.raises(package.PackageError):
        docx_stream.text_and_rows(b"no archive")


def test_inline_styles_are_split_once(spark):
    df = spark.createDataFrame([(" A:1; b : x:y ;a: 2;;:z;c:;B:w",), (None,)], "style string").select(css.declarations(F.col("style")).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [list(r["m"].items()) for r in df.collect()] == [[("a", "2"), ("b", "w")], []]


@pytest.mark.parametrize("name", ["css_declarations", "css_run_style", "css_paragraph_style", "css_cell_style", "css_table_style"])
def test_styles_of_one_small_file_are_dealt_out(spark, name, tmp_path):
    spark.createDataFrame([(1, "n", 5)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = getattr(values, name)(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString() and found.count()


def test_documents_of_a_hot_key_are_not_split(spark):
    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2048"}
    for key, value in hot.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(0, 40000, 1, 8).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id % 50 END AS k", "id AS n")
        rows = lines.join(spark.range(50).withColumnRenamed("id", "order"), F.col("k") == F.col("order"))
        made = bulk.docs_from_rows(rows, bulk.compile_template("<p>{{order}}</p><p>{{#line}}{{n}}{{/line}}</p>", "html"), "order", ["n"]).collect()
    finally:
        for key in hot:
            spark.conf.unset(key)
    assert len(made) == len({r["doc_id"] for r in made}) == 26
    assert {r["content"] for r in made if r["doc_id"] == 0} == {"<p>0</p>" + "".join(f"<p>{n}</p>" for n in range(0, 40000, 2))}


def test_values_of_a_batch_are_shown_as_one_by_one():
    texts = ["a&<b>\"'", None, "", "x\ty\r\nz\nq\rw", "\x00\x1fé￾￿\U0001f600", "&amp;"]
    for format, one in (("docx", bulk._word), ("html", lambda v: escape(v or ""))):
        assert bulk._shown(pa.array(texts), format).to_pylist() == [one(x) for x in texts]
    column = pa.array(["ab", "", "c", "de"]).slice(1)
    assert bytes(bulk._between(column, 0, 2)) == b"c" and bytes(bulk._between(column, 1, 3)) == b"cde"


def test_labels_are_told_once_for_equal_levels(spark):
    levels = spark.createDataFrame([(k, c, t, d, "decimal") for k in (1, 2, None) for c, t, d in (("a", "(%1)", 0), ("b", None, 1), (None, "(%1)", 0))], "k long, class string, level_text string, depth int, format string")
    found = labels.marker_sheets(levels, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "<=> _text" in plan  # the levels that differ, joined back
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.createDataFrame([(k, '.a::marker { content: "(" counter(list-item) ") " }\n') for k in (1, 2, None)], "k long, css string").collect()))


def test_node_tables_of_some_kinds_and_columns_are_the_filtered_whole(spark):
    html = '<h1>t</h1><table><tr><td rowspan=2>a<td width=50% class="x">b<tr><td colspan="2"> c &amp; d</td></tr></table><ol start="3"><li>e<ul><li>f</ul></ol><a href="u">g</a>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id long, html string")
    columns = ("kind", "doc_id", "node_id", "parent_id", "text", "row_span", "is_continue", "start_at", "href", "style")
    found = sources.nodes(df, "id", "html", kinds=("cell", "list", "link"), columns=columns)
    whole = sources.nodes(df, "id", "html").filter("kind IN ('cell', 'list', 'link')").select(found.columns)
    assert found.schema == whole.schema and set(found.columns) == set(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count() == 7
    with pytest.raises(ValueError):
        sources.nodes(df, "id", "html", columns=("doc_id", "none"))


def test_plain_tags_are_read_as_the_tokenizer_reads_them(monkeypatch):
    odd = ['<p class="a" id=b>x</p>', "<style>.a::marker { content: '<p>' }</style><p>y</p >z", "<script>a<b</script><p>c</p>", '<td rowspan=2 width=5%>a<td colspan="2">b', '<a href="u"x="v">k</a>', "<p a=1/>d<hr/>e", '<a href="?a&amp;b">f</a></', "<P>g</P\n>h", '<p title="a>b">i</p><x-y z="">j</x-y>']
    read = lambda: [html_read.from_html(a + b) for a in odd for b in odd]
    fast = read()
    for name in ("_PLAIN_START", "_PLAIN_END"):
        monkeypatch.setattr(html_read, name, html_read.re.compile("(?!)"))
    assert read() == fast


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", ["list_numbering", "list_nesting", "field_marks"])
def test_lines_are_dealt_once_in_partitions_that_grow_with_the_files(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_pages_of_the_fidelity_report_are_read_once(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(sources, "_map", lambda df, id, value, one, schema: made.update(one=one))
    sources.fidelity(None, "id", "html")
    read = []
    monkeypatch.setattr(html_read, "from_html", lambda body, f=html_read.from_html: read.append(body) or f(body))
    assert made["one"](1, "<p>a <b>b</b>&amp; 'c'</p>") == [{"doc_id": 1, "reads": True, "covered": True, "fixed_point": True}]
    assert len(read) == 2  # the page, and what the first round made of it


def test_equal_styles_are_told_once_and_types_are_told_apart():
    told = []
    tell = told_once(lambda s: told.append(s) or str(s))
    styles = [{"size": 1}, {"size": True}, {"size": 1.0}, {"size": 1, "bold": None}, {"borders": {"top": {}}}, {"font": "x" * 5000}, {}]
    assert [tell(dict(s)) for s in styles * 2] == [str(s) for s in styles * 2]
    assert len(told) == len(styles) + 2  # dicts are told anew, and so are long ones


def test_properties_that_say_the_same_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(styles, "para_props", lambda e, f=styles.para_props: read.append(e) or f(e))
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{}</w:document>'
    pprs = ['<w:pPr><w:jc w:val="center"/></w:pPr>', '<w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="2"/></w:numPr></w:pPr>', '<w:pPr><w:pBdr><w:top w:val="single"><w:x><w:y/></w:x></w:top></w:pBdr></w:pPr>']
    found = list(package.xml(xml.format("".join(pprs * 3)).encode()))
    plain = [styles.Styles().paragraph(e) for e in found]
    known = styles.Styles()
    read.clear()
    got = [known.paragraph(e) for e in found]
    assert got == plain and len(read) == 2 + 3  # the third goes deeper than is compared
    got[0][0]["align"] = "end"
    assert known.paragraph(found[3])[0]["align"] == "center"


def test_plain_texts_are_escaped_as_all_are():
    texts = ["", "a", "a&<>\"'b", "\x00\x1f\x7f\t\n\r", "\ud800x\udfff", "￾￿\U0001f600 é&", "&amp;"]
    names = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
    named = lambda t: "".join(names.get(c, c) for c in t)
    kept = lambda c: c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c > "￿"
    assert [esc(t) for t in texts] == ["".join(filter(kept, named(t.encode("utf-8", "surrogatepass").decode("utf-8", "replace")))) for t in texts]
    assert [escape(t) for t in texts] == [named(t.encode("utf-8", "replace").decode()) for t in texts]


def test_texts_of_packages_are_read_back_where_they_lie(spark, tmp_path):
    texts = ["a\n\tb & c\nd", "", "x\x0cy\r\nz", None, "é" * 9000 + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = documents.docx_text_roundtrip(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "ENSURE_REQUIREMENTS" not in plan  # no text is dealt again
    packed = sources.text_to_docx(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")
    nodes = sources.nodes(packed, "doc_id", "content", "docx").collect()
    by_tree = [(k, hashlib.md5("".join(n["text"] for n in nodes if n["doc_id"] == k and n["kind"] == "run").encode()).hexdigest(), sum(n["doc_id"] == k and n["kind"] == "br" for n in nodes)) for k, t in enumerate(texts) if t is not None]
    assert sorted(map(tuple, found.collect())) == by_tree and [b for *_, b in by_tree] == [2, 0, 1, 1]


def test_runs_of_equal_styles_are_told_once(spark, monkeypatch):
    from folium.operators import cascade

    written = []
    monkeypatch.setattr(cascade, "cut", lambda df, name, f=cascade.cut: written.append((name, f(df, name))) or written[-1][1])
    made = spark.createDataFrame([(1, "N", "paragraph", None, True), (1, "H", "paragraph", "N", False), (None, "N", "paragraph", None, True)], "doc_id int, style_id string, kind string, based_on string, is_default boolean")
    rows = [(1, "style", "N", "size", "22", None), (1, "style", "H", "bold", None, None), (None, "style", "N", "size", "7", None)]
    rows += [(1, "run", f"r{k}", "size", str(k), None) for k in range(0, 200, 2)] + [(1, "run", "r0", "size", "9", None), (1, "run", "r0", None, "x", None), (3, "run", "own", "size", "1", None), (1, "run", "r1", "color", None, "gone")]
    properties = spark.createDataFrame(rows, "doc_id int, owner string, owner_id string, name string, value string, theme string")
    theme = spark.createDataFrame([], "doc_id int, theme string, value string")
    runs = spark.createDataFrame([(1, f"r{k}", "H" if k % 3 else None, None) for k in range(200)] + [(None, "r0", None, None), (2, "none", None, None), (3, "own", None, None)], "doc_id int, run_id string, p_style string, r_style string")
    got = sorted(map(str, map(tuple, cascade.cascade_runs(runs, made, properties, theme).collect())))
    want = [(1, f"r{k}", "size", "9" if k == 0 else str(k) if k % 2 == 0 else "22") for k in range(200)] + [(1, f"r{k}", "bold", "true") for k in range(200) if k % 3]
    assert got == sorted(map(str, want + [(1, "r0", None, "x"), (None, "r0", "size", "7"), (3, "own", "size", "1")]))
    sizes = {name: df.count() for name, df in written}
    assert sizes["looks"] == 5 and sizes["told"] == 3 and sizes["properties"] == 3  # no row of a run's own is written


@pytest.mark.parametrize("name", ["docx_to_html", "docx_structures", "docx_lists", "docx_cascade"])
def test_packages_are_read_by_the_worker_that_makes_them(spark, name, tmp_path):
    spark.createDataFrame([(1, "t&amp;", 5, "b")], "p_partkey long, p_type string, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = queries.queries()[name](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and found.count()


def test_packages_read_where_they_are_made_are_those_read_later(spark):
    text = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    df = spark.createDataFrame([(1, text.format("a")), (2, None), (3, "<w:p>"), (4, "")], "id long, body string")
    packed = sources.assemble(df, "id", "body")
    for then, later in ((sources.html_reader(), sources.to_html(packed, "doc_id", "content")), (sources.nodes_reader("docx"), sources.nodes(packed, "doc_id", "content", "docx"))):
        found = sources.assemble(df, "id", "body", then=then)
        assert found.schema == later.schema and sorted(map(str, found.collect())) == sorted(map(str, later.collect())) and found.count() >= 2
