"""Trees as rows: folds, bulk documents, content models and selectors against plain Python."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folium.build.bulk import compile_template, docs_from_rows
from folium.operators import content as C
from folium.operators import selectors as S
from folium.operators.markup import fold, nodes_to_docx, nodes_to_html
from folium.sources import documents as D

RICH = """<h2 style="text-align:center">T &amp; "q"</h2><p style="margin-left:10pt;color:#f00;line-height:1.5">a <b>b<i>c</i></b><br>x <a href="/u?a=1&b=2">l<b>k</b></a> <sup>2</sup> <span style="color:red;font-size:9pt">s</span></p><p></p>
<ul><li>1<ol type="a" start="3"><li>n1</li><li>n2</li></ol></li><li>2</li></ul><table style="width:50%"><caption>cap</caption><tr><th>h</th><th>i</th></tr><tr><td rowspan=2 style="border:1px solid red;padding:2pt;background:#eee">m</td>
<td>c<ul><li>q</li></ul></td></tr><tr><td>z</td></tr></table><hr><p style="border-top:2pt dashed blue"><page-number/> <u>u</u><s>s</s></p>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, RICH), (2, "<p>x</p>"), (3, ""), (4, None)], "id long, html string")


def bodies(df):
    return {r["doc_id"]: r["body"] for r in df.collect()}


def test_nodes_to_html_is_what_the_writer_makes(spark, pages):
    made = bodies(nodes_to_html(D.nodes(pages, "id", "html")))
    assert made == {k: v for k, v in bodies(D.to_html(pages, "id", "html", "html")).items() if v}  # a page without blocks has no nodes
    packed = D.to_docx(pages, "id", "html")
    wanted = bodies(D.to_html(packed, "doc_id", "content"))
    assert {k: v for k, v in bodies(nodes_to_html(D.nodes(packed, "doc_id", "content", "docx"))).items() if k == 1} == {1: wanted[1]}


def test_node_rows_may_change(spark, pages):
    nodes = D.nodes(pages, "id", "html").filter("doc_id = 1")
    less = nodes.filter("kind NOT IN ('table', 'link')").withColumn("text", F.when(F.col("kind") == "run", F.upper("text")).otherwise(F.col("text")))
    body = bodies(nodes_to_html(less))[1]
    assert "<table" not in body and "<a " not in body and "<strong>B<em>" not in body and "<strong>B</strong>" in body and ">n1<" not in body and "N1" in body
    (row,) = nodes_to_docx(less).collect()
    assert row["error"] is None and zipfile.ZipFile(io.BytesIO(bytes(row["content"]))).testzip() is None
    assert nodes_to_html(nodes.filter("false")).collect() == []


def test_images_come_from_the_media_table(spark):
    png = bytes.fromhex("89504E470D0A1A0A")
    nodes = D.nodes(spark.createDataFrame([(7, "<p>x</p>")], "id long, html string"), "id", "html").withColumn("kind", F.when(F.col("kind") == "run", "image").otherwise(F.col("kind"))).withColumn("media_sha", F.lit("ab"))
    media = spark.createDataFrame([("ab", "image/png", png), ("ab", "image/png", png)], "media_sha string, mime string, content binary")
    assert "src=\"data:image/png;base64,iVBORw0KGgo=\"" in bodies(nodes_to_html(nodes, media))[7] and 'src="ab"' in bodies(nodes_to_html(nodes))[7]


def test_fold_of_deep_and_broken_trees(spark):
    deep = [(1, k, k - 1 if k else None, 0, k) for k in range(15)]
    rows = deep + [(1, 40, 39, 0, 3), (2, 0, None, 1, 0), (2, 1, None, 0, 0), (2, 2, 0, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id int, node_id int, parent_id int, ord int, depth int")
    got = fold(df, F.concat(F.lit("("), "node_id"), F.lit(")"), F.lit("."), keys=("doc_id",))
    assert {r["doc_id"]: r["markup"] for r in got.collect()} == {1: "".join(f"({k}" for k in range(15)) + "." + ")" * 15, 2: "(1.)(0(2.))"}
    assert fold(df.filter("false"), F.lit(""), F.lit(""), F.lit(""), keys=("doc_id",)).collect() == []


def test_documents_from_rows(spark):
    html = "<p>{{name}} & co</p><table><tr><td>{{#a}}{{x}}{{/a}}</td></tr></table><p>{{#b}}[{{x}}]{{/b}}</p><p>end {{name}}</p>"
    rows = [(k, b, o, f"v{o}", f"n{k}") for k in (1, 2) for o, b in enumerate("abbac")] + [(None, "a", 0, "tab\there\nline <&>\x01", None), (3, None, 0, "x", "only head")]
    df = spark.createDataFrame(rows, "k int, block string, o int, x string, name string")
    plan = compile_template(html, "html")
    assert plan.slots == ["name", "x"] and plan.blocks == ["a", "b"]
    got = {r["doc_id"]: r["content"] for r in docs_from_rows(df, plan, "k", ["o"], "block").collect()}
    assert got[1] == "<p>n1 & co</p><table><tr><td>v0</td></tr><tr><td>v3</td></tr></table><p>[v1]</p><p>[v2]</p><p>end n1</p>"
    assert got[3] == "<p>only head & co</p><table></table><p>end only head</p>" and "<td>tab\there\nline &lt;&amp;&gt;\x01</td>" in got[None]
    word = compile_template(html)
    once = {r["doc_id"]: bytes(r["content"]) for r in docs_from_rows(df, word, "k", ["o"], "block").collect()}
    again = {r["doc_id"]: bytes(r["content"]) for r in docs_from_rows(df.repartition(7, "x").orderBy(F.desc("o")), word, "k", ["o"], "block").collect()}
    assert once == again  # the same bytes however the rows come
    runs = D.nodes(spark.createDataFrame([(k or 0, v) for k, v in once.items()], "id long, content binary"), "id", "content", "docx").filter("kind = 'run'").orderBy("node_id").collect()
    assert [r["text"] for r in runs if r["doc_id"] == 2] == ["n2 & co", "v0", "v3", "[v1]", "[v2]", "end n2"]
    assert [r["text"] for r in runs if r["doc_id"] == 0][1:-1] == ["tab\there", "line <&>"]
    assert docs_from_rows(df.filter("false"), word, "k", ["o"], "block").collect() == []


def test_templates_that_cannot_be_compiled(spark):
    df = spark.createDataFrame([(1, "x")], "k int, x string")
    for html in ("<p>{{#a}}{{x}}</p>", "<div>{{#a}}x{{/a}}</div>"):
        with pytest.raises(ValueError):
            compile_template(html, "html")
    with pytest.raises(ValueError):
        docs_from_rows(df, compile_template("<p>{{y}}</p>", "html"), "k")
    with pytest.raises(ValueError):
        docs_from_rows(df, compile_template("<p>{{#a}}{{x}}{{/a}}</p><p>{{#b}}{{x}}{{/b}}</p>", "html"), "k")


def plain_violations(names, model):
    """The rules in words: places in order; what cannot stand where it does is faulty and changes nothing."""
    places, at, used, out = C.slots(model), 0, False, []
    gone = lambda a, b: next(("|".join(p.names) for p in places[a:b] if p.required), None)
    known = {n for p in places for n in p.names}
    for pos, name in enumerate(names, 1):
        name_ = name if name in known else "ANY"
        to = next((j for j in range(at, len(places)) if name_ in places[j].names), None)
        if to is None:
            behind = any(name_ in p.names for p in places[:at])
            just = at and not used and name_ in places[at - 1].names
            out.append((pos, name, "repeated" if just else "misplaced" if behind else "unknown"))
            continue
        if missing := gone(at + used, to):
            out.append((pos, missing, "missing"))
        at, used = (to, True) if places[to].many else (to + 1, False)
    if missing := gone(at + used, len(places)):
        out.append((None, missing, "missing"))
    return out


@pytest.mark.parametrize("chunk", [3, 1024])
def test_violations_against_plain_rules(spark, chunk):
    models = {"m1": "a? b c* d? e", "m2": "x ANY* y?", "m3": "p|q+ r?", "m4": "ANY*"}
    rng = random.Random(4)
    rows, wanted = [], set()
    for k in range(160):
        parent = rng.choice([*models, "none"])
        names = [rng.choice("abcdexypqrz") if rng.random() < 0.4 else rng.choice([n for s in C.slots(models.get(parent, "a")) for n in s.names]) for _ in range(rng.choice([0, 1, 2, 5, 9, 20]))]
        rows += [(k, parent, p, n) for p, n in enumerate(names, 1)] or [(k, parent, None, None)]
        if parent in models:
            wanted |= {(k, parent, *v) for v in plain_violations(names, models[parent])}
    children = spark.createDataFrame(rows, "k int, parent string, pos int, name string")
    got = [tuple(r) for r in C.violations(children, ["k"], models, chunk).select("k", "parent", "pos", "name", "fault").collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_elements_of_markup(spark):
    xml = """<?xml version="1.0"?><a x="1 > 0"><!-- <z> --><b/><c y='/'><d>t</d><d/></c><![CDATA[<q>]]></a>"""
    rows = C.xml_elements(spark.createDataFrame([(1, xml), (2, None), (3, "none")], "id int, xml string"), ["id"], "xml").orderBy("node_id").collect()
    assert [(r["name"], r["parent"], r["pos"], r["depth"]) for r in rows] == [("a", None, 1, 0), ("b", "a", 1, 1), ("c", "a", 2, 1), ("d", "c", 1, 2), ("d", "c", 2, 2)]
    assert [r["end_id"] - r["node_id"] for r in rows] == [7, 0, 4, 1, 0]


def test_our_packages_keep_the_content_models(spark, pages):
    packed = D.to_docx(pages.filter("html IS NOT NULL"), "id", "html").select("doc_id", "content")
    read = lambda data: zipfile.ZipFile(io.BytesIO(bytes(data))).read("word/document.xml").decode()
    parts = spark.createDataFrame([(r["doc_id"], read(r["content"])) for r in packed.collect()], "doc_id long, xml string")
    elements = C.xml_elements(parts, ["doc_id"], "xml").filter("parent_id IS NOT NULL")
    assert elements.count() > 100 and C.violations(elements, ["doc_id", "parent_id"]).collect() == []


SELECTORS = (
    "div p", "div > p", "p + p", "h1 ~ p", "ul ul li", ".a .b", "div.a > .b", "#x p", "[t]", "[t=v]", "[t^='v w']", "[t~=w]", "[t$=w]", "[t*=' ']", "p:first-child", "p:last-child", "li:nth-child(2n+1)", "li:nth-child(-n+2)",
    "li:nth-last-child(2)", "b:only-child", "*", "div * b", "div > ul > li + li b", "ul li ~ li > b", "body > div div.a p",
)


def plain_matches(rows, text):
    """Right to left, as a reader would check one element."""
    at = {r["node_id"]: r for r in rows}
    steps = S.selector(text)[0]

    def fits(r, c):
        attrs = r["attrs"]
        ops = {"": lambda v, x: True, "=": lambda v, x: v == x, "^=": str.startswith, "$=": str.endswith, "*=": lambda v, x: x in v, "~=": lambda v, x: x in v.split()}
        in_series = lambda n, a, b: n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0
        return (
            c["tag"] in (None, r["tag"]) and c["id"] in (None, attrs.get("id")) and all(k in attrs.get("class", "").split() for k in c["classes"])
            and all(k in attrs and ops[op](attrs[k], v) for k, op, v in c["tests"]) and all(in_series(r["nth_last" if last else "nth"], a, b) for last, a, b in c["places"])
        )

    def ok(r, k):
        if not fits(r, steps[k][1]):
            return False
        if k == 0:
            return True
        how, up = steps[k][0], at.get(r["parent_id"])
        siblings = [x for x in rows if x["parent_id"] == r["parent_id"] and x["nth"] < r["nth"]]
        if how == ">":
            return up is not None and ok(up, k - 1)
        if how in "+~":
            return any(ok(x, k - 1) for x in siblings if how == "~" or x["nth"] == r["nth"] - 1)
        while up is not None:
            if ok(up, k - 1):
                return True
            up = at.get(up["parent_id"])
        return False

    return {(r["doc_id"], r["node_id"]) for r in rows if ok(r, len(steps) - 1)}


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "ul", "b", "h1"] if depth < 4 else ["b"]) if rng.random() < 0.6 else rng.choice(["p", "li"])
        attrs = rng.choice(["", "", ' class="a"', ' class="b a"', ' id="x"', ' t="v w"', ' t="v"'])
        inner = random_html(rng, depth + 1) if tag in ("div", "ul") and depth < 4 else rng.choice(["t", "<b>u</b>"])
        out.append(f"<{tag}{attrs}>{inner}</{tag}>")
    return "".join(out)


def test_selectors_against_a_plain_matcher(spark):
    rng = random.Random(2)
    dom = D.elements(spark.createDataFrame([(k, random_html(rng)) for k in range(30)] + [(99, "")], "id long, html string"), "id", "html").cache()
    compounds, _ = S.sheet_tables(spark, "".join(f"{s} {{ color: red }}" for s in SELECTORS))
    got = [tuple(r) for r in S.matches(dom.unionByName(dom.limit(5)), compounds).select("doc_id", "node_id", "rule").collect()]
    assert len(got) == len(set(got))
    by_doc: dict = {}
    for r in dom.filter("tag IS NOT NULL").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for rule, text in enumerate(SELECTORS):
        wanted = set().union(*(plain_matches(rows, text) for rows in by_doc.values()))
        assert {(d, n) for d, n, k in got if k == rule} == wanted, text
    assert S.matches(dom.filter("false"), compounds).collect() == [] and S.matches(dom, compounds.filter("false")).collect() == []


def test_cascade_and_inlining(spark):
    sheet = "p { color: red; margin-top: 1pt } .a { color: blue } p.a { color: green !important } @media print { p { color: black } } p:hover { color: black }"
    assert S.unsupported("p:hover {} a > b {}") == ["p:hover"]
    html = '<p class="a" style="color:black; text-indent: 2pt">x &amp; <br>y</p><p>z</p>'
    got = S.inline_sheet(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html", sheet).collect()
    assert [r["html"] for r in got] == ['<body><p class="a" style="color:green;margin-top:1pt;text-indent:2pt">x &amp; <br>y</p><p style="color:red;margin-top:1pt">z</p></body>']
