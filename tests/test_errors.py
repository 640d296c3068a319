"""Unreadable documents become rows, long style chains are followed to their end."""

import io
import zipfile

from folium.kernels.docx_write import write_docx
from folium.kernels.html_read import from_html
from folium.operators.styles import style_chains
from folium.sources import documents as D


def damaged():
    """A package whose picture fails its checksum."""
    source = zipfile.ZipFile(io.BytesIO(write_docx(from_html("<p>x</p>"))))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in source.namelist():
            z.writestr(name, source.read(name))
        z.writestr("word/media/image1.png", b"PICTUREBYTES")
    return out.getvalue().replace(b"PICTUREBYTES", b"PICTUREBYTEX", 1)


def test_damaged_packages_are_rows(spark):
    table = spark.createDataFrame([(1, damaged()), (2, b"no package"), (3, write_docx(from_html("<p>{{a}}</p>"))), (4, None)], "id long, content binary")
    errors = lambda df, c, v: sorted(r["doc_id"] for r in df.collect() if r[c] == v)
    assert errors(D.nodes(table, "id", "content", "docx"), "kind", "error") == [1, 2]
    assert errors(D.variables(table, "id", "content"), "source", "error") == [1, 2]
    assert errors(D.relationships(table, "id", "content"), "type", "error") == [1, 2]
    assert sorted(r["doc_id"] for r in D.to_html(table, "id", "content").filter("error IS NOT NULL").collect()) == [1, 2]
    assert D.to_docx(spark.createDataFrame([(1, "<p>x")], "id long, h string"), "id", "h").filter("error IS NULL").count() == 1


def test_long_style_chains(spark):
    rows = [(k, k - 1 if k else None, "x" if k == 0 else None) for k in range(100)] + [(200, 201, None), (201, 200, "y"), (300, 999, None)]
    got = {r["id"]: r["p"] for r in style_chains(spark.createDataFrame(rows, "id long, up long, p string"), [], "id", "up", ["p"]).collect()}
    assert len(got) == 103 and all(got[k] == "x" for k in range(100)) and got[200] == got[201] == "y" and got[300] is None


def test_assembled_packages(spark):
    run = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    rows = [(1, run.format("a"), "x"), (2, run.format("b"), None), (3, None, "x"), (4, "<w:p>", "x"), (5, "", "")]
    table = spark.createDataFrame(rows, "id long, inner string, styles string").selectExpr("*", "'<w:styles xmlns:w=\"http://schemas.openxmlformats.org/wordprocessingml/2006/main\"/>' AS s")
    table = table.selectExpr("id", "inner", "IF(styles IS NULL, NULL, s) AS styles")
    packed = D.assemble(table, "id", "inner", None, {"d1": ("styles", "styles")})
    roles = sorted((r["doc_id"], r["role"]) for r in D.parts(packed, "doc_id", "content").collect())
    assert roles == [(1, "document"), (1, "styles"), (2, "document"), (4, "error"), (5, "document"), (5, "styles")]
    text = sorted((r["doc_id"], r["text"]) for r in D.nodes(packed, "doc_id", "content", "docx").filter("kind IN ('p', 'error')").collect())
    assert text[:2] == [(1, "a"), (2, "b")] and [k for k, _ in text] == [1, 2, 4]
