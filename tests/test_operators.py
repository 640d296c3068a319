"""Relational operators on small inputs, against direct simulation; sources and streaming."""

import random

from pyspark.sql import functions as F

from folium.build import DocumentBuilder
from folium.operators import layout as L
from folium.operators import styles as S
from folium.plans.convert import fidelity_report, outline, table_cells
from folium.session import cut
from folium.sources import documents as D
from folium.streaming.ingest import stream_nodes


def test_list_numbers_against_counters(spark):
    rng = random.Random(5)
    rows = [(d, o, rng.randrange(4)) for d in range(12) for o in range(30)]
    expected = {}
    for d in range(12):
        counters = {}
        for _, o, level in (r for r in rows if r[0] == d):
            counters[level] = counters.get(level, level) + 1
            counters = {k: v for k, v in counters.items() if k <= level}
            expected[d, o] = counters[level]
    df = spark.createDataFrame(rows, "doc int, ord int, lvl int")
    got = {(r["doc"], r["ord"]): r["number"] for r in L.list_numbers(df, ["doc"], ["ord"], "lvl", F.col("lvl") + 1).collect()}
    assert got == expected


def test_style_cycle_and_chain(spark):
    rows = [(1, "A", "B", "a", None), (1, "B", "C", None, 1), (1, "C", "B", "c", 2), (1, "D", "none", None, None), (1, "E", None, "e", None)] + [(2, f"s{k}", f"s{k + 1}", None, None) for k in range(20)] + [(2, "s20", None, "deep", 9)]
    got = {(r["doc"], r["id"]): (r["font"], r["size"]) for r in S.style_chains(spark.createDataFrame(rows, "doc int, id string, up string, font string, size int"), ["doc"], "id", "up", ["font", "size"]).collect()}
    assert got[1, "A"] == ("a", 1) and got[1, "B"] == ("c", 1) and got[1, "C"] == ("c", 2) and got[1, "D"] == (None, None) and got[2, "s0"] == ("deep", 9)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "doc int, ord int, num int")
    assert L.list_runs(empty, ["doc"], ["ord"], "num").count() == 0 and L.split_sections(empty, ["doc"], ["ord"], F.col("num") == 1).count() == 0
    assert D.nodes(spark.createDataFrame([], "id long, html string"), "id", "html").count() == 0


def test_bad_documents_become_errors(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(DocumentBuilder.new().heading(1, "T").to_bytes())), (3, None)], "id long, b binary")
    rows = {r["doc_id"]: r["kind"] for r in D.nodes(df, "id", "b", "docx").filter("depth = 0").collect()}
    assert rows == {1: "error", 2: "p"}
    html = {r["doc_id"]: r["error"] for r in D.to_html(df, "id", "b").collect()}
    assert html[1] and html[2] is None
    assert [r["text"] for r in outline(D.nodes(df, "id", "b", "docx")).collect()] == ["T"] and D.variables(df, "id", "b").filter("source <> 'error'").count() == 0


def test_tables_and_report(spark):
    df = spark.createDataFrame([(1, "<table><tr><td rowspan=2>a<td>b<tr><td>c</table><p>d</p>")], "id long, html string")
    assert sorted((r["row"], r["col"], r["text"]) for r in table_cells(D.nodes(df, "id", "html")).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")]
    assert fidelity_report(df, "id", "html").first()[1:] == (True, True, True)


def test_files_and_stream(spark, tmp_path):
    packed = D.to_docx(spark.createDataFrame([(k, f"<h1>t{k}</h1>") for k in range(5)], "id long, html string"), "id", "html")
    assert D.write_files(packed, str(tmp_path / "out")) == 5
    files = D.read_docx_files(spark, str(tmp_path / "out"))
    assert files.count() == 5
    stream = stream_nodes(spark, str(tmp_path / "out")).writeStream.format("memory").queryName("nodes_stream").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM nodes_stream WHERE heading = 1").first()[0] == 5


def test_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.array("id"))
    assert sorted(r["id"] for r in cut(df, "t").collect()) == list(range(10))
