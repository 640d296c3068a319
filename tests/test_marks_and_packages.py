"""Marks against a stack, aligned lines against all subsequences, packages written and aborted."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from folium.operators import alignment as A
from folium.operators import marks as M
from folium.sources import documents as D
from folium.sources.packages import read_packages, write_packages


def plain_fields(rows):
    open_, out = [], []
    for pos, mark, text in rows:
        if mark == "begin":
            open_.append([pos, None, None, len(open_), "", ""])
            out.append(open_[-1])
        elif mark == "end":
            if open_:
                open_.pop()[2] = pos
            else:
                out.append([None, None, pos, None, "", ""])
        elif open_ and mark == "separate" and open_[-1][1] is None:
            open_[-1][1] = pos
        elif open_ and text is not None:
            f = open_[-1]
            if mark == "instr" and f[1] is None:
                f[4] += text
            elif mark == "text" and f[1] is not None:
                f[5] += text
    return {(*f[:4], f[4].strip(" "), f[5], "stray" if f[0] is None else "unclosed" if f[2] is None else "closed") for f in out}


def test_fields_against_a_stack(spark):
    rng = random.Random(3)
    rows = [(k if k else None, pos, rng.choice(["begin", "end", "separate", "instr", "text", "other"]), rng.choice(["a", " b", None])) for k in range(40) for pos in range(rng.choice([0, 3, 12, 30]))]
    found = M.fields(spark.createDataFrame(rows, "k int, pos int, mark string, text string"), ["k"]).collect()
    for k in {r[0] for r in rows}:
        assert {tuple(r)[1:] for r in found if r["k"] == k} == plain_fields([r[1:] for r in rows if r[0] == k])
    assert M.fields(spark.createDataFrame([], "k int, pos int, mark string, text string"), ["k"]).collect() == []


def test_bookmarks(spark):
    marks = [(1, "begin", "a"), (2, "begin", "b"), (3, "end", "a"), (4, "end", "b"), (5, "begin", "c"), (6, "begin", "d"), (7, "end", "d"), (8, "end", "c"), (9, "end", "x"), (10, "begin", "e"), (11, "begin", "f"), (12, "end", "f")]
    df = spark.createDataFrame([(None, *m, m[2].upper()) for m in marks], "doc string, pos int, mark string, id string, name string")
    got = {(r["id"], r["start"], r["end"], r["status"]) for r in M.bookmarks(df, ["doc"]).collect()}
    assert got == {("a", 1, 3, "crossing"), ("b", 2, 4, "crossing"), ("c", 5, 8, "closed"), ("d", 6, 7, "closed"), ("x", None, 9, "stray"), ("e", 10, None, "unclosed"), ("f", 11, 12, "closed")}


def test_longest_run_against_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        places = rng.sample(range(20), rng.randint(0, 8))
        kept = A.longest_run(places)
        run = [p for p, k in zip(places, kept) if k]
        best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if list(c) == sorted(c)), default=0)
        assert run == sorted(run) and len(run) == best


def test_aligned_lines(spark):
    old = spark.createDataFrame([(None, i, line) for i, line in enumerate("a b a c d e f".split())] + [(1, 0, "x"), (2, 0, None)], "doc int, pos int, line string")
    new = spark.createDataFrame([(None, i, line) for i, line in enumerate("f a b a d e g e".split())] + [(3, 0, "y")], "doc int, pos int, line string")
    got = {tuple(r) for r in A.aligned(old, new, ["doc"]).collect()}
    assert got == {
        (None, "a", 0, 1, "kept"), (None, "b", 1, 2, "kept"), (None, "a", 2, 3, "kept"), (None, "c", 3, None, "lost"), (None, "d", 4, 4, "kept"), (None, "e", 5, 5, "kept"), (None, "f", 6, 0, "moved"),
        (None, "g", None, 6, "added"), (None, "e", None, 7, "added"), (1, "x", 0, None, "lost"), (3, "y", None, 0, "added"),
    }


def files(folder):
    """What readers see: a task that runs on behind an abort may still write below the staging folder."""
    return sorted(f for at, _, names in os.walk(folder) for f in names if f.endswith(".docx") and "/_staging" not in at)


def test_packages_are_committed_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    packed = D.to_docx(spark.createDataFrame([(k, f"<p>text {k}</p>") for k in range(40)], "id long, html string").repartition(6), "id", "html")
    write_packages(packed, f"file://{folder}")
    assert len(files(folder)) == 40 and not [f for f in os.listdir(folder) if f.startswith("_staging")] and os.path.exists(f"{folder}/_SUCCESS")
    back = {r["name"]: bytes(r["content"]) for r in read_packages(spark, folder).collect()}
    assert back == {str(r["doc_id"]): bytes(r["content"]) for r in packed.collect()}
    write_packages(packed.filter("doc_id < 10"), folder, overwrite=True)  # a rerun leaves no second file
    assert files(folder) == sorted(f"{k}.docx" for k in range(10))


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(0, 60, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 55, F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="killed"):
        write_packages(rows, folder)
    assert files(folder) == []
    write_packages(rows.filter("doc_id <> 55"), folder)
    assert len(files(folder)) == 59
    with pytest.raises(Exception, match="not a file name"):
        write_packages(spark.createDataFrame([("../x", b"y")], "doc_id string, content binary"), folder)
    assert len(files(folder)) == 59


def test_lineage_of_loops_and_gaps(spark):
    from folium.operators.cascade import lineage

    ups = {1: 2, 2: 3, 3: 1, 4: 3, 5: 99, 6: None, **{k: k - 1 for k in range(11, 40)}, 10: None}
    styles = spark.createDataFrame([(None, str(k), None if v is None else str(v)) for k, v in ups.items()], "doc int, id string, up string")
    got: dict = {}
    for r in lineage(styles, ["doc"], "id", "up").orderBy("distance").collect():
        got.setdefault(int(r["id"]), []).append(int(r["ancestor"]))
    for k in ups:
        line, at = [k], ups[k]
        while at in ups and at not in line:
            line.append(at)
            at = ups[at]
        assert got[k] == line, k


def test_cascade_layers(spark):
    from folium.operators.cascade import cascade_runs

    styles = spark.createDataFrame([(1, "N", "paragraph", None, True), (1, "C", "character", None, True), (1, "H", "paragraph", "N", False), (1, "R", "character", None, False)], "doc_id int, style_id string, kind string, based_on string, is_default boolean")
    rows = [("defaults", None, "size", "20", None), ("style", "N", "size", "22", None), ("style", "N", "bold", None, None), ("style", "H", "color", "000001", "Accent1"), ("style", "R", "bold", "0", None), ("style", "R", "color", None, "gone"), ("run", "r3", "bold", "off", None), ("run", "r3", "color", "00ff00", None), ("run", "none", "size", "9", None)]
    properties = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, owner string, owner_id string, name string, value string, theme string")
    theme = spark.createDataFrame([(1, "accent1", "abcdef")], "doc_id int, theme string, value string")
    runs = spark.createDataFrame([(1, "r1", None, None), (1, "r2", "H", "R"), (1, "r3", "H", "missing"), (2, "r4", None, None)], "doc_id int, run_id string, p_style string, r_style string")
    got = {(r["run_id"], r["name"]): r["value"] for r in cascade_runs(runs, styles, properties, theme).collect()}
    assert got == {
        ("r1", "size"): "22", ("r1", "bold"): "true", ("r2", "size"): "22", ("r2", "bold"): "false", ("r2", "color"): "abcdef", ("r3", "size"): "22", ("r3", "bold"): "false", ("r3", "color"): "00ff00",
    }
