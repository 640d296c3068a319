"""Lines of two versions of a document: which stay in place, moved, were lost or added.

The n-th occurrence of a line in one version meets its n-th in the other, by a join. Of the lines that met, the longest
run in rising order on both sides stays in place and the others moved. Documents whose lines all rise are told by a window;
only the others' positions (never their lines) pass through a search for the longest run, as a sorted stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalize_text
from folium.session import cut
from folium.sources import documents as D


def longest_run(places: Sequence[int]) -> list[bool]:
    """Which places belong to a longest rising run; of several runs, the one that ends, and passes each step, lowest."""
    tops: list[int] = []
    tails: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        at = bisect_left(tops, place)
        before[i] = tails[at - 1] if at else -1
        tops[at : at + 1], tails[at : at + 1] = [place], [i]
    kept, i = [False] * len(places), tails[-1] if tails else -1
    while i >= 0:
        kept[i], i = True, before[i]
    return kept


def aligned(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line, old_pos, new_pos, fate): fate is kept, moved, lost or added.

    old and new have keys (together a document), pos (a number, once in a document) and line. Null lines and rows with a
    null pos take no part; null keys are a document. Two empty versions give no rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    key = F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names)])

    def counted(rows: DataFrame, pos: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys, "line").orderBy("pos"))
        return rows.filter("line IS NOT NULL AND pos IS NOT NULL").select(key.alias("doc"), "line", F.col("pos").cast("long").alias(pos), nth.alias("nth"))

    # a struct of keys is equal to another where nulls are, and a line that is everywhere meets itself once a document
    a, b = counted(old, "old_pos").alias("a"), counted(new, "new_pos").alias("b")
    met = a.join(b, F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.nth") == F.col("b.nth")), "full")
    rows = met.select(F.coalesce("a.doc", "b.doc").alias("doc"), F.coalesce("a.line", "b.line").alias("line"), "old_pos", "new_pos")
    both = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()
    step = F.when(both, F.col("new_pos") < F.max(F.when(both, F.col("new_pos"))).over(Window.partitionBy("doc").orderBy(F.asc_nulls_last("old_pos")).rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.withColumn("_fall", F.coalesce(step, F.lit(False)))
    marked = marked.withColumn("_any", F.max("_fall").over(Window.partitionBy("doc")))
    plain = F.when(F.col("new_pos").isNull(), "lost").when(F.col("old_pos").isNull(), "added").otherwise("kept")
    easy = marked.filter(~F.col("_any") | ~both).select("doc", "line", "old_pos", "new_pos", plain.alias("fate"))
    hard = marked.filter(F.col("_any") & both).select("doc", "line", "old_pos", "new_pos")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []

        def told() -> pa.RecordBatch:
            kept = longest_run([b for _, _, b in held])
            out = [pa.array([d for d, _, _ in held], pa.string()), pa.array([x for _, x, _ in held], pa.int64()), pa.array(kept, pa.bool_())]
            return pa.RecordBatch.from_arrays(out, names=["_doc", "_old", "_kept"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    yield told()
                    held = []
                held.append(row)
        if held:
            yield told()

    name = F.to_json("doc")
    told = hard.select(name.alias("_doc"), "old_pos", "new_pos").repartition("_doc").sortWithinPartitions("_doc", "old_pos").mapInArrow(runs, "_doc string, _old long, _kept boolean")
    solved = hard.join(told, (name == F.col("_doc")) & (F.col("old_pos") == F.col("_old"))).select("doc", "line", "old_pos", "new_pos", F.when(F.col("_kept"), "kept").otherwise("moved").alias("fate"))
    return easy.unionByName(solved).select(*[F.col(f"doc.{n}").alias(k) for k, n in zip(keys, names)], "line", "old_pos", "new_pos", "fate")


#: What text_lines needs of a node table.
LINE_NODES = {"kinds": ("p", "item"), "columns": ("doc_id", "part", "node_id", "kind", "text")}


def text_lines(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, line): what a reader sees as lines of a node table: paragraphs and items with text, white space collapsed."""
    line = F.trim(normalize_text(F.col("text")))
    return nodes.filter("kind IN ('p', 'item') AND part = 'body'").select("doc_id", F.col("node_id").alias("pos"), line.alias("line")).filter("line <> ''")


def fidelity_lines(df: DataFrame, id: str, html: str) -> DataFrame:
    """(doc_id, stage, line, old_pos, new_pos, fate): every line of HTML documents through three stages.

    package: written as a package and read; back: that package as HTML, read; again: a second round of both, the package's HTML read
    once more. Each stage is aligned with the one before it.
    """
    packed = cut(D.to_docx(df, id, html).select("doc_id", "content"), "packed")
    page = cut(D.to_html(packed, "doc_id", "content").select("doc_id", "body"), "page")
    second = D.to_docx(page, "doc_id", "body", then=D.html_reader()).select("doc_id", "body")
    steps = [("package", D.nodes(packed, "doc_id", "content", "docx", **LINE_NODES)), ("back", D.nodes(page, "doc_id", "body", **LINE_NODES)), ("again", D.nodes(second, "doc_id", "body", **LINE_NODES))]
    before, out = cut(text_lines(D.nodes(df, id, html, **LINE_NODES)), "lines"), None
    for stage, nodes in steps:
        now = cut(text_lines(nodes), "lines")  # each is compared with the stage before and the one behind
        found = aligned(before, now, ["doc_id"]).select("doc_id", F.lit(stage).alias("stage"), "line", "old_pos", "new_pos", "fate")
        out, before = found if out is None else out.unionByName(found), now
    return out
