"""End-to-end plans: outlines, link graphs, tables, round trips and the fidelity report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.sources import documents as D


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, level, text) of headings in reading order."""
    return nodes.filter((F.col("kind") == "p") & F.col("heading").isNotNull()).select("doc_id", F.col("node_id").alias("ord"), F.col("heading").alias("level"), "text")


def links(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, href, anchor, text) of links."""
    return nodes.filter(F.col("kind") == "link").select("doc_id", F.col("node_id").alias("ord"), "href", "anchor", "text")


#: What table_cells needs of a node table.
TABLE_KINDS, TABLE_COLUMNS = ("row", "cell"), ("doc_id", "node_id", "parent_id", "ord", "kind", "text", "row_span", "grid_span", "is_continue")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, text) of table cells, continuing cells left out."""
    is_row = F.col("kind") == "row"
    kept = nodes.filter("kind = 'row' OR (kind = 'cell' AND NOT is_continue)")
    of = Window.partitionBy("doc_id", "_row")  # one row's cells; a join would parse every document twice
    placed = kept.withColumn("_row", F.when(is_row, F.col("node_id")).otherwise(F.col("parent_id")))
    placed = placed.withColumns({"table_id": F.max(F.when(is_row, F.col("parent_id"))).over(of), "row": F.max(F.when(is_row, F.col("ord"))).over(of)})
    return placed.filter(~is_row).select("doc_id", F.col("ord").alias("col"), "text", "row_span", "grid_span", "table_id", "row")


def fidelity_report(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Per document: does it convert, is all its text in the result, and does a second round give the same text? One map, no shuffle."""
    return D.fidelity(pages, id, html)
