"""Borders of adjoining cells: each edge of a table's grid as one row, with the one border that it shows.

A cell's four sides are edges (axis, line, place): across the columns at a row's line, or down the rows at a column's. Cells that
meet at an edge compete: what is drawn beats what is not, then by weight, width, darkness, and place in reading order. Cells are
dealt by their table, before they become edges; grouping, joins and windows then stay where a table lies, in sorts that may spill.
A cell becomes about a dozen rows, so a partition has EACH bytes of the files that cells come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.css import BORDER, _choose
from folium.functions.text import border_css
from folium.session import grouped, partitions

SIDES = ("top", "left", "bottom", "right")
#: Number of a border style in the standard's list, and the lines that it draws; their product is its weight.
STYLES = {"single": (1, 1), "thick": (2, 1), "double": (3, 2), "dotted": (4, 1), "dashed": (5, 1)}


#: Bytes of files a partition.
EACH = 1 << 20


def _dealt(cells: DataFrame, keys: Sequence[str], tables: DataFrame | Column | None) -> tuple[DataFrame, DataFrame | Column | None, list[str]]:
    """cells dealt by their table, tables likewise, and the columns that name a table.

    Those are the keys, unless rows are to be joined: then _key, a struct of them, that is equal to another where nulls are too. Sorts by the
    keys themselves are the faster ones, and where the caller dealt cells by them, with `grouped` and EACH, no shuffle is due.
    """
    if not isinstance(tables, DataFrame):
        return grouped(cells, *keys, each=EACH), tables, list(keys)
    wrapped = lambda rows: rows.withColumn("_key", F.struct(*keys)).drop(*keys)
    return grouped(wrapped(cells), "_key", each=EACH), wrapped(tables).repartition(partitions(cells, EACH), "_key"), ["_key"]


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select("*", *[F.col("_key")[k].alias(k) for k in keys]).drop("_key") if "_key" in rows.columns else rows


def sides_of(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, side, axis, line, place, border): every edge of every cell; spans below 1 count as 1."""
    tall, wide = F.greatest(F.lit(1), F.coalesce("row_span", F.lit(1))), F.greatest(F.lit(1), F.coalesce("col_span", F.lit(1)))
    at = {"top": ("h", F.col("row"), "col", wide), "bottom": ("h", F.col("row") + tall, "col", wide), "left": ("v", F.col("col"), "row", tall), "right": ("v", F.col("col") + wide, "row", tall)}
    four = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(at[s][0]).alias("axis"), at[s][1].cast("int").alias("line"), F.col(at[s][2]).cast("int").alias("first"), at[s][3].cast("int").alias("n"), F.col(s).cast(BORDER).alias("border")) for s in SIDES])
    return cells.select(*keys, "row", "col", F.inline(four)).select(*keys, "row", "col", "side", "axis", "line", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place"), "border")


def _darkness(color: Column) -> list[Column]:
    r, g, b = (F.conv(F.substring(color, k, 2), 16, 10).cast("int") for k in (1, 3, 5))
    return [-(r + b + 2 * g), -(b + 2 * g), -g]


def edges(cells: DataFrame, keys: Sequence[str], tables: DataFrame | Column | None = None) -> DataFrame:
    """(keys, axis, line, place, border, inner): one row per edge of the grid.

    cells has keys, row, col, row_span, col_span and top, left, bottom, right: struct(style, size, color) or null. Of two
    cells' borders one that is drawn beats one of style "none", that beats null; then the greater weight wins, the
    greater size, the darker colour (red + blue + 2 green, blue + 2 green, green), the upper cell, the left one. Where all are
    null the table's border shows: tables has keys, one row each, and top, left, bottom, right, inside_h and inside_v, or is a struct of these six
    computed from the keys alone, which needs no join. inner: cells lie on both sides. Unknown styles weigh as single; null sizes as 0.
    """
    found = _edges(*_dealt(cells, keys, tables))
    return _keyed(found, keys).select(*keys, "axis", "line", "place", "border", "inner")


def _edges(cells: DataFrame, tables: DataFrame | Column | None, by: list[str], members: bool = False) -> DataFrame:
    """Edges by the columns `by`; members: with the sides that meet at each, mostly two."""
    kept = ["_members"] if members else []
    b = F.col("border")
    drawn = F.when(b.isNull(), 0).when(b["style"] == "none", 1).otherwise(2)
    weight = F.coalesce(_choose(b["style"], {k: n * lines for k, (n, lines) in STYLES.items()}).cast("int"), F.lit(1))
    rank = F.struct(drawn, weight, F.coalesce(b["size"], F.lit(0)), *[F.coalesce(x, F.lit(-2000)) for x in _darkness(b["color"])], -F.col("row"), -F.col("col"))
    has = lambda *names: F.max(F.col("side").isin(*names))
    found = sides_of(cells, by).groupBy(*by, "axis", "line", "place").agg(F.max_by("border", rank).alias("border"), has("top", "left").alias("_behind"), has("bottom", "right").alias("_before"), *[F.collect_list(F.struct("row", "col", "side")).alias(c) for c in kept])
    found = found.withColumn("inner", F.col("_behind") & F.col("_before"))
    if tables is None:
        return found.drop("_behind", "_before")
    if isinstance(tables, DataFrame):
        own = tables.select(*by, F.struct(*[F.col(c).cast(BORDER).alias(c) for c in (*SIDES, "inside_h", "inside_v")]).alias("_table"))
        joined, t = found.join(own, by, "left"), F.col("_table")
    else:
        joined, t = found, tables
    across = F.col("axis") == "h"
    of_table = F.when(F.col("inner"), F.when(across, t["inside_h"]).otherwise(t["inside_v"])).when(F.col("_behind"), F.when(across, t["top"]).otherwise(t["left"])).otherwise(F.when(across, t["bottom"]).otherwise(t["right"]))
    return joined.select(*by, "axis", "line", "place", F.coalesce("border", of_table.cast(BORDER)).alias("border"), "inner", *kept)


def edge_runs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, axis, line, first, last, border): neighbouring edges of one line with equal borders as one stroke; edges without a drawn border are left out."""
    return _runs(grouped(edges, *keys, each=EACH), list(keys)).select(*keys, "axis", "line", "first", "last", "border")


def _runs(edges: DataFrame, by: list[str]) -> DataFrame:
    shown = edges.filter(F.col("border").isNotNull() & ~F.col("border.style").eqNullSafe(F.lit("none")))
    line = Window.partitionBy(*by, "axis", "line").orderBy("place")
    new = ~(F.lag("place").over(line).eqNullSafe(F.col("place") - 1) & F.lag("border").over(line).eqNullSafe(F.col("border")))
    # all in the one order that edges have already: a run ends before the next one's first edge, the last run with the line
    ends = {"_new": new, "_before": F.lag("place").over(line), "_end": F.max("place").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    firsts = shown.withColumns(ends).filter("_new")
    return firsts.select(*by, "axis", "line", F.col("place").alias("first"), F.coalesce(F.lead("_before").over(line), "_end").alias("last"), "border")


def strokes(cells: DataFrame, keys: Sequence[str], tables: DataFrame | Column | None = None) -> DataFrame:
    """edge_runs of edges, with cells dealt once."""
    cells, tables, by = _dealt(cells, keys, tables)
    return _keyed(_runs(_edges(cells, tables, by), by), keys).select(*keys, "axis", "line", "first", "last", "border")


def drawn_borders(cells: DataFrame, keys: Sequence[str], tables: DataFrame | Column | None = None) -> DataFrame:
    """cell_borders of the cells' own edges, with cells dealt once."""
    cells, tables, by = _dealt(cells, keys, tables)
    found = _edges(cells, tables, by, members=True)
    joined = found.select(*by, "axis", "place", F.inline("_members"), F.col("border").alias("_border"), F.col("inner").alias("_inner"))
    return _keyed(_drawn(joined, by), keys).select(*keys, "row", "col", "css", "mixed")


def cell_borders(cells: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, css, mixed): the borders that a cell draws, so that each edge is drawn once.

    Bottom and right sides are drawn by their cell; a top or left side only where no cell lies before it. Along a side whose edges differ
    the first drawn one in order of its places stands for all, and mixed is true. css is empty if a cell draws nothing. Cells are told apart by keys, row and col.
    """
    cells, edges, by = _dealt(cells, keys, edges)
    found = edges.select(*by, "axis", "line", "place", F.col("border").alias("_border"), F.col("inner").alias("_inner"))
    joined = sides_of(cells, by).join(found, [*by, "axis", "line", "place"], "left")
    return _keyed(_drawn(joined, by), keys).select(*keys, "row", "col", "css", "mixed")


def _drawn(joined: DataFrame, by: list[str]) -> DataFrame:
    shows = F.col("_border").isNotNull() & ~F.col("_border.style").eqNullSafe(F.lit("none")) & (F.col("side").isin("bottom", "right") | ~F.col("_inner"))
    drawn = joined.select(*by, "row", "col", "side", "place", F.when(shows, border_css(F.col("_border"))).alias("drawn"))
    of = lambda s, value: F.when(F.col("side") == s, value)
    shown = F.coalesce("drawn", F.lit(""))
    sides = [F.min_by(of(s, F.col("drawn")), of(s, F.when(F.col("drawn").isNotNull(), F.col("place")))).alias(f"_{s}") for s in SIDES]
    mixed = [F.coalesce(F.min(of(s, shown)) != F.max(of(s, shown)), F.lit(False)) for s in SIDES]
    per_cell = drawn.groupBy(*by, "row", "col").agg(*sides, F.greatest(*mixed).alias("mixed"))
    return per_cell.select(*by, "row", "col", F.concat_ws(";", *[F.concat(F.lit(f"border-{s}:"), f"_{s}") for s in SIDES]).alias("css"), "mixed")
