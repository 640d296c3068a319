"""Document structure as relational operators: sections, lists, table merges, grids.

Every window is partitioned by the document (or its table) first, so that work stays document-local and one
shuffle by the document id serves them all. A document fits in a task by construction; no window spans documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.model import papers


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def split_sections(df: DataFrame, keys: Sequence[str], order: Sequence[str], ends: Column, name: str = "sec") -> DataFrame:
    """A running number that grows after each row where `ends` holds (a section's last paragraph)."""
    before = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("int"))


def split_at_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_break: Column, name: str = "part") -> DataFrame:
    """Content between page breaks as numbered parts; the break rows themselves are left out."""
    running = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(is_break.cast("int")).over(running).cast("int")).filter(~is_break)


def list_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], num: str, name: str = "run_no") -> DataFrame:
    """Gaps and islands: consecutive rows with equal `num` form one list; null ends a list and has no number."""
    w = _ordered(keys, order)
    starts = F.col(num).isNotNull() & (~F.col(num).eqNullSafe(F.lag(num).over(w)))
    counted = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col(num).isNotNull(), counted).cast("int"))


def list_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, start: Column, name: str = "number") -> DataFrame:
    """The counter of each list item. A level counts on until a higher one (a smaller number) comes between.

    An item's epoch is the last earlier place of a smaller level; within an epoch and level items are
    numbered from the start that the epoch's first item has.
    """
    place = df.withColumn("_at", F.row_number().over(_ordered(keys, order)))
    running = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.max(F.when(F.col(level) == k, F.col("_at"))).over(running) for k in range(9)]  # levels are 0 to 8
    epoch = F.lit(0)
    for k in range(1, 9):
        epoch = F.when(F.col(level) == k, F.greatest(F.lit(0), *[F.coalesce(s, F.lit(0)) for s in seen[:k]])).otherwise(epoch)
    place = place.withColumn("_epoch", epoch).withColumn("_start", start)
    own = Window.partitionBy(*keys, level, "_epoch").orderBy("_at")
    return place.withColumn(name, (F.first("_start").over(own) + F.row_number().over(own) - 1).cast("int")).drop("_at", "_epoch", "_start")


def list_parents(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, id: str, name: str = "parent_id") -> DataFrame:
    """The nearest earlier item of a smaller level; null where there is none (a parent without a marker is due)."""
    place = df.withColumn("_at", F.row_number().over(_ordered(keys, order)))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.struct("_at", F.col(id).alias("id")))).over(before) for k in range(8)]
    parent = F.lit(None).cast(df.schema[id].dataType)
    for k in range(1, 9):
        parent = F.when(F.col(level) == k, F.greatest(*last[:k], F.lit(None).cast(f"struct<_at:int,id:{df.schema[id].dataType.simpleString()}>"))["id"]).otherwise(parent)
    return place.withColumn(name, parent).drop("_at")


def start_columns(cells: DataFrame, row_keys: Sequence[str], ord: str, span: str, name: str = "col") -> DataFrame:
    """The grid column at which each cell of a row starts."""
    before = _ordered(row_keys, [ord]).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.coalesce(F.sum(F.greatest(F.lit(1), F.col(span))).over(before), F.lit(0)).cast("int"))


def row_spans(cells: DataFrame, table_keys: Sequence[str], row: str, ord: str, span: str, merge: str, name: str = "row_span") -> DataFrame:
    """Heights of vertical merges: merge is "restart", "continue" or null.

    Each continuing cell adds one to the latest restart at its column; without one it counts for nothing.
    """
    placed = start_columns(cells, [*table_keys, row], ord, span)
    down = Window.partitionBy(*table_keys, "col").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    island = placed.withColumn("_group", F.sum((F.col(merge) == "restart").cast("int")).over(down))
    own = Window.partitionBy(*table_keys, "col", "_group")
    tall = F.lit(1) + F.sum(F.coalesce(F.col(merge) == "continue", F.lit(False)).cast("int")).over(own)
    return island.withColumn(name, F.when(F.col(merge) == "restart", tall).otherwise(1).cast("int")).drop("_group")


def spanned_places(cells: DataFrame, row: str, row_span: str, name: str = "at_row") -> DataFrame:
    """One row for every grid row that a cell covers; `is_continue` marks those below its own."""
    below = F.sequence(F.col(row), F.col(row) + F.greatest(F.lit(1), F.col(row_span)) - 1)
    return cells.withColumn(name, F.explode(below)).withColumn("is_continue", F.col(name) > F.col(row))


def share_columns(cols: DataFrame, table_keys: Sequence[str], width: str, name: str = "width_twips") -> DataFrame:
    """Columns without a width share what 9000 twips leave, 720 at least; null if no column has one."""
    w = Window.partitionBy(*table_keys)
    known, missing = F.count(width).over(w), F.count_if(F.col(width).isNull()).over(w)
    share = F.greatest(F.lit(720), F.floor(F.greatest(F.lit(0), F.lit(9000) - F.sum(width).over(w)) / missing))
    return cols.withColumn(name, F.when(known == 0, None).otherwise(F.coalesce(F.col(width), share)).cast("int"))


def share_first_row(cells: DataFrame, table_keys: Sequence[str], width: str, pct: str, name: str = "balanced_pct") -> DataFrame:
    """First-row cells without a width share the percentage (in fiftieths) that the others leave."""
    w = Window.partitionBy(*table_keys)
    bare = F.col(width).isNull() & F.col(pct).isNull()
    each = F.floor(F.greatest(F.lit(0), F.lit(5000) - F.coalesce(F.sum(pct).over(w), F.lit(0))) / F.nullif(F.count_if(bare).over(w), F.lit(0)))
    return cells.withColumn(name, F.when(bare & (each > 0), each).otherwise(F.col(pct)).cast("int"))


def grid_columns(cells: DataFrame, table_keys: Sequence[str], row: str, ord: str, span: str, width: str) -> DataFrame:
    """One row per table and column: the first unspanned cell's width, else a spanned one's share, else 2000.

    The number of columns is that of the first row.
    """
    placed = start_columns(cells, [*table_keys, row], ord, span)
    each = placed.withColumn("column", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest(F.lit(1), F.col(span)) - 1)))
    single = F.col(span) <= 1
    first_row = F.min(row).over(Window.partitionBy(*table_keys))
    each = each.withColumn("_count", F.max(F.when(F.col(row) == first_row, F.col("column"))).over(Window.partitionBy(*table_keys)))
    found = each.filter(F.col("column") <= F.col("_count")).groupBy(*table_keys, "column").agg(
        F.min_by(F.col(width), F.when(single & F.col(width).isNotNull(), F.struct(row, ord))).alias("exact"),
        F.min_by(F.floor(F.col(width) / F.col(span)), F.when(~single & F.col(width).isNotNull(), F.struct(row, ord))).alias("shared"),
    )
    return found.select(*table_keys, "column", F.coalesce("exact", "shared", F.lit(2000)).cast("int").alias("width_twips"))


def detect_paper(pages: DataFrame, width: str, height: str, key: Sequence[str]) -> DataFrame:
    """pages with `paper`: the first named paper whose sides are within 50 twips, else null. Five rows are broadcast."""
    known = F.broadcast(papers(pages.sparkSession).select("ord", "paper", F.greatest("width", "height").alias("_long"), F.least("width", "height").alias("_short")))
    near = (F.abs(F.greatest(width, height) - F.col("_long")) < 50) & (F.abs(F.least(width, height) - F.col("_short")) < 50)
    matched = pages.join(known, near, "left")
    return matched.groupBy(*pages.columns).agg(F.min_by("paper", "ord").alias("paper"))


def effective_parts(sections: DataFrame, doc: str, kind: str, sec: str, part: str, name: str = "effective") -> DataFrame:
    """A section without a header or footer of a type shows the previous section's."""
    running = Window.partitionBy(doc, kind).orderBy(sec).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn(name, F.last(part, ignorenulls=True).over(running))
