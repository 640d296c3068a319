"""Begin and end marks as intervals: fields and bookmarks, over paragraphs and however deep, by depth counters in windows.

A running sum of steps (begin +1, end -1) held above zero by its running minimum is the depth; an end that meets depth zero
is stray and changes nothing. On one level begins and ends take turns, so a begin's end is the next mark of its level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def leveled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begins: Column, ends: Column) -> DataFrame:
    """rows with depth (open intervals behind the row), stray, and level: a mark's own, for others that of the innermost open interval, -1 outside."""
    line = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(begins, 1).when(ends, -1).otherwise(0)
    out = rows.withColumn("_sum", F.sum(step).over(line)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(line)))
    before = F.coalesce(F.lag("_low").over(line), F.lit(0))
    out = out.withColumn("stray", F.coalesce(ends, F.lit(False)) & (F.col("_low") < before)).withColumn("depth", (F.col("_sum") - F.col("_low")).cast("int"))
    own = F.when(F.col("stray"), F.lit(None)).when(begins, F.col("depth") - 1).when(ends, F.col("depth")).otherwise(F.col("depth") - 1)
    return out.withColumn("level", own.cast("int")).drop("_sum", "_low")


def fields(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, separate, end, level, instr, value, status): complex fields from their marks.

    marks has keys, pos, mark (begin, separate, end, instr, text) and text. A field's instruction is the instr rows before its
    first separator, its value the text rows behind it; rows of a field within belong to that one. Status: closed, or
    unclosed (no end, end is null); a stray end gives a row of status stray with its place as end. Rows of other marks and
    null texts count for nothing. Positions are taken to differ within a document.
    """
    begins, ends = F.col("mark") == "begin", F.col("mark") == "end"
    rows = leveled(marks.select(*keys, "pos", "mark", "text"), keys, ["pos"], begins, ends)
    inner = Window.partitionBy(*keys, "level").orderBy("pos")
    inside = rows.filter(F.col("level") >= 0)
    inside = inside.withColumn("start", F.last(F.when(begins, F.col("pos")), ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy(*keys, "start").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("cut", F.min(F.when(F.col("mark") == "separate", F.col("pos"))).over(own))

    def joined(what: Column) -> Column:
        texts = F.array_sort(F.collect_list(F.when(what, F.struct("pos", "text"))))
        return F.array_join(F.transform(texts, lambda x: x["text"]), "")

    found = inside.groupBy(*keys, "start", "level").agg(
        F.min("cut").alias("separate"), F.max(F.when(ends, F.col("pos"))).alias("end"),
        F.trim(joined((F.col("mark") == "instr") & F.col("cut").isNull())).alias("instr"), joined((F.col("mark") == "text") & F.col("cut").isNotNull()).alias("value"),
    )
    found = found.select(*keys, "start", "separate", "end", "level", "instr", "value", F.when(F.col("end").isNull(), "unclosed").otherwise("closed").alias("status"))
    stray = rows.filter("stray").select(*keys, F.lit(None).cast(marks.schema["pos"].dataType).alias("start"), F.lit(None).cast(marks.schema["pos"].dataType).alias("separate"), F.col("pos").alias("end"), F.lit(None).cast("int").alias("level"), F.lit("").alias("instr"), F.lit("").alias("value"), F.lit("stray").alias("status"))
    return found.unionByName(stray)


def bookmarks(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, name, start, end, status): bookmarks from their marks, which may close in any order.

    marks has keys, pos, mark (begin, end), id and name. A start meets the next mark of its id, if that is an end. Status: closed,
    crossing (closed, but another that was opened before it or later ends in between), unclosed (end is null) or stray
    (start is null). Positions are taken to differ within a document.
    """
    begins, ends = F.col("mark") == "begin", F.col("mark") == "end"
    line = Window.partitionBy(*keys, "id").orderBy("pos")
    rows = marks.filter(begins | ends).withColumns({"_next": F.lead(F.struct("mark", "pos")).over(line), "_last": F.lag("mark").over(line)})
    closed = begins & (F.col("_next.mark") == "end")
    pairs = rows.filter(begins).select(*keys, "id", "name", F.col("pos").alias("start"), F.when(F.col("_next.mark") == "end", F.col("_next.pos")).alias("end"))
    stray = rows.filter(ends & ~F.coalesce(F.col("_last") == "begin", F.lit(False))).select(*keys, "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast(marks.schema["pos"].dataType).alias("start"), F.col("pos").alias("end"), F.lit("stray").alias("status"))
    # of the pairs alone: as brackets, each end closes the last one open; where that is another, two bookmarks cross
    partner = rows.filter(F.coalesce(closed, F.lit(False)) | (ends & (F.col("_last") == "begin")))
    level = Window.partitionBy(*keys, "level").orderBy("pos")
    nested = leveled(partner, keys, ["pos"], begins, ends)
    other = F.when(begins, F.lead("id").over(level)).otherwise(F.lag("id").over(level))
    crossing = nested.withColumn("_other", other).filter(~F.col("_other").eqNullSafe(F.col("id"))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.when(begins, F.col("pos")).alias("_start"), F.when(ends, F.col("pos")).alias("_end"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    touched = pairs.join(crossing.select(*[f"_{k}" for k in keys], F.coalesce("_start", "_end").alias("_at")).distinct().withColumn("_hit", F.lit(True)), [*on, F.col("start") == F.col("_at")], "left").drop(*[f"_{k}" for k in keys], "_at")
    touched = touched.withColumnRenamed("_hit", "_opens").join(crossing.select(*[f"_{k}" for k in keys], F.coalesce("_start", "_end").alias("_at")).distinct().withColumn("_hit", F.lit(True)), [*on, F.col("end") == F.col("_at")], "left").drop(*[f"_{k}" for k in keys], "_at")
    status = F.when(F.col("end").isNull(), "unclosed").when(F.coalesce("_opens", "_hit").isNotNull(), "crossing").otherwise("closed")
    return touched.select(*keys, "id", "name", "start", "end", status.alias("status")).unionByName(stray)
