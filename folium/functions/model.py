"""Page geometry, style updates and predicates of the data model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.kernels.nodes import PAPERS


def papers(spark: SparkSession) -> DataFrame:
    """The named papers: name, width, height, in the order in which they are tried."""
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("paper"), F.lit(w).alias("width"), F.lit(h).alias("height")) for k, (n, (w, h)) in enumerate(PAPERS.items())])
    return spark.range(1).select(F.inline(rows))


def page_width(paper_width: Column, paper_height: Column, orientation: Column, own_width: Column, own_height: Column) -> Column:
    own = (F.coalesce(own_width, F.lit(0)) > 0) & (F.coalesce(own_height, F.lit(0)) > 0)
    return F.when(own, own_width).when(orientation == "landscape", paper_height).otherwise(paper_width)


def page_height(paper_width: Column, paper_height: Column, orientation: Column, own_width: Column, own_height: Column) -> Column:
    own = (F.coalesce(own_width, F.lit(0)) > 0) & (F.coalesce(own_height, F.lit(0)) > 0)
    return F.when(own, own_height).when(orientation == "landscape", paper_width).otherwise(paper_height)


def updated(style: Column, changes: dict[str, Column]) -> Column:
    """A style struct with new values; a null change keeps the old value."""
    out = style
    for name, value in changes.items():
        out = out.withField(name, F.coalesce(value, style[name]))
    return out


def is_external(mode: Column) -> Column:
    return F.coalesce(F.lower(mode) == "external", F.lit(False))


def is_internal_link(anchor: Column) -> Column:
    return anchor.isNotNull()


def px_to_emu(px: Column) -> Column:
    return px.cast("long") * 9525


def core_is_empty(*values: Column) -> Column:
    return F.concat_ws("", *values) == ""


def axis(origin: Column, known: tuple[str, ...], default: str) -> Column:
    """A picture's anchor: a known origin, else "margin" for the page margins, else the default."""
    return F.when(origin.isin(*known), origin).when(origin.endswith("Margin"), "margin").otherwise(default)
