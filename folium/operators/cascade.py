"""The style cascade of runs as property rows: layers ranked, the last wins, toggles and theme references resolved on the way.

Document defaults, the default paragraph and character styles, the paragraph's style, the run's style and its own properties are
layers of one table (document, pair of styles, rank, name, value); a run joins its pair, so only its own properties are dealt by run. A style's properties are those of its line of ancestors, nearest first;
lines are found by doubling pointers, so a chain of n styles takes log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import toggle
from folium.session import cut, grouped

#: Properties that are on without a value, and off for false, 0 and off.
TOGGLES = ("bold", "italic", "strike", "all_caps", "small_caps", "keep_next", "keep_lines", "break_before")
DEFAULTS, PARAGRAPH_DEFAULT, CHARACTER_DEFAULT, PARAGRAPH, RUN, DIRECT = range(6)


def lineage(styles: DataFrame, keys: Sequence[str], id: str, based_on: str) -> DataFrame:
    """(keys, id, ancestor, distance): every style with itself (distance 0) and all it is based on.

    A line that comes back to one of its styles ends before it; a style that is not there ends it too. Of styles with one id any
    one line is followed, so make ids unique first.
    """
    now = cut(styles.select(*keys, F.col(id), F.col(based_on).alias("_up"), F.array(id).alias("_line")), "lineage")
    while now.filter(F.col("_up").isNotNull()).limit(1).count():
        above = now.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(id).alias("_id"), F.col("_up").alias("_next"), F.col("_line").alias("_more"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_up") == F.col("_id")]
        joined = now.join(above, on, "left")
        # of what lies above, only what comes before the first style that the line has already
        seen = F.array_position(F.transform("_more", lambda s: F.array_contains("_line", s)), F.lit(True))
        fresh = F.when(F.col("_more").isNull(), F.array().cast(now.schema["_line"].dataType)).when(seen > 0, F.slice("_more", F.lit(1), seen - 1)).otherwise(F.col("_more"))
        now = cut(joined.select(*keys, id, F.when(seen == 0, F.col("_next")).alias("_up"), F.concat("_line", fresh).alias("_line")), "lineage")
    return now.select(*keys, id, F.posexplode("_line").alias("distance", "ancestor"))


def _known(value: Column, name: Column, theme: Column) -> Column:
    """A value as it counts: the theme's where it has one, toggles as true or false."""
    found = F.coalesce(theme, value)
    return F.when(name.isin(*TOGGLES), toggle(found).cast("string")).otherwise(found)


def resolved(properties: DataFrame, theme: DataFrame, keys: Sequence[str]) -> DataFrame:
    """properties with theme references replaced; rows that then say nothing are left out, so lower layers show."""
    colors = theme.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lower("theme").alias("_theme"), F.col("value").alias("_value"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.lower("theme") == F.col("_theme")]
    joined = properties.join(colors, on, "left").withColumn("value", _known(F.col("value"), F.col("name"), F.col("_value")))
    return joined.filter(F.col("value").isNotNull()).drop(*[f"_{k}" for k in keys], "_theme", "_value", "theme")


def cascade_runs(runs: DataFrame, styles: DataFrame, properties: DataFrame, theme: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, run_id, name, value): the effective properties of every run that has any.

    runs(keys, run_id, p_style, r_style); styles(keys, style_id, kind, based_on, is_default), kind paragraph or character;
    properties(keys, owner, owner_id, name, value, theme), owner defaults (owner_id null), style or run, theme the name of a
    theme entry or null; theme(keys, theme, value). A null toggle value is on. Styles that are not there set nothing; a later
    default beside another of its kind is the one of the larger id. A run's id is its own within the keys.
    """
    given = properties.withColumn("value", F.when(F.col("name").isin(*TOGGLES), F.coalesce("value", F.lit("true"))).otherwise(F.col("value")))
    known = cut(resolved(given.filter("owner IN ('defaults', 'style')"), theme, keys), "properties")
    own = known.filter("owner = 'style'").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("owner_id").alias("_owner"), "name", "value")
    line = lineage(styles.select(*keys, "style_id", "based_on").dropDuplicates([*keys, "style_id"]), keys, "style_id", "based_on")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    # each style's effective properties: the nearest ancestor that sets one
    full = cut(line.join(own, [*on, F.col("ancestor") == F.col("_owner")]).groupBy(*keys, "style_id", "name").agg(F.min_by("value", "distance").alias("value")), "styles")

    # what runs of equal styles have, told once for each pair of styles: runs are many, pairs few
    pair = ("p_style", "r_style")
    looks = cut(runs.select(*keys, *pair).distinct(), "looks")
    default = lambda kind: F.max(F.when((F.col("kind") == kind) & F.col("is_default"), F.col("style_id")))
    defaults = styles.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(default("paragraph").alias("_p"), default("character").alias("_c"))
    placed = looks.join(defaults, on, "left")
    layer = lambda rank, style: F.struct(F.lit(rank).alias("rank"), style.alias("style"))
    layers = F.array(layer(PARAGRAPH_DEFAULT, F.col("_p")), layer(CHARACTER_DEFAULT, F.col("_c")), layer(PARAGRAPH, F.col("p_style")), layer(RUN, F.col("r_style")))
    asked = placed.select(*keys, *pair, F.explode(F.filter(layers, lambda x: x["style"].isNotNull())).alias("x")).select(*keys, *pair, "x.rank", "x.style")
    named = full.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("style_id").alias("_style"), "name", "value")
    by_style = asked.join(named, [*on, F.col("style") == F.col("_style")]).select(*keys, *pair, "rank", "name", "value")
    base = known.filter("owner = 'defaults'").select(*[F.col(k).alias(f"_{k}") for k in keys], "name", "value")
    lowest = looks.join(base, on).select(*keys, *pair, F.lit(DEFAULTS).alias("rank"), "name", "value")
    told = lowest.unionByName(by_style).groupBy(*keys, *pair, "name").agg(F.max_by("value", "rank").alias("value"))
    each = [F.col(k).alias(f"_{k}") for k in (*keys, *pair)]
    told = cut(told.groupBy(*each).agg(F.collect_list(F.struct("name", "value")).alias("_told")), "told")

    # a run's own properties hide the others; of two with one name the larger value counts
    direct = resolved(given.filter("owner = 'run'"), theme, keys).select(*keys, F.col("owner_id").cast(runs.schema["run_id"].dataType).alias("run_id"), F.struct("name", "value").alias("x"))
    direct = grouped(direct, *keys, "run_id").groupBy(*keys, "run_id").agg(F.sort_array(F.collect_list("x")).alias("_all"))
    last = lambda x, k: F.coalesce(~x["name"].eqNullSafe(F.get("_all", k + 1)["name"]), F.lit(True)) | (k + 1 == F.size("_all"))
    direct = direct.select(*keys, "run_id", F.filter("_all", last).alias("_own"))
    dressed = runs.join(told, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, *pair)], "left").select(*keys, "run_id", F.coalesce("_told", F.array()).alias("_told"))
    hidden = lambda x: F.exists("_own", lambda o: o["name"].eqNullSafe(x["name"]))
    every = F.when(F.col("_own").isNull(), F.col("_told")).otherwise(F.concat("_own", F.filter("_told", lambda x: ~hidden(x))))
    return dressed.join(direct, [*keys, "run_id"], "left").select(*keys, "run_id", F.inline(every))
