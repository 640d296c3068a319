"""Style cascades, numbering definitions, relationships and variables as relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import PATTERNS, variables
from folium.session import cut


def cascade(*layers: Column) -> Column:
    """The first layer that sets a property wins; layers go from the most specific to the most general."""
    return F.coalesce(*layers)


def style_chains(styles: DataFrame, keys: Sequence[str], id: str, based_on: str, properties: Sequence[str]) -> DataFrame:
    """Effective properties of every style: its own, else those of the style it is based on, and so on.

    Pointers are doubled until none is left, so chains of any length n take log2(n) joins; each step is written
    out, so that the next one does not repeat it. A chain that reaches itself stops there, as does one to a
    missing style.
    """
    now = cut(styles.select(*keys, F.col(id), F.col(based_on).alias("_up"), F.array(F.col(id)).alias("_line"), *properties), "chains")
    while now.filter(F.col("_up").isNotNull()).limit(1).count():
        above = now.select(*keys, F.col(id).alias("_id"), F.col("_up").alias("_next"), F.col("_line").alias("_above"), *[F.col(p).alias(f"_{p}") for p in properties])
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._up") == F.col("r._id")]
        joined = now.alias("l").join(above.alias("r"), on, "left")
        loops = F.arrays_overlap("l._line", "r._above")
        fresh = F.col("r._id").isNotNull() & ~F.coalesce(loops, F.lit(False))
        # where the line above closes a loop, only its styles before the loop count, one step at a time
        one = F.col("r._id").isNotNull() & ~F.array_contains("l._line", F.col("r._id"))
        now = cut(joined.select(
            *[F.col(f"l.{k}") for k in keys], F.col(f"l.{id}"), F.when(fresh, F.col("r._next")).when(one, F.lit(None)).otherwise(F.lit(None)).alias("_up"),
            F.when(fresh, F.concat("l._line", "r._above")).otherwise(F.col("l._line")).alias("_line"),
            *[F.coalesce(F.col(f"l.{p}"), F.when(fresh | one, F.col(f"r._{p}"))).alias(p) for p in properties],
        ), "chains")
    return now.drop("_up", "_line")


def numbering_levels(nums: DataFrame, abstract: DataFrame, overrides: DataFrame) -> DataFrame:
    """(doc_id, num_id, ilvl, fmt, start_at, level_text, counter_key) of every instance.

    nums(doc_id, num_id, abstract_id); abstract(doc_id, abstract_id, ilvl, fmt, start_at, level_text);
    overrides(doc_id, num_id, ilvl, start_override, fmt, start_at, level_text): a full level replaces, a start
    overrides. Instances of a definition count together unless they override anything.
    """
    base = nums.join(abstract, ["doc_id", "abstract_id"])
    o = overrides.select("doc_id", "num_id", "ilvl", F.col("start_override").alias("_start"), F.col("fmt").alias("_fmt"), F.col("start_at").alias("_at"), F.col("level_text").alias("_text"))
    touched = overrides.select("doc_id", "num_id").distinct().withColumn("_own", F.lit(True))
    joined = base.join(o, ["doc_id", "num_id", "ilvl"], "left").join(touched, ["doc_id", "num_id"], "left")
    whole = F.col("_fmt").isNotNull()
    return joined.select(
        "doc_id", "num_id", "ilvl", F.coalesce("_fmt", "fmt").alias("fmt"), F.when(whole, F.coalesce("_at", F.lit(1))).otherwise(F.coalesce("_start", "start_at")).alias("start_at"),
        F.nullif(F.when(whole, F.col("_text")).otherwise(F.col("level_text")), F.lit("")).alias("level_text"),
        F.when(F.col("_own"), F.concat(F.lit("n"), "num_id")).otherwise(F.concat(F.lit("a"), "abstract_id")).alias("counter_key"),
    )


def level_lookup(items: DataFrame, levels: DataFrame) -> DataFrame:
    """items(doc_id, num_id, ilvl, ...) with format and start: of their level, else of level 0, else bullet and 1."""
    own = levels.select("doc_id", "num_id", "ilvl", F.col("fmt").alias("_f"), F.col("start_at").alias("_s"))
    zero = levels.filter("ilvl = 0").select("doc_id", "num_id", F.col("fmt").alias("_f0"), F.col("start_at").alias("_s0"))
    joined = items.join(own, ["doc_id", "num_id", "ilvl"], "left").join(zero, ["doc_id", "num_id"], "left")
    out = joined.withColumn("format", F.coalesce("_f", "_f0", F.lit("bullet"))).withColumn("start_at", F.coalesce("_s", "_s0", F.lit(1)))
    return out.withColumn("ordered", F.col("format") != "bullet").drop("_f", "_s", "_f0", "_s0")


def numbering_instances(lists: DataFrame, doc: str, order: str, fmt: str, start: str) -> DataFrame:
    """num_id of each list: bullets share 1, plain decimals 2, any other (format, start) one from 3 on, by first use."""
    plain = (F.col(fmt) == "bullet") | ((F.col(fmt) == "decimal") & (F.col(start) == 1))
    first = lists.filter(~plain).groupBy(doc, fmt, start).agg(F.min(order).alias("_first"))
    first = first.withColumn("_num", F.dense_rank().over(Window.partitionBy(doc).orderBy("_first")) + 2)
    joined = lists.join(first, [doc, fmt, start], "left")
    return joined.withColumn("num_id", F.when(F.col(fmt) == "bullet", 1).when(plain, 2).otherwise(F.col("_num")).cast("int")).drop("_first", "_num")


def relationship_ids(nodes: DataFrame, part_keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rId1, rId2, ... along each part."""
    n = F.row_number().over(Window.partitionBy(*part_keys).orderBy(*order))
    return nodes.withColumn("rid", F.concat(F.lit("rId"), n.cast("string")))


def resolve_relationships(refs: DataFrame, rels: DataFrame, keys: Sequence[str], rid: str, ord: str, target: str) -> DataFrame:
    """refs with the target of the first relationship that has their id; null where there is none."""
    first = rels.groupBy(*keys, rid).agg(F.min_by(target, ord).alias(target))
    return refs.join(first, [*keys, rid], "left")


def text_variables(paragraphs: DataFrame, doc: str, order: Sequence[str], text: str, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """(doc, name, placeholder, ord): variables in text, the first of each name in a document."""
    placed = paragraphs.select(doc, *order, F.posexplode(variables(F.col(text), patterns)).alias("_k", "v"))
    first = placed.groupBy(doc, F.col("v.name").alias("name")).agg(F.min(F.struct(*order, "_k", "v.placeholder")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(*[f"f.{o}" for o in order], "f._k"))
    return first.select(doc, "name", F.col("f.placeholder").alias("placeholder"), rank.alias("ord"))


def missing_lines(lines: DataFrame, rendered: DataFrame, key: str, line: str, html: str) -> DataFrame:
    """Lines whose text, without white space, is not in their document's rendered text."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    joined = lines.join(rendered.select(key, bare(F.col(html)).alias("_whole")), key)
    return joined.filter(~F.col("_whole").contains(bare(F.col(line)))).drop("_whole")
