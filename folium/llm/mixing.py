"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source; the weights share all words out, no source above CAP times its own; the excess is
shared again by weight until no target is above its cap. Each document is then emitted floor(rate) times plus
one further copy with probability equal to the rate's fraction, drawn from a hash of its id.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.text import count_words
from folium.session import cut

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 16


def ordered_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with its 0-based place by column (code-point order, null last), without a global single-task sort.

    Rows are dealt by range and sorted within partitions; only one count per partition reaches the driver.
    """
    placed = df.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), part + 1)
    return placed.withColumn(name, row + base).drop("_at")


def level(sources: DataFrame) -> float:
    """The words a unit of weight gets, once the excess of capped sources is shared by the others."""
    share, capped = None, (0, 0)
    while True:
        over = F.lit(False) if share is None else F.col("cap") < F.col("weight") * F.lit(share)
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("cap"), F.count_if(over).alias("n"), F.sum(F.when(~over, F.col("weight")).otherwise(0)).alias("w")
        ).first()
        if not row["all"] or not row["w"] or (share is not None and (row["cap"], row["n"]) == capped):
            return share or 0.0
        capped = (row["cap"], row["n"])
        share = float(row["all"] - row["cap"]) / float(row["w"])


def uniform(doc_id: Column, seed: int | Column) -> Column:
    """A number in [0, 1) that the seed and the id fix: the first 52 bits of an MD5."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _copies(seed: int | Column, rate: Column | None = None, doc_id: Column | None = None) -> Column:
    rate = F.col("rate") if rate is None else rate
    whole = F.floor(rate)
    return whole + F.when(uniform(F.col("doc_id") if doc_id is None else doc_id, seed) < rate - whole, 1).otherwise(0)


def rates(docs: DataFrame, weights: Sequence[int], cap: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of every document, and per source (_source, source_size, target, rate, seed)."""
    slim = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    sources = ordered_index(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("cap")), "sources")
    share = level(sources)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(share))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.select("source", "source_size", target.alias("target"), rate.alias("rate")).withColumnRenamed("source", "_source")
    rated = slim.join(sources, slim["source"].eqNullSafe(sources["_source"]))
    sums = rated.groupBy("_source", "source_size", "target", "rate").agg(F.array(*[F.sum(F.col("size") * _copies(k)) for k in range(seeds)]).alias("totals"))
    misses = F.transform("totals", lambda t, k: F.struct(F.abs(t - F.col("target")).alias("miss"), k.alias("seed")))
    return slim, cut(sums.select("_source", "source_size", "target", "rate", F.array_min(misses)["seed"].alias("seed")), "rates")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, seed, copies, taken.

    Sources stand in code-point order, null last, as a source of its own; the weights repeat along them. Null
    texts have size 0 and take nothing. Of `seeds` hash seeds each source uses the one whose total comes
    nearest its target (the smaller on ties), all of them counted in one pass, so that reruns agree and small
    sources miss their targets less. Rows that repeat an id draw the same number. An empty table gives an
    empty result; columns other than doc_id, text and source are not read.

    Only ids, sources and sizes move, pre-aggregated; a source with any share of the rows is never gathered.
    The source table is written first, so Spark broadcasts it when its size is small and else splits hot keys.
    """
    slim, seeded = rates(docs, weights, cap, seeds)
    out = slim.join(seeded, slim["source"].eqNullSafe(seeded["_source"])).withColumn("copies", _copies(F.col("seed")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "seed", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """docs, each row as many times as mix() takes it, numbered by `copy` from 0 (a column of that name is replaced).

    A row's copies follow from its own id and its source's rate, so only the table of sources is joined and no
    text is moved. Rows with a null id draw as the empty id, rows that repeat an id once each. Texts that are null or
    have no words are taken as often as their source's rate says, though they add no words. An empty table
    gives an empty result.
    """
    _, seeded = rates(docs, weights, cap, seeds)
    rate, seed, source = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("rate", "seed", "source"))  # clash with no column of docs
    table = seeded.select(F.col("_source").alias(source), F.col("rate").alias(rate), F.col("seed").alias(seed))
    joined = docs.join(table, docs["source"].eqNullSafe(table[source]))
    copies = _copies(F.col(seed), F.col(rate), docs["doc_id"]).cast("int")
    others = [docs[c] for c in docs.columns if c != "copy"]
    return joined.filter(copies > 0).select(*others, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
