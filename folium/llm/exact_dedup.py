"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut into chunks at places that its own characters decide: a sentence end or line break that follows at
least MIN_CHUNK characters, and in text without either a space or a character of a class that a rule picks. So
equal passages give equal chunks wherever they stand. The chunk dictionary holds each 64-bit key once and verifies
with SHA-256 that one content stands behind it; a key of several contents gets one identifier per content. A
document is then its recipe, the ordered list of verified identifiers, and texts are equal if their recipes are:
nothing else groups them. The SHA-256 of the whole text is a result, and checks each group. Only recipes of some
tens of bytes a chunk are shuffled; a text is read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.text import lower_ascii
from folium.session import cut

MIN_CHUNK = 1024
MAX_CHUNK = 8192


#: Characters that may end a chunk of text without marks: space, and of every script those at each STEP-th place.
STEP = 41
SPARE = " \t" + "".join(chr(c) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xA0, 0xD800)] if c % STEP == 7)


def chunks(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """The text as an array of chunks that join to it again; an empty text has none."""
    within = rf".{{{smallest},{largest - 1}}}?"
    pattern = rf"(?s){within}(?:[.!?。！？\n]|\z)|{within}[{SPARE}]|.{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_key (tells texts of one id apart), text_sha256, and the chunks' keys and digests in order."""
    normal = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return normal.select(
        "doc_id",
        "text_key",
        F.sha2("_t", 256).alias("text_sha256"),
        F.transform(chunks(F.col("_t")), lambda c: F.struct(F.xxhash64(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
    )


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dictionary(recipe: DataFrame) -> DataFrame:
    """The chunk dictionary: one row per key with its occurrences and whether one content stands behind it."""
    every = recipe.select(F.explode("chunks").alias("c")).select("c.key", "c.digest")
    return every.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"), (F.min("digest") == F.max("digest")).alias("verified"))


def identified(recipe: DataFrame) -> DataFrame:
    """recipe with `ids`, the verified identifier of each chunk in order.

    The identifier of a chunk is its key where the dictionary verifies it. A key of several contents is made
    unique by the contents' digests: chunks that hold one are looked up in the table of such keys.
    """
    clashing = cut(dictionary(recipe).filter(~F.col("verified")).select("key"), "clashing")
    plain = F.transform("chunks", lambda c: F.struct(c["key"].alias("key"), F.lit(None).cast("binary").alias("digest")))
    if not clashing.limit(1).count():  # all keys are verified
        return recipe.withColumn("ids", F.transform("chunks", lambda c: c["key"]))
    each = recipe.withColumn("_row", F.monotonically_increasing_id())
    each = cut(each, "numbered")
    touched = each.select("_row", F.explode("chunks").alias("c")).select("_row", "c.key").join(clashing, "key").groupBy("_row").agg(F.collect_set("key").alias("_keys"))
    touched = cut(touched, "touched").withColumnRenamed("_row", "_r")
    both = each.join(touched, each["_row"] == touched["_r"], "left")
    mixed = F.transform("chunks", lambda c: F.struct(c["key"].alias("key"), F.when(F.array_contains("_keys", c["key"]), c["digest"]).alias("digest")))
    return both.withColumn("ids", F.coalesce(F.when(F.col("_keys").isNotNull(), mixed), plain)).drop("_row", "_r", "_keys")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, text_key.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are one
    group. The largest doc_id of a group stays. Rows that repeat a doc_id count in group_size and share its
    fate; null ids never win while another id is in the group. Other columns of docs are not read, so clashing
    names do not matter. An empty table gives an empty result.

    A group may hold any share of the rows: sizes come from a pre-aggregated groupBy, and the join back is
    against the much smaller table of groups with more than one row, written first so that Spark sees its
    size (broadcast when small, else a sort-merge join whose hot partitions adaptive execution splits).
    """
    listed = identified(cut(recipes(docs, text, doc_id), "recipes")).select("doc_id", "text_key", "text_sha256", "ids")
    sized = listed.groupBy("ids").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.when(F.min("text_sha256") != F.max("text_sha256"), F.raise_error(F.lit("one recipe, two texts"))).alias("_bad")
    )
    repeated = cut(sized.filter("group_size > 1 AND _bad IS NULL").drop("_bad"), "groups").withColumnRenamed("ids", "_ids")
    joined = listed.join(repeated, F.col("ids") == F.col("_ids"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("ids").alias("n_chunks"),
        "text_key",
    )


def keep_one_of_equal(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() does not keep; all columns stay.

    Rows are known by id and text, so a repeated id loses only the texts that another row repeats, and null ids
    go like others. Rows that repeat both id and text share their fate. The table of lost rows is written first:
    Spark broadcasts it where its size allows, and no text is moved then.
    """
    gone = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_lost"), F.col("text_key").alias("_key")).distinct()
    lost = cut(gone, "lost")
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost"]) & (text_key(docs["text"]) == lost["_key"]), "left_anti")
