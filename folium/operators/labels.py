"""Labels of lists between node tables and style sheets: a rule per list level out, level texts back in."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import labels as L
from folium.session import cut, merged


def marker_sheets(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, css): one `.class::marker` rule for each class of a document whose label CSS can say, in order of the classes.

    levels has keys, class, level_text, depth and format. Rows that repeat a class count once; if they differ, the greatest
    content stays. A document without such a class gives no row.
    """
    said = _once(levels, {"level_text": "_text", "depth": "_depth", "format": "_format"}, L.content(L.tokens(F.col("_text")), F.col("_depth"), F.col("_format")), "content")
    return rules_css(said.filter("class IS NOT NULL AND content IS NOT NULL").select(*keys, "class", "content"), keys)


def _once(rows: DataFrame, inputs: dict[str, str], value: Column, name: str) -> DataFrame:
    """rows with value as name, computed once for each set of its inputs, under the names given for them: documents repeat them, and labels are dear."""
    made = rows.select(*[F.col(c).alias(n) for c, n in inputs.items()]).distinct().withColumn(name, value)
    return rows.join(made, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in inputs.items()]), "left").drop(*inputs.values())


def rules_css(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, css) of (keys, class, content): a rule per class in order of the classes, the greatest content of each."""
    rules = rules.groupBy(*keys, "class").agg(F.max("content").alias("content"))
    one = F.concat(F.lit("."), "class", F.lit("::marker { content: "), "content", F.lit(" }\n"))
    return rules.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("css"))


def labels_of_items(items: DataFrame, sheets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """items with level_text: that of the first of their classes that has a rule in their document's sheets, else null.

    items has keys, classes (an array) and depth; sheets has keys and css, of which a document may have several: of rules for
    one class the last by the sheet's text and place stays. Other columns of items pass through.
    """
    on = [f"_{k}" for k in keys]
    rules = sheets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("css").alias("_css"), F.posexplode(L.marker_rules(F.col("css"))).alias("_at", "_rule"))
    rules = rules.groupBy(*on, F.col("_rule.name").alias("_name")).agg(F.max_by("_rule.content", F.struct("_css", "_at")).alias("_content"))
    per_doc = rules.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_content"))).alias("_rules"))
    joined = items.join(per_doc, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*on)
    first = F.get(F.filter(F.transform("classes", lambda c: F.try_element_at("_rules", c)), lambda x: x.isNotNull()), 0)
    return joined.withColumn("_content", first).withColumn("level_text", L.level_text(F.col("_content"), F.col("depth"))).drop("_content", "_rules")


def list_depths(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, list_depth): how many lists each list of a node table lies in, one join per depth of nesting."""
    items = nodes.filter(F.col("kind") == "item").select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_outer"))
    nested = cut(nodes.filter(F.col("kind") == "list").select("doc_id", "node_id", "parent_id").join(merged(items), ["doc_id", "parent_id"], "left").select("doc_id", "node_id", "_outer"), "lists")
    level, found, depth = nested.filter("_outer IS NULL"), [], 0
    while depth == 0 or not level.isEmpty():
        found.append(level.select("doc_id", "node_id", F.lit(depth).alias("list_depth")))
        level, depth = cut(nested.join(merged(level.select("doc_id", F.col("node_id").alias("_outer"))), ["doc_id", "_outer"]).select("doc_id", "node_id"), "inner-lists"), depth + 1
    return reduce(DataFrame.union, found)


def marked_lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, class, content): the numbered lists of a node table whose labels need a ::marker rule, and can have one."""
    lists = nodes.filter((F.col("kind") == "list") & F.col("ordered")).select("doc_id", "node_id", "format", F.col("style")["marker_class"].alias("class"), F.col("style")["level_text"].alias("_text"))
    lists = cut(lists.filter("class IS NOT NULL AND _text IS NOT NULL"), "labelled")
    said = L.content(L.tokens(F.col("_text")), F.col("list_depth"), F.col("format"))
    if lists.isEmpty():  # no nesting needs to be followed
        return lists.select("doc_id", "node_id", "class", F.lit(None).cast("string").alias("content"))
    return lists.join(merged(list_depths(nodes)), ["doc_id", "node_id"]).select("doc_id", "node_id", "class", said.alias("content")).filter("content IS NOT NULL")


def nodes_css(nodes: DataFrame) -> DataFrame:
    """(doc_id, css): the ::marker rules that go with the HTML of a node table; no row for documents that need none."""
    return rules_css(marked_lists(nodes), ["doc_id"])
