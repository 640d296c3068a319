"""Decontamination on repeated and null ids, in parts, and against brute force over the small tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from folium.llm import decontamination as D
from folium.llm.queries_text import op2_decontamination

SF = "/root/testdata/sf0.001"
A = "the quick surveyor measured seven broken fences along the northern road before the rain came down"
B = "every winter the old harbour master counted the boats twice and wrote the number in a green book"
DOCS = [(1, f"x {A} y"), (2, B), (None, f"{A} and {B}"), (3, None), (4, ""), (5, "nothing of the kind is here"), (2, B), (6, B.upper() + " word" * 30_000)]
ITEMS = [(7, A), (7, B), (8, A), (8, A), (None, B), (9, None), (10, ""), (11, "one")]


def rows(df):
    return sorted(((r["doc_id"], r["item_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [D.MAX_SHIPPED, 40, 1])
def test_repeated_and_null_ids(spark, most):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("coverage", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    expected = [(d, i) for d, t in DOCS for i, x in ITEMS if t and x and len(x.split()) > 1 and x.lower() in t.lower()]
    assert rows(D.contaminated(docs, items, max_shipped=most)) == sorted(expected, key=str)
    kept = D.drop_contaminated(docs, items, max_shipped=most)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_parts_are_bounded_and_whole(spark):
    items = [(k % 5, f"item number {k} has some words " * (1 + k % 3)) for k in range(200)] + [(1, "same text again")] * 50 + [(2, "long " * 500)]
    parts = list(D.parts_of(spark.createDataFrame(items, "item_id long, text string"), 120))
    assert sorted(x for p in parts for x in p) == sorted(items)
    assert all(len(p) == 1 or sum(len(t.split()) + 1 for _, t in p) <= 120 for p in parts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query_against_brute_force(spark):
    """Every pair is verified without any index; verbatim copies are found by a search of words of its own."""
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    docs, items = [(r["doc_id"], r["text"] or "") for r in read("documents")], [(r["item_id"], r["text"] or "") for r in read("benchmark")]
    got = rows(op2_decontamination(spark, SF))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    assert {(d, i) for d, t in docs for i, x in items if len(plain(x).split()) >= 8 and plain(x) in plain(t)} <= set(got)
    known = [(i, D.readings(x)) for i, x in items]
    assert got == sorted(((d, i) for d, t in docs for doc in [D.readings(t)] for i, item in known if D.verify(doc, item, D.WINDOW)), key=str)
