"""Token counts of a whole table against the library; the toxicity scores' worth on held-out rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm.token_counts import token_counts
from folium.llm.toxicity import toxicity

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="test tables are not here")


def test_token_counts_of_a_table(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    table = table.union(table.limit(5)).withColumn("n_tokens", F.lit("x"))  # repeated rows, a name that clashes
    library = tokenizers.Tokenizer.from_file(path)
    want = []
    for r in table.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode("utf-8")), n, n > 1024))
    assert sorted(tuple(r) for r in token_counts(table, path).collect()) == sorted(want) and len(want) > 200


def test_toxicity_is_worth_more_than_a_constant(spark):
    """AUC, precision and recall at 0.3 on rows whose labels no training saw, at a scale with enough of them."""
    read = lambda name: spark.read.parquet(f"{DATA}/sf0.1/{name}.parquet")
    held = toxicity(read("documents"), read("labels")).filter("held_out").join(read("labels"), "doc_id").filter("toxic IS NOT NULL").select("score", "predicted", "toxic").toPandas()
    toxic = held["toxic"].to_numpy() == 1
    ranks = held["score"].rank().to_numpy()
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    hit = held["predicted"].to_numpy() == 1
    precision, recall = np.mean(toxic[hit]), np.mean(hit[toxic])
    print(f"rows {len(held)}, toxic {toxic.sum()}, AUC {area:.3f}, precision {precision:.3f}, recall {recall:.3f}")
    assert toxic.sum() > 50 and area > 0.95 and precision > 0.8 and recall > 0.8
