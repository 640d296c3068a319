"""Trained operators: gradients, held-out accuracy, odd inputs; the pipeline against a brute-force version."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import license_scan as L
from folium.llm import recurrent as R
from folium.llm.quality import features, quality
from folium.llm.toxicity import ToxicityModel, drop_toxic, toxicity
from folium.llm.words import slices, split_words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_gradients():
    rng = np.random.default_rng(0)
    net, words = R.Network(), R.Words.of(["abc", "defg", "hi", "xyz", "long-word", "été"])
    net.stats = (rng.standard_normal(R.STAT_WORDS).astype(R.F32), rng.standard_normal(R.STAT_GRAMS).astype(R.F32))
    codes, y = np.array([[0, 1, 2, 3, -1], [4, 5, 0, -1, -1], [2, 2, 1, 5, 3]]), np.array([1, 0, 1], R.F32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: net.gradients(net.inputs(words), words, codes, y)
    grads, _ = loss()
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was, step = net.p[k][at], 1e-3
        net.p[k][at] = was + step
        up = loss()[1]
        net.p[k][at] = was - step
        down = loss()[1]
        net.p[k][at] = was
        assert abs((up - down) / (2 * step) - g[at]) < 1e-4, k


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        codes, offsets = np.arange(n), np.array([0, n])
        text, found = R.windows(codes, offsets)
        assert set(found[found >= 0].tolist()) == set(range(n)) and len(text) == (0 if n == 0 else max(1, -(-(n - 64) // 48) + 1))


def test_split_words_and_slices():
    codes, offsets, words = split_words(pa.array([" a b  a", None, "", "b\x1cc\u00a0"]))
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [["a", "b", "a"], [], [], ["b\x1cc\u00a0"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 40] * 9)], names=["a", "b"])
    assert sum(s.num_rows for s in slices(batch, limit=100)) == 9


def accuracy(spark, query, label, folds, held):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([p == t for p, t in known]), rows, truth


@here
def test_toxicity_held_out(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    found, rows, truth = accuracy(spark, toxicity(read("documents"), read("labels")), "toxic", 4, 2)
    assert found > 0.85
    scores = {r["doc_id"]: r["score"] for r in rows}
    mean = lambda y: np.mean([scores[k] for k, v in truth.items() if v == y])
    assert mean(1) > mean(0) + 0.2


@here
def test_quality_held_out(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    assert accuracy(spark, quality(read("documents"), read("labels")), "quality", 5, 0)[0] > 0.9


def test_models_on_odd_inputs(spark):
    texts = [None, "", "a", "word " * 5000, "plain text here"] * 3
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for query in (toxicity, quality):
        for table in (labels, none):
            rows = query(docs(spark, texts).withColumn("label", F.lit(1)).withColumn("toxic", F.lit(1)), table).collect()
            by = {r["doc_id"]: r["score"] for r in rows}
            assert len(rows) == 15 and by[0] == by[1] == by[5]
        assert query(docs(spark, []), labels).count() == 0
    assert features(pa.array(["", None])).shape[0] == 2 and not np.isnan(features(pa.array(["", "x", None]))).any()


def test_toxic_words_are_learnt(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(plain, 120)) for _ in range(300)]
    labels = np.zeros(300, int)
    for k in range(0, 300, 4):
        words = texts[k].split()
        words[int(rng.integers(120))] = words[int(rng.integers(120))] = "nastyword"
        texts[k], labels[k] = " ".join(words), 1
    model = ToxicityModel(texts, labels, np.bincount(labels))
    long = " ".join(rng.choice(plain, 4000))
    scores = model.score(pa.array([long, long + " nastyword nastyword"]))
    assert scores[1] > scores[0]
    for size in (5, 20, 150):
        clean = [" ".join(rng.choice(plain, size)) for _ in range(100)]
        assert (model.score(pa.array(clean)) < 0.3).mean() > 0.85 and (model.score(pa.array([t + " nastyword nastyword" for t in clean])) >= 0.3).mean() > 0.85


def test_licences(spark):
    texts = [
        "Intro line\nLicensed under the Apache License, Version 2.0.\nmore", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", None, "",
        "The license plate of my car. He got permission to copy the free software version of the book.", "SPDX-License-Identifier: BSD-3-Clause", "x " * 3000 + ". Licensed under the Mozilla Public License, version 2.0.",
    ]
    got = {(r["doc_id"], r["family"]) for r in L.scan_licenses(docs(spark, texts).withColumn("family", F.lit("x"))).collect()}
    assert got == {(0, "Apache-2.0"), (1, "GPL"), (2, "MIT"), (3, "CC-BY-NC"), (7, "BSD"), (8, "MPL")}
    assert L.scan_licenses(docs(spark, [])).count() == 0


def test_licence_notices_are_recognised(spark):
    rows = [(f, n) for f, notices in L.NOTICES.items() for n in notices]
    found = {r["doc_id"]: r["family"] for r in L.scan_licenses(docs(spark, [n for _, n in rows])).collect()}
    assert sum(found.get(k) == f for k, (f, _) in enumerate(rows)) >= 0.9 * len(rows)
    none = L.scan_licenses(docs(spark, L.ORDINARY)).count()
    assert none == 0


@here
def test_pipeline_against_its_parts(spark):
    """Every stage against a version of its own on the driver: labels by the scoring query, the rest by brute force."""
    import corpus_pipeline as P

    from folium.llm import decontamination as D
    from folium.llm.mixing import mix
    from tests.llm.test_similar import brute

    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    rows = {r["doc_id"]: r for r in read("documents").collect()}
    toxic = {r["doc_id"] for r in toxicity(read("documents"), read("labels")).filter("predicted = 1").collect()}
    left = {k: v for k, v in rows.items() if k not in toxic}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by_text: dict = {}
    for k, v in left.items():
        key = (v["text"] or "").translate(lower)
        by_text[key] = max(by_text.get(key, k), k)
    ids = sorted(by_text.values())
    group = brute([rows[k]["text"] for k in ids])
    left = {ids[k]: rows[ids[k]] for k in range(len(ids)) if group[k] == k}
    items = [D.readings(r["text"]) for r in read("benchmark").collect() if r["text"]]
    index = D.Index([(k, r["text"]) for k, r in enumerate(read("benchmark").collect())], D.WINDOW)
    maybe = {k for k, v in left.items() if index.meet(pa.array([v["text"]], pa.string()))}
    held = {k for k in maybe for doc in [D.readings(left[k]["text"])] if any(D.verify(doc, item, D.WINDOW) for item in items)}
    left = {k: v for k, v in left.items() if k not in held}
    expected = {r["doc_id"]: r["copies"] for r in mix(spark.createDataFrame([tuple(v) for v in left.values()], SCHEMA)).collect() if r["copies"]}
    got = P.run(spark, SF).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == expected and toxic and held
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]


ODD = [(None, None, None), (None, "", "s"), (4, "", "t"), (4, "a b", "s"), (4, "a b", "s"), (5, "A b", "s"), (None, "a b", None), (9, "long word " * 60_000, "s"), (9, "other words are here now", "t")]


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    from folium.llm import exact_dedup as X
    from folium.llm.decontamination import drop_contaminated
    from folium.llm.mixing import mix, mixed_documents

    table = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1))
    for extra in ("_lost", "_key", "copies", "text_key", "keep_id", "score", "label", "_id", "rate", "_source"):
        table = table.withColumn(extra, F.lit("clash"))
    show = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in df.collect()), key=str)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    whole = show(table)
    assert show(drop_toxic(table, labels)) == whole
    assert show(drop_contaminated(table, spark.createDataFrame([(None, "other words are here now"), (1, None)], "item_id long, text string"))) == [x for x in whole if x[1] != "other"]
    # of the empty texts id 4 stays, of "a b" id 5
    assert show(X.keep_one_of_equal(table)) == sorted([(4, ""), (5, "A b"), (9, "long "), (9, "other")], key=str)
    assert show(P.near_dedup(spark, table, "")) == sorted([(4, ""), (4, "a b"), (4, "a b"), (9, "long "), (9, "other")], key=str)
    taken = mix(table).collect()
    mixed = mixed_documents(table)
    assert len(taken) == len(ODD) and mixed.count() == sum(r["copies"] for r in taken) and set(mixed.columns) == {*table.columns, "copy"}
    for stage in (lambda t: drop_toxic(t, labels), X.keep_one_of_equal, lambda t: P.near_dedup(spark, t, ""), lambda t: drop_contaminated(t, labels.selectExpr("doc_id item_id", "'x y' text")), mixed_documents):
        assert stage(table.limit(0)).count() == 0


@here
def test_stages_keep_the_columns(spark):
    import corpus_pipeline as P

    small = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, small, SF).columns == P.COLUMNS, name
        assert "Exchange hashpartitioning(doc_id" not in stage(spark, small, SF)._jdf.queryExecution().toString(), name


def test_drop_toxic_keeps_columns(spark):
    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    assert drop_toxic(docs(spark, ["a", "b"]), labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]
