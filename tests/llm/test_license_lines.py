"""Licence lines without any common notice word, and notices wrapped over lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import license_scan as L
from folium.llm.license_scan import scan_licenses
from tests.llm.test_near_and_leaks import docs

LINES = [
    ("Distributed under the MIT License.", "MIT"),
    ("Distributed under the terms of the MIT license.", "MIT"),
    ("Available under the Apache License, Version 2.0.", "Apache-2.0"),
    ("under the terms of the Mozilla Public License, v. 2.0.", "MPL"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary"),
]


def test_lines_without_anchor_words(spark):
    texts = [f"Some text here.\n{line}\nMore of it" for line, _ in LINES] + ["The license plate of the car was hard to read."]
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in scan_licenses(docs(spark, texts)).collect()}
    assert got == {(k, 1, family) for k, (_, family) in enumerate(LINES)}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notice(spark, mark):
    lines = ["First line.", "", "This Source Code Form is subject", "to the terms of the Mozilla", "Public License, v. 2.0.", "", "Last line"]
    text = "\n".join(mark + x if x else x for x in lines)
    got = [r for r in scan_licenses(docs(spark, [text, None, ""])).collect() if "Form is subject" in r["paragraph_text"] and "v. 2.0" in r["paragraph_text"]]
    assert [(r["doc_id"], r["paragraph"], r["family"], r["shared"] > 0.6) for r in got] == [(0, 1, "MPL", True)]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
WHOLE = [
    (MIT, "MIT", 6), ("The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability.", "MIT", 1),
    ("Unless required by applicable law or agreed to in writing, software", "Apache-2.0", 1), ("This is under the Eclipse Public License 2.0", "EPL", 1),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", 1),
]


def test_notices_beyond_the_first_line(spark):
    rows = scan_licenses(docs(spark, [t for t, _, _ in WHOLE] + ["word " * 20_000 + "Released under the MIT License."])).collect()
    for k, (_, family, least) in enumerate(WHOLE):
        own = [r for r in rows if r["doc_id"] == k]
        assert {r["family"] for r in own} == {family} and len(own) >= least


def test_calibration_is_on_unseen_texts():
    """No notice or sentence of a fold is among those that its model is fitted on, and the folds hold all of them."""
    notices = [n for own in L.NOTICES.values() for n in own]
    held = []
    for k in range(L.FOLDS):
        (own, plain), (other, unseen) = L.fold(k)
        fitted_on = {n for v in own.values() for n in v} | set(plain)
        judged = [n for v in other.values() for n in v] + unseen
        assert not fitted_on & set(judged) and all(own.values())  # every family has notices left to learn from
        held += judged
    assert sorted(held) == sorted(notices + L.ORDINARY)


def test_unknown_class():
    """The probability that a family needs keeps out all but FALSE of unseen ordinary texts; known wordings pass it."""
    m = L.model()
    judge = lambda texts: L.probabilities(L.matrix(texts, m["vocabulary"]), m["weights"], m["bias"])
    texts, truth = L.examples(77, m["families"], L.NOTICES, L.ORDINARY)
    p, last = judge(texts), len(m["families"]) - 1
    named = (p.argmax(1) < last) & (p.max(1) >= m["least"])
    right = named & (p.argmax(1) == truth)
    assert named[truth == last].mean() <= 2 * L.FALSE and right[truth < last].mean() >= 0.97
    assert 0.05 < m["least"] < 0.9 and 0.5 < m["held"] < 1 and np.mean(list(m["recall"].values())) > 0.25  # unseen wordings: far lower


def test_the_classifier_decides(spark, monkeypatch):
    """Without its weights nothing is found, however much of a notice stands there."""
    m = L.model()
    monkeypatch.setattr(L, "model", lambda: m | {"weights": np.zeros_like(m["weights"]), "bias": np.append(np.zeros(len(m["bias"]) - 1), 1.0)})
    assert scan_licenses(docs(spark, [MIT])).count() == 0


def test_keys_equal_sparks(spark):
    words = ["", "mit", "licensed under the", "public license v 2 and some thirty two bytes more"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert got == [L._key(w) for w in words]
