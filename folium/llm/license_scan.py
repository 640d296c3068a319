"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A multinomial logistic regression over sparse word 1- and 2-grams tells licence families from each other and
from ordinary text. It is fitted on the driver from the notices below, variants of them and ordinary sentences,
all fixed and small. The unknown class is calibrated by cross-fitting, on notices and sentences of which the judging
model saw none: the probability that a family needs is the least at which at most FALSE of the ordinary texts would be named. A named
paragraph must also share enough word 3-grams with the family's notices, its templates.

Scoring needs no shuffle: the n-grams' weights and the templates' 3-grams are constants of some thousand entries,
looked up by XXH64 in arrays of buckets, and a paragraph's score is a sum over its own n-grams. Paragraphs without
any 3-gram of a notice cannot share enough of them and are left out before scoring, which changes no result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by family, in the words in which these licences are commonly announced.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is distributed under the terms of the MIT license.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU General Public License version 2.",
        "Released under the GPL, version 2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL": ["Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0"],
    "Proprietary": ["All rights reserved.", "Copyright all rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential."],
}
#: Ordinary sentences, some with words that notices use.
ORDINARY = [
    "The license plate of the car was hard to read in the dark.",
    "She applied for a driving license in the spring and passed the test.",
    "Permission to enter the building was given by the guard at the gate.",
    "The software was slow, so the team used another library for the work.",
    "The general public was not allowed to use the foundation of the old bridge.",
    "Version 2 of the report was published with a notice in all papers.",
    "He had the right to be heard, and the terms of the contract were clear.",
    "Free food is given to any person who comes with or without a ticket.",
    "A copy of the book is in the library under the old roof.",
    "The following conditions of the road are bad: snow, ice and wind.",
    "This work was done by hand, and the source of the water was found.",
    "You may use the form to modify your order or obtain a new one.",
    "Read the file and compare the results with those of last year.",
    "The city, in the north of the country, is known for its common market.",
    "the of and to in is it that for with as by on at from this be are",
    "copyright law is taught at the school of law in the second year",
]
#: A prediction needs this share of its word 3-grams among the family's notices. Share of held-out ordinary texts that may be named.
SHARED, FALSE = 0.5, 0.01
#: Buckets of the look-up arrays; variants of a notice in training, and as many again for calibration; folds of the calibration.
BUCKETS, VARIANTS, FOLDS = 4096, 16, 3
SEGMENT = r"\n+|(?<=[.!?])\s+(?=[A-Z])"
#: As SEGMENT, but a single line break that follows no end of a sentence divides nothing.
SENTENCE = r"\n{2,}|(?<=[.!?])(?:\n|\s+(?=[A-Z]))"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def triples_of(words: list[str]) -> set[str]:
    """Word 3-grams; of fewer words the whole."""
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or ({" ".join(words)} if words else set())


def examples(seed: int, families: list[str], notices: dict[str, list[str]], ordinary: list[str]) -> tuple[list[set[str]], np.ndarray]:
    """Seeded variants of the notices (parts, with ordinary words before them) and ordinary texts, with their classes."""
    rng = np.random.default_rng(seed)
    filler = [w for s in ordinary for w in words_of(s)]
    rows: list[tuple[set[str], int]] = []
    for k, family in enumerate(families[:-1]):
        for notice in notices[family]:
            words = words_of(notice)
            for _ in range(VARIANTS):
                own = list(words)
                if len(own) > 16 and rng.random() < 0.6:  # a wrapped line of the notice
                    a = int(rng.integers(0, len(own) - 8))
                    own = own[a : a + int(rng.integers(8, 15))]
                elif len(own) > 6 and rng.random() < 0.5:  # a part of it
                    a = int(rng.integers(0, len(own) // 3))
                    own = own[a : a + max(5, int(len(own) * 0.7))]
                if rng.random() < 0.5:
                    own = [str(x) for x in rng.choice(filler, int(rng.integers(1, 5)))] + own
                rows.append((grams_of(own), k))
    for sentence in ordinary:
        words = words_of(sentence)
        rows += [(grams_of(words), len(families) - 1)] * 6
        rows += [(grams_of([str(x) for x in rng.choice(filler, int(rng.integers(3, 30)))]), len(families) - 1) for _ in range(40)]
    return [r for r, _ in rows], np.array([k for _, k in rows])


def fold(k: int) -> tuple[tuple[dict[str, list[str]], list[str]], tuple[dict[str, list[str]], list[str]]]:
    """(notices, ordinary sentences) without those of fold k, and those of fold k; no sentence is in both."""
    parts = lambda held: ({f: [n for i, n in enumerate(own) if (i % FOLDS == k) == held] for f, own in NOTICES.items()}, [s for i, s in enumerate(ORDINARY) if (i % FOLDS == k) == held])
    return parts(False), parts(True)


def matrix(texts: list[set[str]], vocabulary: list[str]) -> np.ndarray:
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, grams in enumerate(texts):
        x[i, [place[g] for g in grams if g in place]] = 1.0
    return x


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fitted(rows: list[set[str]], classes: np.ndarray, count: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Vocabulary, weights and intercepts of a multinomial logistic regression with evenly weighing classes."""
    seen = Counter(g for r in rows for g in r)
    vocabulary = sorted(g for g, n in seen.items() if n >= 3)
    x, y = matrix(rows, vocabulary), np.eye(count, dtype=np.float32)[classes]
    balance = (1.0 / y.sum(0))[classes]
    balance *= len(rows) / balance.sum()
    w, b = np.zeros((len(vocabulary), count), np.float32), np.zeros(count, np.float32)
    for step in range(300):
        g = (probabilities(x, w, b) - y) * balance[:, None] / len(rows)
        rate = 4.0 if step < 200 else 1.0
        w -= rate * (x.T @ g + 2e-4 * w)
        b -= rate * g.sum(0)
    return vocabulary, w, b


@lru_cache(maxsize=1)
def model() -> dict:
    """vocabulary, weights per class, intercepts, families, the calibrated probability and the recall on unseen wordings.

    Both figures come from folds: each fold's notices and sentences are judged by a model that was fitted without them. The
    model that scores is fitted on all.
    """
    families = [*NOTICES, UNKNOWN]
    held = []
    for k in range(FOLDS):
        own, other = fold(k)
        vocabulary, w, b = fitted(*examples(2, families, *own), len(families))
        texts, truth = examples(3, families, *other)
        held.append((probabilities(matrix(texts, vocabulary), w, b), truth))
    found, truth = np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held])
    ordinary = found[truth == len(families) - 1, :-1].max(1)
    least = float(np.quantile(ordinary, 1 - FALSE))
    named = (found.argmax(1) == truth) & (found.max(1) >= least)
    recall = {f: float(named[truth == k].mean()) for k, f in enumerate(families[:-1])}
    vocabulary, w, b = fitted(*examples(2, families, NOTICES, ORDINARY), len(families))
    return {"families": families, "vocabulary": vocabulary, "weights": w, "bias": b, "least": least, "recall": recall, "held": float((found.argmax(1) == truth).mean())}


@lru_cache(maxsize=1)
def held_pattern() -> str:
    """Finds a word 3-gram of any notice in a lower-cased text: a paragraph without one can never reach SHARED."""
    tree: dict = {}
    for triple in sorted({t for notices in NOTICES.values() for n in notices for t in triples_of(words_of(n))}):
        at = tree
        for c in triple:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [(r"(?![a-z0-9])" if c == "" else "[^a-z0-9]+" if c == " " else c) + (pattern(below) if below else "") for c, below in at.items()]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?<![a-z0-9])" + pattern(tree)


def _key(gram: str) -> int:
    """What F.xxhash64 gives for a string."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(gram.encode("utf-8"), 42)).view(np.int64))


def _buckets(entries: dict[str, object], kind: str) -> Column:
    """An array constant: bucket -> the entries whose key falls there, as structs (h, x)."""
    out: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for gram, x in entries.items():
        out[_key(gram) % BUCKETS].append({"h": _key(gram), "x": x})
    return F.from_json(F.lit(json.dumps(out)), f"array<array<struct<h:bigint,x:{kind}>>>")


def _hits(grams: Column, buckets: Column) -> Column:
    """What the bucket array holds for each of the n-grams that it has."""

    def find(gram: Column) -> Column:
        h = F.xxhash64(gram)
        return F.transform(F.filter(F.get(buckets, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda e: e["h"] == h), lambda e: e["x"])

    return F.flatten(F.transform(grams, find))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), "[^a-z0-9]+"), lambda w: w != "")


def _ngrams(words: Column, n: int) -> Column:
    tails = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
    return F.array_distinct(F.transform(tails, lambda i: F.array_join(F.slice(words, i, n), " ")))


def _wrapped(text: Column) -> Column:
    """Array of (paragraph, paragraph_text) of the sentences that run over several lines, the number being the first line's."""
    kind = "array<struct<paragraph:int,paragraph_text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, x: Column) -> Column:
        lines = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1
        one = F.struct(state["at"].alias("paragraph"), F.replace(x, F.lit("\n"), F.lit(" ")).alias("paragraph_text"))
        return F.struct((state["at"] + lines).alias("at"), F.when(lines > 1, F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.split(text, SENTENCE), start, step, lambda s: s["found"])


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (0-based), family, probability, shared, paragraph_text.

    Paragraphs are lines, and sentences within lines; a sentence that is wrapped over lines is one too, beside
    its lines, under the first one's number and with its lines joined by spaces. Null and empty texts, and texts without licence
    paragraphs, give no row. Ties of probability go to the earlier family name. A repeated row gives its
    paragraphs once per (doc_id, paragraph, text). Other columns are not read; an empty table gives an empty
    result. A paragraph of any length is scored whole, by sums over its own n-grams.
    """
    m = model()
    families, known = m["families"], {}
    for k, family in enumerate(families[:-1]):
        for triple in {t for n in NOTICES[family] for t in triples_of(words_of(n))}:
            known[triple] = known.get(triple, 0) | 1 << k
    weights = _buckets({g: [round(float(x), 6) for x in w] for g, w in zip(m["vocabulary"], m["weights"])}, "array<double>")
    templates = _buckets(known, "bigint")
    holds = lambda c: F.lower(c).rlike(held_pattern())
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).filter(holds("_t"))
    lines = held.select("doc_id", F.posexplode(F.split("_t", SEGMENT)).alias("paragraph", "paragraph_text"))
    parts = lines.union(held.select("doc_id", F.inline(_wrapped(F.col("_t"))))).filter(holds("paragraph_text"))
    last = len(families) - 1
    bias = F.array(*[F.lit(float(x)) for x in m["bias"]])
    names, bits = F.array(*[F.lit(f) for f in families]), F.array(*[F.lit(1 << k) for k in range(len(families))]).cast("array<bigint>")

    def judge(words: Column) -> Column:
        scores = F.aggregate(_hits(F.array_distinct(F.concat(words, _ngrams(words, 2))), weights), bias, lambda s, w: F.zip_with(s, w, lambda x, y: x + y))
        return _let(scores, lambda s: _let(F.struct(F.array_max(s).alias("top"), s.alias("s")), lambda t: confirm(words, t["s"], t["top"])))

    def confirm(words: Column, s: Column, top: Column) -> Column:
        best = F.array_position(s, top).cast("int")
        chance = 1.0 / F.aggregate(s, F.lit(0.0), lambda total, x: total + F.exp(x - top))
        named = (best <= last) & (chance >= m["least"])
        shared = _let(_ngrams(words, 3), lambda t: F.size(F.filter(_hits(t, templates), lambda held: held.bitwiseAND(F.element_at(bits, best)) != 0)) / F.size(t))
        return F.struct(F.element_at(names, best).alias("family"), chance.alias("probability"), F.when(named, shared).otherwise(0.0).alias("shared"))

    judged = F.filter(F.transform(F.array(_words(F.col("paragraph_text"))), judge), lambda r: r["shared"] >= SHARED)
    found = parts.select("doc_id", "paragraph", "paragraph_text", F.inline(judged))  # a generator, so that nothing is computed twice
    return found.select("doc_id", "paragraph", "family", "probability", "shared", "paragraph_text").distinct()
