"""Toxicity by a recurrent network over all overlapping windows of a text.

The network (recurrent.py) is trained on the driver from a bounded, hash-ordered sample of labelled rows of the
training folds; a text's score combines its windows' logits and is calibrated to the labels' natural rate.
Scoring is one map over the documents: no shuffle, and a kernel works on a few megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.recurrent import WINDOW, Network, Words, associations, windows
from folium.llm.text import crc_mod
from folium.llm.words import filter_rows, release, slices, split_words

#: Labelled rows per class that training reads at most, and the longest text among them.
SAMPLE, LONGEST = 2000, 100_000
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and 0/1 labels of a bounded sample of training rows, and all training labels' counts by class.

    Per class the `most` ids with the smallest hashes are taken, of several texts of an id the smallest, so reruns
    agree; several labels of one id count as their largest. Texts of over `longest` characters are not among them.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    ids = []
    for value in (0, 1):
        ids += [(r[0], value) for r in known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()]
    if not ids:
        return [], np.zeros(0), np.array([counts.get(0, 0), counts.get(1, 0)])
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "_id long, label int"))  # at most 2 * most rows
    plain = docs.select("doc_id", "text")  # nothing else, so that no column's name clashes
    held_texts = plain.join(chosen, plain["doc_id"] == chosen["_id"]).filter(F.length("text") <= longest)
    rows = held_texts.groupBy("_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_id"])
    return [r["text"] for r in rows], np.array([r["label"] for r in rows]), np.array([counts.get(0, 0), counts.get(1, 0)])


def summary(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: the largest window logit, a soft sum of positive evidence, and the logarithm of the window count."""
    top = np.full(n, -6.0)
    np.maximum.at(top, text, logits.clip(-12, 12))
    mass = np.bincount(text, 1.0 / (1.0 + np.exp(-logits.clip(-12, 12))), n)
    return np.stack([top, np.log(mass + 0.02), np.log1p(np.bincount(text, minlength=n))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with intercept, by Newton steps; x is standardised inside."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    a = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-(a @ w).clip(-30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        hessian[-1, -1] -= ridge * 0.99
        w += np.linalg.solve(hessian, a.T @ (weight * (y - p)) - ridge * np.append(w[:-1], 0))
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def shortened(windows_: np.ndarray, marks: np.ndarray, hint: np.ndarray, rng) -> np.ndarray:
    """A stretch of 1 to 24 words of each window; a positive's is around its most telling word."""
    out = np.full_like(windows_, -1)
    for k, row in enumerate(windows_):
        own = row[row >= 0]
        size = int(rng.integers(1, 25))
        middle = int(np.argmax(hint[own])) if marks[k] else int(rng.integers(len(own)))
        start = max(0, middle - int(rng.integers(0, size)))
        part = own[start : start + size]
        out[k, : len(part)] = part
    return out


class ToxicityModel:
    """The network, its calibration, and scores of a batch of texts."""

    def __init__(self, texts: list[str], labels: np.ndarray, counts: np.ndarray, seed: int = 9):
        self.net, self.calibration = Network(), np.array([0.0, 0.0, 0.0, -2.2])
        if len(set(labels.tolist())) < 2:
            rate = (float(counts[1]) + 0.1) / (float(counts.sum()) + 1.0)  # few labels of one class say little: not toxic
            self.calibration[-1] = np.log(rate / (1 - rate))
            return
        codes, offsets, words = split_words(pa.array(texts, pa.string()))
        known = Words.of(words)
        each = [codes[a:b] for a, b in zip(offsets, offsets[1:])]
        half = np.random.default_rng(seed).random(len(texts)) < 0.5
        # statistics from one half, the network from the other, so that it does not trust them too much
        self.net.stats = associations([x for x, h in zip(each, half) if h], labels[half], known)
        x = self.net.inputs(known)
        hint = np.append(x[:-1, 0] + x[:-1, 1], np.float32(0))
        text, cut = windows(codes, offsets)
        weight = np.concatenate([np.sort(hint[part], axis=1)[:, -3:].sum(1) for part in np.split(cut, range(4096, len(cut), 4096))])
        chosen = []
        order = np.lexsort((-weight, text))
        first = np.searchsorted(text[order], np.arange(len(texts) + 1))
        rng = np.random.default_rng(seed)
        for k in np.nonzero(~half)[0]:
            own = order[first[k] : first[k + 1]]
            if len(own):
                chosen += own[:2].tolist() if labels[k] else {own[0], own[rng.integers(len(own))]}
        chosen = np.array(chosen)
        parts, marks = cut[chosen], labels[text[chosen]]
        short = shortened(parts, marks, hint, rng)  # texts may be of a few words
        self.net.train(known, np.concatenate([parts, short]), np.concatenate([marks, marks]))
        self.net.stats = associations(each, labels, known)
        gates = self.net.project(self.net.inputs(known))
        rest = ~half
        if len(set(labels[rest].tolist())) < 2:
            rest = np.ones(len(texts), bool)
        take = rest[text]
        features = summary(self.net.logits(gates, cut[take]), text[take], len(texts))[rest]
        # the sample's classes count as they occur
        share = np.bincount(labels[rest], minlength=2)
        self.calibration = logistic(features, labels[rest], (counts / counts.sum() / (share / share.sum()))[labels[rest]])

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, words = split_words(texts)
        n = len(offsets) - 1
        gates = self.net.project(self.net.inputs(Words.of(words)))
        text, cut = windows(codes, offsets)
        x = summary(self.net.logits(gates, cut), text, n)
        return 1.0 / (1.0 + np.exp(-(x @ self.calibration[:-1] + self.calibration[-1]).clip(-30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> ToxicityModel:
    model = ToxicityModel(*sample(docs, labels, "toxic", FOLDS, HELD, most))
    release()
    return model


def score_documents(docs: DataFrame, model, folds: int, held: int, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row by model.score, which maps an Arrow array of texts to scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    return plain.mapInArrow(kernel, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted.

    docs needs doc_id and text, labels doc_id and toxic; other columns are not read, so no label, language,
    source or id enters a score. Null and empty texts get the score of a text without windows. Without
    labels of both classes every text gets the labels' smoothed rate. Equal texts get equal scores; repeated
    rows give repeated results; an empty table gives an empty result.
    """
    return score_documents(docs, fit_toxicity(docs, labels, most), FOLDS, HELD)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay, and nothing of them is shuffled.

    Each row is judged by its own text, so null and repeated ids do not matter; null and empty texts are judged
    as texts without windows. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, most))
    return filter_rows(docs, "text", lambda texts: shared.value.score(texts) < THRESHOLD)
