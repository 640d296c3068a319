"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of the training folds with quality 1; the unlabelled texts are web text
sampled without regard to labels. No row with quality 0 is ever read. The class prior is estimated from the two
samples: a first network tells positives from unlabelled texts, and on halves that it has not seen the prior is the
least ratio of the unlabelled to the positive share above a threshold, with a margin for small shares (best-bin
estimation). A small network over document statistics then minimises the non-negative unbiased risk: prior *
loss(positives as positive) + max(0, loss(unlabelled as negative) - prior * loss(positives as negative)), with the
logistic loss, under which its output is the log odds of a positive. Scoring is one map over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.toxicity import LONGEST, sample, score_documents
from folium.llm.words import split_words

SAMPLE = 2000
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
HIDDEN = 24
#: Random halvings whose median is the prior; networks whose log odds are averaged.
SPLITS, NETWORKS = 7, 3

#: Classes of bytes: white space, lower, upper, digit, sentence marks, other ASCII marks, non-ASCII.
CLASSES = np.full(256, 5, np.int64)
CLASSES[list(b" \t\n\r\x0b\x0c")] = 0
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[list(b".,;:'\"-()")], CLASSES[128:] = 1, 2, 3, 4, 6


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros."""
    codes, offsets, words = split_words(texts)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    size = np.maximum(sizes, 1)
    of = np.repeat(np.arange(n), sizes)
    raw = [w.encode("utf-8", "replace") for w in words]
    flags = np.zeros((len(words), 8))
    for k, w in enumerate(raw):
        core = w.strip(b".,;:!?'\"()")
        last = w[-1:]
        flags[k] = (
            len(w),
            words[k].isupper() and len(core) > 1,
            not core.isalnum() and not any(c >= 128 for c in core) and core != b"",
            last in b"%*&$#@^~|",
            last == b"!",
            core.isdigit(),
            core == b"",
            len(w) > 20,
        )
    at = flags[codes] if len(codes) else np.zeros((0, 8))
    mean = np.stack([np.bincount(of, at[:, k], n) / size for k in range(8)], 1)
    # repetition: distinct words, adjacent repeats, repeats two and three words apart, the most frequent word's share
    key = of * np.int64(len(words) + 1) + codes
    unique, counts = np.unique(key, return_counts=True)
    whose = unique // np.int64(len(words) + 1)
    distinct = np.bincount(whose.astype(np.int64), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, whose.astype(np.int64), counts)
    columns = [mean, (distinct / size)[:, None], (distinct / np.sqrt(size))[:, None], (most / size)[:, None]]
    for gap in (1, 2, 3, 7):
        same = (key[gap:] == key[:-gap]) if len(key) > gap else np.zeros(0, bool)
        columns.append((np.bincount(of[gap:][same], minlength=n) / size)[:, None])
    ends = np.fromiter((w[-1:] in b".!?" for w in raw), np.float64, len(raw))[codes] if len(codes) else np.zeros(0)
    columns.append((np.bincount(of, ends, n) / size)[:, None])
    kinds, lines = np.zeros((n, 7)), np.zeros((n, 3))
    for k, x in enumerate(texts):
        text = x.as_buffer().to_pybytes() if x.is_valid else b""
        if text:
            kinds[k] = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
            parts = text.split(b"\n")
            lines[k] = len(parts) / len(text) * 40, len(set(parts)) / len(parts), text.count(b"http") / size[k]
    columns += [kinds, lines, np.log1p(sizes)[:, None], (sizes == 0)[:, None].astype(float)]
    return np.concatenate(columns, 1)


class QualityModel:
    """Standardised statistics, one hidden layer, the prior, and the non-negative PU risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 1500, seed: int = 4):
        every = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else features(pa.array([""]))
        self.low, self.high = np.quantile(every, 0.005, axis=0), np.quantile(every, 0.995, axis=0)
        held = every.clip(self.low, self.high)
        self.mean, self.spread = held.mean(0), held.std(0) + 1e-3
        self.prior = 0.5 if prior is None else prior
        rng, self.trained = np.random.default_rng(seed), []
        self._start(rng)
        if len(positive) > 1 and len(unlabelled) > 1:
            pos, unl = self._scale(positive), self._scale(unlabelled)
            if prior is None:
                self.prior = float(np.median([self._estimate(pos, unl, steps // 4, rng) for _ in range(SPLITS)]))
            for _ in range(NETWORKS):
                self._start(rng)
                self._train(pos, unl, steps, rng)
                self.trained.append(self.p)

    def _start(self, rng) -> None:
        d = len(self.mean)
        self.p = {"w": rng.standard_normal((d, HIDDEN)) / np.sqrt(d), "b": np.zeros(HIDDEN), "v": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "c": np.zeros(1)}

    def _estimate(self, pos: np.ndarray, unl: np.ndarray, steps: int, rng) -> float:
        """The prior by best-bin estimation on halves that the first network has not seen."""
        a, b = rng.permutation(len(pos)), rng.permutation(len(unl))
        self._start(rng)
        self._train(pos[a[::2]], unl[b[::2]], steps, rng, plain=True)
        own, others = (np.sort(self._forward(x)[0]) for x in (pos[a[1::2]], unl[b[1::2]]))
        cuts = own
        p = 1 - np.searchsorted(own, cuts) / len(own)
        u = 1 - np.searchsorted(others, cuts) / len(others)
        margin = np.sqrt(np.log(40.0) / 2) * (1 / np.sqrt(len(own)) + 1 / np.sqrt(len(others)))
        best = int(np.argmin((u + margin) / p))
        return float(np.clip(u[best] / p[best], 0.02, 0.98))

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return (x.clip(self.low, self.high) - self.mean) / self.spread

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        return h @ self.p["v"] + self.p["c"][0], h

    def _train(self, pos: np.ndarray, unl: np.ndarray, steps: int, rng, plain: bool = False) -> None:
        """Adam on the non-negative risk; `plain` tells the two samples apart instead."""
        sigmoid = lambda z: 1.0 / (1.0 + np.exp(-z.clip(-30, 30)))
        soft = lambda z: np.logaddexp(0, z)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            a, b = pos[rng.integers(len(pos), size=256)], unl[rng.integers(len(unl), size=512)]
            fa, ha = self._forward(a)
            fb, hb = self._forward(b)
            # logistic loss: soft(-f) for a positive, soft(f) for a negative; their slopes are sigmoid(f) - 1 and sigmoid(f)
            if plain:
                ga, gb = (sigmoid(fa) - 1) / len(a), sigmoid(fb) / len(b)
            else:
                ga, gb = self.prior * (sigmoid(fa) - 1) / len(a), np.zeros(len(b))
                if soft(fb).mean() - self.prior * soft(fa).mean() >= 0:
                    ga, gb = ga - self.prior * sigmoid(fa) / len(a), sigmoid(fb) / len(b)
                else:  # step back from the overfit part of the risk
                    ga, gb = self.prior * sigmoid(fa) / len(a), -sigmoid(fb) / len(b)
            grads = {k: np.zeros_like(x) for k, x in self.p.items()}
            for x, h, g in ((a, ha, ga), (b, hb, gb)):
                inner = g[:, None] * self.p["v"] * (1 - h**2)
                grads["w"] += x.T @ inner
                grads["b"] += inner.sum(0)
                grads["v"] += h.T @ g
                grads["c"] += g.sum()
            for k, g in grads.items():
                g = g + 1e-4 * self.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The chance of a positive: the networks' mean log odds as a probability."""
        x = self._scale(features(texts))
        f = np.zeros(len(x))
        for self.p in self.trained or [self.p]:
            f += self._forward(x)[0] / max(1, len(self.trained))
        return 1.0 / (1.0 + np.exp(-f.clip(-30, 30)))


def web_sample(docs: DataFrame, most: int, longest: int = LONGEST) -> list[str]:
    """`most` texts, the first by the hash of their ids and without regard to labels; none of over `longest` characters."""
    part = max(1, docs.count() // (2 * most))  # some twice as many are ordered, not all
    chosen = docs.filter((F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0) & (F.length("text") <= longest)).select("doc_id", "text")
    rows = chosen.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").limit(most).collect()
    return [r["text"] for r in rows]


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    texts, _, _ = sample(docs, labels.filter("quality = 1"), "quality", FOLDS, HELD, most)
    web = web_sample(docs, 2 * most)
    return QualityModel(features(pa.array(texts, pa.string())), features(pa.array(web, pa.string())))


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted.

    docs needs doc_id and text, labels doc_id and quality; other columns are not read. Null and empty texts
    have zero statistics and the score that follows from them. Without labels the untrained network scores.
    Equal texts get equal scores; repeated rows give repeated results; an empty table gives an empty result.
    """
    return score_documents(docs, fit_quality(docs, labels, most), FOLDS, HELD, THRESHOLD)
