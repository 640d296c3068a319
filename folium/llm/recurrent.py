"""A bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word enters as a vector of its hashed word embedding, the mean of its hashed byte n-gram embeddings, and three
fixed association statistics (of the word and of its n-grams with the label, shrunk, from training texts only).
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 14
STAT_WORDS, STAT_GRAMS = 1 << 18, 1 << 18
EMB, HIDDEN, ATTEND = 6, 8, 8
GRAMS = (4, 7)
WINDOW, STRIDE = 64, 48
#: Words that are hashed at once.
PART = 16_384
LEAST = 3
_EDGE = string.punctuation + "…“”„«»¿¡"
F32 = np.float32


def bare(word: str) -> bytes:
    return (word.lower().strip(_EDGE) or word).encode("utf-8", "replace")


@dataclass
class Words:
    """Distinct words as hashes, and the hashes of their byte n-grams: those of word k are grams[first[k]:first[k + 1]]."""

    hashes: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        if len(words) > PART:  # in parts, which bound the temporary arrays
            return cls.joined([cls.of(words[k : k + PART]) for k in range(0, len(words), PART)])
        parts = [b"^" + bare(w) + b"$" for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        at = np.arange(len(raw))
        left = ends[of] - at
        prime = np.uint64(0x100000001B3)
        owner, grams = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        rolled, taken = np.zeros(len(raw), np.uint64), 0
        for n in GRAMS:
            while taken < n:
                live = max(0, len(raw) - taken)
                rolled[:live] = rolled[:live] * prime + raw[taken:] + np.uint64(7)
                taken += 1
            good = left >= n
            owner.append(of[good])
            grams.append(_scramble(rolled[good] + np.uint64(n)).astype(np.uint32))
        # a whole word's hash: its bytes weighted by place
        place = (at - (ends - sizes)[of]).astype(np.uint64)
        sums = np.zeros(len(parts), np.uint64)
        np.add.at(sums, of, _scramble(raw * np.uint64(0x9E3779B1) + place * np.uint64(0x85EBCA77C2B2AE63)))
        whose = np.concatenate(owner)
        order = np.argsort(whose, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(parts)))])
        return cls(_scramble(sums), np.concatenate(grams)[order], first)

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        counts = np.concatenate([p.counts for p in parts])
        return cls(np.concatenate([p.hashes for p in parts]), np.concatenate([p.grams for p in parts]), np.concatenate([[0], np.cumsum(counts)]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.hashes), dtype=np.int32), self.counts)

    def take(self, chosen: np.ndarray) -> Words:
        """The words of the given numbers, renumbered."""
        counts = self.counts[chosen]
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.first[chosen] - first[:-1], counts) + np.arange(first[-1])
        return Words(self.hashes[chosen], self.grams[at], first)

    def part(self, a: int, b: int) -> Words:
        return Words(self.hashes[a:b], self.grams[self.first[a] : self.first[b]], self.first[a : b + 1] - self.first[a])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def associations(texts: list[np.ndarray], labels: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log odds of the label, per hashed word and per hashed n-gram, over texts given as word numbers."""
    tables = []
    for kind, size in (("word", STAT_WORDS), ("gram", STAT_GRAMS)):
        count = np.zeros((2, size))
        for text, label in zip(texts, labels):
            seen = np.unique(text)
            hashed = words.hashes[seen].astype(np.uint32) if kind == "word" else words.take(seen).grams
            count[int(label), np.unique(hashed & np.uint32(size - 1))] += 1
        total = np.bincount(labels.astype(int), minlength=2) + 1.0
        odds = np.log((count[1] + 0.5) / total[1]) - np.log((count[0] + 0.5) / total[0])
        n = count.sum(0)
        tables.append(np.where(n >= LEAST, odds * n / (n + 4.0), 0.0).clip(-4, 4).astype(F32))
    return tables[0], tables[1]


class Network:
    """Parameters, inputs of words, scores of windows, and training."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = 3 + 2 * EMB
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(F32)
        self.p = {
            "we": (0.05 * rng.standard_normal((WORD_BUCKETS, EMB))).astype(F32),
            "ge": (0.05 * rng.standard_normal((GRAM_BUCKETS, EMB))).astype(F32),
            "w": init(2, d, 3 * HIDDEN),
            "b": np.zeros((2, 3 * HIDDEN), F32),
            "u": 0.7 * init(2, HIDDEN, 3 * HIDDEN),
            "wa": init(2 * HIDDEN, ATTEND),
            "ba": np.zeros(ATTEND, F32),
            "va": init(ATTEND, 1)[:, 0],
            "wo": init(2 * HIDDEN, 1)[:, 0],
            "bo": np.zeros(1, F32),
        }
        self.stats = (np.zeros(STAT_WORDS, F32), np.zeros(STAT_GRAMS, F32))

    def inputs(self, words: Words, block: int = 32_768) -> np.ndarray:
        """One row of inputs per distinct word; the last row is of padding. In blocks, which bound the memory."""
        n = len(words.hashes)
        x = np.zeros((n + 1, 3 + 2 * EMB), F32)
        for a in range(0, n, block):
            part = words.part(a, min(n, a + block))
            size, owner, to = len(part.hashes), part.owner, x[a : a + block][: min(block, n - a)]
            to[:, 0] = self.stats[0][part.hashes.astype(np.uint32) & np.uint32(STAT_WORDS - 1)]
            odds = self.stats[1][part.grams & np.uint32(STAT_GRAMS - 1)]
            most = np.zeros(size, F32)
            np.maximum.at(most, owner, odds)
            count = np.maximum(part.counts, 1)
            to[:, 1], to[:, 2] = most, np.bincount(owner, odds, size) / count
            to[:, 3 : 3 + EMB] = self.p["we"][part.hashes.astype(np.uint32) & np.uint32(WORD_BUCKETS - 1)]
            buckets = part.grams & np.uint32(GRAM_BUCKETS - 1)
            for k in range(EMB):
                to[:, 3 + EMB + k] = np.bincount(owner, self.p["ge"][buckets, k], size) / np.sqrt(count)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        """(words + 1, 2, 3 HIDDEN): what each word adds to the gates of either direction."""
        out = np.empty((2, len(x), 3 * HIDDEN), self.p["w"].dtype)
        for k in range(2):  # without a second array of that size
            np.matmul(x, self.p["w"][k], out=out[k])
            out[k] += self.p["b"][k]
        return out.transpose(1, 0, 2)

    def states(self, gates: np.ndarray, codes: np.ndarray, keep: bool = False):
        """Hidden states (T, 2, B, HIDDEN) over windows of word numbers (B, T); -1 pads."""
        steps, size = codes.shape[1], codes.shape[0]
        h = np.zeros((2, size, HIDDEN), F32)
        out = np.empty((steps, 2, size, HIDDEN), F32)
        saved = []
        u, k = self.p["u"], HIDDEN
        for t in range(steps):
            ahead, back = codes[:, t], codes[:, steps - 1 - t]
            px = np.stack([gates[ahead, 0], gates[back, 1]])
            mask = np.stack([ahead >= 0, back >= 0])[:, :, None]
            g = h @ u
            zr = 1.0 / (1.0 + np.exp(-(px[..., : 2 * k] + g[..., : 2 * k])))
            z, r = zr[..., :k], zr[..., k:]
            n = np.tanh(px[..., 2 * k :] + r * g[..., 2 * k :])
            new = np.where(mask, n + z * (h - n), h)
            if keep:
                saved.append((h, z, r, n, g[..., 2 * k :], mask))
            h = new
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return out, saved

    def pool(self, out: np.ndarray, codes: np.ndarray):
        joined = out.transpose(2, 0, 1, 3).reshape(codes.shape[0], codes.shape[1], 2 * HIDDEN)
        inner = np.tanh(joined @ self.p["wa"] + self.p["ba"])
        score = np.where(codes >= 0, inner @ self.p["va"], F32(-1e9))
        weight = np.exp(score - score.max(1, keepdims=True)) * (codes >= 0)
        weight /= np.maximum(weight.sum(1, keepdims=True), F32(1e-9))
        pooled = np.einsum("bt,bth->bh", weight, joined)
        return pooled @ self.p["wo"] + self.p["bo"], pooled, weight, inner, joined

    def logits(self, gates: np.ndarray, codes: np.ndarray, block: int = 2048) -> np.ndarray:
        """The logit of each window."""
        out = [self.pool(self.states(gates, part)[0], part)[0] for part in (codes[k : k + block] for k in range(0, len(codes), block))]
        return np.concatenate(out) if out else np.zeros(0, F32)

    def gradients(self, x: np.ndarray, words: Words, codes: np.ndarray, labels: np.ndarray) -> tuple[dict, float]:
        p, k = self.p, HIDDEN
        gates = self.project(x)
        out, saved = self.states(gates, codes, keep=True)
        logit, pooled, weight, inner, joined = self.pool(out, codes)
        prob = 1.0 / (1.0 + np.exp(-logit))
        size, steps = codes.shape
        g: dict[str, np.ndarray] = {}
        dl = ((prob - labels) / size).astype(F32)
        g["bo"], g["wo"] = dl.sum(keepdims=True), pooled.T @ dl
        dp = dl[:, None] * p["wo"]
        dw = np.einsum("bh,bth->bt", dp, joined)
        ds = weight * (dw - (weight * dw).sum(1, keepdims=True))
        di = ds[:, :, None] * p["va"] * (1 - inner**2)
        g["va"] = np.einsum("bt,bta->a", ds, inner)
        g["wa"], g["ba"] = np.einsum("bth,bta->ha", joined, di), di.sum((0, 1))
        dj = weight[:, :, None] * dp[:, None, :] + di @ p["wa"].T
        dout = dj.reshape(size, steps, 2, k).transpose(1, 2, 0, 3)
        dh = np.zeros((2, size, k), F32)
        dpx = np.empty((steps, 2, size, 3 * k), F32)
        g["u"] = np.zeros_like(p["u"])
        for t in range(steps - 1, -1, -1):
            h, z, r, n, gn, mask = saved[t]
            dh = dh + np.stack([dout[t, 0], dout[steps - 1 - t, 1]])
            dn = np.where(mask, dh, 0)
            dz = dn * (h - n) * z * (1 - z)
            before = np.where(mask, 0, dh) + dn * z
            dn = dn * (1 - z) * (1 - n**2)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], -1)
            dpx[t] = np.concatenate([dz, dr, dn], -1)
            g["u"] += h.transpose(0, 2, 1) @ dg
            dh = before + dg @ p["u"].transpose(0, 2, 1)
        dgate = np.zeros_like(gates)
        np.add.at(dgate[:, 0], codes.T, dpx[:, 0])
        np.add.at(dgate[:, 1], codes.T[::-1], dpx[:, 1])
        dgate[-1] = 0
        g["b"] = dgate.sum(0)
        g["w"] = np.einsum("vd,vkh->kdh", x, dgate, optimize=True)
        dx = np.einsum("vkh,kdh->vd", dgate, p["w"], optimize=True)[:-1]
        g["we"] = np.zeros_like(p["we"])
        np.add.at(g["we"], words.hashes.astype(np.uint32) & np.uint32(WORD_BUCKETS - 1), dx[:, 3 : 3 + EMB])
        count = np.sqrt(np.maximum(words.counts, 1))[:, None]
        g["ge"] = np.zeros_like(p["ge"])
        np.add.at(g["ge"], words.grams & np.uint32(GRAM_BUCKETS - 1), (dx[:, 3 + EMB :] / count)[words.owner])
        loss = float(-(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9)).mean())
        return g, loss

    def train(self, words: Words, codes: np.ndarray, labels: np.ndarray, epochs: int = 4, least: int = 160, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over `epochs` passes, or as many more as make `least` steps of a small sample."""
        rng = np.random.default_rng(seed)
        used = np.unique(codes[codes >= 0])
        words, codes = words.take(used), np.where(codes >= 0, np.searchsorted(used, codes), -1)
        size = min(192, max(24, len(codes) // 4))
        epochs = max(epochs, -(-least * size // max(len(codes), 1)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, step = [], 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), size):
                at = order[k : k + size]
                part = codes[at]
                used = np.unique(part[part >= 0])
                own = words.take(used)
                part = np.where(part >= 0, np.searchsorted(used, part), -1)
                g, loss = self.gradients(self.inputs(own), own, part, labels[at].astype(F32))
                step += 1
                for name, grad in g.items():
                    m[name] += 0.1 * (grad - m[name])
                    v[name] += 0.01 * (grad * grad - v[name])
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(F32)
                losses.append(loss)
        return losses


def windows(codes: np.ndarray, offsets: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(text, word numbers) of every overlapping window; together they cover all words; a text without words has none."""
    sizes = np.diff(offsets)
    count = np.where(sizes == 0, 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    found = np.full((len(text), WINDOW), -1, np.int32)
    for a in range(0, len(text), block):  # the places of all windows at once would take several times the memory of the result
        own = text[a : a + block]
        at = (nth[a : a + block] * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < sizes[own][:, None]
        found[a : a + block][inside] = codes[(at + offsets[:-1][own][:, None])[inside]]
    return text, found
