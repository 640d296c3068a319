"""SimHash near-duplicates with vantage-point trees.

1. Each text becomes a 64-bit fingerprint in an Arrow kernel; from then on only ids and fingerprints move.
2. Fingerprints are made distinct, each with its smallest doc_id.
3. Two trees deal them into shards. If two fingerprints differ in at most R bits, their upper or their lower
   halves differ in at most R // 2, so one tree searches upper halves and the other lower halves, each with
   radius R // 2. A node holds a vantage point and a distance; a fingerprint goes to its own side, and also to
   the other wherever the triangle bound cannot exclude a partner there. With R // 2 = 1 the shards beyond the
   border are looked up exactly: those where one of the 32 halves that differ in one bit is at home, so a
   fingerprint visits 33 shards of a tree at most, however many there are. Where half a fingerprint no longer
   separates points (many share it), the tree goes on with whole fingerprints and radius R. The trees are
   grown from a sample that keeps pace with the input (one in 512, up to SAMPLE_MOST), so shards keep their size.
4. In a shard the same rule goes on in memory down to small leaves, where pairs are compared exactly. A shard
   returns a spanning forest of its links, never all pairs.
5. Components come from contraction rounds over those links; no link, component or fingerprint set is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.session import cut

SEED = 42
BITS = 3
SHINGLE = 3
#: Distinct fingerprints a shard holds on average (its own, without visitors).
SHARD = 8_192
#: Fingerprints the trees are grown from: at least SAMPLE, 16 a shard, at most SAMPLE_MOST (32 MB). The sample bounds
#: the driver's memory and the trees' (some 25 bytes a shard in a task), not what is searched.
SAMPLE, SAMPLE_MOST = 20_000, 1 << 22
#: In a shard, leaves of so many points are compared pair by pair.
LEAF = 384
BLOCK = 4096
HIGH, LOW, ALL = np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8; bytes.lower() and bytes.split() know ASCII letters and white space only."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.zeros(len(found), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(kernel, "doc_id long, fp long")


def distance(a: np.ndarray, b, mask=ALL) -> np.ndarray:
    return np.bitwise_count(a ^ b if mask is ALL else (a ^ b) & mask)


def split(points: np.ndarray, choices: np.ndarray, masks: list) -> tuple | None:
    """The vantage point, mask, radius and cut distance with the fewest points on both sides, or None.

    None if even the best leaves a side with nearly all points: there the triangle bound prunes nothing.
    """
    for mask, radius in masks:
        best = None
        for vantage in choices:
            d = distance(points, vantage, mask).astype(np.int64)
            middle = int(np.partition(d, len(d) // 2)[len(d) // 2])
            for edge in (middle, middle + 1):
                inside, outside = np.count_nonzero(d - radius < edge), np.count_nonzero(d + radius >= edge)
                if max(inside, outside) <= 0.9 * len(d) and (best is None or inside + outside < best[0]):
                    best = (inside + outside, (vantage, mask, radius, edge))
        if best is not None:
            return best[1]
    return None


def sides(points: np.ndarray, home: np.ndarray, node: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which points go inside and outside, and for which that is their home. A visitor may go to both."""
    vantage, mask, radius, edge = node
    d = distance(points, vantage, mask).astype(np.int64)
    return [(d - radius < edge, home & (d < edge)), (d + radius >= edge, home & (d >= edge))]


def sampled(points: np.ndarray, rng) -> np.ndarray:
    return points if len(points) < 4096 else rng.choice(points, 4096, replace=False)


def grow(sample: np.ndarray, leaf: int, masks: list, numbers: Iterator[int], rng):
    """A tree over the sample as nested tuples (node, inside, outside); a leaf is its number."""
    if len(sample) > leaf and (node := split(sampled(sample, rng), rng.choice(sample, min(12, len(sample)), replace=False), masks)) is not None:
        d = distance(sample, node[0], node[1])
        return node, grow(sample[d < node[3]], leaf, masks, numbers, rng), grow(sample[d >= node[3]], leaf, masks, numbers, rng)
    return next(numbers)


def deal(tree, points: np.ndarray, index: np.ndarray, home: np.ndarray, out: list) -> None:
    """Append (leaf, index, home) for every leaf that a point belongs to or, by the triangle bound, visits."""
    if isinstance(tree, int):
        out.append((tree, index, home))
        return
    node, *below = tree
    for k, (goes, own) in enumerate(sides(points, home, node)):
        if goes.any():
            deal(below[k], points[goes], index[goes], own[goes], out)


class Tree:
    """A vantage-point tree over one half of the fingerprints, in arrays; a leaf may go on as a tree over whole ones."""

    def __init__(self, sample: np.ndarray, leaf: int, half: np.uint64, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half, self.bits, self.radius = half, bits, bits // 2
        vantage, edge, below = [], [], []
        self.deeper: dict[int, object] = {}
        self.leaves = 0
        stack = [(sample, -1, 0)]
        while stack:
            points, parent, side = stack.pop()
            node = split(sampled(points, rng), rng.choice(points, min(12, len(points)), replace=False), [(half, self.radius)]) if len(points) > leaf else None
            if node is None:
                name = -(self.leaves + 1)
                if len(points) > leaf:
                    self.deeper[self.leaves] = grow(points, leaf, [(ALL, bits)], count(), rng)
                self.leaves += 1
            else:
                name = len(vantage)
                vantage.append(node[0])
                edge.append(node[3])
                below.append([0, 0])
                d = distance(points, node[0], half)
                stack += [(points[d < node[3]], name, 0), (points[d >= node[3]], name, 1)]
            if parent >= 0:
                below[parent][side] = name
        self.vantage, self.edge = np.array(vantage, np.uint64), np.array(edge, np.uint8)
        self.below = np.array(below, np.int32).reshape(-1, 2)

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point belongs to."""
        at = np.zeros(len(points), np.int32) if len(self.vantage) else np.full(len(points), -1, np.int32)
        live = np.nonzero(at >= 0)[0]
        while len(live):
            here = at[live]
            at[live] = self.below[here, (distance(points[live], self.vantage[here], self.half) >= self.edge[here]).astype(np.int8)]
            live = live[at[live] >= 0]
        return -1 - at.astype(np.int64)

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home) of every leaf of this tree where a point belongs or can have a partner."""
        if self.radius > 1:
            return self._by_bound(points)
        flips = np.array([0] + [1 << k for k in range(64) if int(self.half) >> k & 1], np.uint64)[: 1 if self.radius == 0 else None]
        parts = []
        for a in range(0, len(points), BLOCK):
            leaf = self.homes((points[a : a + BLOCK, None] ^ flips[None, :]).ravel()).reshape(-1, len(flips))
            index = np.repeat(np.arange(a, a + len(leaf)), len(flips))
            key = np.unique(index * np.int64(self.leaves) + leaf.ravel())
            own, found = key // self.leaves, key % self.leaves
            parts.append((own, found, found == leaf[own - a, 0]))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_))

    def _by_bound(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(0 if len(self.vantage) else -1, np.arange(len(points)), np.ones(len(points), np.bool_))]
        while stack:
            at, index, home = stack.pop()
            if at < 0:
                out.append((index, np.full(len(index), -1 - at, np.int64), home))
                continue
            for k, (goes, own) in enumerate(sides(points[index], home, (self.vantage[at], self.half, self.radius, int(self.edge[at])))):
                if goes.any():
                    stack.append((int(self.below[at, k]), index[goes], own[goes]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home): visits(), and below leaves that go on, the leaves of their trees."""
        index, leaf, home = self.visits(points)
        if not self.deeper:
            return index, leaf << 24, home
        plain = ~np.isin(leaf, np.fromiter(self.deeper, np.int64))
        parts = [(index[plain], leaf[plain] << 24, home[plain])]
        for number in np.unique(leaf[~plain]).tolist():
            own = leaf == number
            out: list = []
            deal(self.deeper[number], points[index[own]], index[own], home[own], out)
            parts += [(i, np.full(len(i), (number << 24) + k, np.int64), h) for k, i, h in out]
        return tuple(np.concatenate(x) for x in zip(*parts))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            q = self.up[r]
            if np.array_equal(q, r):
                break
            r = q
        self.up[at] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def search(points: np.ndarray, index: np.ndarray, home: np.ndarray, masks: list, bits: int, forest: Forest, rng) -> None:
    """Link every pair within `bits` that has a point at home here; exact."""
    if not home.any() or len(points) < 2:
        return
    middle = points[rng.integers(len(points))]
    near = distance(points, middle) <= bits // 2
    if near.all():  # any two are within `bits` of each other
        forest.link(index, np.full(len(index), index[0]))
        return
    if len(points) > LEAF:
        node = split(sampled(points, rng), rng.choice(points, 6), masks)
        if node is not None:
            for goes, own in sides(points, home, node):
                if own.any():
                    search(points[goes], index[goes], own[goes], masks, bits, forest, rng)
            return
    mine, at = points[home], index[home]
    step = max(1, 2_000_000 // len(points))
    for k in range(0, len(mine), step):
        a, b = np.nonzero(distance(mine[k : k + step, None], points[None, :]) <= bits)
        forest.link(at[k : k + step][a], index[b])


def _masks(tree: int, bits: int) -> list:
    return [(HIGH if tree == 0 else LOW, bits // 2), (ALL, bits)]


def shard_trees(distinct: DataFrame, bits: int, sample: int, most: int, shard: int) -> list[Tree]:
    n = distinct.count()
    wanted = min(max(sample, 16 * n // shard), most)
    part = max(1, -(-n // wanted))
    chosen = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0) if part > 1 else distinct
    taken = chosen.select("fp").limit(2 * wanted).toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64)  # 8 bytes each
    leaf = max(16, int(len(taken) * shard / max(n, 1)))
    return [Tree(taken, leaf, half, bits) for half in (HIGH, LOW)]


def shard_links(distinct: DataFrame, bits: int = BITS, sample: int = SAMPLE, shard: int = SHARD, most: int = SAMPLE_MOST) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`: a spanning forest of each shard's pairs."""
    trees = distinct.sparkSession.sparkContext.broadcast(shard_trees(distinct, bits, sample, most, shard))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(trees.value):
                index, number, home = tree.shards(points)
                columns = [pa.array(np.full(len(index), t, np.int32)), pa.array(number), pa.array(points[index].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "shard", "fp", "home"])

    def join(table: pa.Table) -> pa.Table:
        points, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        forest = Forest(len(points))
        search(points, np.arange(len(points)), home, _masks(table.column("tree")[0].as_py(), bits), bits, forest, np.random.default_rng(11))
        root = forest.roots(np.arange(len(points)))
        linked = root != np.arange(len(points))
        return pa.table({"a": pa.array(points[linked].view(np.int64)), "b": pa.array(points[root[linked]].view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(spread, "tree int, shard long, fp long, home boolean")
    return dealt.groupBy("tree", "shard").applyInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links, root being the smallest node it is connected to.

    Each round gives every node the smallest id among itself and its neighbours, follows such pointers once
    more, and replaces the ends of each link by them; links inside one group vanish. Nodes drop out as they
    merge, so rounds grow with the logarithm of a component's width. Only counts reach the driver. The two
    joins of a round read written tables, so hot nodes are split by adaptive execution.
    """
    live = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while live.limit(1).count():
        ends = live.select("a", "b").union(live.select("b", "a"))
        least = cut(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "least")
        hop = least.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        moved = cut(least.join(hop, least["to"] == hop["n2"], "left").select("node", F.coalesce("t2", "to").alias("to")), "moved")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("root"))
        else:
            labels = cut(labels.join(moved, labels["root"] == moved["node"], "left").select(labels["node"], F.coalesce("to", "root").alias("root")), "labels")
        left, right = moved.select(F.col("node").alias("na"), F.col("to").alias("ta")), moved.select(F.col("node").alias("nb"), F.col("to").alias("tb"))
        half = live.join(left, live["a"] == left["na"]).select("ta", "b")
        both = half.join(right, half["b"] == right["nb"]).filter("ta <> tb")
        live = cut(both.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id).

    Words are runs without ASCII white space, A-Z lower-cased; shingles count as often as they occur; a text
    with fewer words than a shingle is one shingle, and a text without words (or null) has fingerprint zero,
    linked like any other. Rows without an id link nothing; they get the component of the rows with an id that
    share their fingerprint, else null. Rows that repeat an id keep one row each, and their fingerprints are
    linked only by distance. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, text, doc_id), "fingerprints")
    distinct = prints.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = cut(distinct, "distinct")
    linked = cut(components(shard_links(distinct, bits)), "linked")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "_root")
    merged = cut(rooted.join(smallest, rooted["root"] == smallest["_root"]).select(F.col("fp").alias("_fp"), "component_id"), "merged")
    out = prints.join(merged, prints["fp"] == merged["_fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_near(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, its smallest id; rows without an id stay unless an id shares their component."""
    lost = simhash_groups(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_lost")).distinct()
    lost = cut(lost, "lost")
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost"]), "left_anti")
