"""Nearest vectors by largest inner product: a forest of random-projection trees and a shared priority queue.

1. Vectors are brought to one length (a last coordinate fills them up, queries are scaled), where the largest inner
   product is the smallest distance.
2. Each tree has an orthonormal basis of its own, one random direction a level, and a threshold a node, the median of
   a bounded sample. Every row belongs to one leaf of each tree.
3. A query keeps one priority queue over the nodes of all trees. A node's key is the sum of the squared margins by
   which the query lies on the other side of its ancestors' thresholds, which no point below it can undercut as a
   squared distance. The queue stops at the first key above c r^2, r being the distance of the k-th neighbour
   estimated from the sample. c is fitted: for neighbours in the sample it is the quantile of (least key among the
   trees) / (squared distance) that keeps the wanted share of them. How far a search goes depends on the data and not on
   a fixed number of leaves; with neighbours nearer than the sample's it errs towards more.
4. Leaves are joined with the queries that chose them, shard by shard, and all candidates are ranked by the inner
   products of the original vectors in double precision.

Copies of one vector beyond the k + 1 smallest ids can be in no answer; they are left out before anything is dealt,
and equal queries are searched once, so copies do not meet in pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.session import cut

TREES = 2
#: Share of the sample's neighbours that the stopping rule keeps.
RECALL = 0.96
#: Rows of a leaf on average, and of a shard (neighbouring leaves of a tree); a table of one shard is one leaf.
LEAF, SHARD = 128, 8_192
#: Rows and components of the sample that thresholds and distances are taken from; it bounds the fit, not the search.
SAMPLE, SAMPLE_VALUES = 65_536, 1 << 22
#: Sample rows that a leaf is grown from at least, and rows of the sample that a query is compared with.
GROWN, PROBE = 8, 4_096
#: Rows of the sample that the stopping rule is fitted on, and neighbours of each.
FITTED, NEAR = 1_024, 20
#: Points and queries of one task; larger shards are divided by hash, every part meeting every part.
POINTS, QUERIES = 16_384, 16_384
#: Queries that a task ranks at once.
SLICE = 512


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix in double precision; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Forest:
    """Trees over a sample: `bases` (width + 1, depth) and `edges`, for each tree the thresholds of each level."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, trees: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.longest, self.rows = longest, rows
        self.width = sample.shape[1] + 1
        raised = self.raised(sample)
        wanted = int(np.ceil(np.log2(rows / LEAF))) if rows > SHARD else 0
        self.depth = max(0, min(wanted, int(np.log2(max(1, len(sample) / GROWN)))))
        self.shard_depth = min(self.depth, max(0, int(np.ceil(np.log2(rows / SHARD))))) if self.depth else 0
        self.trees = trees if self.depth else 1
        self.bases, self.edges = [], []
        for _ in range(self.trees):
            sets = [np.linalg.qr(rng.normal(size=(self.width, self.width)))[0] for _ in range(-(-self.depth // self.width))]
            basis = np.concatenate([np.zeros((self.width, 0)), *sets], axis=1)[:, : self.depth]
            self.bases.append(basis)
            self.edges.append(self._medians(raised @ basis))
        self.probe = raised[: min(len(raised), PROBE)]
        # the k-th of all rows is about the (k * share)-th of the probe; two deviations more keep the estimate above it
        self.share = len(self.probe) / max(rows, 1)
        self.stretch = self._fitted(sample, raised) if self.depth else 0.0

    def _fitted(self, sample: np.ndarray, raised: np.ndarray) -> float:
        """The quantile RECALL of least key / squared distance, over pairs of a sample row and a near other one."""
        asking = np.arange(0, len(sample), max(1, len(sample) // FITTED))
        ratios = []
        for rows in np.array_split(asking, max(1, len(asking) // 64)):
            aimed = self.aimed(sample[rows])
            apart = 2 - 2 * (aimed @ raised.T)
            apart[np.arange(len(rows)), rows] = np.inf
            near = np.argpartition(apart, min(NEAR, len(sample) - 1) - 1, axis=1)[:, :NEAR]
            least = np.full(near.shape, np.inf)
            for basis, edges in zip(self.bases, self.edges):
                mine, theirs = aimed @ basis, raised[near.ravel()] @ basis
                least = np.minimum(least, self._keys(np.repeat(mine, near.shape[1], axis=0), theirs, edges).reshape(near.shape))
            ratios.append((least / np.maximum(np.take_along_axis(apart, near, axis=1), 1e-12)).ravel())
        return float(np.quantile(np.concatenate(ratios), RECALL))

    def _keys(self, mine: np.ndarray, theirs: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        """The key that a search from `mine` gives to the leaf of `theirs`, row by row."""
        node = np.zeros(len(mine), np.int64)
        sums, before = np.zeros(len(mine)), np.zeros(len(mine))
        for level, edge in enumerate(edges):
            if level and level % self.width == 0:
                before, sums = np.maximum(before, sums), np.zeros(len(mine))
            margin, side = mine[:, level] - edge[node], theirs[:, level] >= edge[node]
            sums = sums + np.where((margin >= 0) != side, margin * margin, 0.0)
            node = 2 * node + side
        return np.maximum(before, sums)

    def _medians(self, places: np.ndarray) -> list[np.ndarray]:
        at, edges = np.zeros(len(places), np.int64), []
        for level in range(self.depth):
            edge = np.zeros(1 << level)
            order = np.lexsort((places[:, level], at))
            ends = np.searchsorted(at[order], np.arange((1 << level) + 1))
            full = ends[1:] > ends[:-1]
            edge[full] = places[order[((ends[1:] + ends[:-1]) // 2)[full]], level]
            edges.append(edge)
            at = 2 * at + (places[:, level] >= edge[at])
        return edges

    def raised(self, vectors: np.ndarray) -> np.ndarray:
        """Points scaled to at most length one, the last coordinate filling them up to it."""
        scaled = vectors / self.longest
        return np.concatenate([scaled, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))[:, None]], axis=1)

    def aimed(self, vectors: np.ndarray) -> np.ndarray:
        """Queries scaled to length one; their last coordinate is zero."""
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        scaled /= np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        return np.concatenate([scaled, np.zeros((len(scaled), 1))], axis=1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        raised, out = self.raised(vectors), np.zeros((self.trees, len(vectors)), np.int32)
        for t, (basis, edges) in enumerate(zip(self.bases, self.edges)):
            places = raised @ basis
            for level, edge in enumerate(edges):
                out[t] = 2 * out[t] + (places[:, level] >= edge[out[t]])
        return out

    def reach(self, aimed: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of each query's k-th neighbour, estimated from the probe, not too small."""
        near = k * self.share
        rank = min(len(self.probe), int(np.ceil(near + 2 * np.sqrt(near) + 1)), k + 1)
        return np.partition(2 - 2 * (aimed @ self.probe.T), rank - 1, axis=1)[:, rank - 1]

    def search(self, vectors: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the leaves to look at, numbered through all trees (tree * leaves + leaf)."""
        if not self.depth:
            return [np.zeros(1, np.int32)] * len(vectors)
        aimed = self.aimed(vectors)
        limits = self.stretch * np.maximum(self.reach(aimed, k), 0) + 1e-12
        places = np.stack([aimed @ basis for basis in self.bases], axis=1).tolist()
        edges = [[level.tolist() for level in tree] for tree in self.edges]
        return [self._queue(p, limit, edges) for p, limit in zip(places, limits.tolist())]

    def _queue(self, places: list, limit: float, edges: list) -> np.ndarray:
        found, depth, width = [], self.depth, self.width
        # (key, tree, level, node, squared margins in the basis at hand, the most of an earlier basis)
        queue = [(0.0, t, 0, 0, 0.0, 0.0) for t in range(self.trees)]
        while queue:
            key, tree, level, node, sums, before = heapq.heappop(queue)
            if key > limit:
                break
            while level < depth:  # down the near side; the far sides wait in the queue
                if level and level % width == 0:
                    before, sums = max(before, sums), 0.0
                margin = places[tree][level] - edges[tree][level][node]
                away = sums + margin * margin
                near = 2 * node + (margin >= 0)
                level += 1
                if (far := max(before, away)) <= limit:
                    heapq.heappush(queue, (far, tree, level, near ^ 1, away, before))
                node = near
            found.append((tree << depth) + node)
        return np.array(found, np.int32)


def usable(vectors: DataFrame, embedding: str, vec_id: str) -> DataFrame:
    """vec_id and vec of the rows that take part."""
    vec = F.col("vec")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & vec.isNotNull() & F.forall(vec, number) & F.exists(vec, lambda x: x != 0))


def without_spare_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows less those that k + 1 rows of the same vector and smaller ids precede.

    Hashes find the vectors that may have so many copies; only their rows are moved and compared, and the limit of
    the window is applied before they are.
    """
    hashed = rows.withColumn("h", F.xxhash64("vec"))
    many = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select(F.col("h").alias("_h")), "copied")
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = hashed.join(many, hashed["h"] == many["_h"], "left_anti").select("vec_id", "vec")
    copied = hashed.join(many, hashed["h"] == many["_h"], "left_semi").select("vec_id", "vec").dropDuplicates()
    return few.unionByName(copied.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1).select("vec_id", "vec"))


def grow_forest(points: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest | None:
    """The forest of points, from a sample of at most `sample` rows and SAMPLE_VALUES components chosen by hash."""
    facts = points.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    rows, width, square = facts
    if not rows:
        return None
    most = max(2, min(sample, SAMPLE_VALUES // max(width, 1)))
    part = max(1, -(-rows // most))
    chosen = points.filter(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0) if part > 1 else points
    taken = padded(chosen.select("vec").limit(2 * most).toArrow().column("vec"), width)
    if not len(taken):
        taken = padded(points.select("vec").limit(1).toArrow().column("vec"), width)
    longest = float(np.sqrt(square)) if np.isfinite(square) and square > 0 else float(np.abs(taken).max() * np.sqrt(width) * 4)
    return Forest(taken, rows, longest, trees)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


def ranked(points: np.ndarray, ids: np.ndarray, leaf: np.ndarray, queries: np.ndarray, asks: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): the k best points of the leaves that each query asks for, by score, then id."""
    order = np.argsort(leaf, kind="stable")
    points, ids, leaf = points[order], ids[order], leaf[order]
    names, starts = np.unique(leaf, return_index=True)
    ends = np.append(starts[1:], len(leaf))
    loose = 1e-12 * points.shape[1] * np.sqrt(np.einsum("ij,ij->i", points, points).max()) if len(points) else 0.0
    for a in range(0, len(queries), SLICE):
        mine = queries[a : a + SLICE]
        who = np.repeat(np.arange(len(mine)), [len(x) for x in asks[a : a + SLICE]])
        what = np.concatenate([*asks[a : a + SLICE], np.zeros(0, np.int32)])
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        spans = [(x, y, who[i:j]) for x, y, i, j in zip(starts, ends, np.searchsorted(what, names), np.searchsorted(what, names, "right")) if j > i]
        best = np.full((len(mine), k), -np.inf)
        for x, y, q in spans:
            best[q] = -np.partition(-np.concatenate([best[q], mine[q] @ points[x:y].T], axis=1), k - 1, axis=1)[:, :k]
        least = best.min(axis=1) - loose * np.sqrt(np.einsum("ij,ij->i", mine, mine))
        parts = []
        for x, y, q in spans:
            row, column = np.nonzero(mine[q] @ points[x:y].T >= least[q][:, None])
            parts.append((q[row], column + x))
        if not parts:
            continue
        row, column = (np.concatenate(p) for p in zip(*parts))
        score = np.concatenate([exact_products(mine[row[i : i + 65_536]], points[column[i : i + 65_536]]) for i in range(0, len(row), 65_536)] or [np.zeros(0)])
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], ids[column[order]], score[order]
        first = np.ones(len(row), np.bool_)  # a repeated id counts once, with its best score
        back = np.lexsort((np.arange(len(row)), column, row))
        same = (row[back][1:] == row[back][:-1]) & (column[back][1:] == column[back][:-1])
        first[back[1:][same]] = False
        row, column, score = row[first], column[first], score[first]
        begins = np.searchsorted(row, np.arange(len(mine) + 1))
        for i in range(len(mine)):
            stop = min(begins[i + 1], begins[i] + k)
            if stop > begins[i]:
                yield a + i, column[begins[i] : stop], score[begins[i] : stop]


def nearest(vectors: DataFrame, query: F.Column, k: int = 20, embedding: str = "embedding", vec_id: str = "vec_id", trees: int = TREES, forest: Forest | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each row that `query` (a condition on vec_id) marks.

    Nearness is the largest inner product in double precision, ties go to the smaller id. Rows take no part whose
    vector is null, zero, or holds null or a component that is not finite, and rows without an id. A query is not its own
    neighbour; rows that repeat an id are one candidate with its best score. Shorter vectors count as ending in
    zeros. With fewer than k other rows all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, embedding, vec_id)
    kind = rows.schema["vec"].dataType.simpleString()
    points = without_spare_copies(rows, k)
    forest = forest or grow_forest(points, trees)
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, depth, keep = forest.width - 1, forest.depth, k + 1
    below = depth - forest.shard_depth
    sent = spark.sparkContext.broadcast(forest)

    asked = rows.filter(query).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    # each vector once, under a number of its own that is written with it; few rows that cost much work, dealt to all cores
    texts = cut(asked.select("vec").distinct().repartition(spark.sparkContext.defaultParallelism).withColumn("id", F.monotonically_increasing_id()), "queries")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                row, shard, asks = [], [], []
                for i, found in enumerate(sent.value.search(padded(part.column("vec"), width), k)):
                    found.sort()
                    names, starts = np.unique(found >> below, return_index=True)
                    row += [i] * len(names)
                    shard += names.tolist()
                    asks += [x.tobytes() for x in np.split(found, starts[1:])]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column("id").take(at), pa.array(asks, pa.binary()), part.column("vec").take(at)], names=["shard", "id", "asks", "vec"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.leaves(padded(batch.column("vec"), width))
            for t in range(len(leaf)):
                numbers = leaf[t] + np.int32(t << depth)
                yield pa.RecordBatch.from_arrays([pa.array(numbers >> below), batch.column("vec_id"), pa.array([x.tobytes() for x in numbers], pa.binary()), batch.column("vec")], names=["shard", "id", "asks", "vec"])

    shape = f"shard int, id long, asks binary, vec {kind}"
    visits = cut(texts.select("id", "vec").mapInArrow(visit, shape), "visits")
    dealt = points.select("vec_id", "vec").mapInArrow(deal, shape)
    # the parts of each shard: at most trees * 2^depth rows, a size that the sample bounds
    sizes = points.select("vec_id", "vec").mapInArrow(deal, shape).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select(F.col("shard").alias("_shard"), F.ceil(F.col("n") / POINTS).cast("int").alias("p_parts"))
    loads = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_parts")).withColumnRenamed("shard", "_q")
    plan = F.broadcast(cut(parts.join(loads, parts["_shard"] == loads["_q"]).select("_shard", "p_parts", "q_parts"), "parts"))

    def sides(of: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine, all_of = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        named = [(all_of if is_query else mine).alias("p"), (mine if is_query else all_of).alias("q")]
        return of.join(plan, of["shard"] == plan["_shard"]).select("shard", *named, F.lit(is_query).alias("asking"), "id", "asks", "vec")

    def rank(table: pa.Table) -> pa.Table:
        asking = table.column("asking").to_numpy()
        p, q = table.filter(pa.array(~asking)), table.filter(pa.array(asking))
        out: tuple[list, list, list] = ([], [], [])
        if p.num_rows and q.num_rows:
            asks = [np.frombuffer(x, np.int32) for x in q.column("asks").to_pylist()]
            leaf = np.frombuffer(b"".join(p.column("asks").to_pylist()), np.int32)
            names = q.column("id").to_pylist()
            for i, ids, scores in ranked(padded(p.column("vec"), width), p.column("id").to_numpy(), leaf, padded(q.column("vec"), width), asks, keep):
                out[0].append(names[i])
                out[1].append(ids)
                out[2].append(scores)
        return pa.table({"id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "scores": pa.array(out[2], pa.list_(pa.float64()))})

    both = sides(dealt, "p_parts", "q_parts", False).unionByName(sides(visits, "q_parts", "p_parts", True))
    found = both.groupBy("shard", "p", "q").applyInArrow(rank, "id long, ids array<long>, scores array<double>")
    one = found.select("id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    best = one.withColumn("_place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_place") <= keep)
    # sorting negated scores sorts by score from the largest, then by id; at most k + 1 entries a query
    lists = cut(best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best")), "nearest")
    known = asked.join(texts.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select("query_id", F.col("id").alias("_id"))
    answers = known.join(lists, known["_id"] == lists["id"]).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("_place", "x")).select("query_id", (F.col("_place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
