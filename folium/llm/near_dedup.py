"""Near-duplicates by similarity: the pipeline's stage keeps one of all texts whose 5-word shingles agree.

1. Each text becomes the set of its 5-word shingles, and the set a fingerprint of four 64-bit SimHash words. Equal
   sets are one point from here on.
2. Points are searched for partners by vantage points and the triangle bound, and no pair within the bounds is left
   out. The first vantage point is the empty set: a set's distance from it is its size, and the sizes of similar sets
   differ by the factor SIMILAR at most. So points are dealt to bands of size, bands to blocks of bounded size, and
   every pair of blocks in reach of each other is a shard.
3. In a shard, balls around vantage points whose members are all within BITS of each other are linked at once.
   Vantage-point trees over the first words divide the rest wherever the triangle bound excludes any; what stays
   together is compared. Fingerprints of similar sets may differ in a quarter of their bits, where that bound seldom
   excludes unrelated texts, so the work grows with the square of the points in reach by size.
4. A shard returns a spanning forest of its links, contraction rounds make them groups of fingerprints. Texts
   that are similar and within the bounds are in one group, so the exact check needs no more than the groups.
5. In a group of more than BLOCK shingles all points are first compared with its leader, in SQL and in linear time;
   what is verified is joined. Then every group is searched as in 3 for pairs of different components, one of more
   than BLOCK shingles in pairs of blocks, and these are tested by the exact similarity of their shingle sets, the
   nearest first, and only while nothing joins the two: a shard returns a spanning forest of its links, so no group
   emits its pairs. Only the texts of groups are moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.decontamination import _mix
from folium.llm.simhash import ALL, LEAF, Forest, components, distance, sides, split
from folium.llm.words import slices, split_words
from folium.session import cut

WORDS = 5
SIMILAR = 0.8
#: Words of a fingerprint; most differing bits of all of them, and of the first alone. At similarity 0.8 some 39 of
#: 256 differ, with a standard deviation of 6; sets of under FEW shingles, whose bits are often tied, differ in more.
PRINT, LEADER = ["f1", "f2", "f3", "f4"], ["l1", "l2", "l3", "l4"]
BITS, FIRST, FEW, FEW_BITS = 72, 24, 8, 96
#: Logarithm of the sizes that a band spans: similar sets are at most REACH bands apart (the rest is for rounding).
REACH = 2
BAND = -math.log(SIMILAR) / REACH * (1 + 1e-9)
#: Points of a block: a part of all, but neither fewer nor more than these.
PART, LEAST, MOST = 32, 1024, 1 << 18
#: Vantage points of a shard whose balls are linked at once.
BALLS = 64
#: Shingles (8 bytes each) of a bucket that are searched together, and of the rows that one task searches.
BLOCK, TASK = 1 << 20, 1 << 21
#: Runs of up to so many points are compared without a tree.
SMALL = 32


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of fewer words than a shingle, the whole is one."""
    import xxhash

    codes, offsets, words = split_words(pc.ascii_lower(texts.cast(pa.string())))
    hashed = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in words], np.uint64)
    ids = hashed[codes] if len(words) else np.zeros(0, np.uint64)
    found = _mix(ids, WORDS)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        out.append(np.unique(found[a : b - WORDS + 1] if n >= WORDS else _mix(ids[a:b], n) if n else ids[:0]))
    return out


def _again(hashes: np.ndarray) -> np.ndarray:
    out = (hashes ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xC4CEB9FE1A85EC53)


#: A byte's lowest bit in each byte of a word; hashes that bytes can count; hashes that are counted together.
_LANES, _RUN, _TOGETHER = np.uint64(0x0101010101010101), 255, 1 << 15


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash words of each set, a row each, every word over hashes of its own.

    Every eighth bit of a hash becomes a byte of its own, so one addition counts eight bits, and many small sets are counted at once.
    """
    out = np.zeros((len(sets), len(PRINT)), np.uint64)
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.nonzero(sizes)[0]
    for at in np.split(full, np.nonzero(np.diff(np.cumsum(sizes[full]) // _TOGETHER))[0] + 1):
        if not len(at):
            continue
        hashes, n = np.concatenate([sets[k] for k in at]), sizes[at]
        runs = -(-n // _RUN)
        first = np.cumsum(runs) - runs
        starts = np.repeat(np.cumsum(n) - n - _RUN * first, runs) + _RUN * np.arange(runs.sum())
        ones = np.zeros((len(at), 8, 8), np.int64)
        for word in range(len(PRINT)):
            for shift in range(8):
                sums = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
                ones[:, :, shift] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            more = 2 * ones.reshape(-1, 64) > n[:, None]
            out[at, word] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
            hashes = _again(hashes)
    return out


def fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash words of one set."""
    return fingerprints([hashes])[0].tolist()


def prints_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (distinct shingles), same (a hash of the set) and the fingerprint's words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1))
                same = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                words = fingerprints(sets)
                longs = [pa.array(x.view(np.int64)) for x in (np.array(same, np.uint64), *np.ascontiguousarray(words.T))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), *longs], names=["doc_id", "text_key", "n", "same", *PRINT])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(docs["text"]).alias("text_key"))
    return plain.mapInArrow(kernel, "doc_id long, text_key long, n long, same long, f1 long, f2 long, f3 long, f4 long")


def text_key(text: Column) -> Column:
    """What tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def leaves(points: np.ndarray, index: np.ndarray, home: np.ndarray, rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, home) of the parts in which every pair within FIRST bits meets at the home of one of the two."""
    if not home.any():
        return
    if len(points) > LEAF:
        node = split(points if len(points) < 4096 else rng.choice(points, 4096, replace=False), rng.choice(points, 6), [(ALL, FIRST)])
        if node is not None:
            for goes, own in sides(points, home, node):
                yield from leaves(points[goes], index[goes], own[goes], rng)
            return
    yield index, home


def _far(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The differing bits of the fingerprints at i and j; f has a row for every word."""
    return sum(distance(words[i], words[j]).astype(np.int64) for words in f)


def _similar(n: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whether the sets at i and j may be similar, by their sizes and the differing bits."""
    least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (far <= np.where(least < FEW, FEW_BITS, BITS)) & (least >= SIMILAR * most - 1e-9)


def candidates(n: np.ndarray, f: np.ndarray, home: np.ndarray, other: np.ndarray, rng) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) of pairs of places, a at home and b of the others, that may be similar; if a place is both, a pair can come twice."""
    both = np.nonzero(home | other)[0]
    for index, own in leaves(f[0][both], both, home[both], rng):
        at, mine = index[other[index]], index[own]
        if not len(at):
            continue
        at, mine = at[np.argsort(n[at], kind="stable")], mine[np.argsort(n[mine], kind="stable")]
        sizes, firsts = n[at], f[0][at]
        low, high = np.searchsorted(sizes, np.ceil(SIMILAR * n[mine] - 1e-9)), np.searchsorted(sizes, np.floor(n[mine] / SIMILAR + 1e-9), "right")
        k = 0
        while k < len(mine):
            step = max(1, 1_000_000 // len(at))
            part = mine[k : k + step]
            a, b = int(low[k]), int(high[min(k + step, len(mine)) - 1])
            i, j = np.nonzero(distance(f[0][part][:, None], firsts[a:b][None, :]) <= FIRST)
            i, j = part[i], at[a + j]
            far = _far(f, i, j)
            good = (i != j) & _similar(n, i, j, far)
            yield i[good], j[good], far[good]
            k += step


def met_in(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the points of a shard's two blocks, or of its one, whose sets may be similar."""
    point, n, home = (table.column(c).to_numpy() for c in ("point", "n", "home"))
    f = np.stack([table.column(c).to_numpy() for c in PRINT]).view(np.uint64)
    other = home if table.column("lo")[0].as_py() == table.column("hi")[0].as_py() else ~home
    every, forest, rng = np.arange(len(n)), Forest(len(n)), np.random.default_rng(11)
    if home.any() and other.any():
        for k in rng.choice(len(n), min(BALLS, len(n)), replace=False):
            ball = np.nonzero(_far(f, every, k) <= BITS // 2)[0]
            forest.link(ball, np.full(len(ball), ball[0]))
        label = forest.roots(every)
        names, counts = np.unique(label, return_counts=True)
        large = names[counts > LEAF]  # within these nothing is left to find
        left = ~np.isin(label, large)
        for mine, with_ in [(home & left, other), *((home & (label == x), other & (label != x)) for x in large)]:
            for i, j, _ in candidates(n, f, mine, with_, rng):
                forest.link(i, j)
    root = forest.roots(every)
    linked = root != every
    return pa.table({"a": pa.array(point[linked]), "b": pa.array(point[root[linked]])})


def met(points: DataFrame) -> DataFrame:
    """Links (a, b) of points whose sets may be similar, a spanning forest of each shard: no such pair is left unconnected.

    points: (point, band, n, *PRINT), n > 0. The bands' counts reach the driver, nine bands for every factor e of size.
    A point goes to a shard for every block in its reach.
    """
    counts = dict(points.groupBy("band").count().collect())
    block = min(max(LEAST, sum(counts.values()) // PART), MOST)
    start, many = {}, {}
    for band in sorted(counts):
        start[band], many[band] = sum(many.values()), -(-counts[band] // block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, bands = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mixed = (point.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for band in np.unique(bands).tolist():
                rows = np.nonzero(bands == band)[0]
                own = start[band] + (mixed[rows] % np.uint64(many[band])).astype(np.int64)
                others = np.concatenate([start[b] + np.arange(many[b]) for b in range(band - REACH, band + REACH + 1) if b in many])
                for k in range(0, len(rows), max(1, 200_000 // len(others))):
                    part = slice(k, k + max(1, 200_000 // len(others)))
                    mine, partner = np.repeat(own[part], len(others)), np.tile(others, len(own[part]))
                    low = np.minimum(mine, partner)
                    held = batch.select(["point", "n", *PRINT]).take(pa.array(np.repeat(rows[part], len(others))))
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(np.maximum(mine, partner)), pa.array(mine == low), *held.columns], names=["lo", "hi", "home", *held.schema.names])

    dealt = points.select("point", "band", "n", *PRINT).mapInArrow(deal, "lo long, hi long, home boolean, point long, n long, f1 long, f2 long, f3 long, f4 long")
    return dealt.groupBy("lo", "hi").applyInArrow(met_in, "a long, b long")


def buckets_of(groups: DataFrame, points: DataFrame) -> DataFrame:
    """(key, point, n, *PRINT, lead, ln, l1, ...) of every point in a group (node, root), with its leader, the group's smallest point."""
    slim = points.select("point", "n", *PRINT)
    leaders = slim.toDF("lead", "ln", *LEADER)
    held = groups.select(F.col("node").alias("point"), F.col("root").alias("key"), F.col("root").alias("lead"))
    return held.join(slim, "point").join(leaders, "lead").select("key", "point", "n", *PRINT, "lead", "ln", *LEADER)


def led(buckets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): each point and its leader, if they may be similar."""
    far = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(PRINT, LEADER)), F.lit(0))
    least, most = F.least("n", "ln"), F.greatest("n", "ln")
    near = (least >= SIMILAR * most - 1e-9) & (far <= F.when(least < FEW, FEW_BITS).otherwise(BITS))
    return buckets.filter((F.col("point") != F.col("lead")) & near).select(F.col("point").alias("a"), F.col("lead").alias("b"))


def _pairs_in(key: np.ndarray, label: np.ndarray, n: np.ndarray, f: np.ndarray, rng) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of places in one run of equal keys each, with different labels, that may be similar; key is sorted."""
    edges = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
    sizes = np.diff(edges)
    at = np.nonzero(np.repeat(sizes <= SMALL, sizes))[0]
    for shift in range(1, SMALL):
        i, j = at[:-shift], at[shift:]
        good = key[i] == key[j]
        if not good.any():
            break
        i, j = i[good], j[good]
        good = label[i] != label[j]
        i, j = i[good], j[good]
        far = _far(f, i, j)
        good = _similar(n, i, j, far)
        yield i[good], j[good], far[good]
    for k in np.nonzero(sizes > SMALL)[0].tolist():
        run = slice(edges[k], edges[k + 1])
        names, counts = np.unique(label[run], return_counts=True)
        if len(names) > 1:  # of any pair of different labels, one has not the most frequent label
            for i, j, far in candidates(n[run], f[:, run], label[run] != names[counts.argmax()], np.ones(sizes[k], np.bool_), rng):
                good = label[run][i] != label[run][j]
                yield i[good] + edges[k], j[good] + edges[k], far[good]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def texts_of(wanted: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted, a table with a row for each wanted `point`, with `text`; only the texts of these are kept."""
    keys = cut(wanted.join(points.select("point", "text_key"), "point"), "wanted").withColumnRenamed("text_key", "_key")
    plain = docs.select(F.col("text").cast("string").alias("text"), text_key(docs["text"]).alias("text_key"))
    found = plain.join(keys, plain["text_key"] == keys["_key"])
    others = [F.first(c).alias(c) for c in wanted.columns if c != "point"]
    return found.groupBy("point").agg(F.min("text").alias("text"), *others)  # rows of one text_key have one text


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of points whose texts' shingle sets are similar. Only texts of points in a pair are moved."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ones, others = shingle_sets(part.column(2)), shingle_sets(part.column(3))
                yield part.select([0, 1]).filter(pa.array([similarity(x, y) >= SIMILAR for x, y in zip(ones, others)], pa.bool_()))

    texts = cut(texts_of(pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct(), points, docs).select("point", "text"), "texts")
    first = pairs.join(texts.withColumnsRenamed({"point": "a", "text": "text_a"}), "a")
    both = first.join(texts.withColumnsRenamed({"point": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(kernel, "a long, b long")


def sets_of(texts: DataFrame) -> DataFrame:
    """texts with `hashes`, the shingle set at 8 bytes a shingle, in place of `text`, which comes first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                hashes = pa.array([x.tobytes() for x in shingle_sets(part.column(0))], pa.binary())
                yield pa.RecordBatch.from_arrays([hashes, *part.columns[1:]], names=["hashes", *part.schema.names[1:]])

    others = texts.drop("text")
    return texts.select("text", *others.columns).mapInArrow(kernel, "hashes binary, " + ", ".join(f"{x} {kind}" for x, kind in others.dtypes))


def linked_in(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the similar pairs in every run of a shard: candidates by fingerprint, the nearest
    first, each tested by its exact similarity unless the forest or a common label joins the two already."""
    table = table.sort_by("run")
    run, point, label, n = (table.column(c).to_numpy() for c in ("run", "point", "label", "n"))
    f = np.stack([table.column(c).to_numpy() for c in PRINT]).view(np.uint64)
    hashes = table.column("hashes")
    held: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in held:
            if len(held) >= 20_000:
                held.clear()
            held[k] = np.frombuffer(hashes[k].as_buffer(), np.uint64)
        return held[k]

    names, own = np.unique(label, return_inverse=True)
    forest, out = Forest(len(names)), []
    for i, j, far in _pairs_in(run, label, n, f, np.random.default_rng(11)):
        order = np.argsort(far, kind="stable")
        for k in range(0, len(order), 4096):
            at = order[k : k + 4096]
            one, other = i[at], j[at]
            apart = np.nonzero(forest.roots(own[one]) != forest.roots(own[other]))[0]
            for x, y in zip(one[apart].tolist(), other[apart].tolist()):
                pair = own[[x, y]]
                roots = forest.roots(pair)
                if roots[0] != roots[1] and similarity(set_of(x), set_of(y)) >= SIMILAR:
                    forest.link(pair[:1], pair[1:])
                    out.append((max(point[x], point[y]), min(point[x], point[y])))
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def forests(buckets: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of similar points of different labels, a spanning forest of each shard; never all pairs.

    buckets: (key, point, label, n, *PRINT). Only points of buckets with several labels are moved, with their
    shingle sets. A bucket of over BLOCK shingles is dealt out as pairs of blocks, each a run of its own.
    """
    mixed = buckets.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.sum("n").alias("weight")).filter("_lo <> _hi").select("key", "weight")
    left = buckets.join(mixed, "key").withColumn("m", F.ceil(F.col("weight") / F.lit(BLOCK)).cast("int")).drop("weight")
    left = cut(left.withColumn("x", F.pmod(F.xxhash64("point"), F.col("m")).cast("int")), "mixed")
    tasks = max(1, -(-(left.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) // TASK))
    dealt = sets_of(texts_of(left, points, docs)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.withColumn("run", F.when(F.col("m") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("x", "other"), F.greatest("x", "other"))))
    shards = dealt.select(F.pmod(F.xxhash64("run"), F.lit(tasks)).alias("shard"), "run", "point", "label", "n", *PRINT, "hashes")
    return shards.groupBy("shard").applyInArrow(linked_in, "a long, b long")


def _labelled(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """buckets with `label`, the component of each point."""
    named = joined.withColumnsRenamed({"node": "_node", "root": "_root"})
    return buckets.join(named, buckets["point"] == named["_node"], "left").select(*buckets.columns, F.coalesce("_root", "point").alias("label"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, component (a number), keep_id and keep_key, the row that stays.

    Links are pairs whose sets of 5-word shingles (A-Z lower-cased) have a Jaccard similarity of SIMILAR or more;
    fewer words than a shingle are one shingle; null, empty and other texts without words are alike. The row with
    the smallest doc_id of a component stays, of several texts of that id the one with the smallest text_key; null
    ids stay only where there is no other. Rows that repeat id and text share their fate. Other columns are not
    read. An empty table gives an empty result.
    """
    prints = cut(prints_of(docs), "prints")
    sets = ["same", "n", *PRINT]
    points = prints.groupBy(*sets).agg(F.min("text_key").alias("text_key"))
    band = F.when(F.col("n") > 0, F.floor(F.log("n") / F.lit(BAND)).cast("long")).alias("band")
    points = cut(points.select("*", F.monotonically_increasing_id().alias("point"), band), "points")  # written once, so numbers stay
    groups = cut(components(met(points.filter("n > 0"))), "groups")
    buckets = cut(buckets_of(groups, points), "dealt")
    large = cut(buckets.groupBy("key").agg(F.sum("n").alias("weight")).filter(F.col("weight") > BLOCK).select("key"), "large")
    near = groups.toDF("a", "b").limit(0)
    if large.limit(1).count():
        near = cut(verified(cut(led(buckets.join(large, "key")), "led"), points, docs), "near")
    linked = cut(components(near), "linked")
    apart = _labelled(buckets.drop("lead", "ln", *LEADER), linked)
    rest = cut(forests(cut(apart, "labelled"), points, docs), "rest")
    if rest.limit(1).count():
        linked = cut(components(near.union(rest)), "linked")
    roots = cut(points.join(linked, points["point"] == linked["node"], "left").select(*sets, F.coalesce("root", "point").alias("component")), "roots")
    placed = cut(prints.join(roots, sets).select("doc_id", "text_key", "component"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key")).alias("_keep")
    keep = cut(placed.groupBy("component").agg(first).select(F.col("component").alias("_c"), "_keep"), "keep")
    return placed.join(keep, placed["component"] == keep["_c"]).select("doc_id", "text_key", "component", F.col("_keep.doc_id").alias("keep_id"), F.col("_keep.text_key").alias("keep_key"))


def keep_one_of_similar(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of similar texts: see similar_groups() for which, and for nulls and repeated rows."""
    groups = similar_groups(docs).filter(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))))
    lost = cut(groups.select(F.col("doc_id").alias("_lost"), F.col("text_key").alias("_key")).distinct(), "lost")
    return docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost["_lost"]) & (text_key(docs["text"]) == lost["_key"]), "left_anti")
