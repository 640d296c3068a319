"""The pipeline's near-dedup stage against brute force over sets of 5-word shingles."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import near_dedup as N
from tests.llm.test_near_and_leaks import docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                i, j = sorted((root(a), root(b)))
                up[j] = i
    return {i: root(i) for i in range(len(texts))}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = [None, "", "One two", "one TWO", "one two three"]
    for _ in range(50):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 12, 30, 100, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own + ["end"] * rng.randint(0, 2)))
    return texts


def test_groups_against_brute_force(spark, monkeypatch):
    texts = near_copies()
    expected = brute(texts)
    for block, small in ((N.BLOCK, N.SMALL), (400, 2)):  # one block a bucket, and pairs of blocks searched by trees
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "SMALL", small)
        assert {r["doc_id"]: r["keep_id"] for r in N.similar_groups(docs(spark, texts)).collect()} == expected


def test_large_bucket_of_near_copies(spark):
    """A third of the rows are copies with a word or two changed: one group, found without pairs of all of them."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(500):
        own = list(base)
        own[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1000)]
    got = {r["doc_id"]: r["keep_id"] for r in N.similar_groups(docs(spark, texts)).collect()}
    assert all(got[k] == 0 for k in range(500)) and all(got[k] == k for k in range(500, 1500))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(None, text), (5, text + " end"), (5, other), (5, other), (None, other + " end"), (None, None), (7, ""), (2, "x " * 40_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("point", F.lit(1)).withColumn("_lost", F.lit(2)).withColumn("text_key", F.lit(3))
    kept = N.keep_one_of_similar(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()) == [(2, "x x x x x"), (5, "other0 ot"), (5, "other0 ot"), (5, "word0 wor"), (7, "")]


def test_stage_keeps_one_of_near_copies(spark):
    text = " ".join(f"word{k}" for k in range(400))
    half = " ".join(f"word{k}" for k in range(200))
    kept = corpus_pipeline.near_dedup(spark, docs(spark, [text, text + " end", half, text.replace("word9 ", "other "), None]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4] and len(kept.columns) == 5
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), "").count() == 0


def test_similar_pairs_that_share_no_minwise_bucket(spark):
    """Two pairs at a similarity of 0.8 exactly, of which buckets by 20 keys of 5 min-wise samples find neither."""
    texts = []
    for seed in (8248, 19409):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(54)]
        texts += [" ".join(words), " ".join(words[:44])]
    assert {r["doc_id"]: r["keep_id"] for r in N.similar_groups(docs(spark, texts)).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_search_loses_no_pair_of_near_fingerprints(spark, monkeypatch):
    """Every pair within the bounds of size and bits is connected, over blocks and bands; only connected points are."""
    rng = random.Random(4)
    points = []
    for _ in range(300):
        n, prints = rng.choice([4, 5, 30, 40, 300]), [rng.getrandbits(64) for _ in N.PRINT]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = [x ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 6, 12, 18, 24, 30]))) for x in prints]
            points.append((len(points) << 20, max(1, n + rng.randint(-n // 4, n // 4)), own))
    far = lambda x, y: [(a ^ b).bit_count() for a, b in zip(x, y)]
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, n, x) in enumerate(points):
        for j in range(i):
            _, m, y = points[j]
            bits = far(x, y)
            if min(n, m) >= 0.8 * max(n, m) and bits[0] <= N.FIRST and sum(bits) <= (N.FEW_BITS if min(n, m) < N.FEW else N.BITS):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    expected = {points[i][0]: points[root(i)][0] for i in range(len(points))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(p, n, *map(signed, x)) for p, n, x in points]
    table = spark.createDataFrame(rows, "point long, n long, f1 long, f2 long, f3 long, f4 long")
    table = table.withColumn("band", F.floor(F.log("n") / F.lit(N.BAND)).cast("long"))
    for least in (N.LEAST, 7):
        monkeypatch.setattr(N, "LEAST", least)
        got = {p: p for p in expected} | {r["node"]: r["root"] for r in N.components(N.met(table)).collect()}
        wide = [p for p in expected if got[p] != expected[p]]  # balls may connect more, whatever the sizes and first words
        assert all(got[p] == got[expected[p]] for p in expected) and len(wide) < len(points) // 10
