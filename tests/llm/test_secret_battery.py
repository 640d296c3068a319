"""The randomness battery: planted secrets that no base rule fits, false finds, p-values and thresholds by brute force."""

import base64
import random
import string

import pytest
from pyspark.sql import functions as F

from folium.llm import secret_scan as S

PLAIN = ["theQuickBrownFoxJumpsOverTheLazyDogAgainToday", "AbstractSingletonProxyFactoryBean2", "12345678901234567890123", "a_long_name_of_some_variable_here", "ELIGIBLE-CUSTOMER-RELATIONSHIP-MANAGER"]
WORDS = "the old river ran below stone bridge where nobody had walked since winter storm came down from northern hills and people of town counted their boats twice before leaving for market".split()


def secrets(rng, n):
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    kinds = [
        lambda: base64.b64encode(rng.randbytes(30)).decode(), lambda: pick(string.ascii_letters + string.digits, 40), lambda: pick(string.ascii_lowercase, 32), lambda: pick(string.ascii_lowercase + string.digits, 36),
        lambda: pick(string.ascii_uppercase + "234567", 32),
    ]
    return [kinds[k % 5]() for k in range(n)]


def test_planted_secrets_and_false_finds(spark):
    rng = random.Random(5)
    planted = secrets(rng, 300)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(2000)]
    for k, secret in enumerate(planted):
        texts[k] += f" {'STRIPE_KEY=' if k % 3 == 0 else 'https://h.org/p?sig=' if k % 3 == 1 else 'auth: '}{secret} end"
    for k, value in enumerate(PLAIN * 20):
        texts[500 + k] += f" {value} end"
    texts.append("x" * 1_000_000)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("value", F.lit(1)).withColumn("w", F.lit("x"))
    found = {r["doc_id"]: [s["value"] for s in r["found"]] for r in S.scan(table).collect()}
    caught = sum(any(p.rstrip("=") in v for v in found[k]) for k, p in enumerate(planted))
    wrong = sum(bool(found[k]) for k in range(300, 2000))
    assert len(found) == 2001 and caught >= 0.75 * len(planted) and wrong == 0 and found[2000] == []


def test_small_tables_take_few_files(spark, monkeypatch):
    """A file in a local folder costs the executor child processes (chmod): a few runs are not to take one a shuffle partition."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(400)]
    for k, secret in enumerate(secrets(rng, 100)):
        texts[k] += f" auth: {secret} end"
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    written, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found = {r["doc_id"]: r["found"] for r in S.scan(table).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(bool(found[k]) for k in range(100)) >= 75 and len(found) == 400
    assert sum(len(x.inputFiles()) for x in written) <= 8


def test_no_decoys_no_finds(spark):
    one = "auth: b9Kx2QpLm7ZtR4vWn8YcJd3HsGf6TzUq"
    assert [r["found"] for r in S.scan(spark.createDataFrame([(1, one)], "doc_id long, text string")).collect()] == [[]]


def test_battery_against_plain_arithmetic(spark):
    rng = random.Random(1)
    values = [*secrets(rng, 20), *PLAIN]
    rows = S.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    for r in rows:
        own = r["value"].rstrip("=")
        n, k = len(own), r["k"]
        chi = k / n * sum(own.count(c) ** 2 for c in set(own)) - n
        mean = sum(map(ord, own)) / n
        spread = sum((ord(c) - mean) ** 2 for c in own)
        serial = sum((ord(a) - mean) * (ord(b) - mean) for a, b in zip(own, own[1:])) / spread
        assert r["chi"] == pytest.approx(chi) and r["mean"] == pytest.approx(mean) and 0 <= r["p"] <= 1
        assert r["p_serial"] == pytest.approx(2 * (1 - phi(abs((serial + 1 / n) * n**0.5))), abs=1e-6)


def phi(x):
    import math

    return 0.5 * (1 + math.erf(x / 2**0.5))


def test_thresholds_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.random() ** (4 if decoy else 0.6), band, decoy) for band in (0, 1) for decoy in (True, False) for _ in range(400)] + [(0.99, 2, False)] * 9
    got = S.thresholds(spark.createDataFrame(rows, "p double, band int, decoy boolean"))
    for band in (0, 1, 2):
        d, t = ([p for p, b, x in rows if b == band and x == decoy] for decoy in (True, False))
        fits = [a for a in S.GRID if (n := sum(p >= a for p in t)) and (sum(p >= a for p in d) + 1) / (len(d) + 1) * len(t) <= S.Q * n]
        assert got[band] == (min(fits) if fits else 2.0)
    assert got[2] == 2.0
