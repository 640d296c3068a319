"""Phrase mining, nearest neighbours and conversation repair against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import conversations as C
from folium.llm import neighbours as N
from folium.llm import phrases as P


def plain_phrases(rows, least=10, top=2000):
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = []
    kept = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    for (lang, w), a in kept.items():
        if any(len(w2) > len(w) and l2 == lang and a2 * 100 >= 50 * a and any(w2[i : i + len(w)] == w for i in range(len(w2) - len(w) + 1)) for (l2, w2), a2 in kept.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(own, 1)]
    return sorted(ranked)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "\x0b", "x\ty", "a  b", "A.B", "no,", "\U0001f600", "v"]
    rows = [(rng.choice(["en", "fr", None, ""]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40])))) for _ in range(300)]
    return [*rows, ("en", None), ("en", ""), ("en", "new york city " * 3000), ("fr", "\n\r;:!? ."), *[("de", "ein wort")] * 9, *[("it", "una parola")] * 10]


@pytest.mark.parametrize("bounds", [None, (256, 256, 64)])
def test_phrases_against_plain_counts(spark, monkeypatch, bounds):
    most = P.HASHES
    if bounds:  # many hand-overs, small slices, and the bit map in place of hashes
        monkeypatch.setattr(P, "WORDS", bounds[0])
        monkeypatch.setattr(P, "SUMS", 8)
        monkeypatch.setattr(P, "HELD", 16)
        monkeypatch.setattr(P, "BUCKET", 512)
        monkeypatch.setattr(P, "PART", bounds[1])
        most = 3
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(3)
    got = P.phrases(docs, top=40, most=most, bits=1 << 12).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, top=40)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert P.phrases(docs).collect() == []
    with pytest.raises(ValueError):
        P.phrases(docs, length=4)


def test_bit_map_holds_what_it_was_given(spark):
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(3)
    level = spark.createDataFrame([(int(s),) for s in P.short(hashes, 8)], "s long")
    for most in (10_000, 10):
        known = P.known(level, 8, most, 1 << 16)
        assert (known.hashes is None) == (most == 10) and known.holds(hashes).all()
    assert known.holds(np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)).mean() < 0.1


def plain_nearest(rows, asks, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in rows:
        if not asks(q):
            continue
        best = {}
        for i, w in rows:
            if i != q:
                s = 0.0
                for x, y in zip(v, w):
                    s += float(x) * float(y)
                best[i] = max(best.get(i, -math.inf), s)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_nearest_with_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 2)) for _ in range(rng.choice([3, 3, 2]))]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)] + [(5, [9.0, 0.0, 0.0]), (5, [9.0, 0.0, 0.0]), (20, [0.5, 0.5, 0.5])]
    rows += [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 2.0]), (300, [float("nan"), 1.0, 1.0]), (301, [float("inf"), 1.0, 1.0]), (None, [5.0, 5.0, 5.0]), (302, [-0.0, 1.0, 2.0]), (303, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = N.nearest(df, F.col("vec_id") % 20 == 0, 7)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "double"]
    assert sorted(tuple(r) for r in got.collect()) == plain_nearest(rows, lambda q: q % 20 == 0, 7)
    few = df.filter("vec_id IN (0, 1, 2, 20)")
    assert {r["query_id"] for r in N.nearest(few, F.col("vec_id") % 20 == 0, 7).collect()} <= {0, 20}
    assert N.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).collect() == [] and N.nearest(df.filter("vec_id = 40"), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies", "flat"])
def test_forest_finds_nine_in_ten(spark, monkeypatch, kind):
    for name, value in (("SHARD", 512), ("LEAF", 32), ("POINTS", 400), ("QUERIES", 50), ("SLICE", 16)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(5)
    n, d = 4000, 2 if kind == "flat" else 24
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(40, d))[rng.integers(40, size=n)] + 0.2 * x
        x *= rng.uniform(0.3, 3, size=(n, 1))
    if kind == "copies":
        x[: n // 3] = x[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = N.nearest(df, F.col("vec_id") % 50 == 0, 10).collect()
    ids = np.arange(0, n, 50)
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids:
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(n), -np.round(s, 9)))[:10]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(v - s[i]) < 1e-9 for _, i, v in mine)
        assert [(-v, i) for _, i, v in mine] == sorted((-v, i) for _, i, v in mine)
        hits, total = hits + len({i for _, i, _ in mine} & set(order.tolist())), total + 10
    assert hits >= 0.9 * total


def plain_repair(rows):
    """(cost, audit, roles): all edits of few rows, tried out in order of cost then audit."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")
    for inserts in range(3):
        for slots in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            for edits in itertools.product("DKR", repeat=len(rows)):
                cost = 5 * inserts + sum({"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and f == "truncated" else 0) for e, (_, f) in zip(edits, rows))
                if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows)):
                    continue
                line = []
                for i in range(len(rows) + 1):
                    line += [("I", "?")] * slots.count(i)
                    if i < len(rows):
                        line.append((edits[i], rows[i][0] if edits[i] == "K" else "?" if edits[i] == "R" else ""))
                audit = "".join(e for e, _ in line)
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                free = [r for _, r in line if r]
                for fill in itertools.product("ua", repeat=free.count("?")):
                    it = iter(fill)
                    roles = "".join(next(it) if r == "?" else r for r in free)
                    if grammar.fullmatch(roles):
                        best = cost, audit, roles
                        break
    return best


def test_search_against_all_edits():
    rng = random.Random(6)
    letters = {v: k for k, v in C.SYMBOLS.items()}
    for _ in range(250):
        rows = [(rng.choice("ssuuaa-"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 4))]
        symbols = "".join(letters[r] for r in rows)
        assert C.repaired(symbols) == plain_repair(rows)[:2]


def test_segments_compose_to_the_whole():
    rng = random.Random(7)
    for _ in range(120):
        symbols = "".join(rng.choice("ABCDDABCABEGIKMNO") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(rng.randint(1, 5)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        cost, audits = C.composed([C.crossings(p) for p in parts])
        assert (cost, "".join(audits)) == C.repaired(symbols) and len(audits) == len(parts)


def plain_report(rows):
    """The whole contract for one conversation's rows (turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in out:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in out if t is not None]
    initials = [r[:1] for _, r, _ in out]
    letters = {v: k for k, v in C.SYMBOLS.items()}
    cost, audit = C.repaired("".join(letters[(i if i in "sua" else "-", f)] for i, f in zip([x or "-" for x in initials], faults)))
    kept, it, state = [], iter(out), 0
    for edit in audit:
        row = next(it) if edit != "I" else None
        if edit == "D":
            continue
        role = row[1] if edit == "K" else C.NAMES[C.WANTED[state]]
        kept.append(f"{role}:{row[2] if row else ''}")
        state = C.NEXT[state, role[0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_against_the_contract(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rng = random.Random(8)
    texts = ["Yes.", "No?", "What", "", "  ", None, "Tell me.\n", "é…", "Yes."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 3, 6, 12])):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, -turn]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "-"]), rng.choice(texts)))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 50}.") for t in range(400)] + rows[:5]  # long, and repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("cost", F.lit(1)).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain_report([r for r in rows if r[0] == conv]), conv


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(df).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = C.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
