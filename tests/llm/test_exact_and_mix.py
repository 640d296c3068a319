"""Exact dedup, mixing and URL filters on small and odd inputs, and against SQL."""

import hashlib
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folium.llm import registry
from folium.llm.exact_dedup import chunks, exact_dedup, keep_one_of_equal
from folium.llm.mixing import mix, mixed_documents, ordered_index
from folium.llm.text import count_words
from folium.llm.url_filters import Rule, filter_urls, parse_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


LONG = "Word one two three. " * 2000
ODD = [(1, "Abc", "a"), (2, "aBC", "b"), (3, None, None), (4, "", "a"), (5, "É", "b"), (6, "é", "b"), (7, LONG, "a"), (8, LONG.upper(), "a"), (9, LONG + "x", "a"), (9, LONG + "x", "a"), (10, "x" * 30000, "b"), (11, " \t\n", None), (12, "a\U0001f600b", "b")]


def test_exact_dedup_against_brute_force(spark):
    groups = defaultdict(list)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t, _ in ODD:
        groups[(t or "").translate(lower)].append(i)
    got = exact_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        key = next(k for k, v in groups.items() if r["doc_id"] in v)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[key]), len(groups[key]), r["doc_id"] == max(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_chunks_join_to_the_text(spark):
    rows = [(LONG,), ("x" * 30000,), ("",), ("a\n" * 5000,), ("ü" * 9000 + ".",)]
    for r in spark.createDataFrame(rows, "t string").select("t", chunks(F.col("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(1 <= len(c) <= 8192 for c in r["c"])


def test_recipes_alone_decide(spark, monkeypatch):
    """Equal recipes are one group whatever the whole text's digest says; a key of two contents is told apart by digests."""
    from folium.llm import exact_dedup as X

    body = "".join(f"Sentence number {k} is here. " for k in range(200))
    table = docs(spark, [(1, body, "a"), (2, body.upper(), "a"), (3, body + "x", "a")])
    monkeypatch.setattr(X, "chunks", lambda text: F.array(F.substring(text, 1, 10)))  # too short on purpose: all recipes are equal
    with pytest.raises(Exception, match="one recipe, two texts"):
        X.exact_dedup(table).collect()
    monkeypatch.undo()
    recipe = X.recipes(docs(spark, [(1, "abc", "a"), (2, "abd", "a"), (3, "abc", "a"), (4, body, "a")]))
    same_key = recipe.withColumn("chunks", F.transform("chunks", lambda c: F.struct(F.lit(7).cast("long").alias("key"), c["digest"].alias("digest"))))
    ids = {r["doc_id"]: str(r["ids"]) for r in X.identified(same_key).select("doc_id", "ids").collect()}
    assert ids[1] == ids[3] != ids[2]


def test_chunks_of_text_without_marks(spark):
    import random

    rng = random.Random(4)
    for alphabet in ("".join(chr(0x4E00 + k) for k in range(3000)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "word other thing "):
        body = "".join(rng.choice(alphabet) for _ in range(40_000))
        rows = spark.createDataFrame([(body,), (body[:50] + "QQ" + body[50:],)], "t string").select(chunks(F.col("t")).alias("c")).collect()
        a, b = (set(r["c"]) for r in rows)
        assert "".join(rows[0]["c"]) == body and len(a & b) > 0.5 * len(a)


def test_chunks_realign_after_an_insertion(spark):
    body = "".join(f"Sentence number {k} is here. " for k in range(900))
    a, b = (set(r["c"]) for r in spark.createDataFrame([(body,), ("Inserted words stand here! " + body,)], "t string").select(chunks(F.col("t")).alias("c")).collect())
    assert len(a) > 5 and len(a | b) < len(a) + len(b)


def test_keep_one(spark):
    left = keep_one_of_equal(docs(spark, ODD)).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 4, 5, 6, 8, 9, 9, 10, 11, 12]
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert exact_dedup(empty).count() == 0 and mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_clashing_columns(spark):
    df = docs(spark, ODD).withColumn("keep_id", F.lit(1)).withColumn("recipe", F.lit("x")).withColumn("size", F.lit(3)).withColumn("_t", F.lit(0)).withColumn("copies", F.lit(9))
    assert exact_dedup(df).count() == len(ODD) and mix(df).count() == len(ODD) and {"keep_id", "copies"} <= set(mixed_documents(df).columns)


def test_count_words(spark):
    rows = [("",), (None,), (" a  b\t\x0bc\n",), ("\u00a0",), ("\x1cx y",), ("one",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(count_words(F.col("t"))).collect()] == [0, 0, 3, 1, 2, 1]


def test_mix_targets(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 4}" if k % 4 else None) for k in range(400)]
    got = mix(docs(spark, rows)).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 0.05 * target[s] + 7
    again = {r["doc_id"]: r["taken"] for r in mix(docs(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_cap_is_reshared(spark):
    rows = [(1, "a " * 10, "a")] + [(k, "b " * 100, "b") for k in range(2, 6)] + [(k, "c " * 100, "c") for k in range(6, 10)]
    target = {r["source"]: r["target"] for r in mix(docs(spark, rows)).collect()}
    assert target["a"] == 30.0 and abs(target["b"] - 2 * target["c"]) < 1e-9 and abs(sum(target.values()) - 810) < 1e-9


def test_mixed_rows(spark):
    rows = [(k, "w " * 5, f"s{k % 3}") for k in range(60)]
    taken = {r["doc_id"]: r["copies"] for r in mix(docs(spark, rows)).collect()}
    got = mixed_documents(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {k: v for k, v in taken.items() if v}


def test_ordered_index(spark):
    df = spark.createDataFrame([(f"s{k:03d}",) for k in range(50)] + [(None,)], "s string").repartition(7)
    got = {r["s"]: r["i"] for r in ordered_index(df, "s", "i").collect()}
    assert got == {**{f"s{k:03d}": k for k in range(50)}, None: 50}


def test_rules():
    assert parse_rules(["allow org/", "block a.org/x/1"]) == [Rule("allow", "org", "/"), Rule("block", "a.org", "/x/1")]
    with pytest.raises(ValueError):
        parse_rules(["deny x/"])


def test_url_edges(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x#y"), (2, None), (3, "no scheme"), (4, "https://example.org"), (5, "http://badexample.org/es/x"), (6, "http://example.org/en/1"), (7, "x://h.net/a/12/b#c"), (8, "://com/de/"), (8, "://com/de/"), (9, "")]
    rules = parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("shape", F.lit(1)), rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (2, 3, 9)] == [("", "", None)] * 3
    assert got[4]["rule"] is None and got[5]["rule"] == "org/" and got[6]["rule"] == "example.org/en/1" and got[8]["verdict"] == "block" and got[7]["verdict"] in ("allow", "block")
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_url_purity_follows_labels(spark):
    rows = [(k, f"http://h{k % 5}.x.com/{'de' if k % 2 else 'fr'}/{k}") for k in range(200)] + [(900, "http://u.net/de/5"), (901, "http://u.net/fr/5")]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), parse_rules(["allow com/fr/", "block com/de/"])).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow" and got[900]["template"] == "de/#"


def test_url_subtrees_of_merged_branches_are_pooled(spark):
    """Many cities with few items each: cities become a wildcard, and then the items of all of them do."""
    rules = parse_rules(["block com/shop/city1/", "block com/shop/city2/"])
    rows = [(100 * c + i, f"http://a.com/shop/city{chr(97 + c)}x/item{chr(97 + (c * 3 + i) % 26)}z") for c in range(20) for i in range(3)]
    deep = [(9000, "http://b.net/" + "/".join("abcdefghijklmnopqrstuvw")), (9001, "http://b.net/" + "x/" * 500)]
    got = {r["page_id"]: r["template"] for r in filter_urls(spark.createDataFrame(rows + deep, "page_id long, url string"), rules).collect()}
    assert {got[k] for k, _ in rows} == {"shop/*/*"} and got[9000] == "/".join("abcdefghijklmnopqrstuvw")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    show = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    expected = sorted(tuple(show(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(show(v) for v in r) for r in df.select(*columns).collect()) == expected
