"""Rules of any number against plain matching; trees of any depth against a plain recursion."""

import random

import numpy as np
from pyspark.sql import functions as F

from folium.llm import url_filters as U


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(((len(r.text), r.text, r.verdict) for r in fit), default=(0, None, None))[1:]


def test_many_rules(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "org", "é", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", "z1", ""]) for _ in range(rng.randint(0, 3)))
    rules = list({r.text: r for r in U.parse_rules([f"{rng.choice(['allow', 'block'])} {host()}{path()}" for _ in range(1500)])}.values())
    rows = [(host(), path()) for _ in range(400)] + [("", ""), ("a", ""), ("." * 3000, "/x")]
    got = spark.createDataFrame(rows, "host string, path string").select("host", "path", U.rule_for(F.col("host"), F.col("path"), rules).alias("r")).collect()
    assert len(rules) > 900
    for r in got:
        assert (r["r"] and tuple(r["r"])[1:] or (None, None)) == plain_rule(r["host"], r["path"], rules)


def plain_tree(rows):
    """shape -> template of one host's rows (shape, n, nb, na)."""
    out = {}

    def label(segment, own, all_, kids):
        if "#" in segment:
            return segment
        n, nb, na = own
        pn, pb, pa = all_
        if kids >= U.FANOUT and n * kids <= U.TWICE * pn:
            return "*"
        mine, others = nb + na, pb + pa - nb - na
        if mine >= U.LEAST and others >= U.LEAST:
            pooled = pb / (pb + pa)
            if abs(nb / mine - (pb - nb) / others) <= U.ALIKE * np.sqrt(pooled * (1 - pooled) * (1 / mine + 1 / others)):
                return "*"
        return segment

    level = {(): [(s.split("/"), s, c) for s, *c in rows]}
    while level:
        below = {}
        for template, held in level.items():
            sums = {}
            for parts, _, c in held:
                if parts:
                    sums[parts[0]] = np.add(sums.get(parts[0], 0), c)
            for parts, s, c in held:
                if not parts:
                    out[s] = "/".join(template)
                else:
                    below.setdefault((*template, label(parts[0], sums[parts[0]], sum(sums.values()), len(sums))), []).append((parts[1:], s, c))
        level = below
    return out


def test_trees_of_any_depth(spark):
    rng = random.Random(4)
    rows = {}
    for host in ("a", "b", "c"):
        shapes = {"/".join(rng.choice(["u", "v", "w#", "k", "l", "m", "n", "o", "p", "q"][: rng.choice([2, 10])]) for _ in range(rng.randint(1, 6))) for _ in range(150)} | {""}
        shapes |= {"/".join(["deep"] * 900 + [x]) for x in ("e", "f", "f/g")} | {"deep"}
        rows[host] = [(s, rng.randint(1, 20), rng.randint(0, 6), rng.randint(0, 6)) for s in sorted(shapes)]
    df = spark.createDataFrame([(h, *r) for h, held in rows.items() for r in held], "host string, shape string, n long, nb long, na long")
    got = {(r["host"], r["shape"]): r["template"] for r in U.template_tree(df).collect()}
    assert got == {(h, s): t for h, held in rows.items() for s, t in plain_tree(held).items()}
    assert U.template_tree(df.limit(0)).count() == 0
