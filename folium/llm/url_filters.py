"""URL filters by a path-template tree, in DataFrame operations only.

Per host, the segments of a path form a tree. Segments that vary by form (runs of digits, identifiers) become
wildcards at once. Then branches of one parent are compared, depth by depth from the root: a child that is one of
many and no more popular than chance is a variable segment, and a child whose labelled share of blocked urls does not
differ from its siblings' is merged with them; both become "*", and their subtrees are one from there on, so at the
next depth children of merged branches are pooled and compared together. Urls that a rule judges are the labelled ones. A template is
rejected by its smoothed purity: blocked over labelled, shrunk towards the same template's share over all hosts,
which is itself shrunk towards the overall share.

Work after the first pass is on distinct (host, shape) pairs, which a partial aggregation makes before
anything is shuffled; a host may own any share of the rows. Tables that are joined by a hot key are written
first, so that Spark broadcasts them if they are small and adaptive execution splits hot partitions if not.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.text import lower_ascii
from folium.session import cut

#: Buckets of the constant in which the rules of a host are looked up.
BUCKETS = 1024
#: A child among at least so many, with at most TWICE the even share of rows, is a variable segment.
FANOUT, TWICE = 8, 2
#: Labelled urls on both sides that a comparison of shares needs, and the |z| below which shares are alike.
LEAST, ALIKE = 5, 1.0
#: Pseudo-counts of the smoothing, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines such as "block example.org/es/"."""
    found = []
    for line in lines:
        verdict, _, rest = line.partition(" ")
        host, slash, path = rest.partition("/")
        if verdict not in ("allow", "block") or not slash:
            raise ValueError(f"not a rule: {line}")
        found.append(Rule(verdict, host.lower(), slash + path))
    return found


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(text, verdict) of the longest rule that fits, else null; of equally long ones the later text.

    The rules are a constant, an array of buckets by the hash of their host, and a host's suffixes are looked up in it:
    a row's work does not grow with the number of rules. If rules of one text differ in verdict, the last counts.
    """
    import xxhash

    last = {r.text: r for r in rules}
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for rule in last.values():
        place = xxhash.xxh64_intdigest(rule.host.encode("utf-8"), 42)  # what F.xxhash64 gives
        buckets[(place - (1 << 64) if place >> 63 else place) % BUCKETS].append({"host": rule.host, "path": rule.path, "size": len(rule.text), "text": rule.text, "verdict": rule.verdict})
    kind = "struct<host:string,path:string,size:int,text:string,verdict:string>"
    known = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{kind}>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.transform(suffixes, lambda s: F.filter(F.get(known, F.pmod(F.xxhash64(s), F.lit(BUCKETS)).cast("int")), lambda r: r["host"] == s)))
    fits = F.transform(F.filter(near, lambda r: path.startswith(r["path"])), lambda r: F.struct(r["size"], r["text"].alias("text"), r["verdict"].alias("verdict")))
    return F.array_max(fits)


def shape_of(path: Column) -> Column:
    """The path's segments with their variable parts as "#": whole identifiers, or digits within a segment."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    known = F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$") & (F.length(s) >= 8), F.lit("#")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))
    return F.array_join(known, "/")


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, labelled verdict and shape of every page."""
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parsed.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.verdict").alias("label"), shape_of(F.col("path")).alias("shape"))


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) for shapes: (host, shape, n, nb, na), one row each.

    Each round takes every branch to its next fork: what all shapes below a template begin with is an only child at each
    depth, which no comparison changes, so it is passed over at once. Rounds are as many as forks lie on one path,
    not as paths have segments.
    """
    live = shapes.select("host", "shape", "n", "nb", "na", F.split("shape", "/").alias("parts"), F.lit("").alias("template"))
    sums = [F.sum(c).alias(c) for c in ("n", "nb", "na")]
    below = lambda label: F.when(F.col("template") == "", label).otherwise(F.concat_ws("/", "template", label))
    rest = lambda n: F.slice("parts", n + 1, F.greatest(F.lit(1), F.size("parts")))
    done: list[DataFrame] = []
    while True:
        same = F.array_position(F.zip_with(F.min("parts"), F.max("parts"), lambda a, b: a.eqNullSafe(b)), False).cast("int")
        heads = cut(live.groupBy("host", "template").agg(F.when(same > 0, same - 1).otherwise(F.size(F.min("parts"))).alias("common")), "heads")
        passed = F.when(F.col("common") > 0, below(F.array_join(F.slice("parts", F.lit(1), F.col("common")), "/"))).otherwise(F.col("template"))
        live = cut(live.join(heads, ["host", "template"]).select("host", "shape", "n", "nb", "na", rest(F.col("common")).alias("parts"), passed.alias("template")), "tree")
        done.append(live.filter(F.size("parts") == 0).select("host", "shape", "template"))
        live = live.filter(F.size("parts") > 0).withColumn("segment", F.get("parts", 0))
        nodes = cut(live.groupBy("host", "template", "segment").agg(*sums), "nodes")
        if nodes.isEmpty():
            return reduce(DataFrame.union, done)
        parents = cut(nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("pn"), F.sum("nb").alias("pb"), F.sum("na").alias("pa")), "parents")
        named = cut(nodes.join(parents, ["host", "template"]).select("host", "template", "segment", _label().alias("label")), "labels")
        live = cut(live.join(named, ["host", "template", "segment"]).select("host", "shape", "n", "nb", "na", rest(F.lit(1)).alias("parts"), below(F.col("label")).alias("template")), "tree")


def _label() -> Column:
    """A node's segment, or "*" where its branch is merged with its siblings'."""
    own, others = F.col("nb") + F.col("na"), F.col("pb") + F.col("pa") - F.col("nb") - F.col("na")
    pooled = (F.col("pb") / (F.col("pb") + F.col("pa"))).cast("double")
    gap = F.col("nb") / own - (F.col("pb") - F.col("nb")) / others
    error = F.sqrt(pooled * (1 - pooled) * (1.0 / own + 1.0 / others))
    alike = F.when((own >= LEAST) & (others >= LEAST), F.abs(gap) <= ALIKE * error).otherwise(False)
    varies = (F.col("kids") >= FANOUT) & (F.col("n") * F.col("kids") <= TWICE * F.col("pn"))
    return F.when(F.col("segment").contains("#"), F.col("segment")).when(varies | alike, F.lit("*")).otherwise(F.col("segment"))


def verdicts(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) with the template's smoothed share of blocked urls."""
    tree = cut(shapes.join(template_tree(shapes), ["host", "shape"]), "tree")
    total = tree.agg(F.sum("nb"), F.sum("na")).first()
    nb, na = total[0] or 0, total[1] or 0
    overall = (nb + 1.0) / (nb + na + 2.0)
    sums = [F.sum("nb").alias("nb"), F.sum("na").alias("na")]
    per_host = tree.groupBy("host", "template").agg(*sums)
    everywhere = cut(per_host.groupBy("template").agg(F.sum("nb").alias("xb"), F.sum("na").alias("xa")), "everywhere")
    prior = (F.col("xb") + F.lit(PRIOR * overall)) / (F.col("xb") + F.col("xa") + F.lit(PRIOR))
    purity = (F.col("nb") + F.lit(PRIOR) * prior) / (F.col("nb") + F.col("na") + F.lit(PRIOR))
    scored = cut(cut(per_host, "per-host").join(everywhere, "template").select("host", "template", purity.alias("purity")), "scored")
    return tree.select("host", "shape", "template").join(scored, ["host", "template"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    verdict is the longest fitting rule's, else "block" if the template's purity reaches REJECT, else "allow".
    A null url or one without "://" has an empty host and path, and so an empty template. Paths may have any
    number of segments, and there may be any number of rules that the driver holds. Ties of rule length go to the later text. Repeated rows give repeated results; other columns are not read; an empty table
    gives an empty result.
    """
    rows = judged(pages, rules, url, page_id)
    label = lambda v: F.count_if(F.col("label") == v)
    shapes = cut(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), label("block").alias("nb"), label("allow").alias("na")), "shapes")
    scored = cut(verdicts(shapes), "verdicts").withColumnsRenamed({"host": "_host", "shape": "_shape"})
    out = rows.join(scored, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    verdict = F.coalesce("label", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
