"""Style sheets over element tables: selectors as joins and windows, the cascade as a maximum.

A selector is cut at its combinators into compounds, and each compound is filed under its strongest part (id, class or
type), which is what elements are joined on; attributes and positions are checked on what the join finds. Then steps are
followed from left to right. An element is below an earlier match if the furthest end among the matches before it, in
document order, lies behind it: intervals of a tree nest, so one running maximum replaces all pairs of ancestors and
descendants. Children and siblings are semi joins on the parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions.text import html_escape
from folium.kernels.css import declarations
from folium.operators.markup import fold
from folium.session import cut
from folium.sources.documents import elements

COMPOUNDS = (
    "rule int, step int, steps int, combinator string, key string, tag string, id string, classes array<string>, "
    "tests array<struct<attr:string,op:string,value:string>>, places array<struct<last:boolean,a:int,b:int>>"
)
DECLARATIONS = "rule int, weight array<int>, property string, value string, important boolean"
_NAME = r"-?[A-Za-z_][\w-]*"
_PART = re.compile(rf"""\*|{_NAME}|\.{_NAME}|\#{_NAME}|\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:(first-child|last-child|only-child)|:(nth-child|nth-last-child)\(\s*([^)]+)\s*\)""")
#: Elements without content or closing tag.
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def _formula(text: str) -> tuple[int, int] | None:
    """a and b of an+b, odd or even."""
    word = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), text.strip().lower().replace(" ", ""))
    if re.fullmatch(r"[+-]?\d+", word):
        return 0, int(word)
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", word)
    return (int(found[1] + "1") if found[1] in ("", "+", "-") else int(found[1]), int(found[2] or 0)) if found else None


def compound(text: str) -> dict | None:
    """The parts of a compound selector, or None if it holds what is not supported."""
    out: dict = {"tag": None, "id": None, "classes": [], "tests": [], "places": []}
    at = 0
    while at < len(text):
        found = _PART.match(text, at)
        if found is None:
            return None
        part, at = found[0], found.end()
        if part[0] == "#":
            out["id"] = part[1:]
        elif part[0] == ".":
            out["classes"].append(part[1:])
        elif part[0] == "[":
            value = found[3]
            out["tests"].append((found[1].lower(), found[2] or "", value[1:-1] if value and value[0] in "\"'" else value or ""))
        elif part[0] == ":":
            formula = (0, 1) if found[4] else _formula(found[6])
            if formula is None:
                return None
            ends = {"first-child": [False], "last-child": [True], "only-child": [False, True]}.get(found[4] or "", [found[5] == "nth-last-child"])
            out["places"] += [(last, *formula) for last in ends]
        elif part != "*":
            out["tag"] = part.lower()
    return out if text else None


def selector(text: str) -> tuple[list[tuple[str, dict]], list[int]] | None:
    """(combinator before, compound) from left to right, and the specificity: ids, classes and their like, types."""
    words = [w for w in re.split(r"\s*([>+~])\s*|\s+", re.sub(r"\[[^\]]*\]|\([^)]*\)", lambda m: re.sub(r"\s", "\0", m[0]).replace(">", "\1").replace("+", "\2").replace("~", "\3"), text.strip())) if w is not None and w != ""]
    steps, combinator = [], ""
    for word in words:
        if word in (">", "+", "~"):
            combinator = word
            continue
        made = compound(word.replace("\0", " ").replace("\1", ">").replace("\2", "+").replace("\3", "~"))
        if made is None:
            return None
        steps.append((combinator if steps else "", made))
        combinator = " "
    if not steps or words[-1] in (">", "+", "~") or words[0] in (">", "+", "~"):
        return None
    parts = [c for _, c in steps]
    return steps, [sum(c["id"] is not None for c in parts), sum(len(c["classes"]) + len(c["tests"]) + len(c["places"]) for c in parts), sum(c["tag"] is not None for c in parts)]


def parse_sheet(sheet: str, first: int = 0) -> Iterator[tuple[int, list[int], list[tuple[str, dict]], dict[str, str]]]:
    """(rule, specificity, steps, declarations) of every supported selector in order; @ rules and others are left out."""
    plain = re.sub(r"(?s)/\*.*?\*/|@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", "", sheet)
    number = first
    for found in re.finditer(r"([^{}]+)\{([^{}]*)\}", plain):
        for text in re.split(r",(?![^\[(]*[\])])", found[1]):
            if (made := selector(text)) is not None:
                yield number, made[1], made[0], declarations(found[2])
                number += 1


def sheet_tables(spark: SparkSession, sheet: str) -> tuple[DataFrame, DataFrame]:
    """(compounds, declarations) of a style sheet as tables."""
    steps, values = [], []
    for rule, weight, parts, body in parse_sheet(sheet):
        for k, (combinator, c) in enumerate(parts):
            key = "#" + c["id"] if c["id"] else "." + c["classes"][0] if c["classes"] else c["tag"] or "*"
            steps.append((rule, k, len(parts), combinator, key, c["tag"], c["id"], c["classes"], c["tests"], c["places"]))
        for name, value in body.items():
            bare = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I)
            values.append((rule, weight, name, bare, bare != value))
    return spark.createDataFrame(steps, COMPOUNDS), spark.createDataFrame(values, DECLARATIONS)


def _fits() -> Column:
    """Whether an element row satisfies the compound beside it."""
    attr = lambda t: F.try_element_at(F.col("attrs"), t["attr"])
    classes = F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+")

    def test(t):
        v, x = attr(t), t["value"]
        some = x != ""
        return F.coalesce(
            F.when(t["op"] == "", v.isNotNull()).when(t["op"] == "=", v == x).when(t["op"] == "^=", some & v.startswith(x)).when(t["op"] == "$=", some & v.endswith(x))
            .when(t["op"] == "*=", some & v.contains(x)).when(t["op"] == "~=", some & F.array_contains(F.split(v, r"\s+"), x)).when(t["op"] == "|=", (v == x) | v.startswith(F.concat(x, F.lit("-")))), F.lit(False),
        )

    def place(p):
        n = F.when(p["last"], F.col("nth_last")).otherwise(F.col("nth")) - p["b"]
        return F.when(p["a"] == 0, n == 0).otherwise((F.pmod(n, F.abs(F.nullif(p["a"], F.lit(0)))) == 0) & (n * F.sign(p["a"].cast("double")) >= 0))

    return (
        (F.col("c.tag").isNull() | (F.col("c.tag") == F.col("e.tag"))) & (F.col("id").isNull() | F.col("id").eqNullSafe(F.try_element_at("attrs", F.lit("id"))))
        & F.forall("classes", lambda c: F.array_contains(classes, c)) & F.forall("tests", test) & F.forall("places", place)
    )


def matches(dom: DataFrame, compounds: DataFrame) -> DataFrame:
    """(doc_id, node_id, rule): the elements that each selector selects.

    dom is an element table (see folium.sources.documents.elements); compounds of `sheet_tables`. Repeated rows of an
    element match once; without rules or elements there are no rows.
    """
    classes = F.transform(F.filter(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    id_ = F.coalesce(F.array(F.concat(F.lit("#"), F.try_element_at("attrs", F.lit("id")))), F.array())
    keys = F.filter(F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag")), classes, id_)), lambda k: k.isNotNull())
    filed = dom.filter(F.col("tag").isNotNull()).select("doc_id", "node_id", "end_id", "parent_id", "tag", "attrs", "nth", "nth_last", F.explode(keys).alias("_key"))
    found = filed.alias("e").join(compounds.alias("c"), F.col("e._key") == F.col("c.key")).filter(_fits())
    steps = cut(found.select("doc_id", "node_id", "end_id", "parent_id", "nth", "rule", "step", "steps", "combinator").distinct(), "compounds")
    most = steps.agg(F.max("steps")).first()[0] or 0
    alive, done = None, None
    for k in range(most):
        here = steps.filter(F.col("step") == k)
        if alive is not None:
            own = ["doc_id", "rule"]
            # descendants: matches of the step before and candidates in document order, an element behind itself
            before = alive.select(*own, "node_id", "end_id", F.lit(1).alias("_source"))
            asks = here.filter(F.col("combinator") == " ")
            line = asks.withColumn("_source", F.lit(0)).unionByName(before, allowMissingColumns=True)
            reach = F.max(F.when(F.col("_source") == 1, F.col("end_id"))).over(Window.partitionBy(*own).orderBy("node_id", "_source").rowsBetween(Window.unboundedPreceding, -1))
            below = line.withColumn("_reach", reach).filter((F.col("_source") == 0) & (F.col("_reach") >= F.col("node_id"))).select(*here.columns)
            parents = alive.select(*own, F.col("node_id").alias("parent_id"))
            children = here.filter(F.col("combinator") == ">").join(parents, [*own, "parent_id"], "left_semi")
            next_ = alive.select(*own, "parent_id", (F.col("nth") + 1).alias("nth"))
            following = here.filter(F.col("combinator") == "+").join(next_, [*own, "parent_id", "nth"], "left_semi")
            first = alive.groupBy(*own, "parent_id").agg(F.min("nth").alias("_first"))
            later = here.filter(F.col("combinator") == "~").join(first, [*own, "parent_id"]).filter(F.col("nth") > F.col("_first"))
            here = below.unionByName(children.select(*here.columns)).unionByName(following.select(*here.columns)).unionByName(later.select(*here.columns))
        alive = cut(here, "selected") if k else here
        ended = alive.filter(F.col("steps") == k + 1).select("doc_id", "node_id", "rule")
        done = ended if done is None else done.unionByName(ended)
    return done if done is not None else steps.select("doc_id", "node_id", "rule")


def cascaded(dom: DataFrame, compounds: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, node_id, property, value): for each element and property the declaration that wins.

    Important ones win over others, then an element's own style attribute, then specificity, then the later rule.
    """
    rank = lambda important, own, weight, rule: F.struct(important.alias("important"), own.alias("own"), weight.alias("weight"), rule.alias("rule"))
    ruled = matches(dom, compounds).join(values, "rule").select("doc_id", "node_id", "property", "value", rank(F.col("important"), F.lit(False), F.col("weight"), F.col("rule")).alias("rank"))
    parts = F.posexplode(F.split(F.try_element_at("attrs", F.lit("style")), ";"))
    own = dom.filter(F.col("tag").isNotNull()).select("doc_id", "node_id", parts.alias("_at", "_part"))
    name, text = F.lower(F.trim(F.substring_index("_part", ":", 1))), F.trim(F.regexp_extract("_part", "(?s)^[^:]*:(.*)$", 1))
    bare = F.regexp_replace(text, r"(?i)\s*!\s*important\s*$", "")
    styled = own.select("doc_id", "node_id", name.alias("property"), bare.alias("value"), rank(bare != text, F.lit(True), F.array().cast("array<int>"), F.col("_at")).alias("rank")).filter("property <> '' AND value <> ''")
    return ruled.unionByName(styled).groupBy("doc_id", "node_id", "property").agg(F.max_by("value", "rank").alias("value"))


def inline_sheet(df: DataFrame, id: str, html: str, sheet: str) -> DataFrame:
    """(doc_id, html): the bodies with the sheet's winning declarations in style attributes, in the order of their names.

    Comments, scripts and style blocks of the pages are left out; a null page gives no row.
    """
    dom = cut(elements(df, id, html), "elements")
    styles = cascaded(dom, *sheet_tables(df.sparkSession, sheet)).groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_list(F.concat("property", F.lit(":"), "value"))).alias("_css"))
    whole = dom.join(styles, ["doc_id", "node_id"], "left")
    attrs = F.map_filter("attrs", lambda k, v: k != "style")
    shown = F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), html_escape(e["value"]), F.lit('"'))), "")
    style = F.when(F.col("_css").isNotNull(), F.concat(F.lit(' style="'), html_escape(F.array_join("_css", ";")), F.lit('"'))).otherwise("")
    gone = F.col("tag").isin("script", "style")
    opening = F.when(F.col("tag").isNull(), html_escape("text")).when(~gone, F.concat(F.lit("<"), "tag", shown, style, F.lit(">")))
    closing = F.when(F.col("tag").isNotNull() & ~F.col("tag").isin(*EMPTY), F.concat(F.lit("</"), "tag", F.lit(">")))
    return fold(whole, opening, closing, F.lit(None).cast("string"), keys=("doc_id",)).withColumnRenamed("markup", "html")


def unsupported(sheet: str) -> Sequence[str]:
    """Selectors of a sheet that are left out."""
    plain = re.sub(r"(?s)/\*.*?\*/", "", sheet)
    return [t.strip() for found in re.finditer(r"([^{}]+)\{", plain) for t in re.split(r",(?![^\[(]*[\])])", found[1]) if selector(t) is None]
