"""Node tables back to markup: a fold over the tree, the deepest level first.

A node's markup is its opening, the markup of its children in their order, and its closing. Each level joins the
markup of its nodes to their parents' rows as one aggregation, so every row moves twice however deep the tree is, and
only the rows of the level at hand are read. A level is written out before the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import field_html, html_escape, plain_number, points, run_html
from folium.operators.labels import marked_lists, nodes_css
from folium.session import cut, dealt, merged

#: Alignments, list types and border kinds as CSS and HTML write them.
ALIGNMENTS = {"start": None, "center": "center", "end": "right", "both": "justify", "distribute": "justify"}
LIST_TYPES = {"lowerLetter": "a", "upperLetter": "A", "lowerRoman": "i", "upperRoman": "I"}
BORDER_KINDS = ("dashed", "dotted", "double")
SIDES = ("top", "left", "bottom", "right")


def fold(nodes: DataFrame, opening: Column, closing: Column, empty: Column, keys: tuple[str, ...] = ("doc_id", "sec", "part")) -> DataFrame:
    """(keys, markup): per key the markup of its roots (depth 0) in the order of `ord`, then of `node_id`.

    nodes has keys, node_id, parent_id, ord and depth, and what the three columns read; `empty` stands for the children
    of a node that has none. A node whose opening is null is left out with all below it. Children of a
    node that is not there are left out; a parent is one level above its children.
    """
    id_ = ["doc_id", "node_id"]
    named = nodes.select(*keys, "node_id", "parent_id", "ord", "depth", opening.alias("opening"), closing.alias("closing"), empty.alias("empty"))
    rows = cut(named, "fold").filter(F.col("opening").isNotNull())
    deepest = rows.agg(F.max("depth")).first()[0]
    inner = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        if inner is not None:
            level = level.join(merged(inner), id_, "left")
        body = F.coalesce("inner", "empty", F.lit("")) if inner is not None else F.coalesce("empty", F.lit(""))
        made = level.select(*keys, "node_id", "parent_id", "ord", F.concat("opening", body, F.coalesce("closing", F.lit(""))).alias("markup"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "markup"))), lambda x: x["markup"]), "")
        if depth == 0:
            return made.groupBy(*keys).agg(joined.alias("markup"))
        inner = cut(made.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(joined.alias("inner")), "fold")
    return rows.groupBy(*keys).agg(F.lit("").alias("markup"))


def _style(name: str, kind: str = "string") -> Column:
    return F.try_element_at("style", F.lit(name)).try_cast(kind)


def _pick(key: Column, table: dict[str, str | None], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(otherwise)


def _borders() -> list[Column]:
    out = []
    for side in SIDES:
        kind, size, color = (_style(f"border_{side}_{x}", t) for x, t in (("style", "string"), ("size", "double"), ("color", "string")))
        drawn = F.concat(F.format_string("%.2f", F.greatest(F.lit(0.1), size / 8.0)), F.lit("pt "), F.when(kind.isin(*BORDER_KINDS), kind).otherwise("solid"), F.lit(" #"), color)
        out.append(F.when(kind.isNotNull(), F.concat(F.lit(f"border-{side}:"), F.when(kind == "none", "none").otherwise(drawn))))
    return out


def _width() -> Column:
    width, share = _style("width", "double"), _style("width_pct", "double")
    return F.when(width.isNotNull(), F.concat(F.lit("width:"), points(width))).when(share.isNotNull(), F.concat(F.lit("width:"), plain_number(share / 50.0, 10), F.lit("%")))


def _on(name: str) -> Column:
    return F.coalesce(_style(name) == "true", F.lit(False))


def paragraph_css(left: Column | None = None, first: Column | None = None) -> Column:
    """CSS of a paragraph's or item's style map."""
    size = lambda name, value: F.when(F.coalesce(value, F.lit(0.0)) != 0, F.concat(F.lit(f"{name}:"), points(value)))
    align, line = _style("align"), _style("line", "double")
    exact = F.coalesce(_style("line_rule"), F.lit("auto")) != "auto"
    spacing = F.when(line > 0, F.when(exact, F.concat(F.lit("line-height:"), points(line))).when(line != 240, F.concat(F.lit("line-height:"), plain_number(line / 240.0 * 1.2, 3))))
    return F.concat_ws(
        ";",
        F.when(align != "start", F.concat(F.lit("text-align:"), _pick(align, {k: v for k, v in ALIGNMENTS.items() if v}, F.lit("left")))),
        size("margin-left", _style("left", "double") if left is None else left), size("margin-right", _style("right", "double")), size("text-indent", _style("first", "double") if first is None else first),
        spacing, size("margin-top", _style("before", "double")), size("margin-bottom", _style("after", "double")),
        F.concat(F.lit("background-color:#"), _style("shading")),
        *[F.when(_on(name), css) for name, css in (("keep_next", "break-after:avoid"), ("keep_lines", "break-inside:avoid"), ("break_before", "break-before:page"))],
        *_borders(),
    )


def _styled(css: Column) -> Column:
    return F.when(css != "", F.concat(F.lit(' style="'), html_escape(css), F.lit('"'))).otherwise("")


def table_css() -> Column:
    align = _style("align")
    place = F.when(align == "center", "margin-left:auto;margin-right:auto").when(F.coalesce(_style("indent", "double"), F.lit(0.0)) != 0, F.concat(F.lit("margin-left:"), points(_style("indent", "double"))))
    return F.concat_ws(";", F.lit("border-collapse:collapse"), _width(), place, *_borders())


def cell_css() -> Column:
    valign = _style("valign")
    pads = [F.coalesce(_style(f"pad_{side}", "double"), F.lit(0.0)) for side in ("top", "right", "bottom", "left")]
    padding = F.concat(F.lit("padding:"), F.concat_ws(" ", *[F.concat(F.format_string("%.6f", F.round(p * 5) / 100.0), F.lit("pt")) for p in pads]))
    some = pads[0] + pads[1] + pads[2] + pads[3] != 0
    return F.concat_ws(";", _width(), F.concat(F.lit("background-color:#"), _style("background")), F.when(valign == "center", "vertical-align:middle").when(valign == "bottom", "vertical-align:bottom"), F.when(some, padding), *_borders())


def _run() -> Column:
    style = F.struct(
        F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), F.coalesce("underline", F.lit(False)).alias("underline"), F.coalesce("strike", F.lit(False)).alias("strike"),
        _on("superscript").alias("superscript"), _on("subscript").alias("subscript"), F.nullif(F.nullif(_style("highlight"), F.lit("")), F.lit("false")).alias("highlight"),
        _style("color").alias("color"), _style("background").alias("background"), _style("font").alias("font_family"), _style("size", "double").alias("size_half_points"),
    )
    return run_html(F.coalesce("text", F.lit("")), style)


def _list_places(nodes: DataFrame) -> DataFrame:
    """nodes with what lists need of the rows around them: an item's list's indent, its own left edge, and the outer item's."""
    lists = nodes.filter((F.col("kind") == "list")).select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_up"), _style("indent", "double").alias("list_left"))
    items = nodes.filter(F.col("kind") == "item").join(merged(lists), ["doc_id", "parent_id"]).select("doc_id", "node_id", "_up", "list_left", F.when(F.col("list_left").isNotNull(), F.coalesce(F.nullif(_style("left", "double"), F.lit(0.0)), "list_left")).alias("own_left"))
    outer = items.select("doc_id", F.col("node_id").alias("_up"), F.col("own_left").alias("outer_left"))
    known = items.join(merged(outer), ["doc_id", "_up"], "left").select("doc_id", "node_id", "list_left", "own_left", F.coalesce("outer_left", F.lit(0.0)).alias("outer_left"))
    return nodes.join(merged(known), ["doc_id", "node_id"], "left")


def nodes_to_html(nodes: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(doc_id, body, header, footer, first_header, first_footer): every document of a node table (NODE_SCHEMA) as HTML.

    Rows may have been filtered, changed or added before: a node's children are those whose parent_id names it, one depth
    below, in the order of `ord`. Sections follow each other behind a page break; headers and footers are the first section's.
    media(media_sha, mime, content) gives the images; one that is not in it keeps its digest as its source.
    Items whose list's label needs a ::marker rule have its class; labels.nodes_css gives the rules.
    A document without a body row has a null body, an "error" row gives no markup, and an empty table an empty result.
    """
    placed = _list_places(cut(nodes.filter(F.col("kind") != "error"), "nodes"))  # read several times: lists, cells and the fold
    if media is not None:
        found = media.select("media_sha", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")).alias("_src")).dropDuplicates(["media_sha"])
        placed = placed.join(found, "media_sha", "left")
    source = F.coalesce("_src", "media_sha", F.lit("")) if media is not None else F.coalesce("media_sha", F.lit(""))
    kind, heading = F.col("kind"), F.col("heading")
    tag = F.when(heading.between(1, 6), F.concat(F.lit("h"), heading)).otherwise("p")
    listed = F.when(F.col("ordered"), "ol").otherwise("ul")
    cell_tag = F.when(F.coalesce("_header", F.lit(False)), "th").otherwise("td")
    rows = placed.filter(kind == "row").select("doc_id", F.col("node_id").alias("parent_id"), F.col("is_header").alias("_header"))
    cells = placed.filter(kind == "cell").select("doc_id", "node_id", "parent_id").join(merged(rows), ["doc_id", "parent_id"]).select("doc_id", "node_id", "_header")
    marked = marked_lists(placed).select("doc_id", F.col("node_id").alias("parent_id"), F.col("class").alias("_class"))
    classes = placed.filter(kind == "item").select("doc_id", "node_id", "parent_id").join(merged(marked), ["doc_id", "parent_id"]).select("doc_id", "node_id", "_class")
    whole = placed.join(merged(cells), ["doc_id", "node_id"], "left").join(merged(classes), ["doc_id", "node_id"], "left")
    target = F.coalesce(F.concat(F.lit("#"), "anchor"), "href")
    types = F.when(F.col("ordered"), F.concat_ws("", *[F.when(F.col("format") == k, f' type="{v}"') for k, v in LIST_TYPES.items()], F.when(F.coalesce("start_at", F.lit(1)) != 1, F.concat(F.lit(' start="'), "start_at", F.lit('"'))))).otherwise("")
    left = F.when(F.col("list_left").isNotNull(), F.col("own_left") - F.col("outer_left"))
    item_css = F.concat_ws(";", F.when(_on("hidden"), "list-style-type:none"), F.nullif(paragraph_css(F.coalesce(left, _style("left", "double")), F.when(left.isNotNull(), F.lit(0.0)).otherwise(_style("first", "double"))), F.lit("")))
    spans = F.concat_ws("", *[F.when(F.col(c) > 1, F.concat(F.lit(f' {a}="'), F.col(c), F.lit('"'))) for c, a in (("grid_span", "colspan"), ("row_span", "rowspan"))])
    grid = F.transform(F.split(_style("grid"), ","), lambda w: F.concat(F.lit('<col style="width:'), points(w.cast("double")), F.lit('"/>')))
    note = F.when(_style("note_size").isNotNull(), F.concat(F.lit(' style="font-size:'), plain_number(_style("note_size", "double")), F.lit('pt"'))).otherwise("")
    pixels = lambda name: F.coalesce(F.round(_style(name, "double") / 9525.0).cast("long").cast("string"), F.lit("0"))
    opening = (
        F.when(kind == "p", F.concat(F.lit("<"), tag, _styled(paragraph_css()), F.lit(">")))
        .when(kind == "run", _run())
        .when(kind == "br", "<br/>").when(kind == "pagebreak", '<hr class="page-break"/>').when(kind == "hr", "<hr/>")
        .when(kind == "link", F.coalesce(F.concat(F.lit('<a href="'), html_escape(target), F.lit('">')), F.lit("")))
        .when(kind == "bookmark", F.concat(F.lit('<a id="'), html_escape("name"), F.lit('">')))
        .when(kind == "field", field_html(F.col("instr")))
        .when(kind == "footnote", F.concat(F.lit('<span class="footnote"'), note, F.lit(">"), html_escape(F.coalesce("text", F.lit("")))))
        .when(kind == "image", F.concat(F.when(F.col("depth") == 0, "<p>").otherwise(""), F.lit('<img src="'), source, F.lit('" alt="'), html_escape(F.coalesce(_style("alt"), F.lit(""))), F.lit('" width="'), pixels("width"), F.lit('" height="'), pixels("height"), F.lit('"/>'), F.when(F.col("depth") == 0, "</p>").otherwise("")))
        .when(kind == "list", F.concat(F.lit("<"), listed, F.when(_style("indent").isNotNull(), ' style="margin:0;padding-left:0"').otherwise(""), types, F.lit(">")))
        .when(kind == "item", F.concat(F.lit("<li"), F.when(F.col("_class").isNotNull() & ~F.coalesce(_on("hidden"), F.lit(False)), F.concat(F.lit(' class="'), "_class", F.lit('"'))).otherwise(""), F.when(item_css != "", F.concat(F.lit(' style="'), item_css, F.lit('"'))).otherwise(""), F.lit(">")))
        .when(kind == "table", F.concat(F.lit("<table"), _styled(table_css()), F.lit(">"), F.when(F.col("text") != "", F.concat(F.lit("<caption>"), html_escape("text"), F.lit("</caption>"))).otherwise(""), F.when(_style("grid").isNotNull(), F.concat(F.lit("<colgroup>"), F.array_join(grid, ""), F.lit("</colgroup>"))).otherwise("")))
        .when(kind == "row", F.concat(F.lit("<tr"), F.when(_on("cant_split"), ' style="break-inside:avoid"').otherwise(""), F.lit(">")))
        .when((kind == "cell") & ~F.coalesce("is_continue", F.lit(False)), F.concat(F.lit("<"), cell_tag, spans, _styled(cell_css()), F.lit(">")))
    )
    closing = (
        F.when(kind == "p", F.concat(F.lit("</"), tag, F.lit(">"))).when(kind == "link", F.when(target.isNotNull(), "</a>").otherwise("")).when(kind == "bookmark", "</a>").when(kind == "footnote", "</span>")
        .when(kind == "list", F.concat(F.lit("</"), listed, F.lit(">"))).when(kind == "item", "</li>").when(kind == "table", "</table>").when(kind == "row", "</tr>").when(kind == "cell", F.concat(F.lit("</"), cell_tag, F.lit(">")))
    )
    folded = fold(whole, opening, closing, F.when(kind == "p", "&nbsp;"))
    body = F.when(F.col("part") == "body", F.struct("sec", "markup"))
    one = lambda part: F.max(F.when((F.col("sec") == 0) & (F.col("part") == part), F.nullif("markup", F.lit(""))))
    return folded.groupBy("doc_id").agg(
        F.array_join(F.transform(F.nullif(F.array_sort(F.collect_list(body)), F.array().cast("array<struct<sec:int,markup:string>>")), lambda x: x["markup"]), '<hr class="page-break"/>').alias("body"),
        one("header:default").alias("header"), one("footer:default").alias("footer"), one("header:first").alias("first_header"), one("footer:first").alias("first_footer"),
    )


def nodes_to_docx(nodes: DataFrame, media: DataFrame | None = None, styles: dict | None = None) -> DataFrame:
    """(doc_id, content, error): the bodies of a node table as DOCX packages, by way of their HTML and their labels' rules."""
    from folium.sources.documents import to_docx

    made: Callable[[DataFrame], DataFrame] = lambda html: to_docx(html, "doc_id", "body", styles=styles)
    html = nodes_to_html(nodes, media).join(merged(nodes_css(nodes)), "doc_id", "left")
    return made(dealt(html.select("doc_id", F.concat(F.coalesce(F.concat(F.lit("<style>"), "css", F.lit("</style>")), F.lit("")), "body").alias("body"))))
