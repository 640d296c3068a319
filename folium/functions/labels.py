"""Labels of list levels as Column expressions: level texts as arrays of tokens, and the contents of ::marker rules.

A level text such as "4.%1.%2)" is a row of literals and level numbers. `tokens` and `text_of` undo each other; `content`
says the same in CSS where CSS can, and `level_text` reads it back. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.css import ASCII_SPACE, _choose, bound

TOKENS = "array<struct<literal:string,level:int>>"
#: Counter styles of CSS by number format; other formats take CSS's own, decimal.
COUNTERS = {"lowerLetter": "lower-alpha", "upperLetter": "upper-alpha", "lowerRoman": "lower-roman", "upperRoman": "upper-roman"}
#: A CSS string, and what a content may consist of; the possessive parts keep long strings off the stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_STYLE = r"(?:,\s*[\w-]+\s*)?"
PIECE = rf"(?s){STRING}|counters\(\s*list-item\s*,\s*{STRING}\s*{_STYLE}\)|counter\(\s*list-item\s*{_STYLE}\)"


def tokens(text: Column) -> Column:
    """array(struct(literal, level)) of a level text: either is null; literals are as long as can be. Null for null, empty for ""."""
    parts = F.filter(F.split(text, "(?<=%[1-9])|(?=%[1-9])"), lambda s: s != "")
    number = lambda s: F.when(s.rlike(r"\A%[1-9]\z"), F.substring(s, 2, 1).cast("int"))
    return F.transform(parts, lambda s: F.struct(F.when(number(s).isNull(), s).alias("literal"), number(s).alias("level"))).cast(TOKENS)


def text_of(tokens: Column) -> Column:
    """The level text of tokens; a literal that holds "%1" to "%9" would not come back as one."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(t["literal"], F.concat(F.lit("%"), t["level"].cast("string")))), "")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.substr(text, F.lit(2), F.length(text) - 2), r"(?s)\\(.)", "$1")


def content(tokens: Column, depth: Column, format: Column) -> Column:
    """The ::marker content of a level's tokens at a depth (0 is the outermost).

    Null for no tokens, for a level's own number with a mere "." behind, which browsers draw anyway, and for what CSS cannot say: it
    knows the level's own number, or all numbers from the first with one string between them.
    """
    numbers = lambda t: F.transform(F.filter(t, lambda x: x["level"].isNotNull()), lambda x: x["level"])
    return bound(tokens, lambda t: bound(numbers(t), lambda levels: _content(t, levels, depth, format)))


def _content(tokens: Column, levels: Column, depth: Column, format: Column) -> Column:
    edge = lambda place: F.coalesce(F.try_element_at(tokens, F.lit(place))["literal"], F.lit(""))
    front, back = edge(1), edge(-1)
    inner = F.filter(tokens, lambda t, i: t["level"].isNotNull() | ((i > 0) & (i < F.size(tokens) - 1)))
    between = F.array_distinct(F.transform(F.filter(inner, lambda t: t["literal"].isNotNull()), lambda t: t["literal"]))
    apart = F.when(F.size(inner) == F.size(levels), F.lit("")).when((F.size(inner) == 2 * F.size(levels) - 1) & (F.size(between) == 1), F.get(between, 0))
    style = F.coalesce(F.concat(F.lit(", "), _choose(format, COUNTERS)), F.lit(""))
    own = F.when(levels == F.array((depth + 1).cast("int")), F.concat(F.lit("counter(list-item"), style, F.lit(")")))
    path = F.when((depth > 0) & (levels == F.sequence(F.lit(1), F.greatest(depth, F.lit(0)).cast("int") + 1)), F.concat(F.lit("counters(list-item, "), _quoted(apart), style, F.lit(")")))
    plain = own.isNotNull() & (front == "") & (back == ".")
    before = F.when(front != "", F.concat(_quoted(front), F.lit(" "))).otherwise("")
    return F.when(~plain, F.concat(before, F.coalesce(own, path), F.lit(" "), _quoted(F.concat(back, F.lit(" ")))))


def level_text(content: Column, depth: Column) -> Column:
    """The level text that a ::marker content shows at a depth; null if it says something else, nothing, or at a depth beyond 8.

    Blanks at the end go: the one behind a label is the tab that word processors put there themselves.
    """
    numbers = F.transform(F.sequence(F.lit(1), F.least(F.greatest(depth, F.lit(0)), F.lit(8)).cast("int") + 1), lambda k: F.concat(F.lit("%"), k.cast("string")))

    def shown(piece: Column) -> Column:
        between = _unquoted(F.regexp_extract(piece, f"(?s){STRING}", 0))
        return F.when(piece.startswith('"'), between).when(piece.startswith("counters"), F.array_join(F.transform(numbers, lambda n, i: F.when(i > 0, F.concat(between, n)).otherwise(n)), "")).otherwise(F.element_at(numbers, -1))

    whole = F.rtrim(F.array_join(F.transform(F.regexp_extract_all(content, F.lit(PIECE), F.lit(0)), shown), ""), F.lit(ASCII_SPACE))
    return F.when(F.regexp_replace(content, PIECE, "").rlike(r"\A\s*\z") & depth.between(0, 8) & (whole != ""), whole)


def marker_rules(sheet: Column) -> Column:
    """array(struct(name, content)) of a style sheet's `.name::marker` rules, in order, the last content of each; no rule: an empty array.

    Comments are left out. Braces, semicolons and comment marks within strings are text.
    """
    rule = rf"(?s)\.([\w-]+)::marker\s*\{{((?:{STRING}|[^}}\"])*+)\}}"
    found = F.regexp_extract_all(F.regexp_replace(sheet, rf"(?s)({STRING})|/\*.*?\*/", "$1"), F.lit(rule), F.lit(0))
    said = lambda body: F.filter(F.regexp_extract_all(body, F.lit(f'(?s)(?:{STRING}|[^;"])++'), F.lit(0)), lambda d: d.rlike(r"(?i)\A\s*content\s*:\s*\S"))
    last = lambda body: F.btrim(F.regexp_replace(F.try_element_at(said(body), F.lit(-1)), r"\A[^:]*:", ""), F.lit(ASCII_SPACE))
    read = F.transform(found, lambda r: F.struct(F.regexp_extract(r, rule, 1).alias("name"), last(F.regexp_extract(r, rule, 2)).alias("content")))
    return F.filter(read, lambda r: r["content"].isNotNull())
