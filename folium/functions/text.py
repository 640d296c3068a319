"""Text, markup and naming functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.build.style import UNITS
from folium.kernels.docx_read import PATTERNS
from folium.kernels.nodes import FIELD_TAGS, MERGE_CHARS, WORDS

#: The white space that collapses: Unicode's, the no-break space included.
SPACE = r"[\t-\r\x{85}\p{Z}]+"
#: What XML 1.0 does not allow in text.
NOT_XML = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def html_escape(text: Column) -> Column:
    out = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def xml_escape(text: Column) -> Column:
    return F.regexp_replace(html_escape(text), NOT_XML, "")


def bookmark_name(raw: Column) -> Column:
    """Each byte outside [A-Za-z0-9_] becomes "_"; a leading digit or an empty name gets "_" before it; 40 characters."""
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[\x{10000}-\x{10FFFF}]", "____"), r"[\x{800}-\x{FFFF}]", "___"), r"[\x{80}-\x{7FF}]", "__")
    name = F.regexp_replace(wide, "[^A-Za-z0-9_]", "_")
    return F.substring(F.when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("_"), name)), 1, 40)


def run_parts(text: Column) -> Column:
    """array of (kind, text): what a run's text becomes in a package: text, tab, line break, page break."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\t|\r\n|\r|\n|\x0B|\x0C|[^\t\r\n\x0B\x0C]+"), F.lit(0))
    kind = lambda p: F.when(p == "\t", "tab").when(p == "\x0c", "page").when(p.isin("\r\n", "\r", "\n", "\x0b"), "br").otherwise("text")
    return F.transform(found, lambda p: F.struct(kind(p).alias("kind"), p.alias("text")))


def instruction_words(instr: Column) -> Column:
    """The words of a field's instruction; those in quotes keep them."""
    return F.regexp_extract_all(instr, F.lit(WORDS), F.lit(1))


def merge_name(instr: Column) -> Column:
    """The name in a MERGEFIELD instruction: a word in quotes as a whole, else what a bare word begins with."""
    words = instruction_words(instr)
    word = F.get(words, 1)
    quoted = F.regexp_extract(word, f'^"([{MERGE_CHARS}]+)"$', 1)
    name = F.when(quoted != "", quoted).otherwise(F.regexp_extract(word, f"^[{MERGE_CHARS}]+", 0))
    return F.when(F.upper(F.get(words, 0)) == "MERGEFIELD", F.nullif(name, F.lit("")))


def variables(text: Column, patterns: Sequence[str] = PATTERNS) -> Column:
    """array of (name, placeholder) in the order of the patterns, then of place; group 1 is the name."""
    one = [F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("placeholder")) for p in patterns]
    return F.filter(F.flatten(F.array(*one)), lambda v: F.trim(v["name"]) != "")


def heading_level(style_id: Column) -> Column:
    return F.nullif(F.regexp_extract(style_id, "(?i)^heading([1-6])$", 1), F.lit("")).try_cast("int")


def toggle(value: Column) -> Column:
    """An on/off property: on without a value, off for false, 0 and off."""
    return ~F.coalesce(F.lower(value).isin("false", "0", "off"), F.lit(False))


def resolve_target(base: Column, target: Column) -> Column:
    """A relationship target as a package path, relative to the folder of base."""
    folder = F.filter(F.split(F.regexp_replace(base, "[^/]*$", ""), "/"), lambda s: s != "")
    step = lambda stack, s: F.when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(s.isin("", "."), stack).otherwise(F.concat(stack, F.array(s)))
    walked = F.array_join(F.aggregate(F.split(target, "/"), folder, step), "/")
    return F.when(target.startswith("/"), F.ltrim(target, F.lit("/"))).otherwise(walked)


def image_format(path: Column, data: Column) -> Column:
    """By the path's extension, else by the first bytes."""
    ending = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    head = F.hex(F.substring(data, 1, 8))
    by_name = F.when(ending == "png", "png").when(ending.isin("jpg", "jpeg"), "jpeg").when(ending == "gif", "gif").when(ending == "bmp", "bmp").when(ending.isin("tif", "tiff"), "tiff")
    signs = (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))
    by_bytes = F.when(F.lit(False), F.lit(None))
    for sign, name in signs:
        by_bytes = by_bytes.when(head.startswith(sign), name)
    return F.coalesce(by_name, by_bytes)


def image_facts(kind: Column) -> Column:
    """struct(mime, extension, web_safe) of a format."""
    return F.struct(F.concat(F.lit("image/"), kind).alias("mime"), F.when(kind == "jpeg", "jpg").otherwise(kind).alias("extension"), kind.isin("png", "jpeg", "gif").alias("web_safe"))


def list_format(kind: Column, ordered: Column) -> Column:
    """From an HTML list type, case-sensitively."""
    lettered = F.when(kind == "a", "lowerLetter").when(kind == "A", "upperLetter").when(kind == "i", "lowerRoman").when(kind == "I", "upperRoman").otherwise("decimal")
    return F.when(ordered, lettered).otherwise("bullet")


def field_instruction(name: Column, format: Column) -> Column:
    quoted = lambda word, default: F.concat(F.lit(f'{word} \\@ "'), F.coalesce(format, F.lit(default)), F.lit('"'))
    return (
        F.when(name == "page", "PAGE").when(name == "total", "NUMPAGES").when(name == "date", quoted("DATE", "dd.MM.yyyy")).when(name == "time", quoted("TIME", "HH:mm"))
        .when(name == "author", "AUTHOR").when(name == "title", "TITLE")
    )


def field_html(instr: Column) -> Column:
    """A field as markup: a tag by its name, a variable by its merge name, else its instruction."""
    words = instruction_words(instr)
    first = F.upper(F.coalesce(F.get(words, 0), F.lit("")))
    tag = F.coalesce(*[F.when(first.startswith(begins), F.lit(tag)) for begins, tag in FIELD_TAGS.items()])
    format = F.when(tag == "current-date", F.btrim(F.get(F.filter(words, lambda w: w.rlike('^"[^"]+"$')), 0), F.lit('"')))
    name = F.when(~F.get(words, 1).startswith('"') & ~instr.rlike(r"^\s"), merge_name(instr))
    named = F.concat(F.lit('<var data-name="'), html_escape(name), F.lit('">'), html_escape(name), F.lit("</var>"))
    return F.coalesce(
        F.concat(F.lit("<"), tag, F.lit(' format="'), html_escape(format), F.lit('"/>')),
        F.concat(F.lit("<"), tag, F.lit("/>")),
        named,
        F.concat(F.lit('<var data-instr="'), html_escape(instr), F.lit('"></var>')),
    )


def plain_number(x: Column, digits: int = 2) -> Column:
    """Rounded half away from zero, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.round(x, digits).cast(f"decimal(20,{digits})").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def points(size: Column) -> Column:
    return F.concat(plain_number(size / 20.0), F.lit("pt"))


def length_to_twips(value: Column, unit: str) -> Column:
    """The builder's lengths: pt, mm, cm, inch, px, twips."""
    return F.round(value * F.lit(float(UNITS[unit]))).cast("int")


def run_html(text: Column, style: Column) -> Column:
    """A run as HTML; style: struct of bold, italic, underline, strike, superscript, subscript, highlight, color, background, font_family, size_half_points."""
    wraps = (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s"), ("superscript", "sup"), ("subscript", "sub"))
    out = F.replace(html_escape(text), F.lit("\t"), F.lit("&#9;"))
    out = F.when(style["highlight"].isNotNull(), F.concat(F.lit("<mark>"), out, F.lit("</mark>"))).otherwise(out)
    for name, tag in reversed(wraps):
        out = F.when(style[name], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    css = F.concat_ws(
        ";",
        F.concat(F.lit("color:#"), style["color"]),
        F.concat(F.lit("background-color:#"), style["background"]),
        F.concat(F.lit("font-family:"), html_escape(style["font_family"])),
        F.concat(F.lit("font-size:"), plain_number(style["size_half_points"] / 2.0), F.lit("pt")),
    )
    return F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'), out, F.lit("</span>"))).otherwise(out)


def paragraph_css(s: Column) -> Column:
    """CSS of a paragraph style struct (see folium.functions.css.paragraph_style) with line_rule."""
    sized = lambda name, value: F.when(value != 0, F.concat(F.lit(f"{name}:"), points(value)))
    line = s["line_spacing"]
    return F.concat_ws(
        ";",
        F.when(s["alignment"] == "center", "text-align:center").when(s["alignment"] == "end", "text-align:right").when(s["alignment"].isin("both", "distribute"), "text-align:justify"),
        sized("margin-left", s["indent_left"]),
        sized("margin-right", s["indent_right"]),
        sized("text-indent", s["indent_first"]),
        F.when(line <= 0, F.lit(None)).when(F.coalesce(s["line_rule"], F.lit("auto")) != "auto", F.concat(F.lit("line-height:"), points(line))).when(line != 240, F.concat(F.lit("line-height:"), plain_number(line / 240.0 * 1.2, 3))),
        sized("margin-top", s["space_before"]),
        sized("margin-bottom", s["space_after"]),
        F.concat(F.lit("background-color:#"), s["shading"]),
        F.when(s["break_before"], "break-before:page"),
    )


def border_css(b: Column) -> Column:
    kind = F.when(b["style"].isin("dashed", "dotted", "double"), b["style"]).otherwise("solid")
    return F.when(b["style"] == "none", "none").when(b.isNotNull(), F.concat(F.format_string("%.2f", F.greatest(F.lit(0.1), b["size"] / 8.0)), F.lit("pt "), kind, F.lit(" #"), b["color"]))
