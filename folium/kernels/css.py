"""CSS values and inline styles for the tree kernels (the Column forms are in folium.functions.css)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache, wraps

#: Twips per unit; a bare number is in px. em and rem stand for 10pt text.
TWIPS = {"pt": 20, "px": 15, "in": 1440, "cm": 567, "mm": 56.6929, "em": 200, "rem": 200, "dxa": 1, "twip": 1}
#: The named colours.
COLORS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080",
    "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080",
    "aqua": "00ffff", "cyan": "00ffff", "orange": "ffa500",
}
#: Border styles by CSS name.
BORDERS = {"solid": "single", "double": "double", "dashed": "dashed", "dotted": "dotted", "thick": "thick"}
ALIGN = {"left": "start", "start": "start", "center": "center", "right": "end", "end": "end", "justify": "both"}
VALIGN = {"top": "top", "middle": "center", "center": "center", "bottom": "bottom"}
_ASCII_SPACE = " \t\n\r\0\x0b"
_DIGITS = "0123456789"
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?", re.A | re.I)


def short_once(read: Callable) -> Callable:
    """read(value), once for equal short values; what it returns is shared."""
    kept = lru_cache(maxsize=1024)(read)
    return wraps(read)(lambda value: read(value) if value is not None and len(value) > 64 else kept(value))


def rounded(x: float) -> int:
    """Half away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def clean(value: str) -> str:
    return value.strip(_ASCII_SPACE).lower()


def quantity(value: str | None) -> tuple[float, str] | None:
    """A number and the unit after it ("" without one); None for anything else. A sign may only be a minus."""
    text = clean(value or "")
    whole, dot, rest = text.removeprefix("-").partition(".")
    lead = rest if dot else whole
    tail = lead.lstrip(_DIGITS)
    digits = (whole, lead[: len(lead) - len(tail)]) if dot else (lead[: len(lead) - len(tail)], "0")
    if not all(d and not d.strip(_DIGITS) for d in digits):
        return None
    size = float(".".join(digits))
    return (-size if text.startswith("-") else size), tail.strip()


@short_once
def twips(value: str | None) -> int | None:
    size, unit = quantity(value) or (0.0, "?")
    factor = TWIPS.get(unit or "px")
    return None if factor is None else rounded(size * factor)


@short_once
def percent(value: str | None) -> float | None:
    size, unit = quantity(value) or (0.0, "?")
    return size if unit == "%" else None


@short_once
def half_points(value: str | None) -> int | None:
    size = twips(value)
    return None if size is None else rounded(size / 10)


@short_once
def color(value: str | None) -> str | None:
    """Six hex digits of a named colour, #rgb, #rrggbb, rgb() or rgba(); alpha is left out."""
    v = clean(value or "")
    if v.startswith("#"):
        digits = v[1:] if len(v) != 4 else "".join(2 * c for c in v[1:])
        return digits if len(digits) == 6 and not digits.strip("0123456789abcdef") else None
    name, bracket, inside = v.partition("(")
    if not bracket or name not in ("rgb", "rgba"):
        return COLORS.get(v)
    channels = inside.replace(",", " ").split()[:3]
    if len(channels) == 3:
        channels[2] = channels[2][: len(channels[2]) - len(channels[2].lstrip(_DIGITS))]  # the bracket or a fraction may follow
    if len(channels) < 3 or not all(c and not c.strip(_DIGITS) for c in channels):
        return None
    return bytes(min(int(c), 255) for c in channels).hex()


def _eighths(word: str) -> int | None:
    """A border width in eighths of a point; a pixel, and a bare number, counts six."""
    size, unit = quantity(word) or (-1.0, "?")
    return rounded(size * {"": 6, "px": 6, "pt": 8}[unit]) if size >= 0 and unit in ("", "px", "pt") else None


def border(value: str) -> dict:
    """Style, size and colour from the words of a border in any order; the last word of each kind counts."""
    words = clean(value).split()
    if words and words[0] in (("none", "0") if len(words) == 1 else ("0",)):
        return {"style": "none", "size": 4, "color": "000000"}
    found: dict = {}
    for word in words:
        kinds = (("color", color(word)), ("size", _eighths(word)), ("style", BORDERS.get(word)))
        found.update(next(([(kind, x)] for kind, x in kinds if x is not None), []))
    return {"style": found.get("style", "single"), "size": max(2, found.get("size", 4)), "color": found.get("color", "000000")}


def declarations(style: str | None) -> dict[str, str]:
    """name -> value; names lower-cased, the last value of a name wins at the place of the first."""
    out: dict[str, str] = {}
    if not style:
        return out
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        name, value = clean(name), value.strip(_ASCII_SPACE)
        if colon and name and value:
            out[name] = value
    return out


def four_sides(value: str) -> tuple:
    parts = [twips(p) for p in value.split()]
    return {1: lambda: parts * 4, 2: lambda: parts * 2, 3: lambda: [*parts, parts[1]], 4: lambda: parts}.get(len(parts), lambda: [None] * 4)()


@short_once
def line_height(value: str) -> int | None:
    v = value.strip(_ASCII_SPACE)
    if v.endswith("%"):
        lead = _NUMBER.match(v)
        return rounded((float(lead[0]) if lead else 0.0) / 100 * 240)
    if _NUMBER.fullmatch(v):
        return rounded(float(v) * 240)
    return twips(v)


@short_once
def is_bold(value: str) -> bool:
    v = clean(value)
    return v in ("bold", "bolder") or bool(_NUMBER.fullmatch(v) and int(float(v)) >= 600)


def _put(style: dict, key: str, value) -> None:
    if value is not None:
        style[key] = value


def run_style(base: dict, css: dict[str, str]) -> dict:
    if not css and "all_caps" not in base and "small_caps" not in base:
        return base
    out = {k: v for k, v in base.items() if k not in ("all_caps", "small_caps")}  # CSS parsing does not carry capitals
    for name, value in css.items():
        v = clean(value)
        if name == "font-size":
            _put(out, "size", half_points(value))
        elif name == "color":
            _put(out, "color", color(value))
        elif name in ("background", "background-color"):
            _put(out, "background", color(value))
        elif name == "font-family":
            first = value.split(",")[0].strip(_ASCII_SPACE).strip("'\"")
            _put(out, "font", first or None)
        elif name == "font-weight":
            out["bold"] = is_bold(value)
        elif name == "font-style":
            out["italic"] = v in ("italic", "oblique")
        elif name in ("text-decoration", "text-decoration-line"):
            out.update({k: True for word, k in (("underline", "underline"), ("line-through", "strike")) if word in v})
        elif name == "letter-spacing":
            if v == "normal":
                out.pop("spacing", None)
            else:
                _put(out, "spacing", twips(value))
        elif name == "vertical-align" and v in ("super", "sub"):
            out["superscript"], out["subscript"] = v == "super", v == "sub"
    return out


_SIDES = {"margin-top": "before", "margin-right": "right", "margin-bottom": "after", "margin-left": "left", "text-indent": "first"}


def paragraph_style(base: dict, css: dict[str, str]) -> dict:
    if not css and "keep_next" not in base and "keep_lines" not in base and "line_rule" not in base:
        return base
    out = {k: v for k, v in base.items() if k not in ("keep_next", "keep_lines", "line_rule")}
    for name, value in css.items():
        if name == "text-align":
            _put(out, "align", ALIGN.get(clean(value)))
        elif name == "margin":
            for key, side in zip(("before", "right", "after", "left"), four_sides(value)):
                _put(out, key, side)
        elif name in _SIDES:
            _put(out, _SIDES[name], twips(value))
        elif name == "line-height":
            _put(out, "line", line_height(value))
        elif name in ("background", "background-color"):
            _put(out, "shading", color(value))
        elif name in ("page-break-after", "break-after"):
            out["break_after"] = clean(value) in ("always", "page")
        elif name in ("page-break-before", "break-before"):
            out["break_before"] = clean(value) in ("always", "page")
    return out


def _width(style: dict, value: str) -> None:
    share = percent(value)
    if share is not None:
        style["width_pct"] = rounded(share * 50)
        style.pop("width", None)
    elif (size := twips(value)) is not None:
        style["width"] = size
        style.pop("width_pct", None)


def _whole(value: str | None, default: int) -> int:
    found = re.match(r"\s*[+-]?\d+", value) if value is not None else None
    return int(found[0]) if found else (default if value is None else 0)


def cell_style(css: dict[str, str], attrs: dict[str, str]) -> dict:
    out: dict = {}
    if "width" in attrs:
        _width(out, attrs["width"])
    if "valign" in attrs:
        _put(out, "valign", VALIGN.get(clean(attrs["valign"])))
    if "bgcolor" in attrs:
        _put(out, "background", color(attrs["bgcolor"]))
    for name, value in css.items():
        if name == "width":
            _width(out, value)
        elif name == "padding":
            for side, size in zip(("top", "right", "bottom", "left"), four_sides(value)):
                _put(out, f"pad_{side}", size)
        elif name.startswith("padding-") and name[8:] in ("top", "right", "bottom", "left"):
            _put(out, f"pad_{name[8:]}", twips(value))
        elif name in ("background", "background-color"):
            _put(out, "background", color(value))
        elif name == "vertical-align":
            _put(out, "valign", VALIGN.get(clean(value)))
        elif name == "border":
            out["borders"] = dict.fromkeys(("top", "right", "bottom", "left"), border(value))
        elif name.startswith("border-") and name[7:] in ("top", "right", "bottom", "left"):
            out["borders"] = {**out.get("borders", {}), name[7:]: border(value)}
    for key, attr in (("grid_span", "colspan"), ("row_span", "rowspan")):
        if attr in attrs and (n := max(1, _whole(attrs[attr], 1))) > 1:
            out[key] = n
    return out


def table_style(css: dict[str, str], attrs: dict[str, str]) -> dict:
    out: dict = {}
    around = lambda b: dict.fromkeys(("top", "right", "bottom", "left", "insideH", "insideV"), b)
    if "width" in attrs:
        _width(out, attrs["width"])
    _put(out, "align", {k: v for k, v in ALIGN.items() if k != "justify"}.get(clean(attrs.get("align", ""))))
    if "border" in attrs:
        out["borders"] = around(border(f"{attrs['border']}px solid #000"))
    for name, value in css.items():
        if name == "width":
            _width(out, value)
        elif name == "table-layout":
            out["fixed"] = clean(value) == "fixed"
        elif name == "border":
            out["borders"] = around(border(value))
        elif name == "margin-left":
            _put(out, "indent", twips(value))
    return out


def inline(html: str) -> str:
    """Move the rules of <style> blocks into style attributes: type, .class, #id and type.class selectors.

    Rules apply in order of specificity, then of place; an element's own style wins. Other selectors are left.
    """
    sheets = re.findall(r"(?is)<style\b[^>]*>(.*?)</style>", html)
    rules: list[tuple[tuple, str, str, str, str]] = []
    for sheet in sheets:
        for at, found in enumerate(re.finditer(r"([^{}]+)\{([^{}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", sheet))):
            for selector in found[1].split(","):
                one = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:\.([\w-]+))?(?:#([\w-]+))?", selector.strip())
                if one and any(one.groups()):
                    weight = (bool(one[3]), bool(one[2]), bool(one[1]))
                    rules.append(((*weight, len(rules), at), (one[1] or "").lower(), one[2] or "", one[3] or "", found[2].strip().rstrip(";")))
    if not rules:
        return html
    rules.sort(key=lambda r: r[0])

    def styled(tag: re.Match) -> str:
        name, rest = tag[1].lower(), tag[2]
        attr = lambda key: (re.search(rf"""(?i)(?<![\w-]){key}\s*=\s*(?:"([^"]*)"|'([^']*)')""", rest))
        read = lambda m: (m[1] if m[1] is not None else m[2]) if m else ""
        classes, own = read(attr("class")).split(), attr("style")
        add = [body for _, t, c, i, body in rules if t in ("", name) and (not c or c in classes) and (not i or i == read(attr("id")))]
        if not add:
            return tag[0]
        whole = ";".join([*add, read(own)]).rstrip(";").replace('"', "'")
        if own:
            rest = rest[: own.start()] + rest[own.end() :]
        slash = "/" if rest.rstrip().endswith("/") else ""
        return f'<{tag[1]} {rest.rstrip().rstrip("/").strip()} style="{whole}"{slash}>'.replace("  ", " ")

    return re.sub(r"<([a-zA-Z][\w-]*)((?:\s+[^<>]*)?)>", styled, re.sub(r"(?is)<style\b[^>]*>.*?</style>", "", html))
