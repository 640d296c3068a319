"""Run and paragraph properties of OOXML, themes, style cascades and numbering definitions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from folium.kernels.nodes import KEPT_LENGTH, KEPT_RECORDS
from folium.kernels.package import A, W, child, digits, local, toggle, val

_HEX = re.compile(r"[0-9A-Fa-f]{6}")
_LEADING = re.compile(r"\s*[+-]?\d+")
LIST_FORMATS = ("bullet", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")


def leading(text: str | None) -> int:
    """The integer a string begins with, else 0."""
    found = _LEADING.match(text or "")
    return int(found[0]) if found else 0


@dataclass
class Theme:
    """Colours by scheme name and fonts by theme attribute value, both in lower case."""

    colors: dict[str, str] = field(default_factory=dict)
    fonts: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, root: ET.Element | None, strict: bool = True) -> Theme:
        """strict keeps the alias of the "HAnsi" fonts in mixed case, so that look-ups of it miss."""
        theme = cls()
        base = None if root is None else root.find(f"{A}themeElements")
        for entry in child(base, "clrScheme", A) if child(base, "clrScheme", A) is not None else ():
            plain, system = child(entry, "srgbClr", A), child(entry, "sysClr", A)
            found = plain.get("val") if plain is not None else None
            if not found and system is not None:
                found = system.get("lastClr") or {"windowtext": "000000", "window": "ffffff"}.get(system.get("val", "").lower())
            if found and local(entry, A):
                theme.colors[local(entry, A).lower()] = found.lower()
        for part in ("major", "minor"):
            latin = child(child(child(base, "fontScheme", A), f"{part}Font", A), "latin", A)
            if latin is not None and latin.get("typeface"):
                theme.fonts[f"{part}ascii"] = latin.get("typeface")
                theme.fonts[f"{part}HAnsi" if strict else f"{part}hansi"] = latin.get("typeface")
        return theme


def fill(e: ET.Element) -> str | None:
    found = e.get(f"{W}fill")
    return found.lower() if found and found != "auto" else None


def one_border(e: ET.Element) -> dict:
    kind = (val(e) or "single").lower()
    color = e.get(f"{W}color", "000000")
    return {
        "style": {"none": "none", "nil": "none", "dashed": "dashed", "dotted": "dotted", "double": "double"}.get(kind, "single"),
        "size": max(1, leading(e.get(f"{W}sz"))) if e.get(f"{W}sz") is not None else 4,
        "color": color.lower() if _HEX.fullmatch(color) else "000000",
    }


def borders(e: ET.Element) -> dict:
    return {local(c): one_border(c) for c in e if local(c) in ("top", "left", "bottom", "right", "insideH", "insideV")}


def run_props(rpr: ET.Element | None, theme: Theme) -> dict:
    """The properties that an rPr sets; complex-script variants are ignored."""
    out: dict = {}
    for e in rpr if rpr is not None else ():
        name = local(e)
        if name in ("b", "i", "caps", "smallCaps", "strike", "dstrike"):
            out[{"b": "bold", "i": "italic", "caps": "all_caps", "smallCaps": "small_caps"}.get(name, "strike")] = toggle(e)
        elif name == "u":
            out["underline"] = (val(e) or "single").lower() != "none"
        elif name == "vertAlign":
            out["superscript"], out["subscript"] = val(e) == "superscript", val(e) == "subscript"
        elif name == "color":
            out["color"] = val(e).lower() if val(e) and _HEX.fullmatch(val(e)) else theme.colors.get(e.get(f"{W}themeColor", "").lower())
        elif name in ("sz", "spacing"):
            out["size" if name == "sz" else "spacing"] = digits(val(e), signed=True)
        elif name == "rFonts":
            plain = next((e.get(W + k) for k in ("ascii", "hAnsi", "cs", "eastAsia") if e.get(W + k)), None)
            themed = (theme.fonts.get(e.get(f"{W}{k}Theme", "").lower()) for k in ("ascii", "hAnsi", "cs", "eastAsia"))
            out["font"] = plain or next((x for x in themed if x), None)
            out["font_east"] = e.get(f"{W}eastAsia") or out.get("font_east")
        elif name == "highlight":
            out["highlight"] = val(e)
        elif name == "shd":
            out["background"] = fill(e)
    return {k: v for k, v in out.items() if v is not None}


_INDENTS = {"left": "left", "start": "left", "right": "right", "end": "right", "firstLine": "first"}
_FLAGS = {"pageBreakBefore": "break_before", "keepNext": "keep_next", "keepLines": "keep_lines", "widowControl": "widow"}


def para_props(ppr: ET.Element | None) -> dict:
    """The properties that a pPr sets, with style_id, num_id and ilvl."""
    out: dict = {}
    for e in ppr if ppr is not None else ():
        name = local(e)
        if name == "pStyle":
            out["style_id"] = val(e)
        elif name == "jc":
            out["align"] = {"center": "center", "right": "end", "end": "end", "both": "both", "distribute": "distribute"}.get(val(e), "start")
        elif name == "ind":
            for attr, key in _INDENTS.items():
                if (n := digits(e.get(W + attr))) is not None:
                    out[key] = n
            if (hanging := leading(e.get(f"{W}hanging"))) > 0:
                out["first"] = -hanging
        elif name == "spacing":
            for attr in ("before", "after"):
                if e.get(W + attr) is not None:
                    out[attr] = leading(e.get(W + attr))
            if (line := leading(e.get(f"{W}line"))) > 0:
                out["line"], out["line_rule"] = line, e.get(f"{W}lineRule") or "auto"
        elif name in _FLAGS:
            out[_FLAGS[name]] = toggle(e)
        elif name == "pBdr":
            out["borders"] = borders(e)
        elif name == "shd":
            out["shading"] = fill(e)
        elif name == "numPr":
            out["num_id"], out["ilvl"] = digits(val(child(e, "numId"))), digits(val(child(e, "ilvl")))
    return {k: v for k, v in out.items() if v is not None}


def heading_level(style_id: str | None) -> int | None:
    found = re.fullmatch(r"heading([1-6])", style_id or "", re.I)
    return int(found[1]) if found else None


def _said(pr: ET.Element) -> list[tuple] | None:
    """Tags and attributes of properties, two levels of them; None where there are more."""
    out = []
    for e in pr:
        below = ()
        if len(e):
            if any(len(c) for c in e):
                return None
            below = tuple([(c.tag, *c.items()) for c in e])
        out.append((e.tag, below, *e.items()))
    return out


class Styles:
    """styles.xml: defaults, styles by id, and the cascade."""

    def __init__(self, root: ET.Element | None = None, theme: Theme | None = None):
        self.theme = theme or Theme()
        self.by_id: dict[str, tuple[str | None, dict, dict]] = {}
        self.defaults: dict[str, str] = {}
        self._chains: dict[str, tuple[dict, dict]] = {}
        self._known: dict[tuple, tuple] = {}
        doc = child(root, "docDefaults")
        self.doc = para_props(child(child(doc, "pPrDefault"), "pPr")), run_props(child(child(doc, "rPrDefault"), "rPr"), self.theme)
        for e in root.iter(f"{W}style") if root is not None else ():
            if key := e.get(f"{W}styleId"):
                if e.get(f"{W}default") == "1":
                    self.defaults.setdefault(e.get(f"{W}type", ""), key)
                self.by_id[key] = (val(child(e, "basedOn")), para_props(child(e, "pPr")), run_props(child(e, "rPr"), self.theme))

    def chain(self, key: str | None) -> tuple[dict, dict]:
        """Paragraph and run properties of a style with all it is based on; a cycle ends where it would close."""
        if key is None or key not in self.by_id:
            return {}, {}
        if key not in self._chains:
            line: list[str] = []
            at: str | None = key
            while at is not None and at in self.by_id and at not in line:
                line.append(at)
                at = self.by_id[at][0]
            para: dict = {}
            text: dict = {}
            for k in reversed(line):
                para |= self.by_id[k][1]
                text |= self.by_id[k][2]
            self._chains[key] = para, text
        return self._chains[key]

    def paragraph(self, ppr: ET.Element | None) -> tuple[dict, dict, int | None]:
        """Effective paragraph style (with num_id and ilvl only if set directly), base run style, heading level."""
        para, text, heading = self._once(self._paragraph, ppr)
        return dict(para), dict(text), heading

    def _once(self, read: Callable, pr: ET.Element | None):
        """read(pr), once for properties that say the same; most do."""
        if pr is None:
            key: tuple | None = (read.__name__,)
        elif (said := _said(pr)) is None:
            return read(pr)
        else:
            key = (read.__name__, *said)
        found = self._known.get(key)
        if found is None:
            found = read(pr)
            if len(repr(key)) <= KEPT_LENGTH:
                if len(self._known) >= KEPT_RECORDS:
                    self._known.clear()
                self._known[key] = found
        return found

    def _paragraph(self, ppr: ET.Element | None) -> tuple[dict, dict, int | None]:
        direct = para_props(ppr)
        named, base = self.chain(direct.get("style_id")), self.chain(self.defaults.get("paragraph"))
        para = self.doc[0] | base[0] | named[0] | direct
        for key in ("style_id", "num_id", "ilvl"):
            para.pop(key, None)
        para |= {k: direct[k] for k in ("style_id", "num_id", "ilvl") if k in direct}
        text = self.doc[1] | base[1] | self.chain(self.defaults.get("character"))[1] | named[1]
        return para, text, heading_level(direct.get("style_id"))

    def run(self, rpr: ET.Element | None, base: dict) -> dict:
        if rpr is None:
            return base
        return base | self._once(self._run, rpr)

    def _run(self, rpr: ET.Element) -> dict:
        return self.chain(val(child(rpr, "rStyle")))[1] | run_props(rpr, self.theme)


@dataclass
class Level:
    format: str = "decimal"
    start: int = 1
    text: str | None = None
    indent: int | None = None


def _level(e: ET.Element) -> Level:
    kind = val(child(e, "numFmt"))
    ind = child(child(e, "pPr"), "ind")
    found = next((ind.get(W + k) for k in ("left", "start") if ind.get(W + k)), None) if ind is not None else None
    return Level(kind if kind in LIST_FORMATS else "decimal", max(1, digits(val(child(e, "start"))) or 1), val(child(e, "lvlText")), leading(found) if found and re.fullmatch(r"\s*[+-]?\d+(\.\d*)?\s*", found) else None)


class Numbering:
    """numbering.xml: levels of every instance, overrides applied."""

    def __init__(self, root: ET.Element | None = None):
        self.levels: dict[int, dict[int, Level]] = {}
        self.key: dict[int, str] = {}
        plain: dict[int, dict[int, Level]] = {}
        for e in root.iter(f"{W}abstractNum") if root is not None else ():
            if (n := digits(e.get(f"{W}abstractNumId"))) is not None:
                plain[n] = {k: _level(x) for x in e.iter(f"{W}lvl") if (k := digits(x.get(f"{W}ilvl"))) is not None}
        for e in root.findall(f"{W}num") if root is not None else ():
            n, of = digits(e.get(f"{W}numId")), digits(val(child(e, "abstractNumId")))
            if n is None or of is None:
                continue
            own = dict(plain.get(of, {}))
            overrides = e.findall(f"{W}lvlOverride")
            for o in overrides:
                k = digits(o.get(f"{W}ilvl"))
                if k is None:
                    continue
                start, whole = digits(val(child(o, "startOverride"))), child(o, "lvl")
                if whole is not None:
                    own[k] = _level(whole)
                elif start is not None:
                    was = own.get(k, Level("bullet"))
                    own[k] = Level(was.format, start, was.text, was.indent)
            self.levels[n] = own
            # instances of one definition count together, unless an override starts them anew
            self.key[n] = f"n{n}" if overrides else f"a{of}"

    def has(self, n: int | None) -> bool:
        return n in self.levels

    def at(self, n: int, level: int) -> Level:
        """The level, else level 0, else a bullet."""
        own = self.levels.get(n, {})
        return own.get(level) or own.get(0) or Level("bullet")

    def text(self, n: int, level: int) -> str | None:
        found = self.levels.get(n, {}).get(level)
        return (found.text or None) if found else None

    def indent(self, n: int, level: int) -> int | None:
        found = self.levels.get(n, {}).get(level)
        return found.indent if found else None
