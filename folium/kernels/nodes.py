"""The document tree that kernels build, and its flat form.

One Node class serves all kinds: "p", "run", "link", "bookmark", "field", "footnote", "image", "br", "pagebreak",
"hr", "table", "row", "cell", "list", "item". Attributes are plain values; style attributes are dicts that hold
only what differs from the defaults below. A document is a Document of sections of blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Container
from dataclasses import dataclass, field
from typing import Any

#: Defaults of the style records.
CELL_MARGINS = (0, 80, 0, 80)
MARGINS = (1133, 850, 1133, 850)
OFFSET = 283
PAPERS = {"A3": (16838, 23811), "A4": (11906, 16838), "A5": (8391, 11906), "Letter": (12240, 15840), "Legal": (12240, 20160)}
EMU_PX, EMU_TWIP = 9525, 635
DEPTH = 200  # deepest nesting a kernel follows


#: How many records are kept told, and how long one may be.
KEPT_RECORDS, KEPT_LENGTH = 1024, 1024


def told_once(tell: Callable[..., Any]) -> Callable[..., Any]:
    """tell(style), where most styles are alike: equal ones of plain values and the same types are told once. What it returns is shared."""
    kept: dict[tuple, Any] = {}

    def told(style: dict) -> Any:
        key = (*style, *style.values(), *map(type, style.values()))
        try:
            found = kept.get(key)
        except TypeError:  # borders are dicts
            return tell(style)
        if found is None:
            found = tell(style)
            if len(repr(key)) <= KEPT_LENGTH:
                if len(kept) >= KEPT_RECORDS:
                    kept.clear()
                kept[key] = found
        return found

    return told


@dataclass(slots=True)
class Node:
    kind: str
    attrs: dict[str, Any] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def get(self, key: str, default: Any = None) -> Any:
        return self.attrs.get(key, default)

    def text(self) -> str:
        """The text of the node and all below it."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.kind in ("run", "footnote"):
                out.append(node.attrs.get("text", ""))
            stack.extend(reversed(node.children))
        return "".join(out)


@dataclass
class Section:
    body: list[Node] = field(default_factory=list)
    headers: dict[str, list[Node]] = field(default_factory=dict)  # default, first, even
    footers: dict[str, list[Node]] = field(default_factory=dict)
    page: dict[str, Any] = field(default_factory=dict)
    start: str = "nextPage"

    def present(self, which: str) -> dict[str, list[Node]]:
        """Non-empty headers or footers by type."""
        return {k: v for k, v in getattr(self, which).items() if v}

    def has(self, kind: str) -> bool:
        return bool(self.headers.get(kind) or self.footers.get(kind))


@dataclass
class Document:
    sections: list[Section] = field(default_factory=lambda: [Section()])
    watermark: str | None = None
    core: dict[str, Any] = field(default_factory=dict)
    media: dict[str, bytes] = field(default_factory=dict)


def run(text: str, style: dict | None = None) -> Node:
    return Node("run", {"text": text, "style": style or {}})


def paragraph(children: list[Node] | None = None, style: dict | None = None, heading: int | None = None) -> Node:
    return Node("p", {"style": style or {}, "heading": heading}, children or [])


def field_node(instruction: str, style: dict | None = None) -> Node:
    return Node("field", {"instr": instruction, "style": style or {}})


#: Instruction of each field by name; {0} is the format.
FIELDS = {"page": "PAGE", "total": "NUMPAGES", "date": 'DATE \\@ "{0}"', "time": 'TIME \\@ "{0}"', "author": "AUTHOR", "title": "TITLE"}


def instruction(name: str, format: str | None = None) -> str:
    return FIELDS[name].format(format or {"date": "dd.MM.yyyy", "time": "HH:mm"}.get(name, ""))


#: A field's instruction is words, some in quotes; its first word names the field.
WORDS = r'(?:^|\s)("[^"]*"|\S+)'
#: The characters of a merge field's name, and the markup of a field by what its name begins with.
MERGE_CHARS = "A-Za-z0-9_."
FIELD_TAGS = {"PAGE": "page-number", "NUMPAGES": "page-total", "DATE": "current-date", "TIME": "current-time"}


def instruction_words(instr: str) -> list[str]:
    return re.findall(WORDS, instr)


def merge_name(instr: str) -> str | None:
    """The name in a MERGEFIELD instruction: a word in quotes as a whole, else what a bare word begins with."""
    field, name, *_ = [*instruction_words(instr), "", ""]
    if field.upper() != "MERGEFIELD":
        return None
    quoted = re.fullmatch(f'"([{MERGE_CHARS}]+)"', name)
    return quoted[1] if quoted else re.match(f"[{MERGE_CHARS}]*", name)[0] or None


def page_size(page: dict) -> tuple[int, int]:
    """Width and height in twips; landscape exchanges the sides of a named paper."""
    if page.get("width", 0) > 0 and page.get("height", 0) > 0:
        return page["width"], page["height"]
    w, h = PAPERS[page.get("paper", "A4")]
    return (h, w) if page.get("orientation") == "landscape" else (w, h)


def content_width(page: dict) -> int:
    _, right, _, left = page.get("margins", MARGINS)
    return page_size(page)[0] - left - right


#: Schema of the flat node table; ids are pre-order within a document.
NODE_SCHEMA = (
    "doc_id long, sec int, part string, node_id int, parent_id int, ord int, depth int, kind string, text string, heading int, "
    "href string, anchor string, name string, instr string, ordered boolean, format string, start_at int, row_span int, grid_span int, "
    "is_continue boolean, is_header boolean, bold boolean, italic boolean, underline boolean, strike boolean, style map<string,string>, media_sha string"
)


#: What node tables hold of a node beside its columns, in the style map: attribute, name there.
KEPT = (("indent", "indent"), ("hidden", "hidden"), ("cant_split", "cant_split"), ("marker_class", "marker_class"), ("level_text", "level_text"), ("grid", "grid"), ("alt", "alt"), ("width", "width"), ("height", "height"))


def _flat_style(style: dict) -> dict[str, str]:
    """Values as text; the borders of a style as border_<side>_<style, size or color>."""
    out = {}
    for k, v in style.items():
        if k == "borders":
            out |= {f"border_{side}_{part}": str(x) for side, b in (v or {}).items() if b for part, x in ({"style": "single", "size": 4, "color": "000000"} | b).items()}
        elif v is not None:
            out[k] = str(v).lower() if isinstance(v, bool) else str(v)
    return out


def _flat_attrs(node: Node) -> dict[str, str]:
    kept = {name: node.attrs[key] for key, name in KEPT if node.attrs.get(key) not in (None, False, [])}
    if node.kind == "footnote" and node.attrs.get("size") is not None:
        kept["note_size"] = node.attrs["size"]
    return {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in kept.items()}


NODE_COLUMNS = tuple(c.split()[0] for c in NODE_SCHEMA.split(", "))
#: Attributes that are columns as they are: attribute, column.
_PLAIN = {k: k for k in ("heading", "href", "anchor", "name", "instr", "ordered", "format")} | {"start": "start_at"}
_TEXTS = frozenset(("p", "item", "cell", "link", "bookmark"))
_FLAGS = ("bold", "italic", "underline", "strike")


def flatten(doc_id: int, doc: Document, kinds: Container[str] | None = None, columns: Container[str] = NODE_COLUMNS) -> list[dict]:
    """Rows of NODE_SCHEMA, pre-order; parts are body, header:<type>, footer:<type>. A column that a row lacks is null.

    kinds: of which nodes rows are made; ids count all nodes. Columns that cost work (texts, styles, digests) are made only if named.
    """
    rows: list[dict] = []
    number = -1
    texts, styles, digests = "text" in columns, "style" in columns, "media_sha" in columns
    for sec, section in enumerate(doc.sections):
        parts = {"body": section.body} | {f"header:{k}": v for k, v in section.headers.items()} | {f"footer:{k}": v for k, v in section.footers.items()}
        for part, blocks in parts.items():
            stack = [(b, None, k, 0) for k, b in reversed(list(enumerate(blocks)))]
            while stack:
                node, parent, at, depth = stack.pop()
                kind, number = node.kind, number + 1
                if node.children:
                    stack.extend((c, number, k, depth + 1) for k, c in reversed(list(enumerate(node.children))))
                if kinds is not None and kind not in kinds:
                    continue
                a = node.attrs
                style = a.get("style") or {}
                row = {"doc_id": doc_id, "sec": sec, "part": part, "node_id": number, "parent_id": parent, "ord": at, "depth": depth, "kind": kind}
                row.update([(_PLAIN[k], v) for k, v in a.items() if k in _PLAIN])
                if texts:
                    row["text"] = a.get("text") if kind in ("run", "footnote") else (node.text() if kind in _TEXTS else a.get("caption"))
                if kind == "cell":
                    row |= {"row_span": style.get("row_span", 1), "grid_span": style.get("grid_span", 1), "is_continue": bool(style.get("continue"))}
                elif kind == "row":
                    row["is_header"] = bool(a.get("header"))
                elif kind == "run":
                    row.update([(k, bool(style.get(k))) for k in _FLAGS])
                if styles:
                    row["style"] = _flat_style(style) | _flat_attrs(node)
                if digests and (binary := a.get("binary")):
                    row["media_sha"] = hashlib.sha256(binary).hexdigest()
                rows.append(row)
    return rows
