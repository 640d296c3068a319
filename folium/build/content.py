"""Inline and block content that builders share."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from folium.build.style import Length, RunStyleBuilder
from folium.kernels import images
from folium.kernels.nodes import EMU_PX, Node, field_node, instruction, paragraph, run

DEFAULT_PX = 100
WEB = ("png", "jpeg", "gif", "bmp")


def _applied(value: Any, build: Callable) -> Any:
    """A callable receives a fresh builder; anything else is taken as it is."""
    made = build()
    value(made)
    return made


def image(data: bytes, kind: str, width: int | None = None, height: int | None = None, alt: str | None = None, position: dict | None = None) -> Node:
    """Sizes in px: a missing one follows from the other and the bytes, else from the bytes, else 100."""
    own = images.size(data)
    if width is None and height is None:
        width, height = own or (DEFAULT_PX, DEFAULT_PX)
    elif own and own[0] and own[1]:
        width = width if width is not None else max(1, round(height * own[0] / own[1]))
        height = height if height is not None else max(1, round(width * own[1] / own[0]))
    width, height = width or DEFAULT_PX, height or DEFAULT_PX
    return Node("image", {"binary": data, "format": kind, "width": width * EMU_PX, "height": height * EMU_PX, "alt": alt, "offset": 0, "position": position})


def _known(kind: str | None, what: str) -> str:
    if kind not in WEB:
        raise ValueError(f"unknown image format: {what}")
    return kind


class Inlines:
    """Runs, links, fields and images in a row."""

    def __init__(self, style: dict | None = None):
        self.nodes: list[Node] = []
        self.run_style: dict = style or {}

    def add(self, node: Node):
        self.nodes.append(node)
        return self

    def text(self, text: str, **style):
        return self.add(run(text, {**self.run_style, **style}))

    def bold(self, text: str):
        return self.text(text, bold=True)

    def italic(self, text: str):
        return self.text(text, italic=True)

    def underline(self, text: str):
        return self.text(text, underline=True)

    def strike(self, text: str):
        return self.text(text, strike=True)

    def sup(self, text: str):
        return self.text(text, superscript=True)

    def sub(self, text: str):
        return self.text(text, subscript=True)

    def line_break(self):
        return self.add(Node("br"))

    def styled(self, text: str, style: Callable[[RunStyleBuilder], Any] | dict):
        made = style if isinstance(style, dict) else _applied(style, lambda: RunStyleBuilder(self.run_style)).build()
        return self.add(run(text, made))

    def with_run_style(self, style: dict):
        """The style of what is added from now on."""
        self.run_style = style
        return self

    def _within(self, content) -> list[Node]:
        if isinstance(content, str):
            return [run(content, dict(self.run_style))]
        return _applied(content, lambda: Inlines(self.run_style)).nodes if callable(content) else list(content)

    def link(self, href: str, content):
        return self.add(Node("link", {"href": href}, self._within(content)))

    def internal_link(self, anchor: str, content):
        return self.add(Node("link", {"anchor": anchor}, self._within(content)))

    def bookmark(self, name: str, content):
        """The name is taken as it is."""
        return self.add(Node("bookmark", {"name": name}, self._within(content)))

    def field(self, name: str, format: str | None = None):
        return self.add(field_node(instruction(name, format), dict(self.run_style)))

    def page_number(self):
        return self.field("page")

    def total_pages(self):
        return self.field("total")

    def current_date(self, format: str = "dd.MM.yyyy"):
        return self.field("date", format)

    def current_time(self, format: str = "HH:mm"):
        return self.field("time", format)

    def merge_field(self, name: str):
        return self.add(field_node(f"MERGEFIELD {name} \\* MERGEFORMAT", dict(self.run_style)))

    def image(self, node: Node):
        return self.add(node)

    def image_from_bytes(self, data: bytes, kind: str | None = None, **options):
        return self.add(image(data, _known(kind or images.sniff(data), "bytes"), **options))

    def image_from_file(self, path: str, **options):
        """Raises when the file cannot be read or its format is unknown."""
        data = Path(path).read_bytes()
        return self.add(image(data, _known(images.format_of(path, data), path), **options))

    def image_from_data_url(self, url: str, **options):
        """An invalid URL adds nothing."""
        found = re.fullmatch(r"data:image/(\w+);base64,(.+)", url, re.S)
        kind = {"jpg": "jpeg"}.get(found[1].lower(), found[1].lower()) if found else None
        try:
            data = base64.b64decode(found[2], validate=True) if kind in WEB else b""
        except ValueError:
            data = b""
        return self.add(image(data, kind, **options)) if data else self


class Paragraph(Inlines):
    """A paragraph's content and style."""

    def __init__(self):
        super().__init__()
        self.style: dict = {}
        self.heading: int | None = None
        self.id: str | None = None

    def set(self, **values):
        """Style values that are not None; None keeps what is there."""
        self.style.update({k: v for k, v in values.items() if v is not None})
        return self

    def with_style(self, style: dict):
        self.style = dict(style)
        return self

    def heading_level(self, level: int | None):
        self.heading = level
        return self

    def style_id(self, key: str | None):
        self.id = key
        return self

    def align(self, how: str):
        return self.set(align=how)

    def align_center(self):
        return self.align("center")

    def align_right(self):
        return self.align("end")

    def align_justify(self):
        return self.align("both")

    def indent(self, left: float | None = None, right: float | None = None, first: float | None = None, unit: str = "twips"):
        size = lambda v: None if v is None else Length.of(v, unit)
        return self.set(left=size(left), right=size(right), first=size(first))

    def spacing(self, before: float | None = None, after: float | None = None, line: float | None = None, unit: str = "twips"):
        size = lambda v: None if v is None else Length.of(v, unit)
        return self.set(before=size(before), after=size(after), line=size(line))

    def page_break_before(self, on: bool = True):
        return self.set(break_before=on)

    def widow_control(self, on: bool = True):
        return self.set(widow=on)

    def borders(self, borders: dict):
        return self.set(borders=borders)

    def build(self) -> Node:
        node = paragraph(self.nodes, self.style, self.heading)
        node.attrs["style_id"] = self.id
        return node


class Blocks:
    """Block content in a row."""

    def __init__(self):
        self.blocks: list[Node] = []

    def block(self, node: Node | Iterable[Node]):
        self.blocks.extend([node] if isinstance(node, Node) else node)
        return self

    def paragraph(self, content: str | Callable[[Paragraph], Any]):
        made = _applied(content, Paragraph) if callable(content) else Paragraph().text(content)
        return self.block(made.build())

    def heading(self, level: int, content: str | Callable[[Paragraph], Any]):
        if level not in range(1, 7):
            raise ValueError(f"a heading's level is 1 to 6, not {level}")
        made = _applied(content, Paragraph) if callable(content) else Paragraph().text(content)
        return self.block(made.heading_level(level).build())

    def page_break(self):
        return self.block(Node("pagebreak"))

    def horizontal_rule(self):
        return self.block(Node("hr"))

    def empty_line(self):
        return self.block(paragraph())

    def table(self, content: Callable):
        from folium.build.table import TableBuilder

        return self.block(_applied(content, TableBuilder).build())

    def bullet_list(self, content):
        return self.block(make_list(content, False))

    def ordered_list(self, content):
        return self.block(make_list(content, True))

    def image(self, node: Node):
        return self.block(node)

    def image_from_bytes(self, data: bytes, kind: str | None = None, **options):
        return self.block(image(data, _known(kind or images.sniff(data), "bytes"), **options))

    def image_from_file(self, path: str, **options):
        data = Path(path).read_bytes()
        return self.block(image(data, _known(images.format_of(path, data), path), **options))

    def clear(self):
        self.blocks.clear()
        return self


class ListItem(Inlines):
    def __init__(self, ordered: bool):
        super().__init__()
        self.ordered, self.nested = ordered, None

    def with_nested(self, content: Callable[[ListBuilder], Any]):
        """A list below the item, of the same kind."""
        self.nested = make_list(content, self.ordered)
        return self

    def build(self) -> Node:
        return Node("item", {"style": {}, "hidden": False}, self.nodes + ([self.nested] if self.nested else []))


class ListBuilder:
    def __init__(self, ordered: bool):
        self.ordered, self.items, self.kind, self.start = ordered, [], None, 1

    def item(self, content: str | Callable[[ListItem], Any], nested: Callable[[ListBuilder], Any] | None = None):
        made = _applied(content, lambda: ListItem(self.ordered)) if callable(content) else ListItem(self.ordered).text(content)
        if nested:
            made.with_nested(nested)
        self.items.append(made.build())
        return self

    def format(self, kind: str):
        self.kind = kind
        return self

    def start_at(self, n: int):
        self.start = max(1, n)
        return self

    def build(self) -> Node:
        return Node("list", {"ordered": self.ordered, "format": self.kind or ("decimal" if self.ordered else "bullet"), "start": self.start, "level_text": None}, self.items)


def make_list(content: Callable[[ListBuilder], Any] | Iterable[str], ordered: bool) -> Node:
    builder = ListBuilder(ordered)
    if callable(content):
        content(builder)
    else:
        for text in content:
            builder.item(text)
    return builder.build()
