"""Tables for the builder, and tables from rows of data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from folium.build.content import Blocks, _applied
from folium.build.style import Length, hex_color
from folium.kernels.css import rounded
from folium.kernels.html_read import expand_spans
from folium.kernels.nodes import Node, paragraph, run


def _sides(top: float, right: float | None, bottom: float | None, left: float | None, unit: str) -> dict[str, int]:
    """CSS shorthand: right follows top, bottom top, left right."""
    right = top if right is None else right
    values = (top, right, top if bottom is None else bottom, right if left is None else left)
    return {k: Length.of(v, unit) for k, v in zip(("top", "right", "bottom", "left"), values)}


class _Sized:
    """A width in twips or in percent, never both."""

    style: dict

    def width(self, value: float, unit: str = "twips"):
        self.style.pop("width_pct", None)
        self.style["width"] = Length.of(value, unit)
        return self

    def width_percent(self, value: float):
        self.style.pop("width", None)
        self.style["width_pct"] = rounded(min(100.0, max(0.0, value)) * 50)
        return self


class CellBuilder(Blocks, _Sized):
    def __init__(self):
        super().__init__()
        self.style: dict = {}

    def padding(self, top: float, right: float | None = None, bottom: float | None = None, left: float | None = None, unit: str = "twips"):
        self.style.update({f"pad_{k}": v for k, v in _sides(top, right, bottom, left, unit).items()})
        return self

    def background(self, value: str):
        self.style["background"] = hex_color(value)
        return self

    def valign(self, how: str):
        self.style["valign"] = how
        return self

    def valign_center(self):
        return self.valign("center")

    def valign_bottom(self):
        return self.valign("bottom")

    def borders(self, borders: dict):
        self.style["borders"] = borders
        return self

    def grid_span(self, n: int):
        self.style["grid_span"] = max(1, n)
        return self

    def row_span(self, n: int):
        self.style["row_span"] = max(1, n)
        return self

    def build(self) -> Node:
        return Node("cell", {"style": self.style}, self.blocks or [paragraph()])


class RowBuilder:
    def __init__(self):
        self.made: list[Node] = []
        self.attrs: dict = {"header": False, "cant_split": False}

    def cell(self, content: str | Callable[[CellBuilder], Any]):
        made = _applied(content, CellBuilder) if callable(content) else CellBuilder().paragraph(content)
        self.made.append(made.build())
        return self

    def add_cell(self, node: Node):
        self.made.append(node)
        return self

    def cells(self, contents: Iterable):
        for content in contents:
            self.cell(content)
        return self

    def header(self, on: bool = True):
        self.attrs["header"] = on
        return self

    def height(self, value: float, unit: str = "twips", rule: str = "atLeast"):
        self.attrs.update(height=Length.of(value, unit), height_rule=rule)
        return self

    def exact_height(self, value: float, unit: str = "twips"):
        return self.height(value, unit, "exact")

    def cant_split(self, on: bool = True):
        self.attrs["cant_split"] = on
        return self

    def build(self) -> Node:
        return Node("row", self.attrs, self.made)


class ColumnBuilder:
    def __init__(self):
        self.twips: int | None = None

    def width(self, value: float, unit: str = "twips"):
        self.twips = Length.of(value, unit)
        return self

    def build(self) -> int | None:
        return self.twips


class TableBuilder(_Sized):
    def __init__(self):
        self.rows: list[Node] = []
        self.style: dict = {}
        self.title: str | None = None
        self.grid: list[int] | None = None

    def row(self, content: Callable[[RowBuilder], Any] | Sequence):
        made = _applied(content, RowBuilder) if callable(content) else RowBuilder().cells(content)
        self.rows.append(made.build())
        return self

    def header_row(self, content: Callable[[RowBuilder], Any] | Sequence):
        self.row(content)
        self.rows[-1].attrs["header"] = True
        return self

    def add_row(self, node: Node):
        self.rows.append(node)
        return self

    def caption(self, text: str):
        self.title = text
        return self

    def columns(self, *widths: int):
        self.grid = list(widths)
        return self

    def column(self, content: int | Callable[[ColumnBuilder], Any]):
        width = _applied(content, ColumnBuilder).build() if callable(content) else content
        self.grid = [*(self.grid or []), 2000 if width is None else width]
        return self

    def fixed_layout(self, on: bool = True):
        self.style["fixed"] = on
        return self

    def alignment(self, how: str):
        self.style["align"] = how
        return self

    def align_center(self):
        return self.alignment("center")

    def indent(self, value: float, unit: str = "twips"):
        self.style["indent"] = Length.of(value, unit)
        return self

    def borders(self, borders: dict):
        self.style["borders"] = borders
        return self

    def cell_margins(self, top: float, right: float | None = None, bottom: float | None = None, left: float | None = None, unit: str = "twips"):
        self.style.update({f"margin_{k}": v for k, v in _sides(top, right, bottom, left, unit).items()})
        return self

    def build(self, normalize: bool = True) -> Node:
        """normalize: give row spans the continuing cells that a package needs below them."""
        if normalize:
            expand_spans(self.rows)
        return Node("table", {"style": self.style, "caption": self.title, "grid": self.grid}, self.rows)


def table_from_rows(names: Sequence[str], rows: Iterable[Sequence], caption: str | None = None) -> Node:
    """A table with a header row of names; values are written as text, null as an empty cell."""
    cell = lambda v, style: Node("cell", {"style": {}}, [paragraph([run(str(v), style)] if v is not None else [])])
    made = [Node("row", {"header": True}, [cell(n, {"bold": True}) for n in names])]
    made += [Node("row", {"header": False}, [cell(v, {}) for v in row]) for row in rows]
    return Node("table", {"style": {}, "caption": caption, "grid": None}, made)


def borders_all(style: str = "single", size: int = 4, color: str = "000000", inside: bool = True) -> dict:
    return dict.fromkeys(("top", "right", "bottom", "left", *(("insideH", "insideV") if inside else ())), {"style": style, "size": size, "color": color})


def borders_none() -> dict:
    return borders_all("none")
