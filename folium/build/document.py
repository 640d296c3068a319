"""The document builder: sections with bodies, headers and footers."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from folium.build.content import Blocks, _applied
from folium.build.style import Length
from folium.kernels.docx_write import write_docx
from folium.kernels.nodes import Document, Section


def page_setup(paper: str = "A4", orientation: str = "portrait", margins_mm: tuple | None = None, width: int | None = None, height: int | None = None) -> dict:
    """margins_mm: top, right, bottom, left; width and height in twips make a size of its own."""
    out: dict = {"paper": paper, "orientation": orientation}
    if margins_mm:
        out["margins"] = tuple(Length.mm(m) for m in margins_mm)
    return out | ({"width": width, "height": height} if width and height else {})


class DocumentBuilder(Blocks):
    def __init__(self):
        super().__init__()
        self.done: list[Section] = []
        self.current = Section()
        self.mark: str | None = None
        self.core: dict = {}
        self.registry: dict | None = None

    @classmethod
    def new(cls) -> DocumentBuilder:
        return cls()

    def page_setup(self, page: dict):
        self.current.page = page
        return self

    def watermark(self, text: str | None):
        self.mark = text
        return self

    def styles(self, registry: dict[str, tuple[dict, dict]]):
        """style id -> (run style, paragraph style), in place of the default styles."""
        self.registry = registry
        return self

    def core_properties(self, **values):
        self.core.update(values)
        return self

    def _part(self, which: str, kind: str, content: Callable[[Blocks], Any] | str):
        made = _applied(content, Blocks) if callable(content) else Blocks().paragraph(content)
        getattr(self.current, which)[kind] = made.blocks
        return self

    def header(self, content):
        return self._part("headers", "default", content)

    def footer(self, content):
        return self._part("footers", "default", content)

    def first_header(self, content):
        return self._part("headers", "first", content)

    def first_footer(self, content):
        return self._part("footers", "first", content)

    def even_header(self, content):
        return self._part("headers", "even", content)

    def even_footer(self, content):
        return self._part("footers", "even", content)

    def new_section(self, start: str = "nextPage", page: dict | None = None):
        """Close the section; the next one keeps the page setup unless it gets its own."""
        self._close()
        self.current = Section(page=page if page is not None else self.done[-1].page, start=start)
        return self

    def _close(self) -> None:
        self.current.body = list(self.blocks)
        self.done.append(self.current)
        self.blocks.clear()

    def build(self) -> Document:
        sections = [*self.done, Section(list(self.blocks), self.current.headers, self.current.footers, self.current.page, self.current.start)]
        return Document(sections, self.mark, dict(self.core))

    def to_bytes(self) -> bytes:
        return write_docx(self.build(), self.registry)

    def to_file(self, path: str) -> None:
        Path(path).write_bytes(self.to_bytes())
