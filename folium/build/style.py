"""Lengths and run styles for the builder."""

from __future__ import annotations

from folium.kernels.css import rounded

#: Twips per unit in the builder; cm and mm are exact here, unlike in CSS.
UNITS = {"twips": 1, "pt": 20, "mm": 56.6929133858, "cm": 566.929133858, "inch": 1440, "px": 15}


class Length:
    """Twips from other units."""

    @staticmethod
    def of(value: float, unit: str) -> int:
        return rounded(value * UNITS[unit])

    twips = staticmethod(lambda v: Length.of(v, "twips"))
    pt = staticmethod(lambda v: Length.of(v, "pt"))
    mm = staticmethod(lambda v: Length.of(v, "mm"))
    cm = staticmethod(lambda v: Length.of(v, "cm"))
    inch = staticmethod(lambda v: Length.of(v, "inch"))
    px = staticmethod(lambda v: Length.of(v, "px"))


def hex_color(value: str) -> str:
    return value.lstrip("#").lower()


class RunStyleBuilder:
    def __init__(self, base: dict | None = None):
        """A base style lends all but letter spacing and capitals."""
        self.style = {k: v for k, v in (base or {}).items() if k not in ("spacing", "all_caps", "small_caps")}

    def _set(self, **values) -> RunStyleBuilder:
        self.style.update(values)
        return self

    def bold(self, on: bool = True):
        return self._set(bold=on)

    def italic(self, on: bool = True):
        return self._set(italic=on)

    def underline(self, on: bool = True):
        return self._set(underline=on)

    def strike(self, on: bool = True):
        return self._set(strike=on)

    def superscript(self):
        return self._set(superscript=True, subscript=False)

    def subscript(self):
        return self._set(subscript=True, superscript=False)

    def color(self, value: str):
        return self._set(color=hex_color(value))

    def background(self, value: str):
        return self._set(background=hex_color(value))

    def font(self, name: str):
        return self._set(font=name)

    def font_east_asia(self, name: str):
        return self._set(font_east=name)

    def size(self, points: float):
        return self._set(size=rounded(points * 2))

    def highlight(self, name: str):
        return self._set(highlight=name)

    def build(self) -> dict:
        return dict(self.style)
