"""CSS values: the kernel's functions and the Column functions agree, on the documented cases."""

import pytest
from pyspark.sql import functions as F

from folium.functions import css as C
from folium.kernels import css as K

LENGTHS = {"12pt": 240, "1px": 15, "10px": 150, "1in": 1440, "1cm": 567, "1mm": 57, "50%": None, "auto": None, "inherit": None, "7": 105, "-2pt": -40, "2em": 400, "3dxa": 3, "x": None, "": None, "1 pt": 20, "5vh": None}
COLORS = {
    "": None, "#fff": "ffffff", "#F0A": "ff00aa", "rgb(20,184,166)": "14b8a6", "rgba(20, 184, 166, 0.5)": "14b8a6", "red": "ff0000", "teal": "008080", "nocolor": None, "transparent": None, "inherit": None,
    "rgb(300 0 0)": "ff0000", " #ABCDEF ": "abcdef", "#12345": None,
}


@pytest.mark.parametrize(("value", "expected"), LENGTHS.items())
def test_twips(value, expected):
    assert K.twips(value) == expected


@pytest.mark.parametrize(("value", "expected"), COLORS.items())
def test_color(value, expected):
    assert K.color(value) == expected


def test_nulls_and_percent():
    assert K.twips(None) is None and K.color(None) is None and K.percent("12pt") is None
    assert K.percent("50%") == 50.0 and K.percent("33.33%") == 33.33 and K.half_points("12pt") == 24
    assert [K.rounded(x) for x in (2.5, -2.5, 0.49)] == [3, -3, 0]


def test_columns_agree(spark):
    rows = [(v,) for v in [*LENGTHS, *COLORS, None]]
    df = spark.createDataFrame(rows, "v string")
    for row in df.select("v", C.twips(F.col("v")).alias("t"), C.color(F.col("v")).alias("c"), C.line_height(F.col("v")).alias("l"), C.percent(F.col("v")).alias("p")).collect():
        assert row["t"] == K.twips(row["v"]) and row["c"] == K.color(row["v"]) and row["p"] == K.percent(row["v"])


def test_borders(spark):
    cases = ["1px solid red", "dashed 2pt", "none", "0", "0 solid", "#123 double 3px", "thick"]
    got = {r["v"]: r["b"].asDict() for r in spark.createDataFrame([(c,) for c in cases], "v string").select("v", C.border(F.col("v")).alias("b")).collect()}
    for case in cases:
        assert got[case] == K.border(case)
    assert K.border("1px solid red") == {"style": "single", "size": 6, "color": "ff0000"}


def test_declarations(spark):
    style = "Color: red; ; color :blue;margin:1px 2px; bad; background:url(a:b)"
    assert K.declarations(style) == {"color": "blue", "margin": "1px 2px", "background": "url(a:b)"}
    got = spark.createDataFrame([(style,), (None,)], "s string").select(C.declarations(F.col("s")).alias("m")).collect()
    assert got[0]["m"] == K.declarations(style) and got[1]["m"] == {}


def test_styles():
    text = K.run_style({"all_caps": True, "highlight": "yellow"}, K.declarations("font-weight:600;font-style:oblique;text-decoration:underline line-through;vertical-align:super;font-family:'A B', serif"))
    assert text == {"highlight": "yellow", "bold": True, "italic": True, "underline": True, "strike": True, "superscript": True, "subscript": False, "font": "A B"}
    para = K.paragraph_style({"keep_next": True}, K.declarations("margin:1pt 2pt 3pt;line-height:1.5;text-align:justify;break-before:page"))
    assert para == {"before": 20, "right": 40, "after": 60, "left": 40, "line": 360, "align": "both", "break_before": True}
    assert K.cell_style(K.declarations("width:50%"), {"colspan": "2", "rowspan": "0", "bgcolor": "red"}) == {"background": "ff0000", "width_pct": 2500, "grid_span": 2}


def test_inliner():
    out = K.inline('<style>p.a{color:red} #x{color:blue} p{margin:1pt}</style><p class="a" style="color:green">t</p><b id="x">u</b>')
    assert K.declarations(out.split('style="')[1].split('"')[0]) == {"margin": "1pt", "color": "green"}
    assert 'style="color:blue"' in out
