"""Motif logos: the layout as a table, and SVG text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import B, _term


@dataclass(frozen=True)
class Style:
    """Sizes in canvas units; the tick height and the labels lie inside the bottom margin."""

    top: int = 20
    bottom: int = 20
    side: int = 20
    column_width: int = 36
    column_height: int = 60
    label_height: int = 14
    tick: int = 3
    line: str = "stroke:black"
    font: str = "font-family:sans-serif"
    colors: tuple[str, ...] = ("purple", "blue", "green", "red")
    letters: tuple[str, ...] = ("A", "C", "T", "G")

    def margins(self, n: int) -> Style:
        return replace(self, top=n, bottom=n, side=n)

    def rna(self) -> Style:
        return replace(self, letters=("A", "C", "U", "G"))


def layout(frac: DataFrame, style: Style = Style()) -> DataFrame:  # noqa: B008
    """pos, base, height, y: each letter's height and the line it stands on, stacked in order A, C, T, G.

    A column is as high as its information, 1 less half its entropy.
    """
    e = sum((_term(F.col(b)) for b in B), F.lit(0.0)) / 2
    rows = frac.withColumn("e", e)
    share = F.lit(0.0)
    items = []
    for b in B:
        share = share + F.col(b)
        height = (1 - F.col("e")) * style.column_height
        items.append(F.struct(F.lit(b.upper()).alias("base"), (height * F.col(b)).alias("height"), (style.top + style.column_height * F.col("e") + height * share).alias("y")))
    return rows.select("pos", F.inline(F.array(*items)))


def svg(frac: DataFrame, style: Style = Style()) -> str:  # noqa: B008
    """The logo of one profile; a profile is as long as its motif, so it is drawn on the driver."""
    rows = layout(frac, style).orderBy("pos").collect()
    columns = max((r["pos"] for r in rows), default=-1) + 1
    width, height = 2 * style.side + style.column_width * columns, style.top + style.column_height + style.bottom
    axis = style.top + style.column_height
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    line = '<line x1="{}" y1="{}" x2="{}" y2="{}" style="{}"/>'
    out.append(line.format(style.side, axis, width - style.side, axis, style.line))
    for i in range(columns + 1):
        x = style.side + i * style.column_width
        out.append(line.format(x, axis, x, axis + style.tick, style.line))
        y = height - (style.bottom - style.label_height) // 2
        out.append(f'<text x="{x}" y="{y}" style="text-anchor:middle;font-size:{style.label_height}">{i}</text>')
    for r in rows:
        k = "ACTG".index(r["base"])
        x = style.side + r["pos"] * style.column_width
        scale = f"{style.column_width / 12:.2f},{r['height'] / 12:.2f}"
        out.append(f'<g transform="translate({x},{int(r["y"])}) scale({scale})"><text style="{style.font};fill:{style.colors[k]}">{style.letters[k]}</text></g>')
    return "\n".join([*out, "</svg>"])
