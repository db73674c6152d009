"""A map as lines of SVG. Every line is a row that Spark makes; the driver joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.values import short_number, xml_escape
from ..operators.classify import SEQUENTIAL, Palette, breaks_by, coloured, palette_of
from ..operators.geometry import path, plane
from ..sources.tables import POS

# Layout and type of the map.
EDGE, HEAD, BARE_HEAD, FOOT, BARE_FOOT = 24, 54, 12, 58, 34
SWATCH, STEP = 26, 28
FONT = "system-ui, -apple-system, Segoe UI, sans-serif"
INK, GREY, PAPER = "#12161c", "#626b78", "#ffffff"


def choropleth_rows(regions: DataFrame, values: DataFrame, classes: int = 5, method: str = "quantile", palette: Palette | str = SEQUENTIAL) -> DataFrame:
    """regions (name, POS, ...) with value, class and fill. values: (region, value)."""
    breaks = breaks_by(method, values, "value", classes)
    placed = regions.join(values.select(F.col("region").alias("name"), "value"), "name", "left")
    return coloured(placed, breaks, palette)


def _tag(name: str, content: Column | str | None = None, **attributes: Column | str | float) -> Column:
    """An element. Underscores in names of attributes stand for hyphens; text is taken as it is."""
    column = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k.replace("_", "-")}="'), column(v), F.lit('"')]
    return F.concat(*parts, *([F.lit("/>")] if content is None else [F.lit(">"), column(content), F.lit(f"</{name}>")]))


def _shapes(rows: DataFrame, p: Row, palette: Palette) -> DataFrame:
    """A path for each region, in their order."""
    said = F.concat(xml_escape(F.col("name")), F.lit(": "), F.coalesce(short_number(F.col("value")), F.lit("no data")))
    shape = _tag("path", _tag("title", said), d=path(p, F.col("rings")), fill=F.col("fill"), stroke=palette.stroke, stroke_width=0.7, fill_rule="evenodd")
    return rows.select(F.lit(1).alias("part"), F.col(POS).alias("place"), shape.alias("line"))


def _legend(ends: DataFrame, palette: Palette) -> DataFrame:
    """ends: one row (breaks, lowest). A swatch for each class with its lower bound, the last one's upper bound, and one for no data."""
    label = lambda x, text, **more: _tag("text", text, x=x, y=25, font_size=9.5, fill=GREY, **more)
    swatch = lambda x, colour: _tag("rect", x=x, y=0, width=SWATCH, height=11, fill=colour)
    n = F.least(F.size("breaks"), F.lit(len(palette.colours)))
    at = lambda i: (i * STEP).cast("string")
    shades = F.array(*map(F.lit, palette.colours))
    bounds = F.concat(F.array("lowest"), F.col("breaks"))
    classes = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(swatch(at(i - 1), F.get(shades, i - 1)), label(at(i - 1), short_number(F.get(bounds, i - 1))))))
    last = label((STEP * (n - 1) + SWATCH).cast("string"), short_number(F.get(bounds, n)), text_anchor="end")
    none_at = (STEP * n + 18).cast("string")
    none = F.concat(swatch(none_at, palette.no_data), label(none_at, "no data"))
    lines = F.concat(F.when(n > 0, F.array_append(classes, last)).otherwise(F.array().cast("array<string>")), F.array(none))
    return ends.select(F.lit(3).alias("part"), F.posexplode(lines).alias("place", "line"))


def svg_lines(regions: DataFrame, values: DataFrame, *, title: str = "", subtitle: str = "", classes: int = 5, method: str = "quantile", palette: Palette | str = SEQUENTIAL, width: int = 900, height: int = 900) -> DataFrame:
    """(part, place, line): the map's lines; joined in order of part and place they are the document.

    A region without a value is drawn as such, and a map of nothing but such regions is drawn too.
    """
    palette = palette_of(palette)
    breaks = breaks_by(method, values, "value", classes)
    p = plane(regions, width, height, padding=EDGE)
    ends = breaks.crossJoin(F.broadcast(values.agg(F.min("value").alias("lowest"))))
    head = HEAD if title else BARE_HEAD
    tall = (F.lit(p.down + head) + F.when(F.size("breaks") > 0, FOOT).otherwise(BARE_FOOT)).cast("string")
    opening = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{p.across}" height="'), tall, F.lit(f'" viewBox="0 0 {p.across} '), tall, F.lit(f'" font-family="{FONT}">'))
    above = [opening, _tag("rect", width="100%", height="100%", fill=PAPER)]
    for text, style in ((title, {"y": 30, "font_size": 19, "font_weight": 600, "fill": INK}), (subtitle, {"y": 47, "font_size": 12.5, "fill": GREY})):
        if text:
            above.append(_tag("text", xml_escape(F.lit(text)), x=EDGE, **style))
    above.append(F.lit(f'<g transform="translate(0,{head})">'))
    between = [F.lit("</g>"), F.lit(f'<g transform="translate({EDGE},{head + p.down + 18})">')]
    fixed = lambda part, lines: ends.select(F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("place", "line"))
    parts = [fixed(0, above), _shapes(choropleth_rows(regions, values, classes, method, palette), p, palette), fixed(2, between), _legend(ends, palette), fixed(4, [F.lit("</g></svg>")])]
    return reduce(DataFrame.unionByName, (x.withColumn("place", F.col("place").cast("long")) for x in parts))


def render(regions: DataFrame, values: DataFrame, **options) -> str:
    """The SVG text, as svg_lines() makes it. The driver holds the document, as its reader will."""
    return "\n".join(r.line for r in svg_lines(regions, values, **options).orderBy("part", "place").collect())
