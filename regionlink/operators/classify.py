"""Classes of values: upper bounds by rank or by range, and colours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import class_of


@dataclass(frozen=True)
class Palette:
    name: str
    colours: tuple[str, ...]
    no_data: str = "#e6e8eb"
    stroke: str = "#ffffff"


# Colours of the maps, the lightest first.
SEQUENTIAL = Palette("sequential", ("#eef3f8", "#cfe0ee", "#a7c7e0", "#6fa5cd", "#3a7cb0", "#1d5385"))
WARM = Palette("warm", ("#fdf1e4", "#fbdcbb", "#f5bd88", "#e89454", "#d16a2b", "#a44515"))
PALETTES = {p.name: p for p in (SEQUENTIAL, WARM)}

#: Parts into which the values are cut to find ranks, about equally many in each.
_PARTS = 256


def _at_least_two(classes: int) -> None:
    if classes < 2:
        raise ValueError("need at least 2 classes")


def quantile_breaks(values: DataFrame, column: str, classes: int = 5) -> DataFrame:
    """One row (breaks): the values at the ranks that cut them in equal counts, and the largest, each once. Nulls don't count.

    Equal values are counted first. Cuts from a sketch of them part the values about evenly, wherever they lie; sums of the
    parts tell in which of them a wanted rank falls, and only those are ranked inside. There is no global sort.
    """
    _at_least_two(classes)
    counts = values.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ends = counts.agg(F.array_distinct(F.percentile_approx("v", [i / _PARTS for i in range(1, _PARTS)], 10 * _PARTS)).alias("cuts"), F.sum("n").alias("all"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = counts.crossJoin(F.broadcast(ends)).select("v", "n", "all", part.alias("part"))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda i: F.least(F.floor(i * F.col("all") / classes), F.col("all") - 1).cast("long"))
    wanted = F.array_append(wanted, F.col("all") - 1)
    within = lambda lo, hi: F.exists(wanted, lambda r: (r >= F.col(lo)) & (r < F.col(hi)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part", "all").agg(F.sum("n").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    holding = sums.withColumn("upto", F.col("offset") + F.col("m")).filter(within("offset", "upto")).select("part", "offset")
    inside = Window.partitionBy("part").orderBy("v")
    ranked = placed.join(F.broadcast(holding), "part").withColumn("end", F.col("offset") + F.sum("n").over(inside)).withColumn("start", F.col("end") - F.col("n"))
    return ranked.filter(within("start", "end")).agg(F.sort_array(F.collect_set("v")).alias("breaks"))


def equal_breaks(values: DataFrame, column: str, classes: int = 5) -> DataFrame:
    """One row (breaks): upper bounds of classes equally wide; one bound if all values are the same, none without values."""
    _at_least_two(classes)
    ends = values.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / classes
    bounds = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.col("lo") + step * i)
    none = F.array().cast("array<double>")
    return ends.select(F.when(F.col("lo").isNull(), none).when(F.col("lo") == F.col("hi"), F.array("hi")).otherwise(bounds).alias("breaks"))


def breaks_by(method: str, values: DataFrame, column: str, classes: int) -> DataFrame:
    _at_least_two(classes)
    if method not in ("quantile", "equal"):
        raise ValueError(f"unknown method {method!r}; use 'quantile' or 'equal'")
    return (quantile_breaks if method == "quantile" else equal_breaks)(values, column, classes)


def palette_of(palette: Palette | str) -> Palette:
    if isinstance(palette, Palette):
        return palette
    if palette not in PALETTES:
        raise ValueError(f"unknown palette {palette!r}; try {', '.join(PALETTES)}")
    return PALETTES[palette]


def coloured(regions: DataFrame, breaks: DataFrame, palette: Palette | str = SEQUENTIAL, column: str = "value") -> DataFrame:
    """regions with class and fill: the class of the value, and its colour, or the colour of no data. breaks: one row."""
    palette = palette_of(palette)
    shades = F.slice(F.array(*map(F.lit, palette.colours)), 1, F.least(F.size("breaks"), F.lit(len(palette.colours))))
    rows = regions.crossJoin(F.broadcast(breaks)).withColumn("class", class_of(F.col(column), F.col("breaks")))
    return rows.withColumn("fill", F.coalesce(F.when(F.col("class").isNotNull(), F.get(shades, F.least(F.col("class"), F.size(shades) - 1))), F.lit(palette.no_data))).drop("breaks")
