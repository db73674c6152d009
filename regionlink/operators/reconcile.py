"""The reconciliation join: values by region, and with equal weight what did not match."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import to_number
from ..sources.scratch import kept
from ..sources.tables import POS
from .matching import match_names
from .tabular import require

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
#: Names that a section of the summary lists.
LISTED = 10


@dataclass(frozen=True)
class Report:
    """values (region, value, POS), matches as match_names gives them, unmatched (name, POS) and uncovered (name, POS)."""

    values: DataFrame
    matches: DataFrame
    unmatched: DataFrame
    uncovered: DataFrame

    @property
    def fuzzy_matches(self) -> DataFrame:
        return self.matches.filter("method = 'fuzzy'")

    @property
    def alias_matches(self) -> DataFrame:
        return self.matches.filter("method = 'alias'")

    @cached_property
    def matched_count(self) -> int:
        return self.values.count()

    @cached_property
    def coverage(self) -> float:
        """Share of regions with a value. Regions of one name have it once, and are missing each for itself."""
        total = self.matched_count + self.uncovered.count()
        return self.matched_count / total if total else 0.0

    @property
    def complete(self) -> bool:
        return self.unmatched.isEmpty() and self.uncovered.isEmpty()

    def summary(self) -> str:
        def section(label: str, n: int, what: str, shown: list[str]) -> list[str]:
            return [f"{label:<13}{n} {what}".rstrip(), *(" " * 15 + x for x in shown)] if n else []

        first = lambda t: t.orderBy(POS).limit(LISTED).collect()
        lines = [f"{'matched':<13}{self.matched_count} region(s)", f"{'coverage':<13}{self.coverage * 100:.1f}%"]
        lines += section("via alias", self.alias_matches.count(), "", [])
        lines += section("fuzzy", self.fuzzy_matches.count(), "(review these)", [f"{m.query!r} → {m.matched!r} ({m.score})" for m in first(self.fuzzy_matches)])
        lines += section("unmatched", self.unmatched.count(), "data row(s) dropped", [repr(r.name) for r in first(self.unmatched)])
        lines += section("no data", self.uncovered.count(), "region(s)", [repr(r.name) for r in first(self.uncovered)])
        return "\n".join(lines)


def reconcile(table: DataFrame, regions: DataFrame, *, name_column: str, value_column: str, aliases: DataFrame | None = None, threshold: float = 0.85, aggregate: str = "sum", min_margin: float = 0.05, fast: bool = False) -> Report:
    """Joins a table (with POS) to regions (name, POS) by name and rolls its values up.

    The work is done here, and the report reads two small tables. Rows without a name are passed over; blank and unreadable values are absent, not 0. aggregate: sum, mean, max or min.
    """
    require(table, name_column, value_column)
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    rows = table.select(F.col(f"`{name_column}`").alias("query"), F.col(f"`{value_column}`").alias("cell"), POS).filter("query <> ''")
    canonical = regions.select("name", POS)
    matches = kept(match_names(rows.select("query", POS), canonical, aliases, threshold, min_margin, fast), "matches")  # one row a name; every part of the report reads it
    found = matches.filter("matched is not null").select("query", F.col("matched").alias("region"))
    read = rows.select("query", to_number(F.col("cell"), None).alias("value"), POS).filter("value is not null")
    values = kept(read.join(found, "query").groupBy("region").agg(AGGREGATES[aggregate]("value").alias("value"), F.min(POS).alias(POS)), "values")  # one row a region; the table is read once
    unmatched = matches.filter("matched is null").select(F.col("query").alias("name"), POS)
    uncovered = canonical.join(values.select(F.col("region").alias("name")), "name", "left_anti")
    return Report(values, matches, unmatched, uncovered)
