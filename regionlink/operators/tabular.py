"""Operators over tables of strings that keep the order of first sight."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import general, to_number
from ..sources.tables import POS


def require(table: DataFrame, *columns: str) -> None:
    """KeyError if the table lacks one of the columns; their case counts."""
    present = [c for c in table.columns if c != POS]
    if missing := [c for c in columns if c not in present]:
        raise KeyError(f"missing column(s): {', '.join(missing)}. Available: {', '.join(present)}")


def filter_rows(table: DataFrame, predicate: Column | str | Callable[[dict], bool]) -> DataFrame:
    """Rows for which a column or SQL text holds. A Python callable gets each row as a dictionary, in Python workers: slow, for what SQL can't say."""
    if isinstance(predicate, Column | str):
        return table.filter(predicate)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(predicate({k: v for k, v in row.items() if k != POS})) for row in b.to_pylist()], pa.bool_()))

    return table.mapInArrow(kept, table.schema)


def ordered(table: DataFrame) -> Iterator[dict]:
    """The rows as dictionaries, in their order, one part of the table at the driver at a time."""
    for row in table.orderBy(POS).toLocalIterator():
        yield {k: v for k, v in row.asDict().items() if k != POS}


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """(column, POS): the distinct values and where each is first."""
    require(table, column)
    return table.groupBy(F.col(f"`{column}`").alias(column)).agg(F.min(POS).alias(POS))


def group_sum(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, POS): sums by key; unreadable cells count as 0."""
    require(table, key, value)
    return table.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sum(to_number(F.col(f"`{value}`"))).alias("total"), F.min(POS).alias(POS))


def pivot_sum(table: DataFrame, row_key: str, column_key: str, value: str, as_text: bool = True, most: int = 10_000) -> DataFrame:
    """Long to wide: a column for each category, in order, and a row for each key, sorted; sums, 0 where there is nothing.

    as_text: cells of 6 significant digits, as a spreadsheet would show them; else numbers. Categories are matched with their case; one that
    equals row_key raises ValueError. The driver gets the distinct categories, which become columns; more
    than ``most`` raise ValueError.
    """
    require(table, row_key, column_key, value)
    table = table.select(F.col(f"`{row_key}`").alias("k"), F.col(f"`{column_key}`").alias("c"), to_number(F.col(f"`{value}`")).alias("v"))
    categories = [r.c for r in table.select("c").distinct().orderBy("c").limit(most + 1).collect()]
    if len(categories) > most:
        raise ValueError(f"more than {most} categories: they would be as many columns")
    if row_key in categories:
        raise ValueError(f"category {row_key!r} has the name of the key column")
    # columns are named by place: categories that differ in case only would clash
    sums = table.groupBy("k").agg(*(F.coalesce(F.sum(F.when(F.col("c") == x, F.col("v"))), F.lit(0.0)).alias(f"_{i}") for i, x in enumerate(categories)))
    cell = (lambda c: general(F.col(c))) if as_text else F.col
    return sums.orderBy("k").select(F.col("k").alias(row_key), *(cell(f"_{i}").alias(x) for i, x in enumerate(categories)))
