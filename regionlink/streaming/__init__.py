"""Streams: running sums by region of rows that arrive, beyond what batches do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_key
from ..functions.values import to_number
from ..operators.matching import canonical_index


def running_values(stream: DataFrame, regions: DataFrame, *, name_column: str, value_column: str, time_column: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(window, region, value): sums by exact name and window of a stream joined to fixed regions (name, POS)."""
    index = canonical_index(regions).select("key", F.col("name").alias("region"))  # Spark broadcasts it if it is small
    rows = stream.withWatermark(time_column, late).select(time_column, F.explode(F.array(normalise_key(F.col(name_column)))).alias("key"), to_number(F.col(value_column), None).alias("value"))
    return rows.filter("value is not null").join(index, "key").groupBy(F.window(time_column, every), "region").agg(F.sum("value").alias("value"))
