"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows travel to Python at once: texts are far longer than Spark's default of 10,000 rows is made for.

    The setting is read when a plan runs, after the operator has returned, so it stays in the session; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


@contextmanager
def silent_ended(spark: SparkSession, seconds: int) -> Iterator[None]:
    """For what runs inside: a Python worker that for so many seconds neither takes nor gives anything is ended, and its task run again.

    A local master runs no task again unless it says how often one may fail, and workers stay. So they do where the session has a
    limit of its own. The session's settings are as before afterwards.
    """
    limit, end = (f"spark.sql.execution.pyspark.udf.{x}" for x in ("idleTimeoutSeconds", "killOnIdleTimeout"))
    before = {name: spark.conf.get(name, None) for name in (limit, end)}
    if re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master) or re.search("[1-9]", spark.conf.get(limit)):
        yield
        return
    spark.conf.set(limit, seconds)
    spark.conf.set(end, True)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def n_words(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row by content, so that it is the same whenever a lost task is run again.

    Rows that agree in all the columns share a key. Null and the empty string differ.
    """
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts).cast("binary")))


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, named row: what is put beside it clashes with none of them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def rows_with(docs: DataFrame, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of docs, with all their columns, whose text is wanted. make gives, once a task, what tells of many texts which."""
    rows, at = docs.select(whole_row(docs)), docs.columns.index("text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = make()
        for b in batches:
            yield b.filter(pa.array(wanted(b.column(0).field(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(some, rows.schema).select("row.*")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: the lineage is cut, and a lost executor loses none of it.

    The table is removed by discard(), or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub('[^a-z0-9]+', '_', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() gave and that nothing reads any more."""
    for df in tables:
        _drop(df.sparkSession, df.written_to)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
