"""Untidy CSV: a reader that keeps what it should and refuses what would be cut off, and a writer."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .scratch import kept

#: Order of the rows as they were read. Every table of this library has it.
POS = "_pos"
#: Rows that are handed on together.
_ROWS = 20_000


def _records(raw: bytes) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(str(path)).select("path", "content")


def _headers(found: DataFrame) -> dict[str, list[str]]:
    """The header of each file, by path in order. ValueError if they don't have the same names."""

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [[h.strip() for h in next(_records(x), [])] for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(names, pa.list_(pa.string()))], ["path", "names"])

    headers = {r.path: r.names for r in found.mapInArrow(header, "path string, names array<string>").orderBy("path").collect()}
    first = next(iter(headers.items()), ("", []))
    for path, names in headers.items():
        if set(names) != set(first[1]):
            raise ValueError(f"{Path(path).name} has columns {', '.join(names)}, but {Path(first[0]).name} has {', '.join(first[1])}")
    return headers


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files as strings, with POS: the record number less 2, in further files after those of the files before.

    A byte order mark goes, headers and cells lose outer white space, blank records are left out, short ones are filled with
    empty cells. A record with more filled cells than there are headers raises ValueError, now and not when rows are used: it
    mostly has an unquoted comma, and cutting it off would change numbers. Of equal headers the last column counts. Files may
    have their columns in any order, but all the same ones. Each file is read by one task, as quoted cells may hold line ends;
    rows are kept once read.
    """
    found = _files(spark, path)
    headers = _headers(found)
    names = list(dict.fromkeys(next(iter(headers.values()), [])))
    order = {p: i for i, p in enumerate(headers)}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                own = {h: i for i, h in enumerate(headers[name])}
                places, width, out = [own[n] for n in names], len(headers[name]), []
                records = _records(raw)
                next(records, None)
                for number, record in enumerate(records, 2):
                    filled = [x.strip() for x in record]
                    if not any(filled):
                        continue
                    fault = None
                    if any(filled[width:]):
                        start = ",".join(record[:3])
                        fault = f"{Path(name).name} line {number}: {len(record)} fields but {width} columns. Is a value containing a comma unquoted? Row starts: {start}"
                    filled += [""] * width
                    out.append(((order[name] << 40) + number - 2, [filled[i] for i in places], fault))
                    if len(out) >= _ROWS:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    rows = kept(found.mapInArrow(cells, f"{POS} long, cells array<string>, fault string"), "rows")
    if bad := rows.filter("fault is not null").orderBy(POS).first():
        raise ValueError(bad.fault)
    return rows.select(POS, *(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.list_(pa.string()), pa.string()))], [POS, "cells", "fault"])


def rows_to_table(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    """Rows given as dictionaries of strings; a missing cell is empty."""
    schema = f"{POS} long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([Row(i, *(r.get(c, "") for c in columns)) for i, r in enumerate(rows)], schema)


def write_csv(table: DataFrame, path: str) -> None:
    """One file in reading order, columns as they are, with \\r\\n and only the quotes that are needed. Rows pass the driver one by one."""
    columns = [c for c in table.columns if c != POS]
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(columns)
        ordered = table.orderBy(POS) if POS in table.columns else table
        out.writerows(["" if x is None else x for x in r] for r in ordered.select(*(F.col(f"`{c}`") for c in columns)).toLocalIterator())


def write_csv_dir(table: DataFrame, path: str) -> None:
    """A folder of files, written by all tasks."""
    table.drop(POS).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
