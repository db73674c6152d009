"""Queries over files that are made of the driver's tables, written, and read again; and their SQL for DuckDB."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip_space
from ..functions.values import general, plain
from ..operators.classify import breaks_by
from ..operators.geometry import feature_boxes
from ..operators.matching import canonical_size, match_names
from ..operators.reconcile import reconcile
from ..operators.tabular import ordered, require
from ..sources.boundaries import read_aliases, read_geojson
from ..sources.scratch import put_text, shared_dir
from ..sources.tables import POS, read_csv, rows_to_table, write_csv, write_csv_dir
from . import cli
from .queries import _MAPPED, _MATCH, _PATH, _PLANE, _QUANTILE, _SHORT, _aliases, _customers, _listed, _nations, _read, _report, _squares, query


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


# ---- tables. A line of the file for each supplier, untidy by the rest of its key; every fifth after a blank record
_UNTIDY = '''CASE s_suppkey % 5
WHEN 0 THEN concat('"', s_name, ', Ltd",', s_suppkey, ',plain')
WHEN 1 THEN concat('  ', s_name, ' , ', s_suppkey)
WHEN 2 THEN concat('"', s_name, ' ""the ', s_suppkey, '""",', s_suppkey, ',"two\\nlines"')
WHEN 3 THEN concat(s_name, ',', s_suppkey, ',x,,')
ELSE concat(' , ,\\n', chr(160), s_name, chr(9), ',', s_suppkey, ',') END'''


def _suppliers_file(spark: SparkSession, sf_dir: str) -> str:
    # the file is one on purpose: what is checked is how one is read
    lines = [r[0] for r in _read(spark, sf_dir, "supplier").orderBy("s_suppkey").selectExpr(_UNTIDY).toLocalIterator()]
    path = _path(spark, "suppliers.csv")
    put_text(spark, path, "﻿ name , key,note \n\n" + "\n".join(lines) + "\n")
    return path


@query(
    "SELECT CASE s_suppkey % 5 WHEN 0 THEN s_name || ', Ltd' WHEN 2 THEN s_name || ' \"the ' || s_suppkey || '\"' ELSE s_name END AS name, s_suppkey::VARCHAR AS key, "
    "CASE s_suppkey % 5 WHEN 0 THEN 'plain' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN 'x' ELSE '' END AS note, "
    "(row_number() OVER o + count(*) FILTER (s_suppkey % 5 = 4) OVER o)::BIGINT AS pos FROM supplier WINDOW o AS (ORDER BY s_suppkey)"
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, line ends and blanks in cells, short and long records, a byte order mark, numbers of records."""
    return read_csv(spark, _suppliers_file(spark, sf_dir)).select("name", "key", "note", F.col(POS).alias("pos"))


@query("SELECT row_number() OVER (ORDER BY k) - 1 AS place, line FROM (SELECT -1 AS k, 'name,note,empty' AS line UNION ALL SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '\"' || n_name || ', the\",plain,' WHEN 1 THEN n_name || ',\"say \"\"' || n_nationkey || '\"\"\",' ELSE n_name || ',' || n_nationkey || ',' END FROM nation)")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a written file, in reading order."""
    table = _read(spark, sf_dir, "nation").selectExpr(f"cast(n_nationkey AS long) AS {POS}", "CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, ', the') ELSE n_name END AS name", "CASE n_nationkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN concat('say \"', n_nationkey, '\"') ELSE cast(n_nationkey AS string) END AS note", "cast(null AS string) AS empty")
    with tempfile.TemporaryDirectory() as folder:  # only the driver writes and reads it
        write_csv(table.orderBy(F.desc(POS)), f"{folder}/deep/nations.csv")
        raw = Path(folder, "deep", "nations.csv").read_bytes().decode("utf-8")
    return _lines(spark, raw.removesuffix("\r\n").split("\r\n"))


@query("SELECT s_name AS name, s_suppkey::VARCHAR AS key FROM supplier")
def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder written by all tasks and read as one table."""
    path = _path(spark, "folder")
    write_csv_dir(_read(spark, sf_dir, "supplier").selectExpr(f"s_suppkey AS {POS}", "s_name AS name", "cast(s_suppkey AS string) AS key").repartition(3), path)
    return read_csv(spark, f"{path}/*.csv").select("name", "key")


@query("SELECT n_nationkey AS pos, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END AS code FROM nation")
def rows_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows given as dictionaries, with cells missing."""
    names = [r["name"] for r in ordered(_nations(spark, sf_dir))]
    table = rows_to_table(spark, [{"name": n} | ({"code": str(i)} if i % 2 == 0 else {}) for i, n in enumerate(names)], ["name", "code"])
    return table.select(F.col(POS).cast("int").alias("pos"), "name", "code")


@query("SELECT 'missing column(s): Balance, nothing. Available: nation, balance, segment' AS said")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of columns that a table lacks."""
    try:
        require(_customers(spark, sf_dir), "nation", "Balance", "nothing")
        said = ""
    except KeyError as e:
        said = e.args[0]
    return spark.createDataFrame([(said,)], "said string")


@query("SELECT p_partkey, p_name AS name FROM part")
def strip_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks of all kinds at both ends go, those inside stay."""
    odd = F.lit(" \t \x1c \n")
    return _read(spark, sf_dir, "part").select("p_partkey", strip_space(F.concat(odd, "p_name", odd)).alias("name"))


# ---- boundaries: squares; every second nation has another part, with a hole, and altitudes
def _document(spark: SparkSession, sf_dir: str) -> str:
    features = []
    for i, r in enumerate(ordered(_nations(spark, sf_dir))):
        x, y = 70 + i % 5, 10 + i // 5
        ring = [[x + dx, y + dy] for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
        hole = [[x + 0.25, y + 0.25, 7], [x + 0.5, y + 0.25, 7], [x + 0.25, y + 0.5, 7]]
        geometry = {"type": "MultiPolygon", "coordinates": [[ring], [ring, hole]]} if i % 2 else {"type": "Polygon", "coordinates": [ring]}
        features.append({"type": "Feature", "properties": {"area": r["name"], "code": i, "odd": bool(i % 2)}, "geometry": geometry})
    path = _path(spark, "nations.geojson")
    put_text(spark, path, json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    return path


@query("SELECT n_nationkey::BIGINT AS pos, n_name AS name, n_nationkey::VARCHAR AS code, CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END AS odd, CASE WHEN n_nationkey % 2 = 1 THEN '5,5,3' ELSE '5' END AS points, (70 + n_nationkey % 5)::DOUBLE AS min_lon, (11 + n_nationkey // 5)::DOUBLE AS max_lat FROM nation")
def geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons and multipolygons: places in the collection, properties, rings of all parts."""
    boxes = feature_boxes(read_geojson(spark, _document(spark, sf_dir), "area"))
    sizes = F.array_join(F.transform("rings", lambda r: F.size(r).cast("string")), ",")
    return boxes.select(F.col(POS).alias("pos"), "name", F.col("properties")["code"].alias("code"), F.col("properties")["odd"].alias("odd"), sizes.alias("points"), "min_lon", "max_lat")


@query("SELECT 'Old Land ' || n_nationkey AS variant, n_name AS target, n_nationkey::BIGINT AS pos FROM nation")
def alias_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "aliases.json")
    put_text(spark, path, json.dumps({r["variant"]: r["target"] for r in ordered(_aliases(spark, sf_dir))}))
    return read_aliases(spark, path).select("variant", "target", F.col(POS).alias("pos"))


@query("SELECT row_number() OVER (ORDER BY k, line) - 1 AS place, line FROM (SELECT 0 AS k, count(*) || ' region(s)' AS line FROM nation UNION ALL SELECT 1, 'bounds  70.000,10.000 → 75.000,15.000' UNION ALL SELECT 2, '  ' || n_name FROM nation)")
def inspect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command inspect prints."""
    return _lines(spark, cli.inspected(read_geojson(spark, _document(spark, sf_dir), "area")))


# ---- reconciliation
@query("SELECT n_name AS region, round(sum(c_acctbal), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 2 GROUP BY 1")
def rollup_with_blank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name is empty or null are passed over, and are no unmatched names."""
    customers = _read(spark, sf_dir, "customer").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    table = customers.selectExpr("CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN null ELSE n_name END AS nation", "cast(c_acctbal AS string) AS balance", f"c_custkey AS {POS}")
    report = reconcile(table, _nations(spark, sf_dir), name_column="nation", value_column="balance")
    none = report.unmatched.select(F.col("name").alias("region"), F.lit(0.0).alias("value"))
    return report.values.select("region", F.round("value", 2).alias("value")).unionByName(none)


_SUMMARY = """, f AS (SELECT m.*, row_number() OVER (PARTITION BY method ORDER BY pos) AS i FROM (SELECT m.query, matched, method, score, min(pos) AS pos FROM m JOIN c USING (query) GROUP BY ALL) m),
u AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_name NOT IN (SELECT region FROM v)),
n AS (SELECT (SELECT count(DISTINCT region) FROM v) AS matched, (SELECT count(*) FROM u) AS uncovered, count(*) FILTER (method = 'alias') AS alias, count(*) FILTER (method = 'fuzzy') AS fuzzy, count(*) FILTER (method = 'none') AS none FROM f),
l AS (SELECT 0 AS part, 0 AS i, 'matched      ' || matched || ' region(s)' AS line FROM n
UNION ALL SELECT 1, 0, 'coverage     ' || printf('%.1f', matched / (matched + uncovered)::DOUBLE * 100) || '%' FROM n
UNION ALL SELECT 2, 0, 'via alias    ' || alias FROM n WHERE alias > 0
UNION ALL SELECT 3, 0, 'fuzzy        ' || fuzzy || ' (review these)' FROM n WHERE fuzzy > 0
UNION ALL SELECT 3, i, '               ''' || query || ''' → ''' || matched || ''' (' || score || ')' FROM f WHERE method = 'fuzzy' AND i <= 10
UNION ALL SELECT 4, 0, 'unmatched    ' || none || ' data row(s) dropped' FROM n WHERE none > 0
UNION ALL SELECT 4, i, '               ''' || query || '''' FROM f WHERE method = 'none' AND i <= 10
UNION ALL SELECT 5, 0, 'no data      ' || uncovered || ' region(s)' FROM n WHERE uncovered > 0
UNION ALL SELECT 5, i, '               ''' || n_name || '''' FROM u WHERE i <= 10)"""


@query(_MATCH.replace("\nWITH n AS", "\nWITH n0 AS").replace("FROM n),", "FROM n0),").replace("FROM qk, n),", "FROM qk, n0 n),").replace("LEFT JOIN n ON", "LEFT JOIN n0 n ON") + _SUMMARY + " SELECT row_number() OVER (ORDER BY part, i) - 1 AS place, line FROM l")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report: counts, coverage, and the first ten of each section."""
    return _lines(spark, _report(spark, sf_dir).summary().split("\n"))


@query("SELECT 2 * count(*)::BIGINT AS names, count(*)::BIGINT AS matched FROM nation")
def canonical_names_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys count each among canonical names, and the first of them is what names are matched to."""
    nations = _nations(spark, sf_dir)
    twice = nations.unionByName(nations.select(F.concat("name", F.lit(" District")).alias("name"), (F.col(POS) + 1000).alias(POS)))
    found = match_names(nations.withColumnRenamed("name", "query"), twice).filter("matched = query AND method = 'exact'")
    return found.agg(F.lit(canonical_size(twice)).cast("long").alias("names"), F.count("*").alias("matched"))


# ---- classes, numbers, maps
@query(_QUANTILE.format(v="p_retailprice", t="part", k=4) + ", e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT 'quantile' AS method, row_number() OVER (ORDER BY v)::INTEGER AS class, v AS upper FROM b UNION ALL SELECT 'equal', i::INTEGER, lo + (hi - lo) / 4 * i FROM e, range(1, 5) g(i)")
def breaks_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    each = [_listed(breaks_by(m, part, "p_retailprice", 4)).select(F.lit(m).alias("method"), "class", "upper") for m in ("quantile", "equal")]
    return each[0].unionByName(each[1])


@query("SELECT p_partkey, printf('%g', p_retailprice / p_size) AS text FROM part")
def general_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", general(F.col("p_retailprice") / F.col("p_size")).alias("text"))


_DRAWN = _MAPPED + ", " + _PLANE.removeprefix("WITH ").replace("b AS (", "ends AS (").replace("FROM b)", "FROM ends)").replace("860", "852").replace("+ 20", "+ 24") + f""", d AS (SELECT n_nationkey, n_name, w.value, 'M' || {_PATH.replace("+ 20", "+ 24")} || ' Z' AS path FROM p, nation LEFT JOIN w ON region = n_name),
low AS (SELECT min(value) AS lowest FROM w), kk AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM k)"""
_FILL = "CASE WHEN value IS NULL THEN '#e6e8eb' ELSE ['#eef3f8', '#cfe0ee', '#a7c7e0', '#6fa5cd', '#3a7cb0'][(SELECT count(*) FROM k WHERE k.value < d.value - 1e-6)::INTEGER + 1] END"


@query(_DRAWN + f""" SELECT n_nationkey AS place, '<path d="' || path || '" fill="' || {_FILL} || '" stroke="#ffffff" stroke-width="0.7" fill-rule="evenodd"><title>' || n_name || ': ' || CASE WHEN value IS NULL THEN 'no data' ELSE {_SHORT.format(v="value")} END || '</title></path>' AS line FROM d
UNION ALL SELECT 1000 + i, '<text x="' || (i - 1) * 28 || '" y="25" font-size="9.5" fill="#626b78">' || {_SHORT.format(v="low")} || '</text>' FROM (SELECT i, coalesce(lag(value) OVER (ORDER BY i), lowest) AS low FROM kk, low)""")
def map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions and the lower bounds of the legend, from the SVG file that the command map writes."""
    regions, table = _path(spark, "squares.geojson"), _path(spark, "values.csv")
    squares = [{"type": "Feature", "properties": {"name": r["name"]}, "geometry": {"type": "Polygon", "coordinates": [[[p.lon, p.lat] for p in r["rings"][0]]]}} for r in ordered(_squares(spark, sf_dir))]
    put_text(spark, regions, json.dumps({"type": "FeatureCollection", "features": squares}))
    values = _report(spark, sf_dir).values.select(POS, F.col("region").alias("name"), plain(F.col("value")).alias("value"))
    put_text(spark, table, "name,value\n" + "".join(f"{r['name']},{r['value']}\n" for r in ordered(values)))
    with tempfile.TemporaryDirectory() as folder:  # only the driver writes and reads it
        cli.draw(spark, cli.parser().parse_args(["map", table, regions, "--name-column", "name", "--value-column", "value", "--out", f"{folder}/deep/map.svg"]))
        rows = Path(folder, "deep", "map.svg").read_text("utf-8").split("\n")
    rows = [r for r in rows if r.startswith("<path") or r.startswith("<text") and "text-anchor" not in r]
    shapes = [r for r in rows if r.startswith("<path")]
    labels = [r for r in rows if r.startswith("<text")]
    return spark.createDataFrame([*enumerate(shapes), *enumerate(labels, 1001)], "place long, line string")


@query("SELECT * FROM (VALUES ('all found', 0), ('one left over', 1)) t(\"table\", code)")
def check_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command check returns for a table that is matched whole, and for one with another name."""
    document, found = _document(spark, sf_dir), []
    names = [r["name"] for r in ordered(_nations(spark, sf_dir))]
    for label, extra in (("all found", []), ("one left over", ["Atlantis"])):
        path = _path(spark, "check.csv")
        put_text(spark, path, "area,v\n" + "".join(f"{n},1\n" for n in [*names, *extra]))
        given = cli.parser().parse_args(["check", path, document, "--name-column", "area", "--value-column", "v", "--name-property", "area"])
        found.append((label, cli.check(spark, given)))
    return spark.createDataFrame(found, "table string, code int")
