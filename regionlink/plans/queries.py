"""Queries over the driver's tables, and the same in SQL for DuckDB.

The tables are clean, so names and numbers are made untidy by the same rule on both sides: nation names by key modulo 5
are written for the exact tier (0), with a hyphen for the fuzzy one (1), as an old name for the alias tier (2), with two
edits (3) or not at all alike (4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import edit_distance, normalise_key, similarity
from ..functions.values import class_of, general, short_number, to_number, xml_escape
from ..operators.classify import coloured, equal_breaks, quantile_breaks
from ..operators.geometry import CORNERS, box, feature_boxes, on_plane, path, plane
from ..operators.matching import match_names
from ..operators.reconcile import Report, reconcile
from ..operators.tabular import distinct_values, filter_rows, group_sum, pivot_sum
from ..sources.tables import POS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_DIRTY = "CASE n_nationkey % 5 WHEN 0 THEN upper(n_name) || ' DISTRICT' WHEN 1 THEN replace(n_name, '_', '-') WHEN 2 THEN 'Old Land ' || n_nationkey WHEN 3 THEN replace(n_name, 'TIO', 'TOI') ELSE 'Atlantis' END"
_CELL = "CASE {k} % 7 WHEN 0 THEN '$ ' || {d} WHEN 1 THEN '(' || {d} || ')' WHEN 2 THEN 'n/a' WHEN 3 THEN '' ELSE {d} END"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias(POS))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr("'Old Land ' || n_nationkey AS variant", "n_name AS target", f"cast(n_nationkey AS long) AS {POS}")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an untidy nation and balance, as strings."""
    names = F.broadcast(_read(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", f"{_DIRTY} AS nation"))  # 25 rows at any scale
    amount = _CELL.format(k="c_custkey", d="cast(cast(c_acctbal AS decimal(12,2)) AS string)")
    return _read(spark, sf_dir, "customer").join(names, "c_nationkey").selectExpr("nation", f"{amount} AS balance", "c_mktsegment AS segment", f"c_custkey AS {POS}")


def _report(spark: SparkSession, sf_dir: str, aggregate: str = "sum") -> Report:
    return reconcile(_customers(spark, sf_dir), _nations(spark, sf_dir), name_column="nation", value_column="balance", aliases=_aliases(spark, sf_dir), aggregate=aggregate)


#: Common table expressions: m (query, matched, method, score, margin, first), c (customers), v (values by region).
_MATCH = f"""
WITH n AS (SELECT n_nationkey AS k, n_name, replace(lower(n_name), '~', ' ') AS key FROM nation),
q AS (SELECT {_DIRTY} AS query, min(n_nationkey) AS first FROM nation GROUP BY 1),
qk AS (SELECT query, first, trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9_ ]', ' ', 'g'), '(^| )district( |$)', ' ', 'g')) AS key FROM q),
al AS (SELECT 'old land ' || k AS key, n_name FROM n),
s AS (SELECT qk.query, n.n_name, n.k, 1 - levenshtein(qk.key, n.key) / greatest(length(qk.key), length(n.key))::DOUBLE AS s FROM qk, n),
r AS (SELECT query, n_name, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, k) AS rn FROM s),
b AS (SELECT query, max(s) FILTER (rn = 1) AS best, max(s) FILTER (rn = 2) AS second, max(n_name) FILTER (rn = 1) AS n_name FROM r GROUP BY 1),
m AS (SELECT qk.query, qk.first,
        CASE WHEN al.key IS NOT NULL THEN al.n_name WHEN n.key IS NOT NULL THEN n.n_name WHEN best >= 0.85 AND best - second >= 0.05 THEN b.n_name END AS matched,
        CASE WHEN al.key IS NOT NULL THEN 'alias' WHEN n.key IS NOT NULL THEN 'exact' WHEN best >= 0.85 AND best - second >= 0.05 THEN 'fuzzy' ELSE 'none' END AS method,
        CASE WHEN al.key IS NOT NULL OR n.key IS NOT NULL THEN 1.0::DOUBLE ELSE round_even(best, 4) END AS score,
        CASE WHEN al.key IS NOT NULL OR n.key IS NOT NULL THEN 1.0::DOUBLE ELSE round_even(best - second, 4) END AS margin
      FROM qk LEFT JOIN al USING (key) LEFT JOIN n ON n.key = qk.key JOIN b ON b.query = qk.query),
c AS (SELECT {_DIRTY} AS query, {_CELL.format(k="c_custkey", d="CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)")} AS cell, c_mktsegment AS segment, c_custkey AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT *, CASE WHEN cell LIKE '(%' THEN -TRY_CAST(regexp_replace(cell, '[^0-9.\\-]', '', 'g') AS DOUBLE) ELSE TRY_CAST(regexp_replace(cell, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS value FROM c),
v AS (SELECT matched AS region, value FROM x JOIN m USING (query) WHERE matched IS NOT NULL AND value IS NOT NULL)
"""


# ---- names and numbers
@query("SELECT p_name AS name, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name || ' of the ' || p_brand || ' (Region)'), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w NOT IN ('of', 'the', 'region')), ' ') AS key, p_partkey FROM part")
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), normalise_key(F.concat("p_name", F.lit(" of the "), "p_brand", F.lit(" (Region)"))).alias("key"), "p_partkey")


@query("SELECT a.n_name AS a, r_name AS b, 1 - levenshtein(lower(a.n_name), lower(r_name)) / greatest(length(a.n_name), length(r_name))::DOUBLE AS score FROM nation a, region")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("a")).crossJoin(F.broadcast(_read(spark, sf_dir, "region").select(F.col("r_name").alias("b"))))
    return pairs.select("a", "b", similarity(F.lower("a"), F.lower("b")).alias("score"))


@query("SELECT a.n_name AS a, r_name AS b, levenshtein(a.n_name, r_name)::INTEGER AS distance, least(levenshtein(a.n_name, r_name), 6)::INTEGER AS capped FROM nation a, region")
def edit_distance_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("a")).crossJoin(F.broadcast(_read(spark, sf_dir, "region").select(F.col("r_name").alias("b"))))
    return pairs.select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("distance"), edit_distance(F.col("a"), F.col("b"), 5).alias("capped"))


_ORDER_CELL = _CELL.format(k="o_orderkey", d="cast(cast(o_totalprice AS decimal(12,2)) AS {t})")


@query(f"WITH c AS (SELECT o_orderkey, {_ORDER_CELL.format(t='varchar')} AS cell FROM orders), d AS (SELECT *, TRY_CAST(regexp_replace(cell, '[^0-9.\\-]', '', 'g') AS DOUBLE) * CASE WHEN cell LIKE '(%' THEN -1 ELSE 1 END AS x FROM c) SELECT o_orderkey, x AS absent, coalesce(x, 0) AS zero FROM d")
def to_number_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ORDER_CELL.format(t='string')} AS cell")
    return cells.select("o_orderkey", to_number(F.col("cell"), None).alias("absent"), to_number(F.col("cell")).alias("zero"))


@query("SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS number FROM events")
def extract_number_from_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", to_number(F.col("props"), None).alias("number"))


# ---- matching
def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "nation").selectExpr(f"{_DIRTY} AS query", f"cast(n_nationkey AS long) AS {POS}")
    return match_names(names, _nations(spark, sf_dir), _aliases(spark, sf_dir)).drop(POS)


@query(_MATCH + "SELECT query, matched, method, score, margin FROM m")
def match_all_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def _tier(method: str) -> Callable:
    def tier(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _matches(spark, sf_dir).filter(F.col("method") == method)

    return tier


for _name, _method in (("match_alias", "alias"), ("match_exact", "exact"), ("match_fuzzy", "fuzzy"), ("match_none", "none")):
    QUERIES[_name] = _tier(_method)
    SQL[_name] = f"{_MATCH} SELECT query, matched, method, score, margin FROM m WHERE method = '{_method}'"


@query("WITH s AS (SELECT 1 - levenshtein('nation_', lower(n_name)) / greatest(7, length(n_name))::DOUBLE AS s FROM nation), t AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn FROM s) SELECT 'NATION_' AS query, NULL::VARCHAR AS matched, 'none' AS method, round_even(max(s) FILTER (rn = 1), 4) AS score, round_even(max(s) FILTER (rn = 1) - max(s) FILTER (rn = 2), 4) AS margin FROM t")
def match_refused_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_names(spark.createDataFrame([("NATION_", 0)], f"query string, {POS} long"), _nations(spark, sf_dir)).drop(POS)


@query(_MATCH + "SELECT query, matched, method FROM m")
def match_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "nation").selectExpr(f"{_DIRTY} AS query", f"cast(n_nationkey AS long) AS {POS}")
    return match_names(names, _nations(spark, sf_dir), _aliases(spark, sf_dir), fast=True).select("query", "matched", "method")


@query(_MATCH + "SELECT method, count(*)::BIGINT AS names FROM m GROUP BY 1")
def match_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).matches.groupBy("method").agg(F.count("*").alias("names"))


# ---- values by region
def _rollup(aggregate: str) -> Callable:
    def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _report(spark, sf_dir, aggregate).values.select("region", F.round("value", 2).alias("value"))

    return rollup


for _name, _sql in (("sum", "sum(value)"), ("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)")):
    QUERIES[f"rollup_{_name}"] = _rollup(_name)
    SQL[f"rollup_{_name}"] = f"{_MATCH} SELECT region, round({_sql}, 2) AS value FROM v GROUP BY region"


@query(_MATCH + "SELECT query AS name FROM m JOIN c USING (query) WHERE matched IS NULL GROUP BY query")
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).unmatched.select("name")


@query(_MATCH + "SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT region FROM v)")
def uncovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).uncovered.select("name")


@query(_MATCH + "SELECT count(DISTINCT region)::BIGINT AS matched, (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT region FROM v))::BIGINT AS uncovered, count(DISTINCT region) / (SELECT count(*) FROM nation)::DOUBLE AS coverage FROM v")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir)
    counts = report.values.agg(F.count("*").alias("matched")).crossJoin(report.uncovered.agg(F.count("*").alias("uncovered")))
    return counts.withColumn("coverage", F.col("matched") / (F.col("matched") + F.col("uncovered")))


@query(_MATCH + "SELECT n_name AS name, x.value FROM nation LEFT JOIN (SELECT region, round(sum(value), 2) AS value FROM v GROUP BY 1) x ON region = n_name")
def values_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _report(spark, sf_dir).values.select(F.col("region").alias("name"), F.round("value", 2).alias("value"))
    return _nations(spark, sf_dir).select("name").join(values, "name", "left")


# ---- tables
@query(_MATCH + "SELECT segment, round(sum(coalesce(value, 0)), 2) AS total FROM x GROUP BY 1")
def group_sum_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sum(_customers(spark, sf_dir), "segment", "balance").select("segment", F.round("total", 2).alias("total"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _wide(cell: str, amount: str = "c_acctbal") -> str:
    cells = ", ".join(cell.format(f"coalesce(sum({amount}) FILTER (c_mktsegment = '{x}'), 0)") + f' AS "{x}"' for x in _SEGMENTS)
    return f"SELECT r_name AS region, {cells} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


def _by_segment(spark: SparkSession, sf_dir: str, amount: str = "c_acctbal") -> DataFrame:
    places = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return _read(spark, sf_dir, "customer").join(F.broadcast(places), "c_nationkey").select("region", F.col("c_mktsegment").alias("segment"), F.expr(f"cast({amount} AS string)").alias("balance"))


@query(_wide("round({}, 2)"))
def pivot_sum_segment_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pivot_sum(_by_segment(spark, sf_dir), "region", "segment", "balance", as_text=False)
    return wide.select("region", *(F.round(c, 2).alias(c) for c in wide.columns[1:]))


_CENTS = "cast(round(c_acctbal * 100) AS bigint)"


@query(_wide("printf('%g', ({})::DOUBLE)", _CENTS))
def pivot_sum_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cents, so that sums are the same in any order."""
    return pivot_sum(_by_segment(spark, sf_dir, _CENTS), "region", "segment", "balance")


@query("SELECT p_brand, min(p_partkey)::BIGINT AS first FROM part GROUP BY 1")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(_read(spark, sf_dir, "part").withColumn(POS, F.col("p_partkey")), "p_brand").withColumnRenamed(POS, "first")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND p_name LIKE 'small%'")
def filter_rows_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_rows(_read(spark, sf_dir, "part"), "p_size > 25 AND p_name LIKE 'small%'").select("p_partkey", "p_name")


# ---- classes
_QUANTILE = "WITH s AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS r, count(*) OVER () AS n FROM {t}), b AS (SELECT DISTINCT v FROM s, range(1, {k} + 1) g(i) WHERE r = least(i * n // {k}, n - 1))"


@query(_QUANTILE.format(v="p_retailprice", t="part", k=5) + " SELECT row_number() OVER (ORDER BY v)::INTEGER AS class, v AS upper FROM b")
def quantile_breaks_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(quantile_breaks(_read(spark, sf_dir, "part"), "p_retailprice"))


@query(_QUANTILE.format(v="least(p_size, 10)::DOUBLE", t="part", k=7) + " SELECT row_number() OVER (ORDER BY v)::INTEGER AS class, v AS upper FROM b")
def quantile_breaks_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(quantile_breaks(_read(spark, sf_dir, "part").withColumn("v", F.least("p_size", F.lit(10))), "v", 7))


@query("SELECT i::INTEGER AS class, min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) / 6 * i AS upper FROM orders, range(1, 7) g(i) GROUP BY i")
def equal_breaks_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(equal_breaks(_read(spark, sf_dir, "orders"), "o_totalprice", 6))


@query("SELECT 1 AS class, 7.0::DOUBLE AS upper")
def equal_breaks_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(equal_breaks(_read(spark, sf_dir, "region").select(F.lit(7.0).alias("v")), "v"))


def _listed(breaks: DataFrame) -> DataFrame:
    return breaks.select(F.posexplode("breaks").alias("class", "upper")).select((F.col("class") + 1).alias("class"), "upper")


_CLASSED = _QUANTILE.format(v="p_retailprice", t="part", k=5) + ", c AS (SELECT p_partkey, (SELECT count(*) FROM b WHERE b.v < p_retailprice)::INTEGER AS class FROM part)"


@query(_CLASSED + " SELECT p_partkey, class FROM c")
def class_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return part.crossJoin(F.broadcast(quantile_breaks(part, "p_retailprice"))).select("p_partkey", class_of(F.col("p_retailprice"), F.col("breaks")).alias("class"))


@query(_CLASSED + " SELECT p_partkey, ['#fdf1e4', '#fbdcbb', '#f5bd88', '#e89454', '#d16a2b'][class + 1] AS fill FROM c")
def fill_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return coloured(part, quantile_breaks(part, "p_retailprice"), "warm", "p_retailprice").select("p_partkey", "fill")


# ---- geometry: a square of side 1 for each nation
def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "cast(70 + n_nationkey % 5 AS double)", "cast(10 + n_nationkey div 5 AS double)"
    points = ", ".join(f"struct({x} + {dx} AS lon, {y} + {dy} AS lat)" for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)))
    points = points.replace("1.0 AS", "1D AS").replace("0.0 AS", "0D AS")
    return _read(spark, sf_dir, "nation").selectExpr(f"cast(n_nationkey AS long) AS {POS}", "n_name AS name", f"array(array({points})) AS rings")


@query("SELECT n_name AS name, (70 + n_nationkey % 5)::DOUBLE AS min_lon, (10 + n_nationkey // 5)::DOUBLE AS min_lat, (71 + n_nationkey % 5)::DOUBLE AS max_lon, (11 + n_nationkey // 5)::DOUBLE AS max_lat FROM nation")
def feature_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_boxes(_squares(spark, sf_dir)).select("name", "min_lon", "min_lat", "max_lon", "max_lat")


@query("SELECT min(70 + n_nationkey % 5)::DOUBLE AS min_lon, min(10 + n_nationkey // 5)::DOUBLE AS min_lat, max(71 + n_nationkey % 5)::DOUBLE AS max_lon, max(11 + n_nationkey // 5)::DOUBLE AS max_lat, 5.0::DOUBLE AS width, 5.0::DOUBLE AS height, 12.5::DOUBLE AS centre_lat FROM nation")
def collection_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box(_squares(spark, sf_dir)).select(*CORNERS, "width", "height", "centre_lat")


_PLANE = "WITH b AS (SELECT 70.0::DOUBLE AS lon, 15.0::DOUBLE AS lat, cos(radians(12.5)) AS f), p AS (SELECT lon, lat, f, least(860 / (5 * f), 860 / 5.0) AS s FROM b)"


@query(_PLANE + " SELECT n_name AS name, round((70 + n_nationkey % 5 - lon) * f * s + 20, 6) AS x, round((lat - (10 + n_nationkey // 5)) * s + 20, 6) AS y FROM nation, p")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = _squares(spark, sf_dir)
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    x, y = on_plane(plane(squares), first["lon"], first["lat"])
    return squares.select("name", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_SPOT = "printf('%.1f', (70 + n_nationkey % 5 + {dx} - lon) * f * s + 20) || ',' || printf('%.1f', (lat - (10 + n_nationkey // 5 + {dy})) * s + 20)"
_PATH = " || ' L' || ".join(_SPOT.format(dx=dx, dy=dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))


@query(f"{_PLANE} SELECT n_name AS name, 'M' || {_PATH} || ' Z' AS path FROM nation, p")
def ring_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = _squares(spark, sf_dir)
    return squares.select("name", path(plane(squares), F.col("rings")).alias("path"))


@query(_PLANE + " SELECT f AS lon_scale, s AS scale, 20::INTEGER AS padding, round(5 * f * s + 40)::INTEGER AS across, round(5 * s + 40)::INTEGER AS down FROM p")
def projection_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(_squares(spark, sf_dir))
    return spark.createDataFrame([(p.lon_scale, p.scale, p.padding, p.across, p.down)], "lon_scale double, scale double, padding int, across int, down int")


# ---- text
_SHORT = "CASE WHEN abs({v}) >= 1000000 THEN printf('%.1fM', {v} / 1000000) WHEN abs({v}) >= 1000 THEN printf('%.1fk', {v} / 1000) WHEN {v} = floor({v}) THEN {v}::BIGINT::VARCHAR ELSE printf('%.1f', {v}) END"


@query(f"SELECT o_orderkey, {_SHORT.format(v='o_totalprice')} AS label FROM orders")
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", short_number(F.col("o_totalprice")).alias("label"))


@query("SELECT o_orderkey, printf('%g', o_totalprice) AS total, printf('%g', o_totalprice * 1000) AS large, printf('%g', o_totalprice / 1e9) AS small FROM orders")
def general_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _read(spark, sf_dir, "orders").select("o_orderkey", general(price).alias("total"), general(price * 1000).alias("large"), general(price / 1e9).alias("small"))


@query("SELECT n_name AS name, '&lt;' || n_name || ' &amp; &quot;co&quot;&gt;' AS safe FROM nation")
def xml_escape_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select("name", xml_escape(F.concat(F.lit("<"), "name", F.lit(' & "co">'))).alias("safe"))


_MAPPED = _MATCH + ", w AS (SELECT region, sum(value) AS value FROM v GROUP BY 1), rk AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM w), k AS (SELECT DISTINCT value FROM rk, range(1, 6) g(i) WHERE r = least(i * n // 5, n - 1))"


@query(_MAPPED + " SELECT n_name AS name, CASE WHEN w.value IS NOT NULL THEN (SELECT count(*) FROM k WHERE k.value < w.value - 1e-6)::INTEGER END AS class, CASE WHEN w.value IS NULL THEN '#e6e8eb' ELSE ['#eef3f8', '#cfe0ee', '#a7c7e0', '#6fa5cd', '#3a7cb0'][(SELECT count(*) FROM k WHERE k.value < w.value - 1e-6)::INTEGER + 1] END AS fill FROM nation LEFT JOIN w ON region = n_name")
def choropleth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .choropleth import choropleth_rows

    return choropleth_rows(_nations(spark, sf_dir), _report(spark, sf_dir).values).select("name", "class", "fill")
