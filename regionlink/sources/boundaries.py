"""GeoJSON boundaries and alias files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import kept
from .tables import POS

#: Features that are handed on together.
_ROWS = 500
_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_FIELDS = pa.schema([(POS, pa.int64()), ("name", pa.string()), ("rings", pa.list_(pa.list_(_POINT))), ("properties", pa.map_(pa.string(), pa.string())), ("fault", pa.string())])
_SCHEMA = f"{POS} long, name string, rings array<array<struct<lon:double,lat:double>>>, properties map<string,string>, fault string"


def _rings(geometry: dict) -> list[list[dict]]:
    """All rings of a polygon, or of all parts of a multipolygon; altitudes are dropped."""
    kind = geometry.get("type")
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"unsupported geometry type {kind!r}; expected Polygon or MultiPolygon")
    parts = geometry["coordinates"] if kind == "MultiPolygon" else [geometry["coordinates"]]
    return [[{"lon": float(p[0]), "lat": float(p[1])} for p in ring] for part in parts for ring in part]


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _features(raw: str, label: str) -> Iterator[dict]:
    """Rows of a document up to its first fault, which is in a row of its own."""
    pos = -1
    try:
        document = json.loads(raw)
        kind = document.get("type")
        if kind != "FeatureCollection":
            raise ValueError(f"expected a FeatureCollection, found {kind!r}")
        for pos, feature in enumerate(document.get("features", [])):
            properties = feature.get("properties") or {}
            if label not in properties:
                raise ValueError(f"feature {pos} has no {label!r} property (available: {', '.join(sorted(properties)) or 'none'})")
            if not feature.get("geometry"):
                raise ValueError(f"feature {pos} ({properties[label]!r}) has no geometry")
            yield {POS: pos, "name": str(properties[label]), "rings": _rings(feature["geometry"]), "properties": [(k, _text(v)) for k, v in properties.items()], "fault": None}
    except ValueError as e:
        yield {POS: pos, "name": None, "rings": None, "properties": None, "fault": str(e)}


def read_geojson(spark: SparkSession, path: str, name_property: str = "name") -> DataFrame:
    """(POS, name, rings, properties) of a FeatureCollection, in its order. What is wrong with it raises ValueError now.

    name is the property as Python prints it. Other properties that aren't strings are JSON text. A document is parsed by one
    task, once; its features are kept.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("value").to_pylist():
                rows = _features(raw, name_property)
                while some := list(islice(rows, _ROWS)):
                    yield pa.RecordBatch.from_pylist(some, _FIELDS)

    rows = kept(spark.read.text(str(path), wholetext=True).mapInArrow(parse, _SCHEMA), "features")
    if bad := rows.filter("fault is not null").orderBy(POS).first():
        raise ValueError(bad.fault)
    return rows.drop("fault")


def read_aliases(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(POS, variant, target) of a JSON object; None without a path."""
    if not path:
        return None
    found = json.loads("\n".join(r.value for r in spark.read.text(str(path), wholetext=True).collect()))
    if not isinstance(found, dict):
        raise SystemExit("alias file must be a JSON object of {variant: canonical}")
    return alias_table(spark, found)


def alias_table(spark: SparkSession, aliases: dict) -> DataFrame:
    return spark.createDataFrame([(i, str(k), str(v)) for i, (k, v) in enumerate(aliases.items())], f"{POS} long, variant string, target string")
