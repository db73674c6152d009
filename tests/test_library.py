from __future__ import annotations

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from regionlink.functions.names import normalise_key
from regionlink.operators.classify import breaks_by, coloured, equal_breaks, quantile_breaks
from regionlink.operators.geometry import CORNERS, collection_box, path, plane
from regionlink.operators.matching import canonical_size, match_names
from regionlink.operators.reconcile import reconcile
from regionlink.operators.tabular import distinct_values, filter_rows, group_sum, ordered, pivot_sum, require
from regionlink.plans import cli
from regionlink.plans.choropleth import render
from regionlink.sources.boundaries import alias_table, read_aliases, read_geojson
from regionlink.sources.tables import POS, read_csv, rows_to_table, write_csv, write_csv_dir
from regionlink.streaming import running_values


def square(x, y=10.0):
    return [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]


def collection(*features):
    return {"type": "FeatureCollection", "features": [{"properties": {"area": n}, "geometry": g} for n, g in features]}


@pytest.fixture
def shapes(tmp_path):
    path = tmp_path / "shapes.json"
    path.write_text(json.dumps(collection(*((n, {"type": "Polygon", "coordinates": [square(x)]}) for n, x in (("North", 5.0), ("South", 6.0), ("East", 7.0))))))
    return str(path)


def csv_file(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def cells(table):
    return [tuple(r)[1:] for r in table.orderBy(POS).collect()]


# ---- tables
def test_read_csv(spark, tmp_path):
    table = read_csv(spark, csv_file(tmp_path, '﻿ area , n \n  North ,"1,240.5" \n\n , \nSouth\n"Ea""st\nern",3,,\n'))
    assert table.columns == [POS, "area", "n"]
    assert cells(table) == [("North", "1,240.5"), ("South", ""), ('Ea"st\nern', "3")]


def test_read_csv_refuses_wide_rows(spark, tmp_path):
    with pytest.raises(ValueError, match=r"in.csv line 3: 3 fields but 2 columns. Is a value containing a comma unquoted\? Row starts: S,1,240.5"):
        read_csv(spark, csv_file(tmp_path, "area,n\nN,1\nS,1,240.5\n"))


def test_read_csv_edges(spark, tmp_path):
    assert read_csv(spark, csv_file(tmp_path, "")).columns == [POS]
    assert cells(read_csv(spark, csv_file(tmp_path, "a,a\n1,2\n"))) == [("2",)]


def test_table_operators(spark, tmp_path):
    table = rows_to_table(spark, [{"k": k, "c": c, "v": v} for k, c, v in (("b", "Rice", "1,000"), ("a", "rice", "x"), ("b", "rice", "(2)"), ("a", "Rice", "1234567"))] + [{"k": "z"}], ["k", "c", "v"])
    assert [r.k for r in distinct_values(table, "k").orderBy(POS).collect()] == ["b", "a", "z"]
    assert [(r.k, r.total) for r in group_sum(table, "k", "v").orderBy(POS).collect()] == [("b", 998.0), ("a", 1234567.0), ("z", 0.0)]
    assert filter_rows(table, F.col("k") == "b").count() == 2
    assert [r["v"] for r in ordered(filter_rows(table, lambda row: row["k"] == "b" and "," not in row["v"]))] == ["(2)"]
    assert next(ordered(table)) == {"k": "b", "c": "Rice", "v": "1,000"}
    some = filter_rows(table, "c <> ''")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        wide = pivot_sum(some, "k", "c", "v", as_text=False)
        assert (wide.columns, [tuple(r) for r in wide.collect()]) == (["k", "Rice", "rice"], [("a", 1234567.0, 0.0), ("b", 1000.0, -2.0)])
        assert [tuple(r) for r in pivot_sum(some, "k", "c", "v").collect()] == [("a", "1.23457e+06", "0"), ("b", "1000", "-2")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    with pytest.raises(ValueError, match="more than 1 categories"):
        pivot_sum(some, "k", "c", "v", most=1)
    with pytest.raises(KeyError, match=r"missing column\(s\): K. Available: k, c, v"):
        require(table, "K", "c")
    write_csv(table, str(tmp_path / "out" / "x.csv"))
    assert (tmp_path / "out" / "x.csv").read_bytes().startswith(b'k,c,v\r\nb,Rice,"1,000"\r\n')
    write_csv_dir(table, str(tmp_path / "dir"))
    assert spark.read.csv(str(tmp_path / "dir"), header=True).count() == 5


def test_files_that_change_are_read_anew(spark, tmp_path):
    for n in ("1", "2"):
        assert cells(read_csv(spark, csv_file(tmp_path, f"a\n{n}\n"))) == [(n,)]
        assert read_geojson(spark, csv_file(tmp_path, json.dumps(collection((n, {"type": "Polygon", "coordinates": [square(1.0)]}))), "n.json"), "area").first().name == n


def test_read_csv_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    csv_file(folder, "name,v\nx,1\n\ny,2\n", "a.csv")
    csv_file(folder, "v,name\n3,z\n", "b.csv")
    table = read_csv(spark, str(folder))
    assert table.columns == [POS, "name", "v"]
    assert cells(table) == [("x", "1"), ("y", "2"), ("z", "3")]
    assert [r[0] for r in table.orderBy(POS).collect()] == [0, 2, 1 << 40]
    csv_file(folder, "name,w\n3,z\n", "c.csv")
    with pytest.raises(ValueError, match="c.csv has columns name, w, but a.csv has name, v"):
        read_csv(spark, str(folder))


# ---- boundaries
def test_geojson(spark, tmp_path, shapes):
    regions = read_geojson(spark, shapes, "area")
    assert [r.name for r in regions.orderBy(POS).collect()] == ["North", "South", "East"]
    found = collection_box(regions)
    assert [found[c] for c in CORNERS] == [5.0, 10.0, 8.0, 11.0]
    assert (found.width, found.height, found.centre_lat) == (3.0, 1.0, 10.5)
    parts = {"type": "MultiPolygon", "coordinates": [[square(0), [[0.2, 10.2, 99], [0.4, 10.2, 99], [0.4, 10.4, 99]]], [square(3)]]}
    path = csv_file(tmp_path, json.dumps({"type": "FeatureCollection", "features": [{"properties": {"area": None, "n": 1.0, "b": True}, "geometry": parts}]}), "multi.json")
    row = read_geojson(spark, path, "area").first()
    assert (row.name, [len(r) for r in row.rings], row.properties) == ("None", [5, 3, 5], {"area": None, "n": "1.0", "b": "true"})


@pytest.mark.parametrize(
    ("document", "said"),
    [
        ({"type": "Point"}, "expected a FeatureCollection, found 'Point'"),
        (collection(("N", {"type": "Polygon", "coordinates": []})) | {"features": [{"properties": {"z": 1, "label": "N"}}]}, r"feature 0 has no 'area' property \(available: label, z\)"),
        (collection(("N", None)), r"feature 0 \('N'\) has no geometry"),
        (collection(("N", {"type": "Point", "coordinates": [1, 2]})), "unsupported geometry type 'Point'"),
    ],
)
def test_geojson_faults(spark, tmp_path, document, said):
    with pytest.raises(ValueError, match=said):
        read_geojson(spark, csv_file(tmp_path, json.dumps(document), "bad.json"), "area")


def test_aliases(spark, tmp_path):
    assert read_aliases(spark, None) is None
    assert [(r.variant, r.target) for r in read_aliases(spark, csv_file(tmp_path, '{"a": "N", "1": 2}', "a.json")).orderBy(POS).collect()] == [("a", "N"), ("1", "2")]
    with pytest.raises(SystemExit):
        read_aliases(spark, csv_file(tmp_path, "[]", "b.json"))


# ---- matching
def named(spark, names, column="name"):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, {POS} long")


def matched(spark, queries, canonical, aliases=None, **options):
    rows = match_names(named(spark, queries, "query"), named(spark, canonical), alias_table(spark, aliases) if aliases else None, **options)
    return {r.query: (r.matched, r.method, r.score, r.margin) for r in rows.collect()}


def plain(queries, canonical, aliases, threshold, margin, key):
    index, known = {}, {}
    for name in canonical:
        index.setdefault(key[name], name)
    for variant, target in aliases.items():
        known[key[variant]] = index[key[target]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    out = {}
    for q in queries:
        k = key[q]
        if k in known:
            out[q] = (known[k], "alias", 1.0, 1.0)
        elif k in index:
            out[q] = (index[k], "exact", 1.0, 1.0)
        else:
            scores = sorted(((1.0 - distance(k, c) / max(len(k), len(c)) if k or c else 1.0, name) for c, name in index.items()), key=lambda x: -x[0])
            best, second = scores[0][0], scores[1][0] if len(scores) > 1 else 0.0
            good = best >= threshold and best - second >= margin
            out[q] = (scores[0][1] if good else None, "fuzzy" if good else "none", round(best, 4), round(best - second, 4))
    return out


def test_tiers(spark):
    canonical = ["Alpha", "Alpha District", "Beta County", "Gamma"]
    got = matched(spark, ["ALPHA", "the beta", "Gamme", "First", "Delta", "gamma", "..."], canonical, {"first": "alpha", "FIRST": "Gamma", "Gamma": "Beta"}, threshold=0.75)
    assert got["ALPHA"] == ("Alpha", "exact", 1.0, 1.0)
    assert got["the beta"] == ("Beta County", "exact", 1.0, 1.0)
    assert got["Gamme"][:3] == ("Gamma", "fuzzy", 0.8)
    assert got["First"] == ("Gamma", "alias", 1.0, 1.0)
    assert got["gamma"] == ("Beta County", "alias", 1.0, 1.0)
    assert got["Delta"][:2] == (None, "none")
    assert got["..."] == (None, "none", 0.0, 0.0)
    assert matched(spark, ["Weston"], ["Weston North", "Weston South"], threshold=0.5, min_margin=0.2)["Weston"][:2] == (None, "none")
    assert matched(spark, ["x"], []) == {"x": (None, "none", 0.0, 0.0)}
    with pytest.raises(ValueError, match="alias 'a' points at 'Z', which is not a canonical name"):
        matched(spark, ["x"], canonical, {"a": "Z"})
    for bad in (0, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            matched(spark, ["x"], canonical, threshold=bad)


@pytest.mark.parametrize(("threshold", "margin"), [(0.85, 0.05), (0.6, 0.0)])
def test_random_names(spark, threshold, margin):
    rng = random.Random(int(100 * threshold))
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    canonical, queries = [word() for _ in range(25)], [*{word() for _ in range(150)}]
    aliases = {word(): rng.choice(canonical) for _ in range(5)}
    every = sorted({*canonical, *queries, *aliases})
    key = {r.n: r.k for r in spark.createDataFrame([(n,) for n in every], "n string").select("n", normalise_key(F.col("n")).alias("k")).collect()}
    want = plain(queries, canonical, aliases, threshold, margin, key)
    assert matched(spark, queries, canonical, aliases, threshold=threshold, min_margin=margin) == want
    fast = matched(spark, queries, canonical, aliases, threshold=threshold, min_margin=margin, fast=True)
    assert {q: m[:2] for q, m in fast.items()} == {q: m[:2] for q, m in want.items()}


# ---- reconciliation
def test_reconcile(spark, shapes):
    regions = read_geojson(spark, shapes, "area")
    table = rows_to_table(spark, [{"a": a, "v": v} for a, v in (("NORTH", "10"), ("North", "20"), ("Sout", "n/a"), ("", "9"), ("Atlantis", "1"), ("Atlantis", "2"), ("n", "(5)"))], ["a", "v"])
    join = lambda how: reconcile(table, regions, name_column="a", value_column="v", aliases=alias_table(spark, {"n": "North"}), threshold=0.75, aggregate=how)
    for how, want in (("sum", 25.0), ("mean", 25 / 3), ("max", 20.0), ("min", -5.0)):
        assert [(r.region, r.value) for r in join(how).values.collect()] == [("North", want)]
    report = join("sum")
    assert not report.complete
    assert report.summary().split("\n") == [
        "matched      1 region(s)", "coverage     33.3%", "via alias    1", "fuzzy        1 (review these)", " " * 15 + "'Sout' → 'South' (0.8)",
        "unmatched    1 data row(s) dropped", " " * 15 + "'Atlantis'", "no data      2 region(s)", " " * 15 + "'South'", " " * 15 + "'East'",
    ]
    with pytest.raises(ValueError, match="unknown aggregate 'median'"):
        join("median")


#: Names of twelve regions, and thirteen spellings that are to be matched to them.
REGIONS = ["Northvale", "Eastmarch", "Westford", "Southbury", "Highmoor", "Lakeside", "Riverton", "Stonebridge", "Fairhaven", "Oakdale", "Millbrook", "Greyfell"]
SPELT = ["NORTHVALE", "Eastmarch", "West-ford", "Southbury", "Highmoor", "Lakeside District", "Riverton", "Stonebrigde", "Fairhaven", "Oakdale", "Millbrook", "Grayfell", "Ashcombe"]


def test_acceptance_values(spark, tmp_path, capsys):
    """Scores, coverage, lists and exit code that are known for these names."""
    got = matched(spark, SPELT, REGIONS)
    assert got["NORTHVALE"] == ("Northvale", "exact", 1.0, 1.0)
    assert got["Lakeside District"] == ("Lakeside", "exact", 1.0, 1.0)
    assert got["West-ford"] == ("Westford", "fuzzy", 0.8889, 0.6667)
    assert got["Grayfell"] == ("Greyfell", "fuzzy", 0.875, 0.625)
    assert got["Stonebrigde"] == (None, "none", 0.8182, 0.4545)
    assert got["Ashcombe"] == (None, "none", 0.2222, 0.0404)
    aliases = {"Grayfell": "Greyfell", "Ashcombe": "Fairhaven"}
    got = matched(spark, SPELT, REGIONS, aliases, threshold=0.8)
    assert got["Stonebrigde"] == ("Stonebridge", "fuzzy", 0.8182, 0.4545)
    assert got["Grayfell"] == ("Greyfell", "alias", 1.0, 1.0)
    assert got["Ashcombe"] == ("Fairhaven", "alias", 1.0, 1.0)
    cities = ["Bengaluru Urban", "Mysuru", "Belagavi", "Kalaburagi"]
    got = matched(spark, ["BANGALURU URBAN", "Mysore"], cities)
    assert got["BANGALURU URBAN"][:3] == ("Bengaluru Urban", "fuzzy", 0.9333)
    assert got["Mysore"][:3] == (None, "none", 0.6667)
    assert canonical_size(named(spark, ["Alpha", "Alpha District"])) == 2

    data = csv_file(tmp_path, "district,hectares\n" + "".join(f"{n},{i}\n" for i, n in enumerate(SPELT)))
    shapes = csv_file(tmp_path, json.dumps(collection(*((n, {"type": "Polygon", "coordinates": [square(float(i))]}) for i, n in enumerate(REGIONS)))), "regions.json")
    assert cli.main(["check", data, shapes, "--name-column", "district", "--value-column", "hectares", "--name-property", "area"]) == 1
    said = capsys.readouterr().err.split("\n")
    assert said[:3] == ["matched      11 region(s)", "coverage     91.7%", "fuzzy        2 (review these)"]
    assert [x.strip() for x in said[3:5]] == ["'West-ford' → 'Westford' (0.8889)", "'Grayfell' → 'Greyfell' (0.875)"]
    assert [x.strip() for x in said[5:] if x] == ["unmatched    2 data row(s) dropped", "'Stonebrigde'", "'Ashcombe'", "no data      1 region(s)", "'Stonebridge'"]


# ---- classes
@pytest.mark.parametrize("classes", [2, 5, 7])
def test_breaks(spark, classes):
    rng = random.Random(classes)
    for values in ([], [7.0] * 3, [5.0, 5.0, 5.0, 5.0, 9.0], [float(i) for i in range(1, 11)], [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(200)]):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        s = sorted(values)
        want = sorted({s[min(i * len(s) // classes, len(s) - 1)] for i in range(1, classes) if s} | set(s[-1:]))
        assert quantile_breaks(frame, "v", classes).first().breaks == want
        low, high = min(values, default=0), max(values, default=0)
        even = [low + (high - low) / classes * i for i in range(1, classes + 1)] if low < high else s[:1]
        assert equal_breaks(frame, "v", classes).first().breaks == even
    with pytest.raises(ValueError, match="2 classes"):
        breaks_by("other", frame, "v", 1)
    with pytest.raises(ValueError, match="unknown method 'other'"):
        breaks_by("other", frame, "v", 2)


def test_breaks_of_values_far_apart(spark):
    """One value far from all others leaves no part of the range with nearly all of them."""
    rng = random.Random(3)
    values = [rng.random() for _ in range(5000)] + [1e300, -1e300] + [0.5] * 4000
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    s = sorted(values)
    for classes in (2, 9, 40):
        assert quantile_breaks(frame, "v", classes).first().breaks == sorted({s[min(i * len(s) // classes, len(s) - 1)] for i in range(1, classes)} | {s[-1]})


def test_more_classes_than_colours(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(8)] + [(None,)], "value double")
    got = [(r["class"], r.fill) for r in coloured(frame, quantile_breaks(frame, "value", 8), "warm").orderBy("value").collect()]
    assert got[0] == (None, "#e6e8eb")
    assert [c for c, _ in got[1:]] == [0, *range(7)]
    assert len({f for _, f in got[1:]}) == 6
    with pytest.raises(ValueError, match="unknown palette 'none'; try sequential, warm"):
        coloured(frame, quantile_breaks(frame, "value"), "none")


# ---- maps
def ringed(spark, *rings):
    return spark.createDataFrame([(0, "x", [[(float(x), float(y)) for x, y in ring] for ring in rings])], f"{POS} long, name string, rings array<array<struct<lon:double,lat:double>>>")


def test_projection(spark, shapes):
    # three squares of side 1 at latitude 10
    p = plane(read_geojson(spark, shapes, "area"), padding=24)
    assert (p.across, p.down, p.padding) == (900, 337, 24)
    assert abs(p.lon_scale - 0.9832549075639546) < 1e-12 and abs(p.scale - 288.8365954903994) < 1e-9
    with pytest.raises(ValueError, match="zero extent"):
        plane(ringed(spark, [(1, 1), (1, 2)]))
    with pytest.raises(ValueError, match="empty collection"):
        plane(ringed(spark).limit(0))
    with pytest.raises(ValueError, match="without points"):
        collection_box(ringed(spark))


def test_path(spark):
    flat = Row(min_lon=0.0, lon_scale=1.0, scale=1.0, padding=0, max_lat=0.0)
    rings = ringed(spark, [(1.26, -2), (3, -4), (0.25, -0.35)], [(1, 1), (2, 2)], [(0, 0), (0.75, 0), (0, 1234.56)])
    # of a tie the even digit, by the exact value; rings of two points are left out
    assert rings.select(path(flat, F.col("rings"))).first()[0] == "M1.3,2.0 L3.0,4.0 L0.2,0.3 Z M0.0,0.0 L0.8,0.0 L0.0,-1234.6 Z".replace("0.0,0.0", "0.0,0.0")


def test_render(spark, tmp_path):
    path = csv_file(tmp_path, json.dumps(collection(*((n, {"type": "Polygon", "coordinates": [square(x)]}) for n, x in (("<b>", 5.0), ("South", 6.0), ("East", 7.0))))), "m.json")
    regions = read_geojson(spark, path, "area")
    values = spark.createDataFrame([("<b>", 1500.0), ("South", 3.0)], "region string, value double")
    for method in ("quantile", "equal"):
        root = ET.fromstring(render(regions, values, title="A & B", subtitle="x", method=method, palette="warm"))
        paths = root.findall(".//{*}path")
        assert [p.find("{*}title").text for p in paths] == ["<b>: 1.5k", "South: 3", "East: no data"]
        assert paths[2].get("fill") == "#e6e8eb"
    bare = ET.fromstring(render(regions, values.limit(0)))
    assert {p.get("fill") for p in bare.findall(".//{*}path")} == {"#e6e8eb"}


def test_command_line(spark, tmp_path, shapes, capsys):
    data = csv_file(tmp_path, "a,v\nNorth,1\nSouth,2\nEast,3\n")
    shared = [data, shapes, "--name-column", "a", "--value-column", "v", "--name-property", "area"]
    assert cli.main(["inspect", shapes, "--name-property", "area"]) == 0
    assert capsys.readouterr().out == "3 region(s)\nbounds  5.000,10.000 → 8.000,11.000\n  East\n  North\n  South\n"
    assert cli.main(["check", *shared]) == 0
    bad = csv_file(tmp_path, "a,v\nNowhere,1\n", "bad.csv")
    assert cli.main(["check", bad, *shared[1:]]) == 1
    out = tmp_path / "deep" / "map.svg"
    assert cli.main(["map", *shared, "--out", str(out), "--title", "T"]) == 0
    assert f"✓ wrote {out}" in capsys.readouterr().err
    ET.parse(out)


# ---- streams
def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("north", "1,000", "2024-01-01 00:01:00"), ("NORTH", "5", "2024-01-01 00:02:00"), ("?", "7", "2024-01-01 00:02:00")], "a string, v string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    running = running_values(stream, named(spark, ["North"]), name_column="a", value_column="v", time_column="t")
    started = running.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    started.processAllAvailable()
    started.stop()
    assert [(r.region, r.value) for r in spark.sql("SELECT region, value FROM sums").collect()] == [("North", 1005.0)]
