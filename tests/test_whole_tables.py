"""Queries over whole tables against brute force."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from regionlink.functions.values import short_number
from regionlink.plans.queries import QUERIES


def label(value):
    """As Python rounds: the exact value, and of a tie the even digit."""
    if abs(value) < 1000 and value == int(value):
        return str(int(value))
    size, unit = next((s, u) for s, u in ((1_000_000, "M"), (1000, "k"), (1, "")) if abs(value) >= s or s == 1)
    return f"{value / size:.1f}{unit}"


def test_labels_of_all_orders(spark, sf):
    orders = {r.o_orderkey: label(r.o_totalprice) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    assert {r.o_orderkey: r.label for r in QUERIES["format_value"](spark, sf).collect()} == orders


def test_labels_of_whole_amounts_and_ties(spark):
    values = [0.0, 7.0, 999.0, 7.25, 7.35, 0.05, 999.95, 1000.0, 1050.0, 1250.0, 12350.0, 1_000_000.0, 1_250_000.0, -7.0, -7.25, -1250.0]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", short_number(F.col("v"))).collect()
    assert [tuple(r) for r in found] == [(v, label(v)) for v in values]


def test_totals_of_all_segments(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    regions = {r.r_regionkey: r.r_name for r in read("region")}
    places = {n.n_nationkey: regions[n.n_regionkey] for n in read("nation")}
    totals: dict = defaultdict(lambda: defaultdict(float))
    customers = read("customer")
    for c in customers:
        totals[places[c.c_nationkey]][c.c_mktsegment] += float(c.c_acctbal)
    segments = sorted({c.c_mktsegment for c in customers})
    found = QUERIES["pivot_sum_segment_region"](spark, sf)
    assert found.columns == ["region", *segments] and len(segments) == 5
    got = {r.region: [r[s] for s in segments] for r in found.collect()}
    assert got.keys() == totals.keys()
    assert all(abs(x - totals[region][s]) < 0.006 for region, row in got.items() for s, x in zip(segments, row))
