"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges that one task handles with ease.
SMALL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the component's smallest node.

    In each round every component takes its smallest neighbour's label where that is smaller, labels are followed twice, and
    edges inside a component go. Tables are written after each round, and those of
    the round before removed. No edges give no rows; edges from a node to itself count for nothing, nor does it matter how
    often an edge is there. SMALL only changes how many tasks do the work.
    """
    left = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    n = left.count()
    small = n <= SMALL  # so are the labels, then; in one partition, tables this small need no exchange
    while n:
        few = (lambda df: df.coalesce(1)) if small else (lambda df: df)
        lower = few(left).unionAll(few(left).select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        lower = written(lower, "steps")
        again = lower.select(F.col("from").alias("to"), F.col("to").alias("then"))
        jump = written(lower.join(again, "to", "left").select("from", F.coalesce("then", "to").alias("to")), "jumps")
        of = lambda name: jump.select(F.col("from").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        new = written(few(labels).join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), "labels")
        rest = few(left).join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct()
        rest = written(rest, "edges")
        discard(left, labels, lower, jump)
        left, labels = rest, new
        n = left.count()
    discard(left)
    return labels


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after further edges (a, b), found among the components that these touch."""
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    merged = components(between)
    every = found.unionByName(merged.select("node", F.col("node").alias("component")).join(found, "node", "left_anti"))
    return every.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
