"""Names to canonical names: alias, then exact, then the most similar, if it is similar enough and well ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_key, similarity
from ..sources.scratch import kept
from ..sources.tables import POS

#: Up to so many canonical keys, and no more, travel to every task.
BROADCAST_KEYS = 200_000
#: Keys that one row holds when names are compared with all of them.
BLOCK = 500


def canonical_size(canonical: DataFrame) -> int:
    """How many names there are, equal keys included."""
    return canonical.count()


def canonical_index(canonical: DataFrame) -> DataFrame:
    """(key, name, place) of canonical (name, POS): of names with one key the first counts."""
    keyed = canonical.select(normalise_key(F.col("name")).alias("key"), "name", F.col(POS).alias("place"))
    return keyed.groupBy("key").agg(F.min_by("name", "place").alias("name"), F.min("place").alias("place"))


def alias_index(aliases: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, name) of aliases (variant, target, POS): of variants with one key the last counts. And the first (variant, target) whose target is no canonical name, or a row of nulls."""
    keyed = aliases.select(normalise_key(F.col("variant")).alias("key"), normalise_key(F.col("target")).alias("to"), "variant", "target", POS)
    found = keyed.join(index.select(F.col("key").alias("to"), "name"), "to", "left")
    bad = found.filter("name is null").agg(F.min_by("variant", POS).alias("variant"), F.min_by("target", POS).alias("target"))
    return found.groupBy("key").agg(F.max_by("name", POS).alias("name")), bad


def _two_best(found: Column, of: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Of an array of candidates (place, name, ...): the most similar, the first of equals, and how similar it (best) and the next (second) are.

    of: from a candidate to its similarity, and that of its own runner-up.
    """
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), F.lit(-1.0).alias("second"))

    def step(held: Column, x: Column) -> Column:
        s, next_ = of(x)
        ahead = (s > held["best"]) | ((s == held["best"]) & (x["place"] < held["place"]))
        second = F.greatest(F.least(s, held["best"]), held["second"], next_)
        return F.struct(F.greatest(s, held["best"]).alias("best"), F.when(ahead, x["place"]).otherwise(held["place"]).alias("place"), F.when(ahead, x["name"]).otherwise(held["name"]).alias("name"), second.alias("second"))

    return F.aggregate(found, start, step)


def match_names(names: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, threshold: float = 0.85, min_margin: float = 0.05, fast: bool = False) -> DataFrame:
    """(query, matched, method, score, margin, POS) of the distinct names (query, POS).

    canonical: (name, POS). method is alias, exact, fuzzy or none. score and margin over the runner-up are rounded to 4 places
    and stand for refused names too. Names are made distinct first, and only those that no index knows are compared with all
    keys; fast compares them with keys of a length that could matter: the same matches, but scores and margins of what is
    refused, and margins of what is accepted, may be off.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    index = kept(canonical_index(canonical), "index")  # used four times, and small beside the names
    counted = index.agg(F.count("*").alias("size"))
    alias, bad = alias_index(aliases, index) if aliases is not None else (None, None)
    first = (counted.crossJoin(F.broadcast(bad)) if aliases is not None else counted).first()
    if aliases is not None and first.variant is not None:
        raise ValueError(f"alias {first.variant!r} points at {first.target!r}, which is not a canonical name")
    size = first["size"]
    small = (lambda t: F.broadcast(t)) if size <= BROADCAST_KEYS else (lambda t: t)
    queries = names.groupBy("query").agg(F.min(POS).alias(POS))
    # the key is made by reflection; behind a generator it is made once
    keyed = queries.select("query", POS, F.explode(F.array(normalise_key(F.col("query")))).alias("key"))
    exact = index.select("key", F.col("name").alias("exact"))
    if alias is not None:
        keyed = keyed.join(alias.withColumnRenamed("name", "alias"), "key", "left")
    else:
        keyed = keyed.withColumn("alias", F.lit(None).cast("string"))
    keyed = keyed.join(small(exact), "key", "left")
    sure = keyed.filter("alias is not null or exact is not null").select("query", F.coalesce("alias", "exact").alias("matched"), F.when(F.col("alias").isNotNull(), "alias").otherwise("exact").alias("method"), F.lit(1.0).alias("score"), F.lit(1.0).alias("margin"), POS)
    rest = keyed.filter("alias is null and exact is null").select("query", "key", POS)
    against = index.select(F.col("key").alias("known"), "name", "place")
    if fast:
        least = threshold - max(min_margin, 0.0) - 1e-9
        lengths = F.sequence(F.greatest(F.ceil(F.length("key") * least), F.lit(0)), F.floor(F.length("key") / F.lit(least)))
        near = rest.withColumn("_n", F.explode(lengths.cast("array<int>")))
        banded = against.withColumn("_n", F.length("known"))
        blocks = banded.groupBy("_n", F.pmod(F.xxhash64("known"), F.lit(max(1, size // BLOCK))).alias("_block")).agg(F.collect_list(F.struct("known", "name", "place")).alias("keys"))
        pairs = near.join(small(blocks), "_n").select("query", "key", "keys")
    else:
        blocks = against.groupBy(F.pmod(F.xxhash64("known"), F.lit(max(1, size // BLOCK))).alias("_block")).agg(F.collect_list(F.struct("known", "name", "place")).alias("keys"))
        # the names that no index knows against all keys, in blocks
        pairs = rest.crossJoin(small(blocks)).select("query", "key", "keys")
    each = pairs.select("query", _two_best(F.col("keys"), lambda x: (similarity(F.col("key"), x["known"]), F.lit(-1.0))).alias("top"))
    top = each.groupBy("query").agg(F.collect_list("top").alias("tops")).select("query", _two_best(F.col("tops"), lambda x: (x["best"], x["second"])).alias("top"))
    known = lambda c: F.greatest(F.coalesce(F.col(f"top.{c}"), F.lit(0.0)), F.lit(0.0))
    best = rest.select("query", POS).join(top, "query", "left").select("query", POS, "top.name", known("best").alias("best"), known("second").alias("second"))
    ahead = F.col("best") - F.col("second")
    accepted = F.col("name").isNotNull() & (F.col("best") >= threshold) & (ahead >= min_margin)
    likely = best.select("query", F.when(accepted, F.col("name")).alias("matched"), F.when(accepted, "fuzzy").otherwise("none").alias("method"), F.bround("best", 4).alias("score"), F.bround(ahead, 4).alias("margin"), POS)
    return sure.unionByName(likely)
