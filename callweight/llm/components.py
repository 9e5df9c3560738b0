"""Connected components of link tables, and their running contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch

ROUNDS = 100


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of edges(a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log n) rounds, each of
    them a pre-aggregated minimum per vertex and an equi-join, so no neighbourhood is ever
    gathered in one task. Loops and null ends are left out. Fails rather than return components
    that have not settled.
    """
    e = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(ROUNDS):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u > v always holds here; each u hands its smallest v to itself and its other v
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = scratch.keep(large.join(small_low, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u <> v").distinct())
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    roots = e.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct()
    out = scratch.keep(e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component").union(roots))
    scratch.drop(e)
    return out


def relabel(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with each value of `column` replaced by its component in names(v, component), if it has one."""
    n = names.select(F.col("v").alias(column), F.col("component").alias("__new"))
    return df.join(n, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(df.columns)


def compose(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """names after `old` of what `new` then calls the components of old."""
    if old is None:
        return new
    return relabel(old, "component", new).unionByName(new.join(old, "v", "left_anti"))
