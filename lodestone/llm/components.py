"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def _state(edges: DataFrame) -> tuple:
    """Tells whether a step has changed the edges: their number and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Parts that the neighbours of every node are dealt to, so that a hub's neighbours meet in no single task.
SALTS = 8


def _with_least(near: DataFrame, least: DataFrame) -> DataFrame:
    """near (u, v) with m of least (u, m): the few columns of least are repeated for each salt."""
    salted = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["u", "salt"])


def _star(near: DataFrame, keep: Column) -> DataFrame:
    """Points each neighbour v of u that `keep` allows to the least of u and its neighbours."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(near, least).where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, most_steps: int = 64) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node reachable. Nodes are integers.

    large-star: each larger neighbour of u is linked to u's least neighbour; small-star: each smaller neighbour of u, and u,
    is linked to the least of them. Both keep the components, and repeating them leaves stars around the least nodes. The
    least neighbours come from a grouped minimum, combined in each task first, and meet the neighbours in a salted join, so a
    node with very many neighbours is spread. Edges with a null end and loops link nothing and are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = write_shared(edges, "edges")
    before = _state(edges)
    for _ in range(most_steps):
        if not before[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        # large is (v, m) with v > m: every u has its smaller neighbours in it
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(down, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = write_shared(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_steps} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
