"""Connected components of an edge table by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is a minimum by vertex, which
combines before the shuffle, and an equi-join back to the edges, which adaptive execution can split, so a vertex with
very many neighbours isn't one task's work. State lives in the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Each vertex links neighbours (the larger, or the smaller and itself) to its least."""
    if larger_only:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("m", F.least("_m", "_u"))
    joined = sides.join(least, F.col("u") == F.col("_u"))
    if larger_only:
        return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): every vertex of ``edges`` (two long columns, any names), with the least vertex it reaches.

    Loops and repeated edges are allowed, null ends are not edges. No edges: no rows.
    """
    a, b = edges.columns[:2]
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    alone = ends.filter("a = b").select(F.col("a").alias("vertex"))
    now = materialize(ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        held = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held == state or not held[0]:
            break
        state = held
        now = materialize(_star(_star(now, True), False))
    members = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    lone = alone.join(now.select(F.col("u").alias("vertex")), "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return members.unionByName(heads).unionByName(lone).distinct()
