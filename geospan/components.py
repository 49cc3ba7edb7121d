"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.checkpoints import saved


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, kept: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """``node, component`` for each node of ``edges (u, v)``; the component is its smallest node.

    Loops, repeats and null ends are ignored. Edges run from the larger node
    ``a`` to the smaller ``b``. The large star hangs the larger neighbours of a
    node on its smallest neighbour; the small star does so with the smaller
    ones. Neither gathers a node's neighbours: the minimum is aggregated with
    partial sums, and joined back in a join whose skewed side Spark can split. Rounds go on until the
    edges stay as they are. ``kept`` computes a table and cuts its lineage.
    """
    edges = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = _sum(edges)
    while before[0]:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("b"), F.least("u", "m").alias("m"))
        edges = edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        edges = kept(edges)
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = kept(edges)
        now = _sum(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
