"""Connected components of links between 64-bit nodes, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge u -> v with the least neighbour of u. A hub's edges may be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).drop("w")


def _step(edges: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step. Edges point from the larger to the smaller."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        _with_least(both)
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )
    small = _with_least(large)
    linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) to (node, root): root is the smallest node of the component.

    Rounds go on until nothing changes; then every node points at its root. Each round is
    written to the shared folder, so that no plan grows and a lost executor costs one round.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(
        links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    )
    mark = F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))
    state = edges.agg(*mark).first()
    while state[0]:
        edges = stored(_step(edges))
        now = edges.agg(*mark).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(u.alias("node"), v.alias("root")).union(roots)
