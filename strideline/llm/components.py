"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its smallest neighbour to the larger (small star: to the smaller) ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # Written first: the join below then deals both sides anew, so that Spark may split a hub's rows.
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    out = saved(out.where("a <> b").distinct(), "edges")
    discard(edges.sparkSession, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (a, b), without loops or nulls.

    Each round is written to the shared folder; no node's neighbours are gathered in one place. An empty table gives one.
    """
    spark, last = edges.sparkSession, None
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == last or not sums[0]:
            break
        last, middle = sums, _stars(edges, True)
        after = _stars(middle, False)
        discard(spark, edges, middle)
        edges = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
