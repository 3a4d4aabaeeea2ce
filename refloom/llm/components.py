"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import written


def free_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of two different nodes; the component is its smallest node.

    Edges may be repeated and run either way; an edge of a node with itself is ignored. Rounds go on until the
    edges are stars, after about the logarithm of the longest path; more than most_rounds raises RuntimeError.
    A node with very many edges is a hot key of joins whose other side has one row for it, which are split.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    state = None
    for _ in range(most_rounds):
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = tuple(row)
        now = written(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def merged(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges (a, b): they are put between the roots that known (node, component) has, and only those are connected anew."""
    if known is None:
        return written(components(edges), "components")
    for side in ("a", "b"):
        named = known.select(F.col("node").alias(side), F.col("component").alias("root"))
        edges = edges.join(named, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    roots = written(components(edges.select("a", "b").where("a != b").distinct()), "roots")
    moved = known.join(roots.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(roots.join(known.select("node"), "node", "left_anti")), "components")
