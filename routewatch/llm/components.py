"""Connected components of an edge table, by alternating star contractions."""

from pyspark.sql import DataFrame, functions as F

from .shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (u, v: longs) with the smallest node reachable: node, root.

    Every round turns each node's neighbourhood into a star around its smallest member, first over
    the larger neighbours, then over the smaller ones; the number of rounds grows with the logarithm
    of the nodes. Each round is written to the shared folder, and the one before removed. No neighbourhood is collected: a round
    is a minimum per node and a join. Null ends and loops are left out.
    """
    edges = written(_cleaned(edges), "stars")
    before = None
    while (now := _state(edges)) != before:
        before, old = now, edges
        edges = written(_small(_large(edges)), "stars")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _cleaned(edges):
    """Edges as u > v, once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large(edges):
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # edges already hold u > v: the larger neighbours of v are its u
    return _cleaned(edges.select(F.col("v").alias("at"), F.col("u").alias("far")).join(least.withColumnRenamed("u", "at"), "at")
                    .select(F.col("far").alias("u"), F.col("m").alias("v")))


def _small(edges):
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _cleaned(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))))
