"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, remove


def _written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
    spark, path = df.sparkSession, new_path(df.sparkSession, "stars")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back, path, tuple(back.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (columns a, b; long): comp is the smallest node it reaches.

    Each round is two grouped minima with map-side combine and two equi joins; the minima are written first, so that
    Spark can split a hub's edges, which it can't in a join with an aggregate. Rounds grow with the logarithm of a
    component's size. Nothing but a count and a checksum of the edges reaches the driver. No edges: no rows.
    """
    spark = edges.sparkSession
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path, state = _written(first)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        turned = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_at, new_state = _written(turned.union(least.select("u", F.col("m").alias("v"))).distinct())
        remove(spark, path)
        same = new_state == state
        e, path, state = new, new_at, new_state
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
