"""Connected components of an edge list by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.plans.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, its smallest node, for every node of ``edges`` (columns ``a`` and ``b``).

    Self-loops, repeated edges and either direction are fine; null ends are dropped; no edges give no rows. Each round
    is one large-star and one small-star step, so that the diameter shrinks geometrically; hubs are aggregated
    with map-side combine before they are joined. Not to converge in ``max_rounds`` is an error, never a partial result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        e = cut(small.select("v", "m").union(small.select(F.col("u"), "m")).toDF("u", "v").where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(labels, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
