"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component: each node of the edges with the smallest node of its component.

    Only the running edge table moves: every round has two aggregates with a partial
    stage and joins whose skew AQE can split, and ends in a checkpoint, so lost
    executors cost one round at most. A round's size is at most that of the edges;
    nothing is gathered on the driver but a count and a checksum. Self-loops give a
    component of one node; edges with a null end are ignored; an empty table gives
    none. Nodes may be of any type that orders. The number of rounds grows with the
    logarithm of the longest path; beyond `max_rounds` an error is raised.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    loops = clean.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    e = cut(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(centres).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
