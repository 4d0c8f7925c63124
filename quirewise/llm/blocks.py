"""Pairs within blocks, without a block that one task must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.operators import meet

#: Most rows of a table of large blocks that is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST = 100_000


def large_blocks(rows: DataFrame, key: str, block: int) -> tuple[DataFrame, bool]:
    """(key, parts) of the blocks above `block` rows, and whether that table is small enough to broadcast."""
    return meet.large_blocks(rows, key, block, MOST_BROADCAST)


def block_pairs(rows: DataFrame, key: str, ident: str, block: int = 1024, one_key: bool = False) -> DataFrame:
    """a, b: the pairs of ids that share a key, a < b, each once.

    A block above `block` rows is cut into parts by hash, and every pair of parts meets
    under a key of its own, so no task holds more than two parts of a block. Rows with
    null keys meet nothing; repeated rows count once. With `one_key` each id has one key,
    so no pair can meet twice and none is looked for.
    """
    rows = rows.select(key, ident).distinct()
    large, few = large_blocks(rows, key, block)
    marked = rows.join(F.broadcast(large) if few else large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    marked = marked.withColumn("p", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int"))
    left = marked.select(key, F.col(ident).alias("a"), F.col("p").alias("i"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("j"))
    right = marked.select(key, F.col(ident).alias("b"), F.col("p").alias("j"), F.explode(F.sequence(F.lit(0), F.col("p"))).alias("i"))
    met = left.join(right, [key, "i", "j"]).filter("i < j or a < b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs if one_key else pairs.distinct()
