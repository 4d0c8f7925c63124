"""Mixing sources to target shares of the total size, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least parts by hash of each size class, and documents for each part beyond: so a cell that is numbered by itself stays small however
#: much a source holds, and the table of prefix sums has about a row for every CELL documents.
PARTS, CELL = 256, 1_000_000


def mix(items: DataFrame, targets: DataFrame, seed: int = 0, ident: str = "doc_id", source: str = "source", size: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """Chosen documents (doc_id, source, n_tokens, copies) and shares by source.

    `targets` (few rows) has source, target_share, max_repeats. The total is the largest
    at which every source with documents can give its share, shares being scaled to
    those sources; a source that could not give its share with max_repeats copies of
    each document thus limits the total (the smallest source for its share sets it), and a source has e expected copies of each of its documents.
    Sampling is systematic: documents lie in order of size class, part and size within
    their source, expected copies are summed along that order, one random offset is
    added, and a document is emitted once for each integer boundary it crosses, so it
    has floor(e) or ceil(e) copies, never more than max_repeats. Because neighbours in
    the order have like sizes, the sizes drawn follow those of the source.

    Shares have source, target_share, max_repeats, n_docs, available_tokens,
    chosen_docs, chosen_copies, chosen_tokens, actual_share. Documents without a source,
    of a source without target, or with null size or size 0 are never chosen; sources
    without documents get a row with zeros. Targets that are null or not positive count
    as 0; null max_repeats as 1. Repeated source rows in `targets` are one (the largest
    values). Other columns are ignored; empty inputs give empty results.

    Prefix sums need no global order: counts by (source, size class, part) form a
    small table with running sums, and within one part rows are numbered apart.
    """
    spread = F.xxhash64(F.lit(seed), F.col(ident))
    goal = targets.filter("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    docs = items.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens"), spread.alias("h")).filter("n_tokens > 0 and source is not null")
    docs = docs.join(F.broadcast(goal.select("source")), "source", "left_semi") if _small(goal) else docs.join(goal.select("source"), "source", "left_semi")
    parts = max(PARTS, -(-docs.count() // CELL))
    docs = docs.withColumns({"class": F.floor(F.log2("n_tokens") * 2).cast("int"), "part": F.pmod("h", F.lit(parts)).cast("int")})
    cells = docs.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    totals = goal.join(cells.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("t").alias("available")), "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    live = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("target_share"))
    everything = Window.partitionBy(F.lit(1))  # one row for each source of the fixed table
    scaled = totals.withColumn("share", live / F.sum(live).over(everything)).withColumn("total", F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(everything))
    scaled = scaled.withColumn("copies", F.least(F.col("total") * F.col("share") / F.col("available"), F.col("max_repeats").cast("double")))
    rates = scaled.filter("share is not null").select("source", "copies", (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / (1 << 20)).alias("u"))
    running = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).select("source", "class", "part", "before")
    order = Window.partitionBy("source", "class", "part").orderBy("n_tokens", "doc_id")
    placed = docs.withColumn("k", F.row_number().over(order)).join(before, ["source", "class", "part"]).join(rates, "source")
    end = F.floor((F.col("before") + F.col("k")) * F.col("copies") + F.col("u"))
    begin = F.floor((F.col("before") + F.col("k") - 1) * F.col("copies") + F.col("u"))
    chosen = placed.select("doc_id", "source", "n_tokens", (end - begin).cast("int").alias("copies")).filter("copies > 0")
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("chosen_docs"), F.sum("copies").alias("chosen_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("chosen_tokens"))
    shares = totals.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", F.col("available").alias("available_tokens"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chosen_docs", "chosen_copies", "chosen_tokens")]
    )
    whole = F.sum("chosen_tokens").over(everything)
    return chosen, shares.withColumn("actual_share", F.when(whole > 0, F.col("chosen_tokens") / whole).otherwise(0.0))


def _small(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most
