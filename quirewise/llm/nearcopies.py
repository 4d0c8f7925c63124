"""Near-copies among many records: shingle sets, prefix coordinates and a count-vector R-tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm import blocks
from quirewise.llm.components import connected_components
from quirewise.operators.meet import BLOCK, BUCKETS, FLAT, GROUPS, MOST_BUCKETS, STEPS, WIDE, _bits, _buckets, _meeting, _packed, _search, _unpacked, meet  # noqa: F401
from quirewise.session import cut, kept


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(tokens: Column, k: int) -> Column:
    """Sorted distinct 64-bit hashes of all runs of k tokens; empty where there are fewer."""
    run = F.transform(F.sequence(F.lit(0), F.size(tokens) - k), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))
    return F.when(F.size(tokens) >= k, F.sort_array(F.array_distinct(run))).otherwise(F.expr("cast(array() as array<bigint>)"))


def near_copies(df: DataFrame, ident: str, text: str, k: int = 5, num: int = 4, den: int = 5, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """Members (ident, cls) and links (a, b): records by class of equal shingle sets, and pairs of classes at least num/den similar.

    Similarity is the number of distinct runs of k words in both divided by the
    number in either. Records with fewer than `least_words` or k words, null texts and
    null ids have no shingles and are not members. Repeated texts fall in one class, so a third
    of all rows being copies makes one class, not pairs; links hold between different
    classes only, a < b. Other columns are ignored.

    Shingles are ordered by how many shingles of all classes fall in their bucket, so
    rare ones come first; two similar sets share a shingle among the first few of each
    (the prefix), so classes meet in the blocks of their prefix shingles. In a block, sizes, positions and vectors of group
    counts bound the overlap (summed coordinate minima, by bits; of long sets through an R-tree); survivors are verified exactly.
    Blocks above BLOCK rows are split into pairs of parts.
    """
    toks = df.select(F.col(ident).alias("id"), words(F.col(text)).alias("w")).filter("id is not null").filter(F.size("w") >= max(least_words, k))
    sets = toks.select("id", shingles(F.col("w"), k).alias("sh"))
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "sh")), 16, "0")
    # Kept, so that shingles are computed once for members and classes.
    sets = kept(sets.select("id", "sh", F.unhex(F.concat(half(1), half(2))).alias("cls")))
    members = sets.select(F.col("id").alias(ident), "cls")
    classes = kept(sets.groupBy("cls").agg(F.min("sh").alias("sh")).withColumn("no", F.monotonically_increasing_id()))
    met = meet(classes, num, den, BLOCK, FLAT, WIDE, blocks.MOST_BROADCAST)
    a = classes.select(F.col("no").alias("a"), F.col("cls").alias("ca"), F.col("sh").alias("sa"))
    b = classes.select(F.col("no").alias("b"), F.col("cls").alias("cb"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = met.join(a, "a").join(b, "b").filter(both * (den + num) >= num * (F.size("sa") + F.size("sb")))
    return members, links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def near_groups(members: DataFrame, links: DataFrame, ident: str) -> DataFrame:
    """ident, cls, grp, n_links: each record with its class, its group (connected classes) and the links of its class.

    Classes and groups are named by their smallest record. A record alone is its own class
    and group, with no links.
    """
    reps = members.groupBy("cls").agg(F.min(ident).alias("rep"))
    end = lambda c: reps.select(F.col("cls").alias(c), F.col("rep").alias(f"r{c}"))
    named = cut(links.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    whole = connected_components(named)
    n_links = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of = reps.join(whole.join(n_links, "node").withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select(F.col("cls").alias("_cls"), "rep", F.coalesce("component", "rep").alias("grp"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return members.join(of, F.col("cls") == F.col("_cls")).select(ident, F.col("rep").alias("cls"), "grp", "n_links")
