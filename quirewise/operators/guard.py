"""The reverse check: numbers, hedges, protected wording and tables that changed though nobody asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions import text as T

# Words that soften a claim; the month May counts too.
HEDGES = ("may", "might", "could", "suggests", "suggest", "appears", "potentially", "possibly", "likely", "non-significant", "not significant")
# Fixed value: a number, with sign, thousands commas, decimals and per cent sign.
NUMBER = r"(?<![\p{L}\p{N}_.])[+-]?\d[\d,]*(?:\.\d+)?\s?%?"


def document_blocks(paragraphs: DataFrame, cells: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """pair_id, side, kind, a, b, text: all text of each document, block by block (G1a): paragraphs, table rows, notes."""
    out = paragraphs.select("pair_id", "side", F.lit("p").alias("kind"), F.col("number").alias("a"), F.lit(0).alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    if cells is not None:
        row = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
        rows = cells.groupBy("pair_id", "side", "table_index", "row").agg(F.array_join(row, " | ").alias("text"))
        out = out.unionByName(rows.select("pair_id", "side", F.lit("t").alias("kind"), F.col("table_index").alias("a"), F.col("row").alias("b"), "text"))
    if notes is not None:
        out = out.unionByName(notes.select("pair_id", "side", F.lit("n").alias("kind"), F.col("ord").alias("a"), F.lit(0).alias("b"), F.coalesce("text", F.lit("")).alias("text")))
    return out


def _sides(df: DataFrame, *keys: str) -> DataFrame:
    """Counts before and after, of rows with a column n."""
    n = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    return df.groupBy("pair_id", *keys).agg(n("original").alias("before"), n("revised").alias("after"))


def number_changes(blocks: DataFrame) -> DataFrame:
    """pair_id, number, before, after: numbers that stand more often on one side."""
    found = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), T.guard_number)
    each = blocks.select("pair_id", "side", F.explode(found).alias("number")).groupBy("pair_id", "side", "number").agg(F.count(F.lit(1)).alias("n"))
    return _sides(each, "number").filter("before <> after")


def lexicon_counts(blocks: DataFrame, words: Sequence[str] = HEDGES) -> DataFrame:
    """pair_id, word, before, after: how often each word of a list stands, whatever its case."""
    bound = lambda w: F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_]){w.replace('-', '[-]')}(?![\p{{L}}\p{{N}}_])")
    counts = F.array(*[F.struct(F.lit(w).alias("word"), F.regexp_count("text", bound(w)).alias("n")) for w in words])
    return _sides(blocks.select("pair_id", "side", F.inline(counts)).groupBy("pair_id", "side", "word").agg(F.sum("n").alias("n")), "word")


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("int")


def protected_counts(blocks: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """pair_id, phrase, before, after, status: protected wording, blanks and case apart (A13). A phrase lies within one block."""
    if any(not p.strip() for p in phrases):
        raise ValueError("protected phrases must not be blank")
    flat = T.squash(F.col("text"))
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), phrase_count(flat, T.squash(F.lit(p))).alias("n")) for p in phrases])
    both = _sides(blocks.select("pair_id", "side", F.inline(counts)).groupBy("pair_id", "side", "phrase").agg(F.sum("n").alias("n")), "phrase")
    status = F.when(F.col("before") == 0, "INVALID_PROTECTION").when(F.col("after") == 0, "PROTECTED_REMOVED").when(F.col("after") != F.col("before"), "PROTECTED_CHANGED").otherwise("PROTECTED_INTACT")
    return both.withColumn("status", status)


def guard_report(blocks: DataFrame, phrases: Sequence[str] = (), hedges: Sequence[str] = HEDGES) -> DataFrame:
    """pair_id, status, item, before, after: all findings of each pair.

    NUMBERS_CHANGED counts the numbers lost and gained; TABLE_CHANGED the table rows
    that differ. A pair whose texts are equal is UNCHANGED; one with other changes but
    no finding except intact protection NEEDS_REVIEW.
    """
    parts = []
    if phrases:
        parts.append(protected_counts(blocks, phrases).select("pair_id", "status", F.col("phrase").alias("item"), "before", "after"))
    loss, gain = F.greatest(F.col("before") - F.col("after"), F.lit(0)), F.greatest(F.col("after") - F.col("before"), F.lit(0))
    item = F.lit(None).cast("string").alias("item")
    parts.append(number_changes(blocks).groupBy("pair_id").agg(F.sum(loss).alias("before"), F.sum(gain).alias("after")).select("pair_id", F.lit("NUMBERS_CHANGED").alias("status"), item, "before", "after"))
    parts.append(lexicon_counts(blocks, hedges).filter("before > after").select("pair_id", F.lit("HEDGE_REMOVED").alias("status"), F.col("word").alias("item"), "before", "after"))
    text = lambda s: F.max(F.when(F.col("side") == s, F.col("text")))
    same = blocks.groupBy("pair_id", "kind", "a", "b").agg(text("original").alias("o"), text("revised").alias("r")).withColumn("differs", ~F.col("o").eqNullSafe(F.col("r")))
    facts = same.groupBy("pair_id").agg(F.count_if("differs").alias("d"), F.count_if(F.col("differs") & (F.col("kind") == "t")).alias("t"))
    zero = F.lit(0).cast("bigint")
    parts.append(facts.filter("t > 0").select("pair_id", F.lit("TABLE_CHANGED").alias("status"), item, F.col("t").alias("before"), F.col("t").alias("after")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    loud = found.filter("status <> 'PROTECTED_INTACT'").select("pair_id").distinct().withColumn("loud", F.lit(True))
    rest = facts.join(loud, "pair_id", "left").select("pair_id", F.when(F.col("d") == 0, "UNCHANGED").when(F.col("loud").isNull(), "NEEDS_REVIEW").alias("status"), item, zero.alias("before"), zero.alias("after")).filter("status is not null")
    return found.unionByName(rest)


# Statuses that raise no flag.
QUIET = ("PROTECTED_INTACT", "UNCHANGED", "NEEDS_REVIEW")


def flagged(report: DataFrame) -> DataFrame:
    """pair_id, flagged: whether any finding of the pair raises a flag."""
    return report.groupBy("pair_id").agg(F.bool_or(~F.col("status").isin(*QUIET)).alias("flagged"))
