"""Roll-ups of findings: counts, coverage, compound requests, confidence, and the policy for outside assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses and confidences in display order; the decided ones; ranks of rules and places.
STATUSES = ("RESOLVED", "PARTIALLY_RESOLVED", "UNRESOLVED", "NEEDS_REVIEW", "NOT_ASSESSABLE", "ERROR")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
DECIDED = ("RESOLVED", "PARTIALLY_RESOLVED", "UNRESOLVED")
STRUCTURAL, LEXICAL, DETERMINISTIC = 1, 2, 3
NONE, SECTION, FUZZY, EXACT = 0, 1, 2, 3


def value_counts(df: DataFrame, column: str, domain: tuple[str, ...], keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keys, ord, value, n: how often each value of a closed domain stands, in its order, zeros included (A3)."""
    table = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(v).alias("value")) for k, v in enumerate(domain)])
    every = df.select(*keys).distinct().select(*keys, F.inline(table))
    return every.join(df.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), [*keys, "value"], "left").select(*keys, "ord", "value", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(findings: DataFrame) -> DataFrame:
    """pair_id, items, decided, undecided, reasons (map), share, sentence.

    `findings` has pair_id, status, category. Undecided findings are grouped by status,
    those that cannot be assessed also by category; the sentence lists the most frequent
    reasons first. A pair without findings has no row.
    """
    reason = F.when(F.col("status") == "NOT_ASSESSABLE", F.concat_ws("_", F.lit("not_assessable"), F.lower("category"))).when(~F.col("status").isin(*DECIDED), F.lower("status"))
    by = findings.groupBy("pair_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    x = by.groupBy("pair_id").agg(F.sum("n").alias("items"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("decided"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("why"))
    x = x.withColumn("undecided", F.col("items") - F.col("decided"))
    ordered = F.array_sort(F.transform("why", lambda w: F.struct((-w["n"]).alias("k"), w["reason"].alias("reason"))))
    said = F.concat_ws(", ", F.transform(ordered, lambda w: F.concat(w["reason"], F.lit(" "), (-w["k"]).cast("string"))))
    text = F.concat(F.lit("decided "), F.col("decided").cast("string"), F.lit(" of "), F.col("items").cast("string"), F.lit(" comments"))
    sentence = F.when(F.col("undecided") > 0, F.concat(text, F.lit("; "), F.col("undecided").cast("string"), F.lit(" could not be checked ("), said, F.lit(")"))).otherwise(text)
    return x.select("pair_id", "items", "decided", "undecided", F.map_from_entries("why").alias("reasons"), decided_share(F.col("decided"), F.col("items")).alias("share"), sentence.alias("sentence"))


def decided_share(decided: Column, items: Column) -> Column:
    """Per cent decided, to one place, half to even; null without items (A5)."""
    return F.when(items > 0, F.bround(100 * decided / items, 1))


def confidence(strength: Column, quality: Column) -> Column:
    """How sure a rule is, by its strength and how well its place is known."""
    return (
        F.when((strength == DETERMINISTIC) & (quality >= SECTION), "HIGH")
        .when(strength == DETERMINISTIC, "MEDIUM")
        .when((strength == LEXICAL) & (quality >= SECTION), "MEDIUM")
        .when((strength == STRUCTURAL) & (quality >= FUZZY), "MEDIUM")
        .otherwise("LOW")
    )


def needs_person(status: Column, sure: Column) -> Column:
    """False only for a resolved or unresolved finding of high confidence."""
    return ~(status.isin("RESOLVED", "UNRESOLVED") & (sure == "HIGH"))


def roll_up_parts(parts: DataFrame) -> DataFrame:
    """pair_id, issue_id, status, confidence, needs_person, n_parts, n_resolved of compound requests.

    `parts` has pair_id, issue_id, status, confidence. The confidence is that of the
    weakest part; a resolved whole of low confidence needs review.
    """
    is_ = lambda *v: F.col("status").isin(*v)
    rank = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    x = parts.groupBy("pair_id", "issue_id").agg(
        F.bool_or(is_("ERROR")).alias("e"), F.bool_and(is_("RESOLVED")).alias("r"), F.bool_and(is_("NOT_ASSESSABLE")).alias("n"), F.bool_and(is_("UNRESOLVED")).alias("u"),
        F.bool_or(is_("RESOLVED", "PARTIALLY_RESOLVED")).alias("some"), F.bool_or(is_("UNRESOLVED", "PARTIALLY_RESOLVED")).alias("rest"),
        F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n_parts"), F.count_if(is_("RESOLVED")).alias("n_resolved"),
    )
    status = F.when(F.col("e"), "ERROR").when(F.col("r") & (F.col("rank") > 0), "RESOLVED").when(F.col("r"), "NEEDS_REVIEW").when(F.col("n"), "NOT_ASSESSABLE").when(F.col("u"), "UNRESOLVED").when(F.col("some") & F.col("rest"), "PARTIALLY_RESOLVED").otherwise("NEEDS_REVIEW")
    sure = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("rank") + 1)
    return x.select("pair_id", "issue_id", status.alias("status"), sure.alias("confidence"), needs_person(status, sure).alias("needs_person"), "n_parts", "n_resolved")


def merge_assessments(findings: DataFrame, assessments: DataFrame) -> DataFrame:
    """The findings after outside assessments, with `source`.

    `findings` has pair_id, issue_id, status, confidence, n_evidence; `assessments`
    pair_id, issue_id, verdict, verdict_confidence, refs (1-based evidence numbers). Only
    findings that need review, or cannot be assessed but have evidence, are touched. A
    verdict whose references do not exist, and a resolved one of low confidence, become
    NEEDS_REVIEW; confidence is at most MEDIUM.
    """
    x = findings.join(assessments, ["pair_id", "issue_id"], "left")
    open_ = (F.col("status") == "NEEDS_REVIEW") | ((F.col("status") == "NOT_ASSESSABLE") & (F.col("n_evidence") > 0))
    use = open_ & F.col("verdict").isNotNull()
    cited = F.coalesce(F.size(F.filter("refs", lambda r: (r >= 1) & (r <= F.col("n_evidence")))) > 0, F.lit(False))
    verdict = F.when(F.col("verdict").isin(*DECIDED) & ~cited, "NEEDS_REVIEW").when((F.col("verdict") == "RESOLVED") & (F.col("verdict_confidence") == "LOW"), "NEEDS_REVIEW").otherwise(F.col("verdict"))
    sure = F.when(F.col("verdict_confidence") == "LOW", "LOW").otherwise("MEDIUM")
    return x.select("pair_id", "issue_id", F.when(use, verdict).otherwise(F.col("status")).alias("status"), F.when(use, sure).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "semantic").otherwise("deterministic").alias("source"))


def fails(findings: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """pair_id, failed: whether any finding has one of the statuses."""
    return findings.groupBy("pair_id").agg(F.bool_or(F.col("status").isin(*statuses)).alias("failed"))
