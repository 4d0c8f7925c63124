"""Queries on the understanding of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import facts as A
from quirewise.operators import requests as Q
from quirewise.plans.texts import _norm
from quirewise.session import cut
from quirewise.sources.tables import records


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "issues", "pair_id", "id", "comment_text", "anchor_text", "anchor_location", "category", "severity")


def request_classification(spark: SparkSession, folder: str) -> DataFrame:
    """R1-R4."""
    x = Q.classify(_issues(spark, folder).drop("category"), "comment_text")
    t = F.col("comment_text")
    return x.select("issue_key", "category", F.array_join("secondary", "|").alias("secondary"), "actionable", "subjective", Q.detect_severity(t).alias("severity"), Q.requested_action(t).alias("action"))


def request_parse(spark: SparkSession, folder: str) -> DataFrame:
    """R7."""
    x = Q.parse_request(_issues(spark, folder), "comment_text")
    joined = [F.array_join(c, "|").alias(c) for c in ("phrases", "numbers", "table_refs", "figure_refs", "section_refs", "terms")]
    ints = [F.array_join(F.transform(c, lambda v: v.cast("string")), "|").alias(c) for c in ("paragraph_refs", "page_refs")]
    pairs = [F.concat_ws("->", F.col(f"{c}.old"), F.col(f"{c}.new")).alias(c) for c in ("replace_pair", "numeric_correction")]
    return x.select("issue_key", *joined, *ints, *pairs, "min_count", "since_year", "until_year", "destination_section", "style_name")


def compound_split(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements of all requests."""
    x = _issues(spark, folder).select("pair_id", "id", "comment_text", "anchor_text", F.col("anchor_location.section_id").alias("section"), F.col("anchor_location.paragraph_start").alias("paragraph_start"), F.col("anchor_location.table_index").alias("table_index"), "severity", F.lit(None).cast("string").alias("category"))
    return Q.requirements(cut(Q.build_issues(x)))


def concept_labels(spark: SparkSession, folder: str) -> DataFrame:
    """R7d."""
    x = _issues(spark, folder).withColumn("c", Q.concepts(F.col("comment_text")))
    return x.filter(F.size("c") > 0).select("issue_key", F.array_join("c", "|").alias("concepts"))


def prose_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of reports that read as requests, and how many do not."""
    s = spark.read.parquet(f"{folder}/documents.parquet").filter("source in ('review_report', 'client_feedback')").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(Q.looks_like_request(F.col("s"))).alias("requests"), F.count_if(~Q.looks_like_request(F.col("s"))).alias("ignored"))


def similar_issues(spark: SparkSession, folder: str) -> DataFrame:
    """J9."""
    return Q.similar_issues(_issues(spark, folder))


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A17."""
    return A.duplicate_groups(records(spark, folder, "paragraphs", "pair_id", "side", "text"))


QUERIES = {f.__name__: f for f in (similar_issues, duplicate_groups, request_classification, request_parse, compound_split, concept_labels, prose_requests)}

SQL: dict[str, str] = {
    "duplicate_groups": f"""
WITH p AS (SELECT DISTINCT para_id, pair_id, side, {_norm("text")} AS n FROM paragraphs)
SELECT pair_id, sha256(n) AS norm_id, count(*) FILTER (side = 'original') AS before, count(*) FILTER (side = 'revised') AS after FROM p WHERE n <> '' GROUP BY pair_id, n HAVING count(*) FILTER (side = 'original') >= 2""",
}
