"""Queries on facts, roll-ups and rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import facts as A
from quirewise.operators import locate as L
from quirewise.operators import revision as R
from quirewise.operators import rollups as U
from quirewise.plans.places import _requests
from quirewise.plans.revisions import _paragraphs
from quirewise.session import cut, kept
from quirewise.sources import sinks as K
from quirewise.sources.tables import records


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in findings: a status read off the flags that the requests themselves carry, for the roll-ups to work on."""
    i = records(spark, folder, "issues", "pair_id", "id", "category", "severity", "actionable", "subjective", "word_comment_resolved")
    status = F.when(~F.col("actionable"), "NOT_ASSESSABLE").when(F.col("subjective"), "NEEDS_REVIEW").when(F.col("word_comment_resolved"), "RESOLVED").when(F.col("severity") == "major", "UNRESOLVED").when(F.col("severity") == "minor", "PARTIALLY_RESOLVED").otherwise("NEEDS_REVIEW")
    sure = U.confidence(F.when(F.col("severity") == "major", 3).when(F.col("severity") == "minor", 2).otherwise(1), F.when(F.col("category") == "OTHER", 0).when(F.col("category") == "ADD", 1).otherwise(2))
    return i.select("pair_id", F.col("id").alias("issue_id"), "category", status.alias("status"), sure.alias("confidence"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A3, V13."""
    f = _findings(spark, folder)
    return U.value_counts(f, "status", U.STATUSES).unionByName(U.value_counts(f, "confidence", U.CONFIDENCES))


def coverage_block(spark: SparkSession, folder: str) -> DataFrame:
    """A4-A6."""
    c = U.coverage(_findings(spark, folder))
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return c.select("pair_id", "items", "decided", "undecided", "share", "sentence", reasons.alias("reasons"))


def compound_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of one category in a pair, taken as parts of one."""
    return U.roll_up_parts(_findings(spark, folder).withColumn("issue_id", F.col("category")))


def value_facts(spark: SparkSession, folder: str) -> DataFrame:
    """P9, P10, V2 facts: the two numbers of 'shows A, whereas ... shows B' counted in the place of the request, or in the whole document."""
    p = _paragraphs(spark, folder)
    s = cut(R.section_tree(p))
    m = cut(R.match_sections(s, p))
    x = kept(_requests(spark, folder).select(*L.ASKED, "comment_text", "replace_pair", "numeric_correction"))
    t = cut(L.locate_targets(x, p, s, records(spark, folder, "cells")))
    pattern = r"shows (\d+), whereas .*? shows (\d+)"
    pair = F.struct(F.regexp_extract("comment_text", pattern, 1).alias("old"), F.regexp_extract("comment_text", pattern, 2).alias("new"))
    asked = x.select("pair_id", "issue_id", "comment_text", "replace_pair", "numeric_correction").withColumn("numeric_correction", F.coalesce("numeric_correction", F.when(F.col("comment_text").rlike(pattern), pair)))
    # Only requests that name a value, before texts meet them.
    asked = kept(asked.filter("numeric_correction is not null or replace_pair is not null"))
    anywhere = asked.join(L.unlocated(x, t), ["pair_id", "issue_id"], "left_semi")
    located = cut(t.join(asked.select("pair_id", "issue_id"), ["pair_id", "issue_id"], "left_semi"))
    # Values are counted once for each section; requests meet counts, not texts.
    counts = A.value_counts(kept(A._asked(asked)), p, ("section_id",))
    return A.place_value_facts(asked, A.scope_sections(located, m, R.ancestors(s)), p, counts).unionByName(A.whole_value_facts(anywhere, p, counts))


def tracked_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """J18, W9."""
    p = _paragraphs(spark, folder)
    x = kept(_requests(spark, folder).select(*L.ASKED))
    s = cut(R.section_tree(p))
    t = cut(L.locate_targets(x, p, s, records(spark, folder, "cells")))
    scopes = cut(L.revised_scope(t, cut(R.match_sections(s, p)), R.ancestors(s)))
    return A.tracked_evidence(x, scopes, L.unlocated(x, t), records(spark, folder, "tracked", "pair_id", "side", "section_id", "ord", "kind", "story", "text"))


def traceability_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """K3-K7: the matrix of stand-in findings, its CSV row, Markdown line, JSON and letter."""
    i = records(spark, folder, "issues", "pair_id", "id", "reviewer", "comment_text", "anchor_text", "anchor_location", "word_comment_resolved")
    a = F.col("anchor_location")
    place = T.location_label(a["section_id"], a["table_index"], F.lit(None), F.lit(None), a["paragraph_start"], a["paragraph_end"], F.lit(None))
    issues = i.select("pair_id", F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("issue_no"), F.col("id").alias("issue_id"), "reviewer", "anchor_text", place.alias("place"))
    kind = F.array(F.struct(F.lit("CONTEXT").alias("direction"), F.lit("located").alias("explanation")), F.struct(F.when(F.col("status") == "RESOLVED", "SUPPORTS").otherwise("CONTRADICTS").alias("direction"), F.concat(F.lit("status "), "status").alias("explanation")))
    f = _findings(spark, folder).join(i.select("pair_id", F.col("id").alias("issue_id"), F.col("comment_text").alias("text"), F.col("word_comment_resolved").alias("resolved_flag")), ["pair_id", "issue_id"])
    f = f.select("pair_id", "issue_id", F.lit(0).alias("sub_no"), "text", "category", T.truncate(F.col("text"), 80).alias("action"), "status", "confidence", kind.alias("evidence"), F.array(F.lit("unlocated"), F.lit("Section 1")).alias("labels"), F.lit(None).cast("string").alias("remaining"), "resolved_flag", F.lit(None).cast("boolean").alias("document_changed"), F.lit("deterministic").alias("source"), F.lit("stand-in").alias("method"), U.needs_person(F.col("status"), F.col("confidence")).alias("needs_person"))
    m = cut(K.build_matrix(issues, f))
    keys = ["pair_id", "issue_no", "sub_no"]
    return K.csv_matrix(m).join(K.markdown_matrix(m), keys).join(K.json_matrix(m), keys).join(K.response_letter(m), ["pair_id", "issue_no"]).select("pair_id", "issue_no", F.col("ID").alias("id"), F.col("Evidence").alias("evidence"), F.col("Anchored Context").alias("context"), "line", "json", "block", "caveat")


QUERIES = {f.__name__: f for f in (status_counts, coverage_block, compound_rollup, value_facts, tracked_evidence, traceability_matrix)}

_F = """f AS (SELECT pair_id, issue_id, category, status, CASE WHEN s = 3 AND q >= 1 THEN 'HIGH' WHEN s = 3 THEN 'MEDIUM' WHEN s = 2 AND q >= 1 THEN 'MEDIUM' WHEN s = 1 AND q >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
  SELECT DISTINCT issue_key, pair_id, id AS issue_id, category, CASE WHEN NOT actionable THEN 'NOT_ASSESSABLE' WHEN subjective THEN 'NEEDS_REVIEW' WHEN word_comment_resolved THEN 'RESOLVED' WHEN severity = 'major' THEN 'UNRESOLVED' WHEN severity = 'minor' THEN 'PARTIALLY_RESOLVED' ELSE 'NEEDS_REVIEW' END AS status,
    CASE severity WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END AS s, CASE category WHEN 'OTHER' THEN 0 WHEN 'ADD' THEN 1 ELSE 2 END AS q FROM issues))"""
_DOMAIN = lambda values: "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(values)) + ")"

SQL = {
    "status_counts": f"""WITH {_F}, p AS (SELECT DISTINCT pair_id FROM f)
SELECT p.pair_id, d.ord, d.value, count(f.pair_id) AS n FROM p CROSS JOIN {_DOMAIN(U.STATUSES)} d(ord, value) LEFT JOIN f ON f.pair_id = p.pair_id AND f.status = d.value GROUP BY ALL
UNION ALL SELECT p.pair_id, d.ord, d.value, count(f.pair_id) FROM p CROSS JOIN {_DOMAIN(U.CONFIDENCES)} d(ord, value) LEFT JOIN f ON f.pair_id = p.pair_id AND f.confidence = d.value GROUP BY ALL""",
    "coverage_block": f"""WITH {_F},
r AS (SELECT pair_id, CASE WHEN status = 'NOT_ASSESSABLE' THEN 'not_assessable_' || lower(category) WHEN status NOT IN ('RESOLVED', 'PARTIALLY_RESOLVED', 'UNRESOLVED') THEN lower(status) END AS reason, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT pair_id, CAST(sum(n) AS BIGINT) AS items, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS decided, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS reasons,
  string_agg(reason || ' ' || n, ', ' ORDER BY n DESC, reason) FILTER (reason IS NOT NULL) AS why FROM r GROUP BY pair_id)
SELECT pair_id, items, decided, items - decided AS undecided, round_even(100.0 * decided / items, 1) AS share, 'decided ' || decided || ' of ' || items || ' comments' || CASE WHEN items > decided THEN '; ' || (items - decided) || ' could not be checked (' || why || ')' ELSE '' END AS sentence, reasons FROM x""",
    "compound_rollup": f"""WITH {_F},
g AS (SELECT pair_id, category AS issue_id, bool_or(status = 'ERROR') AS e, bool_and(status = 'RESOLVED') AS r, bool_and(status = 'NOT_ASSESSABLE') AS n, bool_and(status = 'UNRESOLVED') AS u, bool_or(status IN ('RESOLVED', 'PARTIALLY_RESOLVED')) AS s, bool_or(status IN ('UNRESOLVED', 'PARTIALLY_RESOLVED')) AS t,
  min(CASE confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS k, count(*) AS n_parts, count(*) FILTER (status = 'RESOLVED') AS n_resolved FROM f GROUP BY ALL),
h AS (SELECT *, CASE WHEN e THEN 'ERROR' WHEN r AND k > 0 THEN 'RESOLVED' WHEN r THEN 'NEEDS_REVIEW' WHEN n THEN 'NOT_ASSESSABLE' WHEN u THEN 'UNRESOLVED' WHEN s AND t THEN 'PARTIALLY_RESOLVED' ELSE 'NEEDS_REVIEW' END AS status, ['LOW', 'MEDIUM', 'HIGH'][k + 1] AS confidence FROM g)
SELECT pair_id, issue_id, status, confidence, NOT (status IN ('RESOLVED', 'UNRESOLVED') AND confidence = 'HIGH') AS needs_person, n_parts, n_resolved FROM h""",
}
