"""Reports as columns of text: traceability matrix, CSV, Markdown, JSON, YAML and the response letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T

# Columns of the matrix with their titles, marks of evidence, and names of statuses.
COLUMNS = (
    ("ID", "id"), ("Reviewer", "reviewer"), ("Comment", "comment"), ("Anchored Context", "anchored_context"), ("Requested Action", "requested_action"), ("Status", "status"), ("Confidence", "confidence"),
    ("Evidence", "evidence"), ("Revised Location", "revised_location"), ("Remaining Issue", "remaining_issue"), ("Reviewer Marked Resolved", "reviewer_marked_resolved"), ("Document Changed", "document_changed"),
    ("Assessment Source", "assessment_source"), ("Method", "method"), ("Needs Human Review", "needs_human_review"),
)
MARKS = {"SUPPORTS": "+", "CONTRADICTS": "-", "CONTEXT": "·"}
MOST_EVIDENCE, MOST_PLACES = 4, 3


def evidence_cell(evidence: Column, most: int = MOST_EVIDENCE) -> Column:
    """K3a. The first lines of evidence that says something, else of all; evidence is array<struct<direction, explanation>>."""
    telling = F.filter(evidence, lambda e: e["direction"] != "CONTEXT")
    chosen = F.when(F.size(telling) > 0, telling).otherwise(evidence)
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    lines = F.transform(F.slice(chosen, 1, most), lambda e: F.concat(mark[e["direction"]], F.lit(" "), e["explanation"]))
    more = F.when(F.size(chosen) > most, F.array(F.concat(F.lit("(+"), (F.size(chosen) - most).cast("string"), F.lit(" more)")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.coalesce(F.array_join(F.concat(lines, more), "\n"), F.lit(""))


def location_cell(labels: Column, most: int = MOST_PLACES) -> Column:
    """K3b. The first different places; labels is array<string>."""
    return F.coalesce(F.array_join(F.slice(F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != "unlocated"))), 1, most), "; "), F.lit(""))


def anchor_cell(anchor: Column, place: Column) -> Column:
    """K3c. The anchor in quotes, with its place."""
    where = F.when(place != "unlocated", place)
    quoted = F.when(F.length(anchor) > 0, F.concat(F.lit('"'), T.truncate(anchor, 200), F.lit('"')))
    return F.coalesce(F.when(quoted.isNotNull() & where.isNotNull(), F.concat(quoted, F.lit(" ("), where, F.lit(")"))), quoted, where, F.lit(""))


def status_label(status: Column) -> Column:
    """A status in words: RESOLVED as Resolved."""
    low = F.lower(F.replace(status, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 100))


def _three(flag: Column, unknown: str) -> Column:
    return F.when(flag.isNull(), unknown).when(flag, "yes").otherwise("no")


def build_matrix(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """K3. One row for each request with a finding, then one for each of its parts, with pair_id, issue_no, sub_no for the order.

    `issues` has pair_id, issue_no, issue_id, reviewer, anchor_text, place; `findings`
    pair_id, issue_id, sub_no (0 for the whole), text, category, action, status,
    confidence, evidence, labels, remaining, resolved_flag, document_changed, source,
    method, needs_person. Requests without a finding are left out; unknown flags stay unknown.
    """
    x = issues.join(findings, ["pair_id", "issue_id"])
    ident = F.when(F.col("sub_no") > 0, F.concat("issue_id", F.lit("."), F.col("sub_no").cast("string"))).otherwise(F.col("issue_id"))
    action = F.when(F.length("action") > 0, F.concat("category", F.lit(": "), "action")).otherwise(F.col("category"))
    return x.select(
        "pair_id", "issue_no", "sub_no", ident.alias("id"), F.coalesce("reviewer", F.lit("")).alias("reviewer"), F.col("text").alias("comment"), anchor_cell(F.col("anchor_text"), F.col("place")).alias("anchored_context"), action.alias("requested_action"),
        status_label(F.col("status")).alias("status"), "confidence", evidence_cell(F.col("evidence")).alias("evidence"), location_cell(F.col("labels")).alias("revised_location"), F.coalesce("remaining", F.lit("")).alias("remaining_issue"),
        _three(F.col("resolved_flag"), "n/a").alias("reviewer_marked_resolved"), _three(F.col("document_changed"), "unknown").alias("document_changed"), F.col("source").alias("assessment_source"), "method", _three(F.col("needs_person"), "unknown").alias("needs_human_review"),
    )


def csv_matrix(matrix: DataFrame) -> DataFrame:
    """K4. The matrix as it goes into CSV: titled columns in order, no cell a spreadsheet takes for a formula."""
    order = [F.col("pair_id"), F.col("issue_no"), F.col("sub_no")]
    return matrix.select(*order, *[T.safe_cell(F.col(c)).alias(title) for title, c in COLUMNS])


def write_csv(matrix: DataFrame, path: str) -> None:
    """K4. Write the matrix as CSV, every cell quoted, one folder for each pair."""
    csv_matrix(matrix).repartition("pair_id").sortWithinPartitions("pair_id", "issue_no", "sub_no").drop("issue_no", "sub_no").write.mode("errorifexists").partitionBy("pair_id").csv(path, header=True, quoteAll=True, escape='"')


def markdown_matrix(matrix: DataFrame) -> DataFrame:
    """K5. pair_id, issue_no, sub_no, line: the matrix as lines of a Markdown table."""
    cell = lambda c: F.regexp_replace(T.md_escape(T.truncate(F.col(c), 220)), "\n", "<br>")
    return matrix.select("pair_id", "issue_no", "sub_no", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for _, c in COLUMNS[:10]]), F.lit(" |")).alias("line"))


def finding_sections(matrix: DataFrame) -> DataFrame:
    """K6. pair_id, issue_no, section: a Markdown section for each request, its evidence as list."""
    quote = F.array_join(F.transform(F.split("comment", "\n"), lambda x: F.concat(F.lit("> "), T.md_escape(x))), "\n")
    evidence = F.array_join(F.transform(F.split("evidence", "\n"), lambda x: F.concat(F.lit("- "), T.md_escape(x))), "\n")
    return matrix.filter("sub_no = 0").select(
        "pair_id", "issue_no", F.concat_ws("\n\n", F.concat(F.lit("### "), "id", F.lit(" — "), "status", F.lit(" (confidence: "), "confidence", F.lit(")")), F.when(F.col("reviewer") != "", F.concat(F.lit("**Reviewer:** "), T.md_escape(F.col("reviewer")))), F.lit("**Comment**"), quote, F.when(F.col("evidence") != "", F.concat(F.lit("**Evidence**\n\n"), evidence))).alias("section")
    )


def response_letter(matrix: DataFrame) -> DataFrame:
    """K7. pair_id, issue_no, block, caveat: the letter request by request; only a resolved request is called addressed.

    A reviewer is named above a request where it differs from the one before, if the pair
    has several. `caveat` marks what the author must check.
    """
    order = Window.partitionBy("pair_id").orderBy("issue_no")
    several = matrix.groupBy("pair_id").agg((F.count_distinct(F.when(F.col("reviewer") != "", F.col("reviewer"))) > 1).alias("several"))
    x = matrix.filter("sub_no = 0").withColumn("before", F.lag("reviewer").over(order)).join(several, "pair_id")
    heading = F.when(F.col("several") & ~F.col("reviewer").eqNullSafe(F.col("before")), F.concat(F.lit("## "), F.when(F.col("reviewer") == "", "Reviewer").otherwise(T.md_escape(F.col("reviewer")))))
    answer = F.when(F.col("status") == "Resolved", "Addressed.").when(F.col("status") == "Partially resolved", "Addressed in part; more remains to be done.").when(F.col("status") == "Unresolved", "Not addressed yet.").otherwise("Open: the author has to say how this was handled.")
    rest = F.when((F.col("remaining_issue") != "") & (F.col("status") != "Resolved"), F.concat(F.lit("**Left to do:** "), T.md_escape(F.col("remaining_issue"))))
    block = F.concat_ws("\n\n", heading, F.concat(F.lit("### Comment "), F.col("issue_no").cast("string")), F.concat(F.lit("<!-- "), "id", F.lit(" -->")), T.md_escape(F.col("comment")), F.concat(F.lit("**Response:** "), answer), rest)
    return x.select("pair_id", "issue_no", block.alias("block"), ((F.col("status") != "Resolved") | (F.col("needs_human_review") != "no")).alias("caveat"))


def json_matrix(matrix: DataFrame) -> DataFrame:
    """K1, K2. pair_id, issue_no, sub_no, json: the rows as JSON objects."""
    return matrix.select("pair_id", "issue_no", "sub_no", F.to_json(F.struct(*[F.col(c) for _, c in COLUMNS])).alias("json"))


def issues_yaml(rows: list) -> str:
    """K9. A request file for people from collected rows of one pair."""
    import yaml

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
    out = []
    for r in rows:
        place = {k: v for k, v in (("section", r["section"]), ("paragraph", r["paragraph_start"]), ("paragraph_end", r["paragraph_end"]), ("table", None if r["table_index"] is None else r["table_index"] + 1)) if v}
        entry = {"id": r["id"], "reviewer": r["reviewer"], "date": r["date"], "comment": r["comment_text"], "anchor": r["anchor_text"], "location": place, "category": r["category"], "severity": r["severity"], "source_id": r["source_id"], "parts": list(r["parts"] or []) if len(r["parts"] or []) > 1 else None, "word_comment_resolved": r["word_comment_resolved"]}
        out.append({k: v for k, v in entry.items() if v is not None and v != "" and v != {}})
    return yaml.dump({"version": 1, "issues": out}, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=100)


def show(df: DataFrame, rows: int = 40) -> str:
    """K8. The first rows as a table for a terminal."""
    head = df.limit(rows).collect()
    lines = [[str(c) for c in df.columns]] + [["" if v is None else str(v).replace("\n", " ") for v in r] for r in head]
    widths = [min(40, max(len(x[k]) for x in lines)) for k in range(len(df.columns))]
    return "\n".join("  ".join(v[:w].ljust(w) for v, w in zip(x, widths)).rstrip() for x in lines)
