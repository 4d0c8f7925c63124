"""Entry points for files: what a person calls for one pair of documents or for folders of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import guard as G
from quirewise.operators import requests as Q
from quirewise.operators import revision as R
from quirewise.operators import tables as B
from quirewise.session import cut
from quirewise.sources import docx as D
from quirewise.sources import reports as P
from quirewise.sources.files import check_docx


@dataclass
class Comparison:
    """The parts of a comparison, as DataFrames keyed by pair_id."""

    sections: DataFrame
    paragraphs: DataFrame
    tables: DataFrame
    cells: DataFrame
    references: DataFrame
    summary: DataFrame


def _entities(spark: SparkSession, pairs: list[tuple[str, str, str]], comments: bool = False) -> dict[str, DataFrame]:
    """Typed entities of the files of all pairs (pair_id, original, revised), keyed by pair_id and side."""
    for _, o, r in pairs:
        check_docx(o)
        check_docx(r)
    files = spark.createDataFrame([(p, s, f) for p, o, r in pairs for s, f in (("original", o), ("revised", r))], "pair_id string, side string, file string")
    paths = sorted({f for _, o, r in pairs for f in (o, r)})
    rows = D.read_docx(spark, paths if len(paths) > 1 else paths[0], comments=comments)
    key = rows.withColumn("file", F.regexp_replace("path", "^file:/*", "/"))
    known = cut(key.join(files.withColumn("file", F.regexp_replace("file", "^/*", "/")), "file").drop("file"))
    return {name: known.filter(F.col("entity") == name).select("pair_id", "side", "path", "ord", F.from_json("payload", schema).alias("x")).select("pair_id", "side", "path", "ord", "x.*") for name, schema in D.ENTITIES.items()}


def compare_documents(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> Comparison:
    """Sections, paragraphs, tables and references that changed between the files of each pair (pair_id, original, revised)."""
    e = _entities(spark, pairs)
    p = cut(e["paragraphs"].drop("path", "ord"))
    m = cut(R.match_sections(R.section_tree(p), p))
    c = cut(R.match_paragraphs(p, m))
    tables = e["tables"].withColumnRenamed("index", "table_index")
    cells = cut(e["cells"].select("pair_id", "side", "table_index", "row", "col", "text"))
    changed, tab = B.compare_tables(cells, B.pair_tables(cells, tables.select("pair_id", "side", "table_index", "caption", "label", "section_id")))
    refs = B.compare_references(e["refs"].select("pair_id", "side", "index", "raw"))
    return Comparison(m, R.describe_changes(c, p), tab, changed, refs, R.change_summary(c, m))


def guard_revision(spark: SparkSession, pairs: list[tuple[str, str, str]], protected: tuple[str, ...] = ()) -> DataFrame:
    """Findings of unrequested changes in each pair."""
    e = _entities(spark, pairs)
    return G.guard_report(G.document_blocks(e["paragraphs"], e["cells"], e["notes"]), protected)


def extract_comments(spark: SparkSession, path: str) -> DataFrame:
    """The comments of a Word file, or of all in a folder, with their anchors and threads."""
    return D.entity(D.read_docx(spark, path), "comments")


def extract_issues(spark: SparkSession, path: str, kind: str = "report") -> DataFrame:
    """Requests of a source in one form; kind is `comments`, `report` or `issues`."""
    none = lambda t: F.lit(None).cast(t)
    if kind == "comments":
        c = extract_comments(spark, path).select(F.col("path").alias("pair_id"), "id", "parent_id", F.col("author").alias("reviewer"), F.col("text").alias("comment_text"), "anchor_text", F.col("anchor.section").alias("section"), F.col("anchor.paragraph_start").alias("paragraph_start"), F.col("anchor.table_index").alias("table_index"))
        x = Q.comment_issues(c).withColumns({"severity": none("string"), "category": none("string")})
    elif kind == "report":
        r = P.report_requests(P.read_reports(spark, path))
        x = r.withColumnRenamed("report_id", "pair_id").withColumns({"anchor_text": F.lit(""), "paragraph_start": none("int"), "table_index": none("int"), "category": none("string")})
    elif kind == "issues":
        x = P.read_issues(spark, path).withColumnRenamed("path", "pair_id")
        return Q.build_issues(x.withColumnRenamed("parts", "given_parts"))
    else:
        raise ValueError("kind must be comments, report or issues")
    return Q.build_issues(x, infer_anchor=kind == "report")
