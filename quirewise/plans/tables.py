"""Queries on tables, reference lists and the guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import guard as G
from quirewise.operators import tables as B
from quirewise.plans.texts import _norm
from quirewise.session import cut
from quirewise.sources.tables import records

PHRASES = ("control arm", "upper terrace", "The Control  Arm, where")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "cells", "text")


def _tables(cells: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    return cells.select("pair_id", "side", "table_index").distinct().select("*", text.alias("caption"), text.alias("label"), F.lit("S0").alias("section_id"))


def _by_index(cells: DataFrame) -> DataFrame:
    sides = cells.groupBy("pair_id", "table_index").agg(F.bool_or(F.col("side") == "original").alias("o"), F.bool_or(F.col("side") == "revised").alias("r"))
    return sides.select("pair_id", F.when(F.col("o"), F.col("table_index")).alias("original_index"), F.when(F.col("r"), F.col("table_index")).alias("revised_index"))


def table_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """J3."""
    cells = cut(_cells(spark, folder))
    return B.pair_tables(cells, _tables(cells))


def table_cell_changes(spark: SparkSession, folder: str) -> DataFrame:
    """J4, tables paired by index."""
    cells = cut(_cells(spark, folder))
    return B.compare_tables(cells, _by_index(cells))[0]


def table_changes(spark: SparkSession, folder: str) -> DataFrame:
    """J4, L4, tables paired by content."""
    cells = cut(_cells(spark, folder))
    return B.compare_tables(cells, B.pair_tables(cells, _tables(cells)))[1].withColumn("description", B.describe_table_change())


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that cite a year in parentheses, taken as reference entries."""
    p = records(spark, folder, "paragraphs", "pair_id", "side", "number", "text").filter(F.col("text").rlike(r"\b(19|20)\d{2}\)"))
    return p.select("pair_id", "side", F.col("number").alias("index"), F.col("text").alias("raw"))


def reference_changes(spark: SparkSession, folder: str) -> DataFrame:
    """J5, A14."""
    return B.compare_references(_refs(spark, folder))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return G.document_blocks(records(spark, folder, "paragraphs", "pair_id", "side", "number", "text"), _cells(spark, folder))


def number_multiset_diff(spark: SparkSession, folder: str) -> DataFrame:
    """A11, U1, F24."""
    return G.number_changes(_blocks(spark, folder))


def lexicon_count_drop(spark: SparkSession, folder: str) -> DataFrame:
    """A12."""
    return G.lexicon_counts(_blocks(spark, folder)).filter("before > after")


def protected_phrase_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A13."""
    return G.protected_counts(_blocks(spark, folder), PHRASES)


def guard_report(spark: SparkSession, folder: str) -> DataFrame:
    """G1."""
    return G.guard_report(_blocks(spark, folder), PHRASES)


def guard_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """P16."""
    return G.flagged(G.guard_report(_blocks(spark, folder), PHRASES))


QUERIES = {f.__name__: f for f in (table_pairs, table_cell_changes, table_changes, reference_changes, number_multiset_diff, lexicon_count_drop, protected_phrase_counts, guard_report, guard_flagged)}

_BLOCKS = """
p AS (SELECT DISTINCT para_id, pair_id, side, number, text FROM paragraphs),
c AS (SELECT DISTINCT pair_id, side, table_index, "row" AS r, col AS k, coalesce(text, '') AS text FROM cells),
blocks AS (SELECT pair_id, side, 'p' AS kind, number AS a, 0 AS b, text FROM p
  UNION ALL SELECT pair_id, side, 't', table_index, r, string_agg(text, ' | ' ORDER BY k, text) FROM c GROUP BY ALL)
"""
_NUMBERS = r"""
x AS (SELECT pair_id, side, unnest(regexp_extract_all(replace(text, '%', '% '), '(^|[^\p{L}\p{N}_.])([+-]?\d[\d,]*(?:\.\d+)?(?:\s?%)?)', 2)) AS raw FROM blocks),
y AS (SELECT pair_id, side, regexp_replace(raw, '[,\s+]', '', 'g') AS b FROM x),
z AS (SELECT pair_id, side, regexp_replace(b, '%$', '') AS d, ends_with(b, '%') AS pc FROM y),
v AS (SELECT pair_id, side, pc, starts_with(d, '-') AS neg, regexp_replace(regexp_extract(d, '^-?(\d*)', 1), '^0+(\d)', '\1') AS w, regexp_replace(regexp_extract(d, '\.(\d*)$', 1), '0+$', '') AS f FROM z),
num AS (SELECT pair_id, (CASE WHEN neg AND NOT (regexp_full_match(w, '0*') AND f = '') THEN '-' ELSE '' END) || w || (CASE WHEN f = '' THEN '' ELSE '.' || f END) || (CASE WHEN pc THEN '%' ELSE '' END) AS number,
  CAST(count(*) FILTER (side = 'original') AS BIGINT) AS before, CAST(count(*) FILTER (side = 'revised') AS BIGINT) AS after FROM v GROUP BY ALL)
"""


def _lexicon() -> str:
    bound = r"[^\p{L}\p{N}_]"
    items = ", ".join(f"{{'word': '{w}', 'n': len(regexp_extract_all(t, '{bound}{w.replace(' ', '  ')}{bound}'))}}" for w in G.HEDGES)
    return f"""
lexrow AS (SELECT pair_id, side, unnest([{items}]) AS x FROM (SELECT pair_id, side, ' ' || regexp_replace(lower(text), '\\s', '  ', 'g') || ' ' AS t FROM blocks)),
lex AS (SELECT pair_id, x.word AS word, CAST(coalesce(sum(x.n) FILTER (side = 'original'), 0) AS BIGINT) AS before, CAST(coalesce(sum(x.n) FILTER (side = 'revised'), 0) AS BIGINT) AS after FROM lexrow GROUP BY ALL)
"""


def _protected() -> str:
    rows = ", ".join(f"('{p}', lower(trim(regexp_replace('{p}', '\\s+', ' ', 'g'))))" for p in PHRASES)
    return rf"""
prot AS (SELECT pair_id, phrase, CAST(coalesce(sum(n) FILTER (side = 'original'), 0) AS BIGINT) AS before, CAST(coalesce(sum(n) FILTER (side = 'revised'), 0) AS BIGINT) AS after FROM (
  SELECT pair_id, side, phrase, (length(t) - length(replace(t, flat, ''))) // length(flat) AS n
  FROM (SELECT pair_id, side, lower(trim(regexp_replace(text, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}]+', ' ', 'g'))) AS t FROM blocks), (VALUES {rows}) l(phrase, flat)) GROUP BY ALL)
"""


_STATUS = "CASE WHEN before = 0 THEN 'INVALID_PROTECTION' WHEN after = 0 THEN 'PROTECTED_REMOVED' WHEN after <> before THEN 'PROTECTED_CHANGED' ELSE 'PROTECTED_INTACT' END"
_GUARD = f"""WITH {_BLOCKS}, {_NUMBERS}, {_lexicon()}, {_protected()},
same AS (SELECT pair_id, kind, max(text) FILTER (side = 'original') IS DISTINCT FROM max(text) FILTER (side = 'revised') AS differs FROM blocks GROUP BY pair_id, kind, a, b),
facts AS (SELECT pair_id, count(*) FILTER (differs) AS d, count(*) FILTER (differs AND kind = 't') AS t FROM same GROUP BY ALL),
found AS (SELECT pair_id, {_STATUS} AS status, phrase AS item, before, after FROM prot
  UNION ALL SELECT pair_id, 'NUMBERS_CHANGED', NULL, CAST(sum(greatest(before - after, 0)) AS BIGINT), CAST(sum(greatest(after - before, 0)) AS BIGINT) FROM num WHERE before <> after GROUP BY pair_id
  UNION ALL SELECT pair_id, 'HEDGE_REMOVED', word, before, after FROM lex WHERE before > after
  UNION ALL SELECT pair_id, 'TABLE_CHANGED', NULL, t, t FROM facts WHERE t > 0),
report AS (SELECT * FROM found UNION ALL SELECT pair_id, CASE WHEN d = 0 THEN 'UNCHANGED' ELSE 'NEEDS_REVIEW' END, NULL, 0, 0 FROM facts
  WHERE d = 0 OR pair_id NOT IN (SELECT pair_id FROM found WHERE status <> 'PROTECTED_INTACT'))
"""

SQL = {
    "table_cell_changes": f"""
WITH c AS (SELECT DISTINCT pair_id, side, table_index AS t, "row" AS r, col AS k, coalesce(text, '') AS x, {_norm("coalesce(text, '')")} AS n FROM cells),
b AS (SELECT pair_id, t FROM c GROUP BY ALL HAVING count(DISTINCT side) = 2),
h AS (SELECT pair_id, side, t, n, max(k) AS k FROM c WHERE r = 0 AND n <> '' GROUP BY ALL),
f AS (SELECT pair_id, t, max(k + 1) FILTER (side = 'original' AND r = 0) AS ow, max(k + 1) FILTER (side = 'revised' AND r = 0) AS rw,
  count(DISTINCT n) FILTER (side = 'original' AND r = 0 AND n <> '') AS onames, count(DISTINCT n) FILTER (side = 'revised' AND r = 0 AND n <> '') AS rnames FROM c SEMI JOIN b USING (pair_id, t) GROUP BY ALL),
w AS (SELECT pair_id, side, t, r, coalesce(max(n) FILTER (k = 0), '') AS key FROM c WHERE r > 0 GROUP BY ALL),
g AS (SELECT pair_id, t, bool_and(ok) AS keyed FROM (SELECT pair_id, side, t, count(*) = count(DISTINCT key) AND min(length(key)) > 0 AS ok FROM w GROUP BY ALL) GROUP BY ALL),
m AS (SELECT f.*, onames > 0 AND rnames > 0 AND onames >= greatest(1, ow - 1) AS named, coalesce(keyed, true) AS keyed FROM f LEFT JOIN g USING (pair_id, t)),
cm AS (SELECT m.pair_id, m.t, a.k AS oc, z.k AS rc FROM m JOIN h a ON a.pair_id = m.pair_id AND a.t = m.t AND a.side = 'original' JOIN h z ON z.pair_id = m.pair_id AND z.t = m.t AND z.side = 'revised' AND z.n = a.n WHERE named
  UNION ALL SELECT pair_id, t, i, i FROM (SELECT pair_id, t, unnest(range(0, least(ow, rw))) AS i FROM m WHERE NOT named)),
rm AS (SELECT m.pair_id, m.t, a.r AS orow, z.r AS rrow FROM m JOIN w a ON a.pair_id = m.pair_id AND a.t = m.t AND a.side = 'original' JOIN w z ON z.pair_id = m.pair_id AND z.t = m.t AND z.side = 'revised' AND (CASE WHEN keyed THEN z.key = a.key ELSE z.r = a.r END)
  UNION ALL SELECT pair_id, t, 0, 0 FROM m),
q AS (SELECT rm.pair_id, rm.t, orow, oc, coalesce(a.x, '') AS original, coalesce(z.x, '') AS revised, coalesce(a.n, '') AS n1, coalesce(z.n, '') AS n2 FROM rm JOIN cm USING (pair_id, t)
  LEFT JOIN c a ON a.pair_id = rm.pair_id AND a.t = rm.t AND a.side = 'original' AND a.r = orow AND a.k = oc LEFT JOIN c z ON z.pair_id = rm.pair_id AND z.t = rm.t AND z.side = 'revised' AND z.r = rrow AND z.k = rc)
SELECT q.pair_id, q.t AS original_index, q.t AS revised_index, orow AS "row", CAST(oc AS INTEGER) AS col, coalesce(CASE WHEN l.n <> '' THEN l.x END, 'row ' || (orow + 1)) AS row_label, coalesce(d.x, 'column ' || (oc + 1)) AS col_label, original, revised
FROM q LEFT JOIN c l ON l.pair_id = q.pair_id AND l.t = q.t AND l.side = 'original' AND l.r = orow AND l.k = 0 LEFT JOIN c d ON d.pair_id = q.pair_id AND d.t = q.t AND d.side = 'original' AND d.r = 0 AND d.k = oc WHERE n1 <> n2""",
    "number_multiset_diff": f"WITH {_BLOCKS}, {_NUMBERS} SELECT pair_id, number, before, after FROM num WHERE before <> after",
    "lexicon_count_drop": f"WITH {_BLOCKS}, {_lexicon()} SELECT pair_id, word, before, after FROM lex WHERE before > after",
    "protected_phrase_counts": f"WITH {_BLOCKS}, {_protected()} SELECT *, {_STATUS} AS status FROM prot",
    "guard_report": _GUARD + "SELECT pair_id, status, item, before, after FROM report",
    "guard_flagged": _GUARD + "SELECT pair_id, bool_or(status NOT IN ('PROTECTED_INTACT', 'UNCHANGED', 'NEEDS_REVIEW')) AS flagged FROM report GROUP BY pair_id",
}
