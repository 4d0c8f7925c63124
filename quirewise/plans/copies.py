"""Queries on timestamps and on copies of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators.copydiff import audit_table_copies
from quirewise.operators.zonetime import to_utc
from quirewise.sources.tables import records, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """UTC instant of every dated record of issues, entries and tracked."""
    parts, stored = [], []
    for name, key in (("issues", "issue_key"), ("entries", "entry_key"), ("tracked", "tracked_key")):
        parts.append(records(spark, folder, name, "date", "office").select(F.lit(name).alias("tab"), F.col(key).alias("rec_id"), "date", "office"))
        stored.append(table(spark, folder, name).select("date"))
    rows = reduce(DataFrame.unionByName, parts).filter(F.regexp_replace("date", r"(?U)[\s\x1c-\x1f]+", "") != "")
    return to_utc(rows, table(spark, folder, "offices"), texts=reduce(DataFrame.unionByName, stored)).select("tab", "rec_id", "utc")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of the two copies of each table, and faults of the change log."""
    cells = records(spark, folder, "cells", "text")
    log = table(spark, folder, "cell_changes").select("pair_id", "table_index", "row_label", "col_label", "original", "revised")
    return audit_table_copies(cells, log)


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

SQL = {
    "p5_found": r"""
WITH c AS (SELECT DISTINCT pair_id, side, table_index, "row" AS r, col AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM cells),
rows_ AS (SELECT pair_id, side, table_index, r, coalesce(t, '') AS row_label FROM c WHERE k = 0 AND r <> 0),
cols_ AS (SELECT pair_id, side, table_index, k, coalesce(t, '') AS col_label FROM c WHERE r = 0 AND k <> 0),
inner_ AS (
  SELECT c.pair_id, c.side, c.table_index, coalesce(row_label, '') AS row_label, coalesce(col_label, '') AS col_label, min(t) AS t
  FROM c LEFT JOIN rows_ USING (pair_id, side, table_index, r) LEFT JOIN cols_ USING (pair_id, side, table_index, k)
  WHERE r <> 0 AND k <> 0 GROUP BY ALL),
rs AS (SELECT pair_id, table_index, row_label, bool_or(side = 'original') AS o, bool_or(side = 'revised') AS v FROM rows_ GROUP BY ALL),
cs AS (SELECT pair_id, table_index, col_label, bool_or(side = 'original') AS o, bool_or(side = 'revised') AS v FROM cols_ GROUP BY ALL),
tb AS (SELECT pair_id, table_index FROM c GROUP BY ALL HAVING count(DISTINCT side) = 2),
val AS (
  SELECT a.pair_id, a.table_index, a.row_label, a.col_label,
    max(t) FILTER (side = 'original') AS o, max(t) FILTER (side = 'revised') AS v
  FROM inner_ a SEMI JOIN (SELECT * FROM rs WHERE o AND v) x ON x.pair_id = a.pair_id AND x.table_index = a.table_index AND x.row_label = a.row_label
  SEMI JOIN (SELECT * FROM cs WHERE o AND v) y ON y.pair_id = a.pair_id AND y.table_index = a.table_index AND y.col_label = a.col_label
  GROUP BY ALL),
lg AS (SELECT pair_id, table_index, regexp_replace(row_label, '^\s+|\s+$', '', 'g') AS row_label, regexp_replace(col_label, '^\s+|\s+$', '', 'g') AS col_label,
  any_value(regexp_replace(original, '^\s+|\s+$', '', 'g')) AS lo, any_value(regexp_replace(revised, '^\s+|\s+$', '', 'g')) AS lv, 1 AS logged FROM cell_changes GROUP BY ALL),
num(x) AS (SELECT 1),
n AS (
  SELECT *, CASE WHEN regexp_full_match(o, '[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?') THEN CAST(replace(o, ',', '') AS DECIMAL(38, 12)) END AS no_,
    CASE WHEN regexp_full_match(v, '[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?') THEN CAST(replace(v, ',', '') AS DECIMAL(38, 12)) END AS nv FROM val),
vals AS (SELECT * FROM n WHERE coalesce(o, '') <> coalesce(v, '') AND NOT coalesce(no_ = nv, false)),
j AS (
  SELECT *, CASE WHEN regexp_full_match(lo, '[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?') THEN CAST(replace(lo, ',', '') AS DECIMAL(38, 12)) END AS nlo,
    CASE WHEN regexp_full_match(lv, '[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?') THEN CAST(replace(lv, ',', '') AS DECIMAL(38, 12)) END AS nlv
  FROM (SELECT *, 1 AS isval FROM vals) FULL JOIN lg USING (pair_id, table_index, row_label, col_label))
SELECT pair_id, table_index, row_label, '' AS col_label, CASE WHEN o THEN 'row_only_original' ELSE 'row_only_revised' END AS kind FROM rs WHERE NOT (o AND v)
UNION ALL SELECT pair_id, table_index, '', col_label, CASE WHEN o THEN 'col_only_original' ELSE 'col_only_revised' END FROM cs SEMI JOIN tb USING (pair_id, table_index) WHERE NOT (o AND v)
UNION ALL SELECT pair_id, table_index, row_label, col_label, 'value' FROM j WHERE isval = 1
UNION ALL SELECT pair_id, table_index, row_label, col_label, 'log_missing' FROM j WHERE isval = 1 AND logged IS NULL
UNION ALL SELECT pair_id, table_index, row_label, col_label, 'log_extra' FROM j WHERE isval IS NULL
UNION ALL SELECT pair_id, table_index, row_label, col_label, 'log_original' FROM j WHERE isval = 1 AND logged = 1 AND coalesce(lo, '') <> coalesce(o, '') AND NOT coalesce(nlo = no_, false)
UNION ALL SELECT pair_id, table_index, row_label, col_label, 'log_revised' FROM j WHERE isval = 1 AND logged = 1 AND coalesce(lv, '') <> coalesce(v, '') AND NOT coalesce(nlv = nv, false)
""",
}
