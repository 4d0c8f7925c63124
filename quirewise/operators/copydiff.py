"""Differences between two copies of a dataset, by a null-safe full outer join on the key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.text import BLANKS

# Fixed value: a plain decimal number, thousands commas allowed.
PLAIN_NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?$|^[+-]?\.\d+$"

def trimmed(text: Column) -> Column:
    """Text without outer white space; null stays null."""
    return F.btrim(text, F.lit(BLANKS))


def comparable_value(text: Column) -> Column:
    """The form in which two cell values are compared.

    Null and blank give ''. Plain decimal numbers lose commas, a plus sign, leading
    zeros and trailing fractional zeros, so numbers of any length are equal exactly
    when their values are; everything else is the trimmed text. A marker keeps the
    two families apart.
    """
    t = F.coalesce(trimmed(text), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, ",", ""), r"^\+", "")
    negative = bare.startswith("-")
    digits = F.regexp_replace(bare, "^-", "")
    whole = F.ltrim(F.regexp_extract(digits, r"^(\d*)", 1), F.lit("0"))
    part = F.rtrim(F.regexp_extract(digits, r"\.(\d*)$", 1), F.lit("0"))
    number = F.concat(
        F.when(negative & ((F.length(whole) > 0) | (F.length(part) > 0)), "-").otherwise(""),
        F.when(F.length(whole) == 0, "0").otherwise(whole),
        F.when(F.length(part) == 0, "").otherwise(F.concat(F.lit("."), part)),
    )
    return F.when(t == "", "").when(t.rlike(PLAIN_NUMBER), F.concat(F.lit("n:"), number)).otherwise(F.concat(F.lit("t:"), t))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str] = (),
    normalise: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] | None = None,
    absent_as_null: bool = False,
) -> DataFrame:
    """Compare two copies row by row and field by field.

    Returns the keys, `in_left`, `in_right` (booleans) and `differences`, an array of
    struct(field, left_value, right_value) with the fields whose normalised values
    differ, stored values as strings. Keys match null-safely: a null key equals a null
    key. A null field equals only what normalises to the same (with the default,
    null). A row on one side only has an empty `differences`, or, with `absent_as_null`,
    is compared with a row of nulls. Other columns of either
    input are ignored, so clashing names do no harm. Repeated keys give every
    combination, as a join does; fold copies first. Two empty inputs give no rows.
    """
    keys, fields = list(keys), list(fields)
    rule = (lambda f: normalise.get(f, lambda c: c.cast("string"))) if isinstance(normalise, dict) else (lambda f: normalise or (lambda c: c.cast("string")))
    a = left.select(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)], *[F.col(f).alias(f"_lf{i}") for i, f in enumerate(fields)], F.lit(True).alias("_l"))
    b = right.select(*[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)], *[F.col(f).alias(f"_rf{i}") for i, f in enumerate(fields)], F.lit(True).alias("_r"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}"))
    j = a.join(b, on, "full_outer")
    compared = F.lit(True) if absent_as_null else F.col("_l").isNotNull() & F.col("_r").isNotNull()
    items = [
        F.when(
            compared & ~rule(f)(F.col(f"_lf{i}")).eqNullSafe(rule(f)(F.col(f"_rf{i}"))),
            F.struct(F.lit(f).alias("field"), F.col(f"_lf{i}").cast("string").alias("left_value"), F.col(f"_rf{i}").cast("string").alias("right_value")),
        )
        for i, f in enumerate(fields)
    ]
    empty = F.expr("cast(array() as array<struct<field:string,left_value:string,right_value:string>>)")
    return j.select(
        *[F.when(F.col("_l").isNotNull(), F.col(f"_lk{i}")).otherwise(F.col(f"_rk{i}")).alias(k) for i, k in enumerate(keys)],
        F.col("_l").isNotNull().alias("in_left"),
        F.col("_r").isNotNull().alias("in_right"),
        (F.filter(F.array(*items), lambda x: x.isNotNull()) if items else empty).alias("differences"),
    )


def labelled_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row labels, column labels and inner cells of tables given cell by cell.

    `cells` has pair_id, side, table_index, row, col, text. Row 0 holds the column
    labels, column 0 the row labels; labels are trimmed and a null label is ''. The
    labels reach their cells through equi-joins, whose skew AQE can split, so no
    table is gathered in one task. A cell in a column without a header cell, or in a
    row without a label cell, gets the label ''.
    """
    at = ["pair_id", "side", "table_index"]
    label = F.coalesce(trimmed(F.col("text")), F.lit(""))
    rows = cells.filter((F.col("col") == 0) & (F.col("row") != 0)).select(*at, "row", label.alias("row_label"))
    cols = cells.filter((F.col("row") == 0) & (F.col("col") != 0)).select(*at, "col", label.alias("col_label"))
    inner = (
        cells.filter((F.col("row") != 0) & (F.col("col") != 0))
        .join(rows, [*at, "row"], "left")
        .join(cols, [*at, "col"], "left")
        .select(*at, F.coalesce("row_label", F.lit("")).alias("row_label"), F.coalesce("col_label", F.lit("")).alias("col_label"), "text")
    )
    return rows, cols, inner


def audit_table_copies(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Rows, columns and values in which the two copies of each table differ, and faults of the log.

    Returns pair_id, table_index, row_label, col_label, kind, with the kinds
    row_only_original, row_only_revised, col_only_original, col_only_revised, value,
    log_missing, log_original, log_revised, log_extra. A cell that is absent, null or
    blank is empty. A table on one side only gives its rows, not its columns. Where a
    label stands twice in one table, or a log row twice, the smallest value counts.
    Cells without a pair, side, table, row or column, and log rows without a pair or
    table, take no part; sides other than `original` and `revised` neither. Other
    columns are ignored. Empty inputs give no rows.
    """
    place = ["pair_id", "table_index"]
    cells = cells.select(*place, "side", "row", "col", "text").filter("pair_id is not null and table_index is not null and row is not null and col is not null and side in ('original', 'revised')")
    log = log.filter("pair_id is not null and table_index is not null")
    rows, cols, inner = labelled_cells(cells)

    def sides(df: DataFrame, *keys: str) -> DataFrame:
        split = [df.filter(F.col("side") == s).select(*keys).distinct() for s in ("original", "revised")]
        return diff_copies(*split, keys)

    row_diff = sides(rows, *place, "row_label")
    col_diff = sides(cols, *place, "col_label")
    on_both = cells.groupBy(*place).agg(F.countDistinct("side").alias("n")).filter("n = 2").select(*place)
    one_side = lambda df, what: df.filter(~(F.col("in_left") & F.col("in_right"))).withColumn(
        "kind", F.when(F.col("in_left"), f"{what}_only_original").otherwise(f"{what}_only_revised")
    )
    row_rows = one_side(row_diff, "row").select(*place, "row_label", F.lit("").alias("col_label"), "kind")
    col_rows = one_side(col_diff, "col").join(on_both, place, "left_semi").select(*place, F.lit("").alias("row_label"), "col_label", "kind")

    cell = [*place, "row_label", "col_label"]
    values = inner.groupBy(*cell, "side").agg(F.min("text").alias("text"))
    split = [values.filter(F.col("side") == s) for s in ("original", "revised")]
    # A cell on one side only is empty on the other, so it differs exactly if it is not empty.
    pairs = diff_copies(*split, cell, ["text"], comparable_value, absent_as_null=True).filter(F.size("differences") > 0)
    pairs = pairs.select(*cell, F.element_at("differences", 1)["left_value"].alias("o"), F.element_at("differences", 1)["right_value"].alias("r"))
    grid_rows = row_diff.filter("in_left and in_right").select(*place, "row_label")
    grid_cols = col_diff.filter("in_left and in_right").select(*place, "col_label")
    value = pairs.join(grid_rows, [*place, "row_label"], "left_semi").join(grid_cols, [*place, "col_label"], "left_semi")
    logged = (
        log.select(*place, F.coalesce(trimmed(F.col("row_label")), F.lit("")).alias("row_label"), F.coalesce(trimmed(F.col("col_label")), F.lit("")).alias("col_label"), "original", "revised")
        .groupBy(*cell)
        .agg(F.min(F.struct("original", "revised")).alias("x"))
        .select(*cell, F.col("x.original").alias("o"), F.col("x.revised").alias("r"))
    )
    against = diff_copies(value, logged, cell, ["o", "r"], {"o": comparable_value, "r": comparable_value})
    differs = lambda f: F.exists("differences", lambda x: x["field"] == f)
    kinds = F.filter(
        F.array(
            F.when(F.col("in_left"), F.lit("value")),
            F.when(F.col("in_left") & ~F.col("in_right"), F.lit("log_missing")),
            F.when(~F.col("in_left"), F.lit("log_extra")),
            F.when(differs("o"), F.lit("log_original")),
            F.when(differs("r"), F.lit("log_revised")),
        ),
        lambda x: x.isNotNull(),
    )
    cell_rows = against.select(*cell, F.explode(kinds).alias("kind"))
    return row_rows.unionByName(col_rows).unionByName(cell_rows)
