"""The domain tables as DataFrames, with redelivered records folded into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of each table in which a record may be delivered again (same values, loaded_at aside).
KEYS = {
    "paragraphs": ["para_id"],
    "issues": ["issue_key"],
    "entries": ["entry_key"],
    "tracked": ["tracked_key"],
    "cells": ["pair_id", "side", "table_index", "row", "col"],
    "cell_changes": ["pair_id", "table_index", "row_label", "col_label"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One row for each record of a redelivered table, with its key and the named columns.

    Copies of a record hold the same values, so one aggregate with a partial stage
    folds them before the shuffle. Where copies differ after all, the smallest
    non-null value of each column stands, whatever the order of arrival.
    """
    keys = KEYS[name]
    rest = [c for c in columns if c not in keys]
    df = table(spark, folder, name).select(*keys, *rest)
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])
