"""Session helpers shared by operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests on one machine) is
    a temporary folder set; on a cluster without the setting an error is raised, as a
    folder of one machine would lose what others wrote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirewise-checkpoint-"))
    return sc.getCheckpointDir()


#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(df: DataFrame) -> Iterator[DataFrame]:
    """df, whose shuffle files are removed as soon as it was executed; for steps whose result is written, so nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        yield df.select("*")  # planned under the setting
    finally:
        if before is None:
            conf.unset(FREED)
        else:
            conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    with freed(df) as x:
        return x.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of df as cut does, by columns: wide rows of texts take a fraction of the bytes, and a reader takes the columns it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4()}"
    with freed(df) as x:
        x.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
