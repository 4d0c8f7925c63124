"""Records as they arrive: the operators that work record by record, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirewise.operators.requests import classify
from quirewise.operators.zonetime import to_utc


def read_arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def utc_arrivals(arrivals: DataFrame, offices: DataFrame) -> DataFrame:
    """Arrivals with their UTC instant; offices and zone intervals are static sides of stream-static joins."""
    return to_utc(arrivals, offices)


def once_each(arrivals: DataFrame, key: str, loaded_at: str = "loaded_at", late: str = "60 days") -> DataFrame:
    """Arrivals without redelivered records; a record delivered again after more than `late` counts anew, as state is bounded."""
    return arrivals.withWatermark(loaded_at, late).dropDuplicatesWithinWatermark([key])


def classified_arrivals(arrivals: DataFrame) -> DataFrame:
    """Arriving requests with category, secondary, actionable and subjective."""
    return classify(arrivals.drop("category", "actionable", "subjective"), "comment_text")


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to parquet, all that has arrived, exactly once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
