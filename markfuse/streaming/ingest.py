"""Incremental ingest: parser outputs arrive as files and are profiled as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from markfuse.operators.profile import profile


def read_outputs(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files with parser outputs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def profile_stream(outputs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Profiles of new outputs appended to path, each exactly once; no state is kept, because a profile
    needs nothing but its own row. once: take what is there and stop."""
    writer = profile(outputs).drop("markdown").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
