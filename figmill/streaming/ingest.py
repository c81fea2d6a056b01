"""Structured Streaming over record files: each file is repaired and flattened as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from figmill.operators.flatten import long_table
from figmill.operators.repair import repair


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files under ``path`` as (paper_id, ord, json); ord is the file's time."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").load(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.element_at(parts, -2).alias("paper_id"), F.unix_micros("_metadata.file_modification_time").alias("ord"), F.col("value").alias("json"))


def stream_long_table(spark: SparkSession, path: str) -> DataFrame:
    """The long table of all files that arrive; stateless, so it keeps up with any rate of files."""
    return long_table(repair(stream_files(spark, path)).filter("record IS NOT NULL").select("paper_id", "ord", "record.*"))


def run(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the long table to Parquet; each file once, across restarts too."""
    return stream_long_table(spark, path).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
