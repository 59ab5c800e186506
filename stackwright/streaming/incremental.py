"""Incremental scans: each run takes the files that came since the last one, and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def new_files(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """A stream of (path, length, modified) of audio files that appear below ``root``; contents aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).filter(T.is_audio(F.col("path")))


def scan(spark: SparkSession, root: str, output: str, checkpoint: str) -> None:
    """Append new files to table folder ``output`` as Parquet; a file is taken once, across runs and failures."""
    new_files(spark, root).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
