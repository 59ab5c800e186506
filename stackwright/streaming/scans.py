"""Scans of many files in batches, which go on where they stopped.

A scan's folder holds ``plan`` (rel, batch_id: which file belongs to which batch), ``results`` (rows of results by
batch_id) and ``manifest`` (one row). Batches are written as partitions, each replaced as a whole, so one that is checked
again leaves one set of results. A file belongs to one batch for good; files that are new when a scan goes on get batches
of their own. Nothing is taken for done but what ``results`` holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        return None


def _in_batches(files: DataFrame, size: int, first: int) -> DataFrame:
    """(rel, batch_id) in the order of paths, ``size`` files a batch, numbered from ``first``: ranges first, then places within them."""
    ranged = files.select("rel").distinct().repartitionByRange("rel").sortWithinPartitions("rel").select("rel", F.spark_partition_id().alias("part"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("rel")) - 1)
    batch = F.struct("part", F.floor(F.col("place") / size).cast("int").alias("k"))
    # One row for each batch.
    numbers = placed.select(batch.alias("b")).distinct().withColumn("batch_id", F.row_number().over(Window.orderBy("b")) + (first - 1))
    return placed.select("rel", batch.alias("b")).join(numbers, "b").select("rel", F.col("batch_id").cast("long").alias("batch_id"))


def plan(files: DataFrame, folder: str, batch_size: int = 200) -> DataFrame:
    """The batches of ``files`` (rel): those of earlier runs as they are, new files in new ones."""
    spark, path = files.sparkSession, f"{folder.rstrip('/')}/plan"
    known = _read(spark, path)
    if known is None:
        _in_batches(files, batch_size, 0).write.mode("append").parquet(path)
    else:
        new = files.select("rel").join(known.select("rel"), "rel", "left_anti")
        if not new.isEmpty():
            last = known.agg(F.max("batch_id")).first()[0]
            _in_batches(new, batch_size, (-1 if last is None else last) + 1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def waiting(planned: DataFrame, folder: str) -> DataFrame:
    """Files of ``planned`` in batches that aren't whole in the results."""
    done = _read(planned.sparkSession, f"{folder.rstrip('/')}/results")
    if done is None:
        return planned
    left = planned.join(done.select("rel", F.col("batch_id").cast("long").alias("batch_id")).distinct(), ["rel", "batch_id"], "left_anti")
    return planned.join(left.select("batch_id").distinct(), "batch_id", "left_semi").select("rel", "batch_id")


def write_results(results: DataFrame, folder: str) -> None:
    """Results (batch_id, rel, ...) in place of those of the same batches; of a file's rows within a batch all stay."""
    path = f"{folder.rstrip('/')}/results"
    results.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def run(files: DataFrame, check: Callable[[DataFrame], DataFrame], folder: str, mode: str = "doctor", batch_size: int = 200, batches_at_once: int = 10_000, most_rounds: int | None = None) -> DataFrame:
    """Checks all files (rel, ...) that a former run hasn't, round by round, and returns the results of all.

    ``check`` turns rows (rel, batch_id, and the columns of ``files``) into rows of results with both; a round's batches
    take effect together. ``most_rounds`` ends a run early.
    """
    spark, folder = files.sparkSession, folder.rstrip("/")
    planned = plan(files, folder, batch_size)
    facts = planned.agg(F.count("*").alias("total_files"), F.countDistinct("batch_id").alias("batches")).withColumns({"mode": F.lit(mode), "batch_size": F.lit(batch_size), "updated_at": F.current_timestamp()})
    facts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    left = sorted(r.batch_id for r in waiting(planned, folder).select("batch_id").distinct().collect())  # a number for each batch
    rounds = [left[k : k + batches_at_once] for k in range(0, len(left), batches_at_once)][:most_rounds]
    for ids in rounds:
        todo = planned.filter(F.col("batch_id").isin(ids))
        write_results(check(files.join(todo, "rel")), folder)
    found = _read(spark, f"{folder}/results")
    return found.withColumn("batch_id", F.col("batch_id").cast("long")) if found is not None else check(files.join(planned, "rel").filter("false"))


def summary(folder: str, spark: SparkSession) -> DataFrame:
    """One row: files planned, files with results, and files in batches that wait."""
    planned = spark.read.parquet(f"{folder.rstrip('/')}/plan")
    left = waiting(planned, folder).withColumn("_waits", F.lit(1))
    counts = planned.join(left, ["rel", "batch_id"], "left").agg(F.count("*").alias("planned"), F.count("_waits").alias("waiting"))
    return counts.withColumn("done", F.col("planned") - F.col("waiting"))
