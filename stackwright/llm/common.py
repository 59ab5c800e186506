"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII white space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a new local one in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, with _part: the number of a row's range, which grows with the order."""
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: list, **sums: Column) -> DataFrame:
    """ranged() rows with running sums up to each row, in two levels: within ranges, then over the ranges' totals."""
    totals = rows.groupBy(F.col("_part").alias("_p")).agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    # One row for each range.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({k: F.sum(v).over(inner) for k, v in sums.items()}).join(F.broadcast(totals), F.col("_part") == F.col("_p"))
    return found.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_p", *[f"_{k}" for k in sums])
