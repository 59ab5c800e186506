"""A bounded, repeatable sample by key, and the rows that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``key``: those with the least hashes of ``order``.

    Counts come first, so that only about twice the wanted rows of a key, however frequent, meet for the ranking.
    """
    place = F.xxhash64(F.lit(7), F.col(order))
    share = (F.shiftrightunsigned("_place", 1).cast("double")) / F.lit(float(2**63))
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"))
    near = (
        rows.withColumn("_place", place)
        .join(counts, F.col(key) == F.col("_key"))
        .filter(share * F.col("_rows") <= 2 * most + 50)
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_place", order))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_key", "_rows", "_rank", "_place")
