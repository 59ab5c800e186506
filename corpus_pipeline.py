"""The corpus pipeline: quality rules, exact and near deduplication, mixing to weights, packing.

Each stage takes the documents that the one before it kept, and its decisions take effect: rejected documents and
copies are gone, the mix repeats or drops documents, and the last stage returns the packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from stackwright.llm import line_quality, minhash_join, mixing, mph_dedup, packing
from stackwright.llm.common import materialize, shared_dir, text_or_empty, unused


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    kept = decided.filter("kept").select(F.col("doc_id").alias(unused("kept_id", docs.columns)))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept.columns[0]]), "left_semi")


def _by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` where texts share a doc_id or have none: over rows numbered in the order of doc_id (null first).

    The numbers stand in for doc_id while the stage decides, so no row is taken for its namesake.
    """
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 OR doc_id IS NULL").isEmpty():
        return stage(docs)
    own = unused("_own_id", docs.columns)
    ordered = docs.withColumn(own, F.col("doc_id")).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    numbered = materialize(ordered.withColumn("doc_id", F.monotonically_increasing_id()))
    return stage(numbered).withColumn("doc_id", F.col(own)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines and the texts that a base rule rejects or that consist mostly of such lines.

    Null and empty texts fail the base rules; rows that repeat or share a doc_id are judged each by text and source; a
    null source is a host of its own. Of all stages: no rows in, no rows out; columns of the input with any names stay.
    """
    return line_quality.kept_texts(docs, max_line_fraction=line_quality.MAX_LINE_FRACTION)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, with the largest doc_id. Of rows that also repeat doc_id, the least by their other columns.

    A null doc_id is less than any other, null text is empty text. Texts are compared whole, by SHA-256.
    """
    digest, kept_id, kept_digest, row = (unused(f"_{n}", docs.columns) for n in ("digest", "kept_id", "kept_digest", "row"))
    kept = mph_dedup.dedup_by_halves(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    hashed = docs.withColumn(digest, F.sha2(text_or_empty(), 256))
    found = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    order = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, AtomicType)]
    one = F.min_by(F.struct(*docs.columns), F.struct(F.lit(0).alias("_"), *order))
    return found.groupBy("doc_id", digest).agg(one.alias(row)).select(f"{row}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without near duplicates, 80 % of two-word shingles as in op5; the smallest doc_id of a component stays.

    Texts without words are no duplicates of each other. Rows that share a doc_id, or have none, are judged each: ties go
    to the row with the least hash of its text.
    """
    return _by_row(docs, lambda rows: _kept(rows, minhash_join.near_duplicates(rows)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last copy cut where a source's target is reached; texts without words go.

    Rows that share a doc_id, or have none, are taken each. A null source is a source, in the last place.
    """
    return _by_row(docs, lambda rows: mixing.take_copies(rows, mixing.mix_sources(rows)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; each copy that the mix took is packed on its own."""
    return packing.pack_best_fit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The tokenizer, and signatures before it, have no SQL form; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over table documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
