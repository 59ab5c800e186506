"""The queries of this subpackage: opN_<name>(spark, sf_dir), and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_repeats, drake_clusters, hierarchical_language, line_quality, minhash_join, mixing, mph_dedup, packing, phrase_fingerprint, pu_toxicity, revisit, seed_extend, token_alignment
from .common import table


def op1_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's captures and revisits: each not-modified answer with the latest earlier full response, validators checked, headers merged."""
    return revisit.page_revisits(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; all tied and repeated rows count, nulls are sources of their own."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from positive labels and unlabelled texts that aren't held out; ties of the sample go by hash."""
    return pu_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those that a 100-byte string covers which starts earlier."""
    return bwt_repeats.removed_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts that share 80 % of their two-word shingles."""
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays; texts of any length are hashed whole, columns of any names are ignored."""
    return mph_dedup.dedup_by_halves(table(spark, sf_dir, "documents"))


def op7_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out."""
    return hierarchical_language.predict_language(table(spark, sf_dir, "documents"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts and whether it is kept; texts of any length are parsed whole."""
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those that a window of 20 words covers which starts earlier."""
    return seed_extend.removed_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids and its place in a sequence of 2,048 tokens."""
    return packing.pack_best_fit(table(spark, sf_dir, "documents"))


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster, squared distance, and facts of its cluster."""
    return drake_clusters.drake_clusters(table(spark, sf_dir, "embeddings")).drop("measured")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links under two tokenizers, and what its links count corpus-wide."""
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrase fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    return phrase_fingerprint.neighbour_likeness(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_revisit,
        op2_mix_sources,
        op3_pu_toxicity,
        op4_bwt_repeats,
        op5_minhash_join,
        op6_mph_dedup,
        op7_hierarchical_language,
        op8_line_quality,
        op9_seed_extend,
        op10_pack_best_fit,
        op11_drake_clusters,
        op12_token_alignment,
        op13_phrase_fingerprint,
    )
}

ORACLE_SQL = {
    "op1_revisit": revisit.SQL,
    "op6_mph_dedup": mph_dedup.SQL,
    "op8_line_quality": line_quality.SQL,
    "op11_drake_clusters": drake_clusters.SQL,
}
