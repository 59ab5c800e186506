"""Keyed state on append-only tables: upserts, deletes, expiry and request windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import canonical_struct

#: What may become of an album, and of a folder's name that a model has read.
ALBUM_STATUSES = ["error", "llm_parsed", "pending", "tagged_ok"]
PARSED, EXTRACTED = "llm_parsed", "_llm_"
LEDGER = ["path_hash", "status", "content_hash", "folder_name_hash", "extraction", "disc_count", "error", "processed_at"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those of the same keys, and the rest of ``new`` added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def live(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Entries younger than ``hours``."""
    return cache.filter(F.col("fetched_at") > now - F.make_interval(hours=F.lit(hours)))


def requests_in_window(log: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """``log`` with n: requests of the same client in the last ``seconds``, this one included (its time at in seconds).

    ``by`` may be empty: all requests count. Requests are counted by second first, and a span of seconds is windowed with
    the one before it, so no window holds more than two spans however many requests there are.
    """
    at = F.col("at").cast("long")
    counted = log.groupBy(*by, at.alias("_at")).agg(F.count("*").alias("_n"))
    span = F.floor(F.col("_at") / seconds)
    placed = counted.withColumn("_span", F.explode(F.array(span, span + 1))).withColumn("_own", F.col("_span") == F.floor(F.col("_at") / seconds))
    window = Window.partitionBy(*by, "_span").orderBy("_at").rangeBetween(1 - seconds, 0)
    sums = placed.withColumn("n", F.sum("_n").over(window)).filter("_own").select(*[F.col(c).alias(f"_{c}") for c in by], "_at", "n")
    same = at == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return log.join(sums, same).drop(*[f"_{c}" for c in by], "_at")


def query_hash(fields: list[str], version: int = 4) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, nulls kept, with the cache's version."""
    return F.sha2(canonical_struct(fields, cache_version=version), 256)


def grouped_tags(rows: DataFrame) -> DataFrame:
    """Tags across tracks: (key, value, n_paths) by upper-case key and value, in the key's first spelling.

    ``rows``: path, ord, key, value. Paths are counted, not gathered; tag_paths() has them as rows.
    """
    return rows.groupBy(F.upper("key").alias("_key"), "value").agg(F.min_by("key", F.struct("path", "ord")).alias("key"), F.countDistinct("path").alias("n_paths")).select("key", "value", "n_paths")


def tag_paths(rows: DataFrame) -> DataFrame:
    """(key, value, path): the paths of each tag, keys in upper case."""
    return rows.select(F.upper("key").alias("key"), "value", "path").distinct()


def same_tags(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, same): whether both sides hold the same set of (upper-case key, trimmed value) for a path."""
    side = lambda rows, s: rows.select("path", F.upper("key").alias("key"), F.trim("value").alias("value")).distinct().withColumn("_side", F.lit(s))
    both = side(left, 1).unionByName(side(right, 2)).groupBy("path", "key", "value").agg(F.count("*").alias("n"))
    return both.groupBy("path").agg(F.bool_and(F.col("n") == 2).alias("same"))


def folder_name_hash(name: Column) -> Column:
    return F.sha2(T.trim(name), 256)


def album_states(albums: DataFrame) -> DataFrame:
    """Ledger rows (LEDGER) of albums (path, status, content_hash, disc_count, error, processed_at) with a valid status.

    The newest row of each album counts. upsert() by path_hash adds them to a ledger.
    """
    rows = albums.filter(F.col("status").isin(ALBUM_STATUSES)).select(
        T.path_hash(F.col("path")).alias("path_hash"), "status", "content_hash", folder_name_hash(T.parent(F.col("path"))).alias("folder_name_hash"),
        F.lit(None).cast("string").alias("extraction"), F.col("disc_count").cast("long").alias("disc_count"), "error", "processed_at",
    )
    return rows.groupBy("path_hash").agg(F.max_by(F.struct(*LEDGER[1:]), F.struct("processed_at", "status")).alias("r")).select("path_hash", "r.*")


def rejected_states(albums: DataFrame) -> DataFrame:
    """(path, problem) of albums whose status isn't one."""
    told = F.concat(F.lit("Invalid album status: "), F.coalesce("status", F.lit("")), F.lit(f". Valid: {', '.join(ALBUM_STATUSES)}"))
    return albums.filter(~F.coalesce(F.col("status").isin(ALBUM_STATUSES), F.lit(False))).select("path", told.alias("problem"))


def extraction_states(read: DataFrame) -> DataFrame:
    """Ledger rows of what a model read from folders' names (folder_name, extraction, processed_at); the newest counts."""
    hashed = read.withColumn("folder_name_hash", folder_name_hash(F.col("folder_name")))
    newest = hashed.groupBy("folder_name_hash").agg(F.max_by(F.struct("extraction", "processed_at"), F.struct("processed_at", "extraction")).alias("r"))
    return newest.select(
        F.concat(F.lit(EXTRACTED), "folder_name_hash").alias("path_hash"), F.lit(PARSED).alias("status"), F.lit("").alias("content_hash"), "folder_name_hash",
        F.col("r.extraction").alias("extraction"), F.lit(0).cast("long").alias("disc_count"), F.lit(None).cast("string").alias("error"), F.col("r.processed_at").alias("processed_at"),
    )


def extractions_of(ledger: DataFrame, folders: DataFrame) -> DataFrame:
    """``folders`` (folder_name, ...) with the extraction that the ledger has of their names, null where it has none."""
    held = ledger.filter("extraction IS NOT NULL").groupBy("folder_name_hash").agg(F.max_by("extraction", "processed_at").alias("extraction"))
    return folders.withColumn("folder_name_hash", folder_name_hash(F.col("folder_name"))).join(held, "folder_name_hash", "left").drop("folder_name_hash")
