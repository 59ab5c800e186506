"""Aggregates over tracks, audit results, matches and file checks. Values are counted, not gathered, where groups may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .health import BUCKETS

# Fields that tracks are edited by together, and the types of a damaged file that still plays.
BATCH_FIELDS = ["artist", "album", "album_artist", "genre", "year"]


def library_facts(tracks: DataFrame) -> DataFrame:
    """One row: albums (folders), tracks, distinct artists and genres, rows that lack a field, size in MB and minutes."""
    named = lambda c: F.countDistinct(F.when(~T.missing(F.col(c)), F.lower(T.trim(F.col(c))))).alias(f"n_{c}s")
    return tracks.agg(
        F.countDistinct(T.parent(F.col("path"))).alias("n_albums"), F.count("*").alias("n_tracks"), named("artist"), named("genre"),
        *[F.count_if(T.missing(F.col(c))).alias(f"missing_{c}") for c in ("title", "artist", "album", "genre", "year")],
        F.round(F.sum("size_bytes") / 1048576, 1).alias("megabytes"), F.round(F.sum("duration") / 60).cast("long").alias("minutes"),
    )


def audit_totals(results: DataFrame) -> DataFrame:
    """One row: albums, results and issues (anything but correct)."""
    return results.agg(F.countDistinct("album_path").alias("albums"), F.count("*").alias("results"), F.count_if(F.col("status") != "correct").alias("issues"))


def _rank() -> Column:
    return F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)


def audit_by_track(results: DataFrame) -> DataFrame:
    """Of each path: results, the gravest status that isn't fixed, whether one needs a look, and how many are fixed."""
    fixed = F.coalesce("auto_fixed", F.lit(False))
    open_rank = F.max(F.when(fixed, 0).otherwise(_rank()))
    return results.groupBy("path").agg(
        F.count("*").alias("n"), F.element_at(F.array(*map(F.lit, ("correct", "warning", "error"))), open_rank + 1).alias("highest"),
        (open_rank > 0).alias("manual"), F.count_if(fixed).alias("fixed"),
    )


def audit_groups(results: DataFrame) -> DataFrame:
    """Of each track (album_path, idx): results that can be applied, those that need a look, and all."""
    fixed, eligible = F.coalesce("auto_fixed", F.lit(False)), F.coalesce("eligible", F.lit(False))
    return results.groupBy("album_path", "idx").agg(F.count_if(eligible & ~fixed).alias("fixable"), F.count_if((_rank() > 0) & ~eligible & ~fixed).alias("manual"), F.count("*").alias("results"))


def genre_conflicts(tracks: DataFrame) -> DataFrame:
    """Albums whose filled genres differ, compared without case and punctuation."""
    genre = T.comparable(T.nfkc(F.coalesce("genre", F.lit(""))))
    return tracks.select("album", F.when(genre != "", genre).alias("g")).groupBy("album").agg(F.countDistinct("g").alias("n_genres")).filter("n_genres > 1")


def batch_suggestions(tracks: DataFrame) -> DataFrame:
    """(field, value): the distinct filled values of each field, discs as n or n/total."""
    disc = F.when(F.col("disc_total").isNull(), F.col("disc_number").cast("string")).otherwise(F.concat_ws("/", "disc_number", "disc_total"))
    each = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in BATCH_FIELDS]
    each.append(F.struct(F.lit("disc").alias("field"), F.when(F.col("disc_number").isNotNull(), disc).alias("value")))
    return tracks.select(F.inline(F.array(*each))).filter("value <> ''").distinct()


def differing_fields(tracks: DataFrame, fields: list[str] = BATCH_FIELDS) -> DataFrame:
    """(field, n_values) of fields in which the tracks differ; a lacking value is one of its own."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in fields])
    return tracks.select(F.inline(each)).groupBy("field").agg(F.countDistinct("value").alias("n_values")).filter("n_values > 1")


def extra_tag_delta(paths: DataFrame, rows: DataFrame, shared: list[tuple[str, str]], removed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, key, value, operation): what changes in the extra tags of ``paths`` (path).

    ``rows``, ``removed`` and ``current``: path, key, value. ``shared``: pairs that every path gets. Keys compare in upper
    case, values trimmed; what is equal on both sides doesn't come out.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in shared]) if shared else F.array().cast("array<struct<key:string,value:string>>")
    form = lambda t: t.select("path", F.upper(T.trim(F.col("key"))).alias("key"), T.trim(F.col("value")).alias("value")).distinct()
    keys = ["path", "key", "value"]
    wanted = form(rows.select(*keys).unionByName(paths.select("path", F.inline(pairs)))).join(form(removed), keys, "left_anti")
    both = wanted.withColumn("_new", F.lit(1)).join(form(current).withColumn("_old", F.lit(1)), keys, "full")
    return both.filter("_new IS NULL OR _old IS NULL").select(*keys, F.when(F.col("_old").isNull(), "set").otherwise("remove").alias("operation"))


def damage_report(files: DataFrame) -> DataFrame:
    """Of each artist and album: failed, minor and warned files, by what is wrong (``kind``); those without issues are left out."""
    kind = F.when(F.col("bucket") == "broken", "failed").when(F.col("bucket") == "minor", "minor").when(F.col("playable_failure"), "warned_playable").when(F.col("bucket") == "medium", "warned")
    return files.groupBy("artist", "album").agg(*[F.count_if(kind == k).alias(k) for k in ("failed", "minor", "warned", "warned_playable")]).filter("failed + minor + warned + warned_playable > 0")


def verification(actions: DataFrame, readback: DataFrame) -> DataFrame:
    """One row: expectations, those that hold after a change, and those that don't. Values compare with nulls equal."""
    now = readback.select("path", "field", F.col("value").alias("_now"))
    held = F.col("new_value").eqNullSafe(F.col("_now"))
    return actions.join(now, ["path", "field"], "left").agg(F.count("*").alias("expected"), F.count_if(held).alias("verified"), F.count_if(~held).alias("failed"))
