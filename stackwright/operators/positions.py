"""Joins by position, and what depends on the order of rows: nth tracks, gaps, repeated calls, latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def indexed(tracks: DataFrame, order: str = "ord") -> DataFrame:
    """``tracks`` with album_path and idx: the place, from 0, in their folder."""
    place = Window.partitionBy("album_path").orderBy(order, "path")
    return tracks.withColumn("album_path", T.parent(F.col("path"))).withColumn("idx", F.row_number().over(place) - 1)


def findings_on_tracks(findings: DataFrame, tracks: DataFrame) -> DataFrame:
    """``findings`` (album_path, idx, ...) with the path of the idx-th track of their album; those of no track go."""
    return findings.join(indexed(tracks).select("album_path", "idx", "path"), ["album_path", "idx"])


def candidates_on_files(candidate: DataFrame, files: DataFrame) -> DataFrame:
    """Every file (album_path, idx, path) with the candidate's track of its place, if there is one."""
    return files.join(candidate, ["album_path", "idx"], "left")


def fill_gaps(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` tracks with what they lack from those of ``source`` at the same keys.

    A blank artist takes the other's (and its list, if none is there); ids, lengths and genres fill nulls.
    """
    other = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("artist", "artists", "musicbrainz_track_id", "length", "genre")], F.lit(True).alias("_there"))
    lacks = T.missing(F.col("artist")) & F.col("_there").isNotNull()
    empty = F.coalesce(F.size("artists"), F.lit(0)) <= 0
    filled = target.join(other, keys, "left").withColumns({
        "artists": F.when(lacks & empty, F.col("_artists")).otherwise(F.col("artists")),
        "artist": F.when(lacks, F.col("_artist")).otherwise(F.col("artist")),
        **{c: F.coalesce(c, f"_{c}") for c in ("musicbrainz_track_id", "length", "genre")},
    })
    return filled.select(*target.columns)


def contiguous(answers: DataFrame, key: str, index: str) -> DataFrame:
    """The answers of keys whose indices are 0, 1, 2, ... without a gap or a repeat; others can't be taken by position."""
    fine = answers.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return answers.join(fine.filter("n = d AND low = 0 AND high = n - 1").select(key), key, "left_semi")


def unresolved(targets: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    return targets.join(answers.select(*keys), keys, "left_anti")


def merge_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (album_path, idx, field, auto_fixed, ...) of ``old``, auto_fixed from the match in ``new``; albums without old rows are new."""
    keys = ["album_path", "idx", "field"]
    told = new.groupBy(*keys).agg(F.max("auto_fixed").alias("_fixed"))
    kept = old.join(told, keys, "left").withColumn("auto_fixed", F.coalesce("_fixed", "auto_fixed")).select(*old.columns)
    return kept.unionByName(new.join(old.select("album_path"), "album_path", "left_anti").select(*old.columns))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side has and the other hasn't, with ``side``; no rows: both sets are equal."""
    mark = lambda rows, bit: rows.select(*keys).distinct().withColumn("_bit", F.lit(bit))
    both = mark(left, 1).unionByName(mark(right, 2)).groupBy(*keys).agg(F.sum("_bit").alias("_bits"))
    return both.filter("_bits < 3").select(*keys, F.when(F.col("_bits") == 1, "left").otherwise("right").alias("side"))


def unused_remote(remote: DataFrame, rows: DataFrame) -> DataFrame:
    """Tracks (album_id, remote_idx) of a release that no row has chosen."""
    return remote.select("album_id", "remote_idx").join(rows.filter("remote_idx IS NOT NULL").select("album_id", "remote_idx"), ["album_id", "remote_idx"], "left_anti")


def chosen_twice(rows: DataFrame) -> DataFrame:
    return rows.filter("remote_idx IS NOT NULL").groupBy("album_id", "remote_idx").agg(F.count("*").alias("n")).filter("n > 1")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls (session, ord, signature) whose two predecessors in their session had the same signature."""
    place = Window.partitionBy("session").orderBy("ord")
    before = [F.lag("signature", k).over(place).alias(f"_{k}") for k in (1, 2)]
    return calls.select("*", *before).filter("signature = _1 AND signature = _2").drop("_1", "_2")


def latest_state(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def pending(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, created, status) whose last state is pending, in the order they came in (``rank``)."""
    now = latest_state(batches, ["batch_id"], ["created", "seq"]).filter("status = 'pending'")
    return now.select("batch_id", "created")
