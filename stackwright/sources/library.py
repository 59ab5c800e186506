"""Files of a library as rows, and albums from them. Contents are read only where tags are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values, by falling priority.
COVER_NAMES = ["cover", "folder", "front", "album"]
COVER_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
LEAST_COVER_BYTES = 1024


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified): every file below ``root``; its path is relative to it. A missing root is an error.

    Spark's reader passes over empty files and names that start with a dot or an underscore.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    whole = F.regexp_replace("path", r"^\w+:/+", "")
    return found.select(F.substr(whole, F.lit(len(base) + 2)).alias("path"), "length", F.col("modificationTime").alias("modified"))


def audio_files(listing: DataFrame, hidden: bool = False) -> DataFrame:
    """The audio files of a listing (path, ...); names that start with a dot only if ``hidden``."""
    return listing.filter(T.is_audio(F.col("path")) & (F.lit(hidden) | ~T.basename(F.col("path")).startswith(".")))


def by_components(path: str = "path") -> Column:
    """Order by path components: a/b before "a b"/x, unlike order by bytes."""
    return F.split(path, "/")


def hints(folder: Column) -> Column:
    """struct(artist, album) of ``Artist - Album``; a year before the first dash belongs to the album."""
    parted = r"^\s*([^-]*?)\s*-\s*(.*?)\s*$"
    named = folder.rlike(parted) & ~folder.rlike(r"^\s*\d{4}\s*-") & (F.regexp_extract(folder, parted, 1) != "") & (F.regexp_extract(folder, parted, 2) != "")
    artist = F.when(named, F.regexp_extract(folder, parted, 1)).otherwise("")
    return F.struct(artist.alias("artist"), F.when(named, F.regexp_extract(folder, parted, 2)).otherwise(folder).alias("album"))


def albums(listing: DataFrame, library: str = "") -> DataFrame:
    """(path, artist_hint, album_hint, track_count) of a listing of relative paths.

    A folder at the top that has audio is an album, its name tells artist and album; otherwise its own folders that
    have audio are albums, and it is the artist. Files at the root make one album, called as the library. Deeper files
    belong to no album. One aggregation by folder, one anti-join over folders.
    """
    counted = audio_files(listing).groupBy(T.parent(F.col("path")).alias("path")).agg(F.count("*").alias("track_count"))
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    counted = counted.withColumn("parts", parts)
    tops = counted.filter(F.size("parts") == 1)
    below = counted.filter(F.size("parts") == 2).withColumn("top", F.get("parts", F.lit(0))).join(tops.select(F.col("path").alias("top")), "top", "left_anti")
    hint = hints(F.col("path"))
    return (
        tops.select("path", hint["artist"].alias("artist_hint"), hint["album"].alias("album_hint"), "track_count")
        .unionByName(below.select("path", F.col("top").alias("artist_hint"), F.get("parts", F.lit(1)).alias("album_hint"), "track_count"))
        .unionByName(counted.filter(F.size("parts") == 0).select(F.lit(".").alias("path"), F.lit("").alias("artist_hint"), F.lit(library).alias("album_hint"), "track_count"))
    )


def album_covers(listing: DataFrame) -> DataFrame:
    """(folder, cover): the best named image of each folder, else its largest image of 1,024 bytes at least, not artist.jpg."""
    name, ext = F.lower(T.stem(F.col("path"))), T.extension(F.col("path"))
    images = listing.filter(ext.isin(COVER_EXTENSIONS)).select("path", "length", T.parent(F.col("path")).alias("folder"), F.array_position(F.array(*map(F.lit, COVER_NAMES)), name).alias("n"), F.array_position(F.array(*map(F.lit, COVER_EXTENSIONS)), ext).alias("e"))
    large = (F.col("length") >= LEAST_COVER_BYTES) & (F.lower(T.basename(F.col("path"))) != "artist.jpg")
    named = F.min_by("path", F.when(F.col("n") > 0, F.struct("n", "e", "path")))
    largest = F.min_by("path", F.when(large, F.struct(-F.col("length"), F.col("path"))))
    return images.groupBy("folder").agg(F.coalesce(named, largest).alias("cover")).filter("cover IS NOT NULL")


def content_hashes(listing: DataFrame) -> DataFrame:
    """(folder, content_hash): SHA-256 of a folder's sorted name:size list. A folder's direct files make one row."""
    entry = F.concat(T.basename(F.col("path")), F.lit(":"), F.col("length").cast("string"))
    return listing.groupBy(T.parent(F.col("path")).alias("folder")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "|"), 256).alias("content_hash"))


def album_status(tracks: DataFrame) -> DataFrame:
    """(album_path, n_tracks, n_errors, status): ok without errors, error if all tracks have one, else warning."""
    counted = tracks.groupBy("album_path").agg(F.count("*").alias("n_tracks"), F.count("error").alias("n_errors"))
    return counted.withColumn("status", F.when(F.col("n_errors") == 0, "ok").when(F.col("n_errors") < F.col("n_tracks"), "warning").otherwise("error"))


def sort_by_album(tracks: DataFrame) -> DataFrame:
    """(source, target): each track in a folder called as its album; blank albums in Unknown Album."""
    album = F.coalesce(F.nullif(T.safe_name(F.col("album")), F.lit("")), F.lit("Unknown Album"))
    return tracks.select(F.col("path").alias("source"), F.concat_ws("/", album, T.basename(F.col("path"))).alias("target"))
