"""Release candidates of a lookup request: filtering, ranking, and merging by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PROVIDERS = ["musicbrainz", "discogs"]
FIELDS = ["artist", "artists", "album", "album_artist", "album_artists", "year", "genre", "musicbrainz_album_id", "musicbrainz_artist_id", "discogs_release_id", "discogs_artist_id"]


def priority() -> Column:
    """Rank of a source: providers' own releases first, then providers, the model, the folder, the rest."""
    source = F.col("source")
    own = ((source == "musicbrainz") & F.col("musicbrainz_album_id").isNotNull()) | ((source == "discogs") & F.col("discogs_release_id").isNotNull())
    return F.when(own, -1).when(source == "musicbrainz", 0).when(source == "discogs", 1).when(source == "llm", 2).when(source == "folder", 3).otherwise(10)


def merge_by_priority(candidates: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row for each request_id: for each field the first filled value, the preferred candidate's first, then by ord.

    Empty lists count as unfilled. A provider's year goes before any other. All of it is one aggregation: the least
    (order, value) whose value is filled, so nothing is sorted and partial results combine before the shuffle.
    """
    types = dict(candidates.dtypes)
    preferred = candidates.groupBy("request_id").agg(F.min(F.struct(priority().alias("p"), F.col("ord").alias("o"))).alias("_best"))
    rows = candidates.join(preferred, "request_id").withColumn("_p", priority())
    order = F.struct((F.col("ord") != F.col("_best.o")).alias("later"), F.col("ord").alias("o"))

    def filled(name: str) -> Column:
        return F.size(name) > 0 if types[name].startswith("array") else F.col(name).isNotNull()

    chosen = [F.min_by(F.col(f), F.when(filled(f), order)).alias(f) for f in fields if f != "year"]
    own_year = F.min_by("year", F.when(F.col("source").isin(PROVIDERS) & F.col("year").isNotNull(), F.struct("_p", "ord")))
    any_year = F.min_by("year", F.when(F.col("year").isNotNull(), order))
    merged = rows.groupBy("request_id").agg(F.min_by("source", order).alias("source"), *chosen, F.coalesce(own_year, any_year).alias("year"))
    if {"album_artist", "album_artists"} <= set(fields):
        # A missing one of the pair is taken from the other.
        listed = F.coalesce(F.col("album_artists"), F.when(F.col("album_artist").isNotNull(), F.array("album_artist")))
        merged = merged.withColumns({"album_artist": F.coalesce("album_artist", F.get("album_artists", F.lit(0))), "album_artists": listed})
    return merged


def rank_candidates(scored: DataFrame) -> DataFrame:
    """rank by title matches, then the difference in tracks, then ord. ``scored``: request_id, ord, title_matches, n_local, n_remote."""
    place = Window.partitionBy("request_id").orderBy(F.desc("title_matches"), F.abs(F.col("n_remote") - F.col("n_local")), "ord")
    return scored.withColumn("rank", F.row_number().over(place))


def rank_releases(releases: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` releases of each request: those of the wanted year, then newer ones, then by title."""
    hit = F.coalesce(F.col("year") == F.col("wanted_year"), F.lit(False))
    place = Window.partitionBy("request_id").orderBy(hit.desc(), F.desc_nulls_last("year"), "title")
    return releases.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
