"""Release answers of two providers, as JSON text, to candidate tracks: from_json and array functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_CREDIT = "array<struct<name:string,joinphrase:string,artist:struct<id:string>>>"
_RECORDING = f"struct<id:string,title:string,length:double,`artist-credit`:{_CREDIT}>"
MUSICBRAINZ = (
    f"id string, title string, date string, country string, barcode string, `artist-credit` {_CREDIT}, `label-info` array<struct<`catalog-number`:string>>, media array<struct<position:string,format:string,"
    f"tracks:array<struct<number:string,position:string,title:string,`artist-credit`:{_CREDIT},recording:{_RECORDING}>>>>"
)
DISCOGS = (
    "id string, title string, year string, genres array<string>, styles array<string>, artists array<struct<id:string,name:string,join:string>>, "
    "tracklist array<struct<position:string,title:string,duration:string,artists:array<struct<name:string>>>>"
)


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _year(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4))


def musicbrainz_summaries(answers: DataFrame, json: str = "json") -> DataFrame:
    """One row for each release found: answers without id or title are left out."""
    r = answers.select(*[c for c in answers.columns if c != json], F.from_json(json, MUSICBRAINZ).alias("r")).filter("r.id IS NOT NULL AND r.title IS NOT NULL")
    rest = [c for c in r.columns if c != "r"]
    return r.select(
        *rest, F.lit("musicbrainz").alias("provider"), "r.id", "r.title", F.get(F.col("r.artist-credit.name"), F.lit(0)).alias("artist"), _year(F.col("r.date")).alias("year"), "r.country",
        _filled(F.coalesce("r.media.format", F.array().cast("array<string>"))).alias("formats"), F.nullif(F.get(F.col("r.label-info.catalog-number"), F.lit(0)), F.lit("")).alias("catalog_number"), "r.barcode",
    )


def musicbrainz_tracks(answers: DataFrame, json: str = "json") -> DataFrame:
    """(release_id, idx, title, match_titles, artist, artists, track_number, track_total, disc_number, recording_id, length).

    A medium whose numbers and titles equal an earlier one's (another format of the same disc) is left out.
    """
    r = answers.select(F.from_json(json, MUSICBRAINZ).alias("r")).filter("r.title IS NOT NULL")
    whole = F.filter("r.media", lambda m: F.size(F.coalesce(m["tracks"], F.array())) > 0)

    def signature(m: Column) -> Column:
        return F.transform(m["tracks"], lambda t: F.concat(F.coalesce(t["number"], t["position"], F.lit("")), F.lit(":"), F.coalesce(t["title"], t["recording"]["title"], F.lit(""))))

    r = r.withColumn("media", whole).withColumn("signs", F.transform("media", signature))
    r = r.withColumn("media", F.filter("media", lambda m, i: F.array_position(F.col("signs"), F.get("signs", i)) == i + 1))
    flat = F.flatten(F.transform("media", lambda m: F.transform(m["tracks"], lambda t: F.struct(T.positive_int(m["position"]).alias("disc"), F.size(m["tracks"]).alias("total"), t.alias("t")))))
    rows = r.select("r.id", F.get(F.col("r.artist-credit.name"), F.lit(0)).alias("release_artist"), F.posexplode(flat).alias("idx", "x")).select("id", "release_artist", "idx", "x.disc", "x.total", "x.t")
    title = F.coalesce("t.title", "t.recording.title")
    credit = F.when(F.size("t.artist-credit") > 0, F.col("t.artist-credit")).when(F.size("t.recording.artist-credit") > 0, F.col("t.recording.artist-credit"))
    text = F.array_join(F.transform(credit, lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit("")))), "")
    other = F.col("t.recording.title")
    return rows.select(
        F.col("id").alias("release_id"), "idx", title.alias("title"),
        F.when(other.isNotNull() & ~other.eqNullSafe(title), F.array(other)).otherwise(F.array().cast("array<string>")).alias("match_titles"),
        F.coalesce(F.nullif(text, F.lit("")), "release_artist").alias("artist"),
        F.when(credit.isNotNull(), _filled(F.transform(credit, lambda c: c["name"]))).otherwise(_filled(F.array("release_artist"))).alias("artists"),
        F.coalesce(T.positive_int(F.col("t.number")), T.positive_int(F.col("t.position"))).alias("track_number"), F.col("total").alias("track_total"), F.col("disc").alias("disc_number"),
        F.col("t.recording.id").alias("recording_id"), F.col("t.recording.length").alias("length"),
    )


def disc_and_track(position: Column) -> Column:
    """struct(disc, track) of ``2-05``, ``CD2-5``, ``A3`` or ``7``."""
    on_disc = r"(?i)^\s*(?:cd|dvd|disc|disk)?\s*(\d+)[-.](\d+)"
    two = position.rlike(on_disc)
    return F.struct(
        F.when(two, T.positive_int(F.regexp_extract(position, on_disc, 1))).alias("disc"),
        F.when(two, T.positive_int(F.regexp_extract(position, on_disc, 2))).otherwise(T.positive_int(T.extract(position, r"^\s*(\d+)\s*$"))).alias("track"),
    )


def clean_artist(name: Column) -> Column:
    """An artist's name without the number that tells namesakes apart: ``Name (2)``."""
    return T.trim(F.regexp_replace(name, r"\s*\(\d+\)\s*$", ""))


def discogs_tracks(answers: DataFrame, json: str = "json") -> DataFrame:
    """As musicbrainz_tracks(); headings (without a position) are left out, totals count each disc's tracks."""
    r = answers.select(F.from_json(json, DISCOGS).alias("r")).filter("r.title IS NOT NULL")
    listed = F.filter("r.tracklist", lambda t: T.trim(F.coalesce(t["position"], F.lit(""))) != "")
    r = r.withColumn("list", F.transform(listed, lambda t: F.struct(disc_and_track(t["position"]).alias("p"), t.alias("t"))))
    names = lambda a: _filled(F.transform(F.coalesce(a, F.array()), lambda x: clean_artist(x["name"])))
    rows = r.select("r.id", names(F.col("r.artists")).alias("release_artists"), F.col("list.p.disc").alias("discs"), F.posexplode("list").alias("idx", "x"))
    own = names(F.col("x.t.artists"))
    artists = F.when(F.size(own) > 0, own).otherwise(F.col("release_artists"))
    total = F.size(F.filter("discs", lambda d: d.eqNullSafe(F.col("x.p.disc"))))
    return rows.select(
        F.col("id").alias("release_id"), "idx", F.col("x.t.title").alias("title"), F.array().cast("array<string>").alias("match_titles"),
        F.nullif(F.array_join(artists, " & "), F.lit("")).alias("artist"), artists.alias("artists"), F.coalesce(F.col("x.p.track"), F.col("idx") + 1).alias("track_number"),
        total.alias("track_total"), F.col("x.p.disc").alias("disc_number"), F.lit(None).cast("string").alias("recording_id"), T.seconds(F.nullif(F.col("x.t.duration"), F.lit(""))).cast("double").alias("length"),
    )


def discogs_releases(answers: DataFrame, json: str = "json") -> DataFrame:
    """(id, title, year, genre): genres, then styles, each once, joined by ", "."""
    r = answers.select(F.from_json(json, DISCOGS).alias("r")).filter("r.title IS NOT NULL")
    none = F.array().cast("array<string>")
    genre = F.array_join(F.array_distinct(F.concat(F.coalesce("r.genres", none), F.coalesce("r.styles", none))), ", ")
    return r.select("r.id", "r.title", "r.year", F.nullif(genre, F.lit("")).alias("genre"))
