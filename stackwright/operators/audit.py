"""Audit of tags against folder and file names: rules for ten fields in one pass, as an array of structs that is inlined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T


def _text_columns(tracks: DataFrame) -> DataFrame:
    """NFKC forms of all compared texts, made in one Arrow pass; lists travel as one joined text."""
    named = {c: F.col(c) for c in ("title", "artist", "album", "album_artist", "year", "artist_hint")}
    listed = {c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\x1f") for c in ("artists", "album_artists")}
    facts = {"fact_title": F.col("facts.title"), "fact_artist": F.col("facts.artist"), "expected_album": F.col("expected_album"), "source_artist": F.col("source_artist")}
    return tracks.withColumns({f"n_{k}": T.nfkc(v) for k, v in (named | listed | facts).items()})


def _same(a: Column, b: Column) -> Column:
    return T.comparable(a) == T.comparable(b)


def _list_key(values: Column) -> Column:
    return F.filter(F.transform(values, T.comparable), lambda x: x != "")


def audit_findings(tracks: DataFrame) -> DataFrame:
    """(album_path, idx, field, status, suggestion, eligible): at most one finding for each track and field.

    ``tracks``: album_path, idx, filename, title, artist, artists, album, album_artist, album_artists, year,
    track_number, track_total, disc_number, artist_hint, album_hint, disc_folder. Nulls are absent tags; an empty
    table has no findings. Album sizes are counted before the join, so no window holds an album's rows.
    """
    sizes = tracks.groupBy(F.col("album_path").alias("_path")).agg(F.count("*").cast("int").alias("n_tracks"))
    rows = tracks.join(sizes, F.col("album_path").eqNullSafe(F.col("_path"))).drop("_path")
    rows = rows.withColumn("facts", T.file_facts(F.col("filename")))
    rows = rows.withColumn("expected_album", F.coalesce(T.folder_album(F.col("album_hint"), F.col("artist_hint")), F.lit("")))
    many = lambda c: F.when(F.size(N.split_names(c)) >= 2, c)
    rows = rows.withColumn("source_artist", F.coalesce(many(F.col("facts.artist")), many(F.col("artist")), F.col("facts.artist"), F.col("artist")))
    rows = _text_columns(rows)

    hint = T.collapse(F.coalesce(F.col("n_artist_hint"), F.lit("")))
    hinted = N.split_names(hint)
    obvious = F.col("album_artist").isNull() & _same(F.col("n_artist"), hint)
    by_hint = (hint != "") & ~obvious
    listed = lambda c: F.filter(F.split(F.col(c), "\x1f"), lambda x: x != "")
    artists, album_artists = listed("n_artists"), listed("n_album_artists")

    source = F.col("source_artist")
    expected = N.split_names(source)
    sure = source.rlike(r"(?iU)\s+(?:feat\.?|ft\.?|featuring)\s+|[&;；、，＋+·‧]") | source.rlike(f"{T.CJK}\\.{T.CJK}")
    only = F.get(artists, F.lit(0))
    replaceable = (F.size(artists) == 0) | (
        (F.size(artists) == 1) & (_same(only, F.col("n_source_artist")) | (F.col("facts.artist").isNotNull() & _same(only, F.col("n_artist"))))
    )
    fix_artists = sure & replaceable
    year = T.folder_year(F.col("album_hint"))
    folder_disc = T.extract(T.trim(F.coalesce("disc_folder", "album_hint")), r"(?i)^(?:cd|disc|disk)\s*(\d{1,2})$").cast("int")
    disc = F.coalesce(F.col("facts.disc"), folder_disc)
    number, total = F.col("facts.track"), F.when(F.col("n_tracks") > 1, F.col("n_tracks"))

    def rule(field: str, condition: Column, suggestion: Column, eligible: Column = F.lit(True)) -> Column:  # noqa: B008
        status = F.when(eligible, "error").otherwise("warning")
        return F.when(condition, F.struct(F.lit(field).alias("field"), status.alias("status"), suggestion.cast("string").alias("suggestion"), eligible.alias("eligible")))

    rules = [
        rule("album", (F.col("expected_album") != "") & ~_same(F.col("n_album"), F.col("n_expected_album")), F.col("expected_album")),
        rule("albumArtist", by_hint & ~_same(F.col("n_album_artist"), hint), hint),
        rule("albumArtists", by_hint & (F.size(album_artists) > 0) & (F.size(hinted) > 0) & (_list_key(album_artists) != _list_key(hinted)), F.array_join(hinted, ", ")),
        rule("title", F.col("facts.title").isNotNull() & ~_same(F.col("n_title"), F.col("n_fact_title")), F.col("facts.title")),
        rule("artist", F.col("facts.artist").isNotNull() & ~_same(F.col("n_artist"), F.col("n_fact_artist")), F.col("facts.artist")),
        rule("artists", (F.size(expected) >= 2) & (_list_key(artists) != _list_key(N.split_names(F.col("n_source_artist")))), F.array_join(expected, ", "), F.coalesce(fix_artists, F.lit(False))),
        rule("year", year.isNotNull() & (T.comparable(F.col("n_year")) != year), year),
        rule("trackNumber", number.isNotNull() & ~F.col("track_number").eqNullSafe(number), number),
        rule("trackTotal", F.col("track_number").eqNullSafe(number) & number.isNotNull() & total.isNotNull() & ~F.col("track_total").eqNullSafe(total), total),
        rule("discNumber", disc.isNotNull() & ~F.col("disc_number").eqNullSafe(disc), disc),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select("album_path", "idx", F.inline(found))


def merge_findings(rule_based: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """Reviewed findings replace rule-based ones of the same key, unless the latter can be applied without review."""
    left = rule_based.join(reviewed.select(*key), key, "left_anti").unionByName(rule_based.filter("eligible").join(reviewed.select(*key), key, "left_semi"))
    return left.unionByName(reviewed, allowMissingColumns=True)


def review_results(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(index, field, ...) of a review: correct rows go, confidence is held to 0..1 (NaN: 0), and a correction counts as
    eligible if its row was asked for, it says so with 0.92 at least, and it touches its own field only.

    ``results``: index, field, status, message, confidence, corrected (map of field to value).
    """
    asked = targets.select("index", "field").distinct().withColumn("asked", F.lit(True))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))))
    own = F.map_filter("corrected", lambda k, v: k == F.col("field"))
    alone = (F.size("corrected") == 1) & (F.size(own) == 1)
    return (
        results.filter(~F.col("status").eqNullSafe("correct"))
        .join(asked, ["index", "field"], "left")
        .withColumn("confidence", sure)
        .withColumn("eligible", F.coalesce(F.col("asked") & alone & (sure >= 0.92), F.lit(False)))
        .withColumn("corrected", own)
        .drop("asked")
    )
