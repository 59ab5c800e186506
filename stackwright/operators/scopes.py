"""Scopes, filters, orders and pages over track rows: predicates as Columns, lookups as semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from .catalog import duplicate_members

# Limits of pages, (default, most).
PAGES = {"search": (20, 100), "inspect": (20, 500), "lookup": (5, 25)}
EVIDENCE_LETTERS = 8000
UNDO_DEPTH = 20
NUMBER_FIELDS = ["trackNumber", "trackTotal", "discNumber", "discTotal"]
LIST_FIELDS = ["artists", "albumArtists"]


# Scopes


def search(title: str = "", artist: str = "", album: str = "", genre: str = "", codec: str = "", year: str | None = None, missing: tuple[str, ...] = (), missing_cover: bool = False) -> Column:
    """The AND of all conditions that are given: texts held whatever their case, the exact year, blank fields, no cover."""
    tests = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(v.lower()) for c, v in (("title", title), ("artist", artist), ("album", album), ("genre", genre), ("codec", codec)) if v]
    tests += [F.col("year").eqNullSafe(year)] if year is not None else []
    tests += [T.missing(F.col(c)) for c in missing] + ([F.col("has_cover").eqNullSafe(F.lit(False))] if missing_cover else [])
    whole = F.lit(True)
    for test in tests:
        whole = whole & test
    return whole


def search_tracks(tracks: DataFrame, has_duplicates: bool = False, **conditions) -> DataFrame:
    """Tracks that meet search()'s ``conditions``; ``has_duplicates``: and that share title, artist and album with another of all ``tracks``."""
    held = duplicate_members(tracks, ["title", "artist", "album"]) if has_duplicates else tracks
    return held.filter(search(**conditions))


def of_album_prefix(album: str) -> Column:
    """Paths that begin with the album's, letter by letter: /a/b also takes /a/bc."""
    return F.col("path").startswith(album)


def of_folder(album: str) -> Column:
    """Paths at or below a folder, by whole parts."""
    return T.inside(F.col("path"), F.lit(album))


def of_listed_folder(album: str) -> Column:
    """Paths at or below a folder as written, back slashes as slashes and none at the end."""
    folder, path = album.replace("\\", "/").rstrip("/"), T.posix(F.col("path"))
    return (path == folder) | path.startswith(folder + "/")


def missing_in(field: str, album: str | None = None) -> Column:
    """Rows that lack a field, in the library or in an album (by prefix)."""
    return T.missing(F.col(field)) & (of_album_prefix(album) if album is not None else F.lit(True))


def referent(query: str, field: str) -> Column:
    """What "them" stands for after a query: the rows that lacked a field if it asked for missing ones, else no rows."""
    return missing_in(field) if "missing" in query.lower() else F.lit(False)


def active(tracks: DataFrame, selected: DataFrame | None, album: str | None) -> DataFrame:
    """The selected tracks if there are any; else those directly in the active album; else all."""
    if selected is not None and not selected.isEmpty():
        return tracks.join(selected.select("path"), "path", "left_semi")
    return tracks if album is None else tracks.filter(T.parent(F.col("path")) == album)


def explicit(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tracks of ``wanted`` (path, ord) with their place ``wanted_ord``; paths that aren't there are left out."""
    return tracks.join(wanted.select("path", F.col("ord").alias("wanted_ord")), "path")


def scope_errors(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, problem) of an explicit scope: asked for twice, unknown, or loaded twice."""
    asked = wanted.groupBy("path").agg(F.count("*").alias("asked"))
    there = tracks.groupBy("path").agg(F.count("*").alias("loaded"))
    why = F.when(F.col("asked") > 1, "duplicate").when(F.col("loaded").isNull(), "unknown").when(F.col("loaded") > 1, "ambiguous")
    return asked.join(there, "path", "left").select("path", why.alias("problem")).filter("problem IS NOT NULL")


def with_album_info(albums: DataFrame, info: DataFrame) -> DataFrame:
    return albums.join(info, "path", "left")


def album_paths(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """(path, ord): the folders of the given tracks (path, ord) in the order they come up; without tracks the given albums."""
    by_track = tracks.groupBy(T.parent(F.col("path")).alias("path")).agg(F.min("ord").alias("ord"))
    if not tracks.isEmpty():
        return by_track
    if albums.isEmpty():
        raise ValueError("neither tracks nor albums are given")
    return albums.select("path", "ord")


# Filters of lists


def grid_text(wanted: str) -> Column:
    """A text in title, artist, album or the last four parts of the path, whatever its case."""
    texts = (F.coalesce("title", F.lit("")), F.coalesce("artist", F.lit("")), F.coalesce("album", F.lit("")), T.short_path(F.col("path")))
    return F.array_max(F.array(*[F.lower(t).contains(wanted.lower()) for t in texts]))


def extra_tag_text(wanted: str) -> Column:
    """Of rows key, value, source: a text in any of them, whatever its case."""
    return F.array_max(F.array(*[F.lower(F.col(c)).contains(wanted.strip().lower()) for c in ("key", "value", "source")]))


def key_suggestions(known: DataFrame, used: DataFrame, wanted: str = "", most: int = 8) -> DataFrame:
    """The first keys of ``known`` (key, ord) that aren't used and hold a text, whatever their case: a list to choose from."""
    free = known.withColumn("_k", F.upper("key")).join(used.select(F.upper("key").alias("_k")), "_k", "left_anti")
    return free.filter(F.col("_k").contains(wanted.strip().upper())).orderBy("ord").limit(most).select("key")


def release_title(wanted: str) -> Column:
    return F.lower(T.nfkc(F.col("title"))).contains(wanted.lower())


def fits_album(hint: Column, album_id: Column) -> Column:
    """Of candidates: found by the id that the tags hold, or without a name to compare, or of a matching name."""
    by_id = F.coalesce(F.col("musicbrainz_album_id") == album_id, F.lit(False))
    return by_id | hint.isNull() | F.col("album").isNull() | N.albums_match(hint, F.col("album"))


def without_dataset(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~F.col("source").eqNullSafe("dataset"))


def pool(fresh: DataFrame, folder: DataFrame, cached: DataFrame) -> DataFrame:
    """All candidates but those of the data set: fresh ones first, then the folder's, then cached ones; ``ord`` says so."""
    sides = [side.withColumn("ord", F.struct(F.lit(k).alias("side"), F.col("ord").alias("ord"))) for k, side in enumerate((fresh, folder, cached))]
    return without_dataset(sides[0].unionByName(sides[1]).unionByName(sides[2]))


def of_disc(tracks: Column, disc: Column, n_local: Column) -> Column:
    """The tracks of the wanted disc if they are as many as the local ones, else all."""
    scoped = F.filter(tracks, lambda t: t["disc_number"] == disc)
    return F.when((F.size(scoped) > 0) & (F.size(scoped) == n_local), scoped).otherwise(tracks)


def is_writable() -> Column:
    """Whether a candidate's track has any field of its own to write."""
    own = ["title", "artist", "track_number", "track_total", "disc_number", "disc_total", "musicbrainz_track_id"]
    return F.coalesce(*[F.col(c).cast("string") for c in own]).isNotNull() | (F.coalesce(F.size("artists"), F.lit(0)) > 0)


def review_targets(findings: DataFrame, tracks: DataFrame) -> DataFrame:
    """(album_path, idx, field): findings that can't be applied as they are, and genres that lack or differ in an album.

    ``findings``: album_path, idx, field, eligible; ``tracks``: album_path, idx, genre. Genres are told apart by an
    aggregate of the album's least and greatest, so no album is one row.
    """
    asked = findings.filter(~F.col("eligible")).select("album_path", "idx", "field")
    named = tracks.withColumn("_g", T.comparable(T.nfkc(F.coalesce("genre", F.lit("")))))
    filled = F.when(F.col("_g") != "", F.col("_g"))
    albums = named.groupBy(F.col("album_path").alias("_path")).agg((F.min(filled) != F.max(filled)).alias("_differ"))
    unsure = named.join(albums, F.col("album_path").eqNullSafe(F.col("_path"))).filter(F.col("genre").isNull() | F.coalesce("_differ", F.lit(False)))
    return asked.unionByName(unsure.select("album_path", "idx", F.lit("genre").alias("field"))).distinct()


def typed_value(field: Column, text: Column) -> Column:
    """struct(list, number, flag, text) with the part filled that a field's type asks for."""
    listed = F.filter(F.transform(F.split(text, ";"), T.trim), lambda v: v != "")
    flag = F.lower(T.trim(text))
    is_list, is_number, is_flag = field.isin(LIST_FIELDS), field.isin(NUMBER_FIELDS), field == "compilation"
    return F.struct(
        F.when(is_list, listed).alias("list"), F.when(is_number, T.trim(text).try_cast("int")).alias("number"),
        F.when(is_flag, F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False)).alias("flag"), F.when(~is_list & ~is_number & ~is_flag, text).alias("text"),
    )


# Orders, pages and reports of bounded size


GRID_KEYS = {
    "filename": lambda: T.short_path(F.col("path")),
    "track": lambda: F.coalesce("track_number", F.lit(999)),
    "duration": lambda: F.col("duration"),
    "bitrate": lambda: F.coalesce("bitrate", F.lit(0.0)),
} | {k: (lambda c=c: F.coalesce(c, F.lit(""))) for k, c in {"title": "title", "artist": "artist", "albumArtist": "album_artist", "album": "album", "year": "year", "genre": "genre"}.items()}


def grid_sorted(tracks: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Tracks by one of ten keys; ties keep the order of ``ord`` both ways."""
    column = GRID_KEYS[key]()
    return tracks.orderBy(column.asc() if ascending else column.desc(), F.col("ord").asc())


def page_of(rows: DataFrame, order: list, kind: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of a kind (PAGES); limits are held between 1 and the kind's most."""
    usual, most = PAGES[kind]
    return rows.orderBy(*order).offset(max(0, round(offset))).limit(min(most, max(1, usual if limit is None else limit)))


def page_facts(rows: DataFrame, kind: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One row: total, and next_offset (null on the last page)."""
    usual, most = PAGES[kind]
    end = max(0, round(offset)) + min(most, max(1, usual if limit is None else limit))
    return rows.agg(F.count("*").alias("total")).withColumn("next_offset", F.when(F.col("total") > end, F.lit(end).cast("long")))


def release_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page counted from 1."""
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def release_page_facts(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One row: whether a page follows, and the number of pages, 1 at least."""
    n = F.count("*")
    return rows.agg((n > max(1, page) * size).alias("has_next"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("pages"))


def preview_examples(rows: DataFrame, by: list[str], value: str, most: int = 5) -> DataFrame:
    """The first distinct values of each group in order, and how many more there are. Values are ranked, not gathered."""
    distinct = rows.filter(F.col(value).isNotNull()).select(*by, value).distinct()
    counts = distinct.groupBy(*by).agg(F.count("*").alias("n_values"))
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value))).filter(F.col("_r") <= most)
    first = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("examples"))
    return first.join(counts, by).withColumn("more", F.greatest(F.lit(0), F.col("n_values") - most).cast("long")).drop("n_values")


def latest_sessions(log: DataFrame, most: int) -> DataFrame:
    """The sessions with the newest entries: conv_id and last_id. A list of ``most``."""
    return log.groupBy("conv_id").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id")).limit(most)


def undo_stack(actions: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """The newest actions by ord, which is what can be undone."""
    return actions.orderBy(F.desc("ord")).limit(depth)


def evidence(text: Column) -> Column:
    return F.substring(text, 1, EVIDENCE_LETTERS)
