"""Planned edits of tags and files, beside those in ``changes``: each gives action rows and touches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import patterns as P
from ..functions import text as T
from ..functions.pipeline import pipeline
from . import changes

# Fixed values.
MIB = 1024 * 1024
PER_TRACK = ["title", "trackNumber", "musicbrainz_track_id"]
NO_EXTENSION = "no-extension"


def _set(rows: DataFrame, field: str) -> DataFrame:
    """Actions of rows (path, old_value, new_value) whose new value is filled and another."""
    fine = ~T.missing(F.col("new_value")) & ~F.col("new_value").eqNullSafe(F.col("old_value"))
    return rows.filter(fine).select("path", F.lit(field).alias("field"), "old_value", "new_value", F.lit("set").alias("operation"))


def patch_each(tracks: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """Actions of values given for single tracks (path, field, new_value); paths out of scope are left to outside()."""
    return changes.changes(wanted.join(tracks.select("path"), "path", "left_semi"), changes.long_fields(tracks, ["path"], fields, "old_value"), ["path", "field"])


def outside(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths that a plan names and its scope doesn't hold: any row stops the plan."""
    return wanted.select("path").distinct().join(tracks.select("path"), "path", "left_anti")


def edit(tracks: DataFrame, scope: Column, values: dict[str, str | None]) -> DataFrame:
    """patch() of several fields at once; fields of single tracks aren't set over many tracks."""
    own = [f for f in values if f in PER_TRACK]
    if own and tracks.filter(scope).limit(2).count() > 1:
        raise ValueError(f"{own[0]} differs from track to track")
    return changes.patch(tracks, scope, values)


def extract_value(tracks: DataFrame, field: str, pattern: str, group: int = 1) -> DataFrame:
    """Actions that leave of a field what a group of a pattern takes."""
    rows = tracks.select("path", F.col(field).alias("old_value"), T.trim(T.extract(F.col(field), pattern, group)).alias("new_value"))
    return _set(rows, field)


def strip_title_numbers(tracks: DataFrame) -> DataFrame:
    return _set(tracks.select("path", F.col("title").alias("old_value"), N.without_title_number(F.col("title")).alias("new_value")), "title")


def infer_tags(tracks: DataFrame) -> DataFrame:
    """Artist and title from file names, where the tags lack them."""
    told = tracks.select("path", "artist", "title", N.told_by_file(F.col("path")).alias("_t")).filter("_t IS NOT NULL")
    sides = [told.filter(T.missing(F.col(f))).select("path", F.lit(f).alias("field"), F.col(f).alias("old_value"), F.col(f"_t.{f}").alias("new_value"), F.lit("set").alias("operation")) for f in ("artist", "title")]
    return sides[0].unionByName(sides[1])


def convert_script(tracks: DataFrame, fields: list[str], way: str = "simplified") -> DataFrame:
    """Actions that write texts in simplified or traditional letters."""
    convert = {"simplified": T.simplified, "traditional": T.traditional}[way]
    rows = changes.long_fields(tracks, ["path"], fields, "old_value").withColumn("new_value", convert(F.col("old_value")))
    return rows.filter(~T.missing(F.col("new_value")) & (F.col("new_value") != F.col("old_value"))).withColumn("operation", F.lit("set"))


def number_actions(numbered: DataFrame, tracks: DataFrame) -> DataFrame:
    """Actions from changes.number_tracks(): of four fields, those that change."""
    fields = {"track_number": "number", "track_total": "total", "disc_number": "disc", "disc_total": "discs"}
    wanted = changes.long_fields(numbered.select("path", *[F.col(v).alias(k) for k, v in fields.items()]), ["path"], list(fields), "new_value")
    return changes.changes(wanted, changes.long_fields(tracks, ["path"], list(fields), "old_value"), ["path", "field"])


def remove_covers(tracks: DataFrame) -> DataFrame:
    return tracks.filter("has_cover").select("path", F.lit("cover").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit("remove").alias("operation"))


# Files


def _moves(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """with_suffixes() of rows (path, target) that move at all."""
    moving = rows.filter("target IS NOT NULL AND target <> path").select(F.col("path").alias("source"), "target", F.col("path").alias("ord"))
    return changes.with_suffixes(moving, existing)


def rename(tracks: DataFrame, operations: list[tuple[str, dict]], existing: DataFrame) -> DataFrame:
    """Renames files by a pipeline over their stems; names that leave their folder, or nothing of them, are left out."""
    done = pipeline(T.stem(F.col("path")), operations)
    rows = tracks.select("path", done.alias("r"))
    name = T.safe_name(F.col("r.value"))
    suffix = F.regexp_extract(T.basename(F.col("path")), r"(?<=.)(\.[^.]*)$", 1)
    target = F.concat(T.parent(F.col("path")), F.lit("/"), name, suffix)
    return _moves(rows.filter(F.col("r.changed") & (name != "") & ~F.col("r.value").contains("/")).select("path", target.alias("target")), existing)


def strip_file_numbers(tracks: DataFrame, existing: DataFrame) -> DataFrame:
    name = N.without_file_number(T.basename(F.col("path")))
    return _moves(tracks.filter(name != "").select("path", F.concat(T.parent(F.col("path")), F.lit("/"), name).alias("target")), existing)


def size_bucket(size: Column) -> Column:
    return F.when(size < 10 * MIB, "small").when(size < 100 * MIB, "medium").when(size < 1024 * MIB, "large").otherwise("huge")


def organize(files: DataFrame, root: str, by: str, existing: DataFrame, pattern: str = "*", extensions: list[str] | None = None) -> DataFrame:
    """Moves of files (path, size_bytes, modified) below root by extension, pattern, month or size."""
    extension = F.coalesce(F.nullif(T.extension(F.col("path")), F.lit("")), F.lit(NO_EXTENSION))
    folder = {
        "extension": F.when(extension.isin(extensions), extension) if extensions is not None else extension,
        "pattern": F.when(P.like_glob(T.basename(F.col("path")), pattern), F.lit("")),
        "month": F.date_format("modified", "yyyy-MM") if "modified" in files.columns else F.lit(None),
        "size": size_bucket(F.col("size_bytes")) if "size_bytes" in files.columns else F.lit(None),
    }[by]
    base = F.when(folder == "", F.lit(root.rstrip("/"))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), folder))
    return _moves(files.select("path", F.concat(base, F.lit("/"), T.basename(F.col("path"))).alias("target")), existing)


def file_actions(paths: DataFrame, kind: str) -> DataFrame:
    """Rows for a deletion, or for a task over files: path and operation; each path once."""
    return paths.select("path").distinct().withColumn("operation", F.lit(kind))


# Applying what was found


def apply_candidate(files: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """(path, field, new_value, operation): an album's fields on all its files, a candidate's tracks on those of their place.

    ``files``: album_path, idx, path. ``albums``: album_path, album, album_artists, year, genre and four ids. ``tracks``:
    album_path, idx and track fields. A null year, genre or number leaves the file's alone; a null album, id, title or artist
    removes it. Album artists fall back on the folder above; a candidate's empty track touches no track field.
    """
    artists = F.when(F.size("album_artists") > 0, F.col("album_artists")).otherwise(F.array(T.basename(T.parent(F.col("album_path")))))
    of_album = albums.select("album_path", artists.alias("_artists"), *[c for c in albums.columns if c not in ("album_path", "album_artists")])

    def value(field: str, column: Column, removes: bool) -> Column:
        text = column.cast("string")
        return F.struct(F.lit(field).alias("field"), text.alias("new_value"), F.when(text.isNotNull(), "set").when(F.lit(removes), "remove").alias("operation"))

    shared = [value("album_artist", F.array_join("_artists", " & "), False), value("album_artists", F.array_join("_artists", "; "), False), value("album", F.col("album"), True)]
    shared += [value(f, F.col(f), False) for f in ("year", "genre")]
    shared += [value(f, F.col(f), True) for f in ("musicbrainz_album_id", "musicbrainz_artist_id", "discogs_release_id", "discogs_artist_id")]
    own = [value(f, F.col(f), True) for f in ("title", "artist")] + [value("artists", F.nullif(F.array_join("artists", "; "), F.lit("")), False)]
    own += [value(f, F.col(f), False) for f in ("track_number", "track_total", "disc_number", "disc_total", "musicbrainz_track_id")]
    numbers = ["title", "artist", "track_number", "track_total", "disc_number", "disc_total", "musicbrainz_track_id"]
    writable = F.coalesce(*[F.col(c).cast("string") for c in numbers]).isNotNull() | (F.coalesce(F.size("artists"), F.lit(0)) > 0)
    rows = files.join(of_album, "album_path").select("path", F.inline(F.array(*shared)))
    placed = files.join(tracks, ["album_path", "idx"]).filter(writable).select("path", F.inline(F.array(*own)))
    return rows.unionByName(placed).filter("operation IS NOT NULL")


def rejected_candidates(requests: DataFrame) -> DataFrame:
    """(album_path, problem) of requests (album_path, n_local, n_remote, least_idx, largest_idx) that can't be applied."""
    wrong = F.when(F.col("n_local") != F.col("n_remote"), "track_count").when((F.col("least_idx") < 0) | (F.col("largest_idx") >= F.col("n_remote")), "index")
    return requests.select("album_path", wrong.alias("problem")).filter("problem IS NOT NULL")


def apply_audit(findings: DataFrame) -> DataFrame:
    """Actions of findings (path, field, old_value, suggestion, corrected, eligible, auto_fixed) that need no review."""
    new = F.coalesce("corrected", "suggestion")
    fine = F.col("eligible") & ~F.coalesce("auto_fixed", F.lit(False)) & new.isNotNull() & ~new.eqNullSafe(F.col("old_value"))
    return findings.filter(fine).select("path", "field", "old_value", new.alias("new_value"), F.lit("set").alias("operation"))


def apply_pattern(tracks: DataFrame, pattern: str) -> DataFrame:
    """Actions of the fields that a template reads from file names."""
    fields = [f for f in P.template_regex(pattern)[1] if f not in ("ext", "filename")]
    column = {"track": "track_number", "disc": "disc_number", "albumArtist": "album_artist"}
    found = tracks.select("path", P.parse_filename(pattern, T.basename(F.col("path"))).alias("_m"), *[F.col(column.get(f, f)).cast("string").alias(f"_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("old_value"), F.try_element_at("_m", F.lit(f)).alias("new_value")) for f in fields])
    rows = found.filter("_m IS NOT NULL").select("path", F.inline(each))
    return rows.filter("new_value IS NOT NULL AND NOT new_value <=> old_value").withColumn("operation", F.lit("set"))


def extra_tags(rows: DataFrame) -> DataFrame:
    """(path, ord, key, value) as they are written: trimmed, keys canonical, reserved ones left out, each pair once, the first.

    Rows are dealt out before keys are made and pairs are sorted: files of few bytes may hold very many rows of one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = rows.select("path", "ord", "key", T.trim(F.col("value")).alias("value")).filter("value != ''").repartition(n, "path", "value")
    # The key is bound once, however often the conditions name it.
    key = F.filter(F.array(N.extra_key(F.col("key"))), lambda k: (k != "") & (~N.is_reserved_key(k) | (F.upper(k) == "ARTISTS")))
    named = filled.select("path", "value", "ord", F.explode(key).alias("key"))
    first = named.groupBy("path", F.upper("key").alias("_k"), "value").agg(F.min(F.struct("ord", "key")).alias("_f"))
    return first.select("path", "_f.ord", "_f.key", "value")


def add_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """``aliases`` (name, alias) with those of ``wanted`` that are new whatever their case, and aren't the name itself."""
    low = lambda rows: rows.select(F.lower("name").alias("_n"), F.lower("alias").alias("_a"))
    new = wanted.filter(F.lower("name") != F.lower("alias")).withColumns({"_n": F.lower("name"), "_a": F.lower("alias")}).join(low(aliases), ["_n", "_a"], "left_anti")
    return aliases.select("name", "alias").unionByName(new.groupBy("_n", "_a").agg(F.min(F.struct("name", "alias")).alias("f")).select("f.name", "f.alias"))


def expectations(actions: DataFrame) -> DataFrame:
    """(path, field, old_value, expected): what must be read back after the actions; empty lists and removals as null."""
    return actions.select("path", "field", "old_value", F.when(F.col("operation") == "set", F.nullif("new_value", F.lit(""))).alias("expected"))


def write_batches(actions: DataFrame, size: int = 20) -> DataFrame:
    """Each path with its folder and the batch, of ``size`` files, in which the folder's files are written."""
    place = Window.partitionBy("folder").orderBy("path")
    paths = actions.select("path").distinct().withColumn("folder", T.parent(F.col("path")))
    return paths.withColumn("batch", F.floor((F.row_number().over(place) - 1) / size))
