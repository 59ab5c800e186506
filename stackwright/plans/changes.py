"""Planned changes: from tracks and wanted values to rows of actions, and the checks before and after they apply.

Actions are long rows (path, field, old_value, new_value, operation), so that "remove" and "leave alone" stay apart:
a removal is a row with a null new_value, a field that isn't touched has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pipeline import pipeline


def long_fields(rows: DataFrame, keys: list[str], fields: list[str], value: str) -> DataFrame:
    """(keys, field, value): each of ``fields`` as text; arrays are joined by "; ", empty ones are null."""
    types = dict(rows.dtypes)

    def as_text(name: str) -> Column:
        if types[name].startswith("array"):
            return F.nullif(F.array_join(F.col(name), "; "), F.lit(""))
        return F.col(name).cast("string")

    each = F.array(*[F.struct(F.lit(f).alias("field"), as_text(f).alias(value)) for f in fields])
    return rows.select(*keys, F.inline(each))


def changes(wanted: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Actions where ``wanted`` (keys, new_value) differs from ``current`` (keys, old_value), null-safe; blanks remove."""
    new = F.when(~T.missing(F.col("new_value")), F.col("new_value"))
    rows = wanted.withColumn("new_value", new).join(current, keys, "left")
    differs = ~F.col("new_value").eqNullSafe(F.col("old_value"))
    return rows.filter(differs).select(*keys, "old_value", "new_value", F.when(F.col("new_value").isNull(), "remove").otherwise("set").alias("operation"))


def patch(tracks: DataFrame, scope: Column, values: dict[str, str | None], only_if_missing: bool = False) -> DataFrame:
    """Actions that give each track of ``scope`` the same values; one pass, no join."""
    fields = list(values)
    current = long_fields(tracks.filter(scope), ["path"], fields, "old_value")
    new = F.coalesce(*[F.when(F.col("field") == f, F.lit(v)) for f, v in values.items()]).cast("string")
    rows = current.withColumn("new_value", F.when(~T.missing(new), new))
    if only_if_missing:
        rows = rows.filter(T.missing(F.col("old_value")))
    operation = F.when(F.col("new_value").isNull(), "remove").otherwise("set")
    return rows.filter(~F.col("new_value").eqNullSafe(F.col("old_value"))).withColumn("operation", operation)


def transform(tracks: DataFrame, source: Column, field: str, operations: list[tuple[str, dict]]) -> DataFrame:
    """Actions that set ``field`` to the pipeline of ``source``; rows without a source, a change or a result are left."""
    result = tracks.select("path", F.col(field).cast("string").alias("old_value"), source.alias("_source")).withColumn("_r", pipeline(F.col("_source"), operations))
    new = F.col("_r.value")
    fine = F.col("_r.changed") & ~T.missing(new) & ~new.eqNullSafe(F.col("old_value"))
    return result.filter(fine).select("path", F.lit(field).alias("field"), "old_value", new.alias("new_value"), F.lit("set").alias("operation"))


def transform_counts(tracks: DataFrame, source: Column, field: str, operations: list[tuple[str, dict]]) -> DataFrame:
    """One row: how many tracks change, and why the others don't (no source, no match, blank result, equal already)."""
    r = pipeline(source, operations)
    rows = tracks.select(F.col(field).cast("string").alias("old"), source.alias("s"), r.alias("r"))
    why = (
        F.when(T.missing(F.col("s")), "missing_source").when(~F.col("r.changed"), "unmatched").when(T.missing(F.col("r.value")), "blank")
        .when(F.col("r.value").eqNullSafe(F.col("old")), "equal").otherwise("changed")
    )
    return rows.select(why.alias("why")).agg(*[F.count_if(F.col("why") == w).alias(w) for w in ("changed", "missing_source", "unmatched", "blank", "equal")])


def merge_patches(actions: DataFrame) -> DataFrame:
    """The last action (by ord) of each path and field; the old value is the first one's."""
    return actions.groupBy("path", "field").agg(F.min_by("old_value", "ord").alias("old_value"), F.max_by("new_value", "ord").alias("new_value"), F.max_by("operation", "ord").alias("operation"))


def stale(actions: DataFrame, now: DataFrame) -> DataFrame:
    """Actions whose track has gone or whose old value isn't what ``now`` (path, field, value) says: preflight."""
    there = now.select("path", "field", F.col("value").alias("_now"), F.lit(True).alias("_there"))
    return actions.join(there, ["path", "field"], "left").filter(F.col("_there").isNull() | ~F.col("old_value").eqNullSafe(F.col("_now"))).drop("_now", "_there")


def unverified(actions: DataFrame, readback: DataFrame) -> DataFrame:
    """Actions whose new value isn't found in ``readback`` (path, field, value) after they applied."""
    there = readback.select("path", "field", F.col("value").alias("_now"))
    return actions.join(there, ["path", "field"], "left").filter(~F.col("new_value").eqNullSafe(F.col("_now"))).drop("_now")


def uniform_literals(actions: DataFrame) -> DataFrame:
    """Fields that get one and the same value across several folders: (field, n_paths, n_folders)."""
    found = actions.groupBy("field").agg(F.countDistinct("new_value").alias("values"), F.countDistinct(T.parent(F.col("path"))).alias("n_folders"), F.countDistinct("path").alias("n_paths"))
    return found.filter("values = 1 AND n_folders > 1").select("field", "n_paths", "n_folders")


def number_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks numbered within (album, disc) by their number (nulls last), then path: path, number, total, disc, discs.

    ``tracks``: path, album, album_artist, album_artists, track_number, disc_number. Without an album the folder is one.
    """
    artist = F.coalesce(F.when(~T.missing(F.col("album_artist")), F.col("album_artist")), F.get("album_artists", F.lit(0)), F.lit(""))
    key = F.when(T.missing(F.col("album")), F.lower(T.parent(F.col("path")))).otherwise(F.concat(F.lower(T.trim(artist)), F.lit("\0"), F.lower(T.trim("album"))))
    disc = F.greatest(F.coalesce("disc_number", F.lit(1)), F.lit(1))
    keyed = tracks.select("path", "track_number", key.alias("_key"), disc.alias("disc"))
    # Totals are counted apart, so that only the numbering itself is a window.
    per_disc = keyed.groupBy("_key", "disc").agg(F.count("*").alias("total"))
    per_album = keyed.groupBy("_key").agg(F.max("disc").alias("discs"))
    place = Window.partitionBy("_key", "disc").orderBy(F.asc_nulls_last("track_number"), "path")
    return keyed.withColumn("number", F.row_number().over(place)).join(per_disc, ["_key", "disc"]).join(per_album, "_key").select("path", "number", F.col("total").cast("int").alias("total"), "disc", "discs")


RULES = {
    "filename": (lambda: F.lower(T.basename(F.col("path"))), lambda: F.lower(T.basename(F.col("path")))),
    "title": (lambda: F.lower(F.coalesce("title", T.basename(F.col("path")))),) * 2,
    "existing": (lambda: F.coalesce("track_number", F.lit(9999)), lambda: F.coalesce("track_number", F.lit(-1))),
    "duration": (lambda: F.coalesce("duration", F.lit(0.0)),) * 2,
}


def number_by_rule(tracks: DataFrame, group: list[str], rule: str, start: int = 1) -> DataFrame:
    """``tracks`` with number, in one of eight orders: filename, title, existing or duration, with -asc or -desc.

    Ties go by file name. A null title counts as the file name, a null number comes last in either order.
    """
    name, _, way = rule.rpartition("-")
    ascending = way == "asc"
    key = RULES[name][0 if ascending else 1]()
    order = [key.asc() if ascending else key.desc(), F.lower(T.basename(F.col("path"))), F.col("path")]
    return tracks.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (start - 1))


def with_suffixes(moves: DataFrame, existing: DataFrame, most: int = 1 << 30) -> DataFrame:
    """(source, target, final): targets that are taken, or wanted twice, get _1, _2, ... before their extension.

    ``moves``: source, target, ord; ``existing``: path. A first-come target that is free stays as it is. The names
    that exist (``name_7``) and names that moves ask for by themselves are left out of the numbers given, set-based: the
    k-th late-comer takes the k-th free number.
    """
    base = F.regexp_replace("target", r"(?<=[^/])\.[^./]+$", "")
    suffix = F.substr(F.col("target"), F.length(base) + 1)
    taken = existing.select(F.col("path").alias("_name")).distinct()
    wanted = moves.select("source", "target", "ord", base.alias("_base"), suffix.alias("_ext"))
    here = taken.withColumn("_taken", F.lit(1))
    ranked = wanted.withColumn("_rank", F.row_number().over(Window.partitionBy("target").orderBy("ord", "source")) - 1)
    ranked = ranked.join(here, F.col("target") == F.col("_name"), "left").withColumn("_late", F.col("_rank") + F.coalesce("_taken", F.lit(0))).drop("_name", "_taken")
    # Numbers in use behind the same base and extension: of files there, and of targets asked for.
    names = taken.unionByName(moves.select(F.col("target").alias("_name"))).distinct()
    name_base = F.regexp_replace("_name", r"(?<=[^/])\.[^./]+$", "")
    used = names.select(F.regexp_extract(name_base, r"^(.*)_([1-9]\d{0,8})$", 1).alias("_base"), F.regexp_extract(name_base, r"_([1-9]\d{0,8})$", 1).try_cast("int").alias("_n"), F.substr(F.col("_name"), F.length(name_base) + 1).alias("_ext"))
    used = used.filter(F.col("_n").isNotNull()).groupBy("_base", "_ext").agg(F.sort_array(F.collect_set("_n")).alias("_used"))

    def free(late: Column, used_numbers: Column) -> Column:
        # Each used number up to the answer moves it on by one.
        return F.aggregate(F.coalesce(used_numbers, F.array().cast("array<int>")), late, lambda n, u: F.when(u <= n, n + 1).otherwise(n))

    final = F.when(F.col("_late") == 0, F.col("target")).otherwise(F.concat("_base", F.lit("_"), free(F.col("_late"), F.col("_used")).cast("string"), "_ext"))
    return ranked.join(used, ["_base", "_ext"], "left").select("source", "target", final.alias("final"))


def relocations(tracks: DataFrame, root: str, segments: list[Column], existing: DataFrame) -> DataFrame:
    """Moves of tracks to root/segment/.../file name; blank segments become Unknown, collisions get suffixes."""
    parts = [F.coalesce(F.nullif(T.safe_name(s), F.lit("")), F.lit("Unknown")) for s in segments]
    target = F.concat_ws("/", F.lit(root.rstrip("/")), *parts, T.basename(F.col("path")))
    moves = tracks.select(F.col("path").alias("source"), target.alias("target"), F.col("path").alias("ord")).filter("source <> target")
    return with_suffixes(moves, existing)
