"""What a matched track is called: its own title, its file's, or the release's.

Titles of matched tracks are rewritten where the match tells that they are polluted ("Song (24bit)" of "Song"), stand-ins
("Track 01") or another form of the release's title. Rules apply in a fixed order, the first that fits counts. All rules are
Columns over rows that the alignment paired; both sides come in by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import PROTECTED, _local_forms, _remote_forms, _without_artist

# Separators of an artist before a title, by rank; titles that stand for none; how much more a title must say to be
# polluted; sources whose titles are taken.
SEPARATORS = [" - ", " – ", " — "]
PLACEHOLDER = r"(?iU)^\s*(?:track\s*\d{1,3}|-|n/?a|unknown|untitled)?\s*$"
MORE_CHARS, MORE_SHARE = 3, 0.25
SOURCES = ["musicbrainz", "discogs"]


def is_placeholder(title: Column) -> Column:
    return F.coalesce(title.rlike(PLACEHOLDER), F.lit(True))


def is_polluted(current: Column, wanted: Column) -> Column:
    """Of keys: whether ``current`` goes on after ``wanted`` with something that doesn't make it another recording."""
    extra = T.trim(F.substr(current, F.length(wanted) + 1))
    more = F.length(current) - F.length(wanted)
    words = F.split(T.collapse(extra), " ")
    enough = (more >= MORE_CHARS) | (more >= MORE_SHARE * F.length(current))
    return (F.octet_length(wanted) >= 2) & (current != wanted) & current.startswith(wanted) & (extra != "") & ~F.arrays_overlap(words, F.array(*map(F.lit, PROTECTED))) & enough


def _after_separator(core: Column) -> Column:
    """What follows the last of the first kind of separator that there is; all, without any."""
    found = [F.when(core.contains(s), T.trim(F.substring_index(core, s, -1))) for s in SEPARATORS]
    return F.coalesce(*found, core)


def with_replacement(rows: DataFrame) -> DataFrame:
    """``rows`` (title, remote_title, remote_forms: keys of all the release's titles) with replacement: the clean title, or null."""
    title, remote = T.trim(F.col("title")), T.trim(F.col("remote_title"))
    core = T.trim(F.regexp_extract(title, r"^[^(（]*", 0))
    staged = rows.withColumns({"_title": title, "_remote": remote, "_core": core})
    staged = staged.withColumn("_shown", _after_separator(F.col("_core")))
    staged = staged.withColumn("_other", F.concat("_shown", F.substr(F.col("_title"), F.length("_core") + 1)))
    # One pass through Unicode normalization for all texts of a row.
    texts = ["_title", "_core", "_other", "_shown", "_remote"]
    staged = staged.withColumn("_joined", T.nfkc(F.array_join(F.array(*texts), "\x1f")))
    others = F.coalesce("remote_forms", F.array().cast("array<string>"))

    def found(keys: Column) -> Column:
        key = {c: F.get(keys, F.lit(k)) for k, c in enumerate(texts)}
        forms = F.array_distinct(F.concat(F.array(key["_remote"]), others))

        def replaced(candidate: str, own: str) -> Column:
            clean = F.when(key[own] == key["_remote"], F.col(own)).otherwise(F.col("_remote"))
            return F.when(F.exists(forms, lambda f: is_polluted(key[candidate], f)), clean)

        return F.coalesce(replaced("_title", "_core"), replaced("_other", "_shown"))

    # The keys are bound once, however often the rules name them.
    wanted = F.get(F.transform(F.array(F.transform(F.split("_joined", "\x1f"), T.title_key)), found), F.lit(0))
    there = (F.coalesce(F.col("_title"), F.lit("")) != "") & (F.coalesce(F.col("_remote"), F.lit("")) != "")
    return staged.withColumn("replacement", F.when(there, wanted)).drop(*texts, "_joined")


def _file_title(local: DataFrame) -> DataFrame:
    """(album_id, idx, file_title): what the file's name says without number, artist and annotations; null if nothing."""
    artists = F.array_join(F.concat(F.coalesce("artists", F.array().cast("array<string>")), F.array(F.coalesce("artist", F.lit("")), F.coalesce("artist_hint", F.lit("")))), "\x1f")
    named = local.select("album_id", "idx", T.nfkc(T.trim(T.stem(F.col("filename")))).alias("_f"), T.nfkc(artists).alias("_a"))
    named = named.withColumns({
        "_artists": F.filter(F.transform(F.split("_a", "\x1f"), T.title_key), lambda x: x != ""),
        "_bare": T.trim(F.regexp_replace("_f", r"^\d+[\s.‐‑‒–—―-]*", "")),
    })
    # The kinds of separators by rank, not the first in the text.
    spaced = F.coalesce(*[F.when(F.instr("_bare", s) > 0, F.substr("_bare", F.instr("_bare", s) + len(s))) for s in SEPARATORS])
    has = F.coalesce(*[F.when(F.instr("_bare", s) > 0, F.substring_index("_bare", s, 1)) for s in SEPARATORS])
    parted = F.when((has != "") & (spaced != ""), spaced).when(has.isNull(), _without_artist(F.col("_bare"), F.col("_artists"), last=False))
    named = named.withColumn("_name", T.strip_annotations(F.coalesce(parted, "_bare")))
    return named.select("album_id", "idx", F.nullif("_name", F.lit("")).alias("file_title"))


def rewritten(aligned: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(album_id, idx, evidence, old_title, title, rule): the title of each matched track, and the rule that gave it.

    ``aligned``: rows of ``matching.align_tracks`` of the same ``local`` and ``remote``. Rules, in order: ``other_title`` (the
    match is by another than the release's main title), ``polluted``, ``recording``, ``placeholder``, ``own`` (the tag is the
    main title), ``file``, ``contained``, and ``own`` again. All but ``own`` and ``file`` need a source whose titles are taken.
    """
    ours = _local_forms(local).select("album_id", "idx", "forms")
    all_forms = _remote_forms(remote).select("album_id", F.col("idx").alias("remote_idx"), F.col("variants").alias("remote_forms"))
    main = remote.withColumn("match_titles", F.lit(None).cast("array<string>"))
    main_forms = _remote_forms(main).select("album_id", F.col("idx").alias("remote_idx"), F.col("variants").alias("main_forms"))
    theirs = remote.select("album_id", F.col("idx").alias("remote_idx"), "source", F.col("title").alias("remote_title"))
    keys = ["album_id", "remote_idx"]
    rows = aligned.filter("remote_idx IS NOT NULL").select("album_id", "idx", "remote_idx", "evidence")
    rows = rows.join(local.select("album_id", "idx", "title"), ["album_id", "idx"]).join(ours, ["album_id", "idx"]).join(_file_title(local), ["album_id", "idx"])
    rows = with_replacement(rows.join(theirs, keys).join(all_forms, keys).join(main_forms, keys))
    taken = F.col("source").isin(SOURCES)
    evidence = F.col("evidence")
    matched = F.get(F.filter("forms", lambda f: (f["evidence"] == F.col("evidence")) & F.array_contains(F.col("remote_forms"), f["form"])), F.lit(0))["form"]
    other = evidence.isin("tag_title", "filename_title") & ~F.coalesce(F.array_contains("main_forms", matched), F.lit(True))
    is_main = F.exists("forms", lambda f: (f["evidence"] == "tag_title") & F.array_contains(F.col("main_forms"), f["form"]))
    rules = [
        ("other_title", taken & other, F.coalesce("remote_title", "title")),
        ("polluted", taken & F.col("replacement").isNotNull(), F.col("replacement")),
        ("recording", taken & (evidence == "recording_id"), F.coalesce("remote_title", "title")),
        ("placeholder", taken & is_placeholder(F.col("title")), F.coalesce("remote_title", "title")),
        ("own", (evidence == "tag_title") & is_main, F.col("title")),
        ("file", evidence == "filename_title", F.coalesce("file_title", "title")),
        ("contained", taken & (evidence == "contained_title"), F.coalesce("remote_title", "title")),
    ]
    fits = [(name, F.coalesce(test, F.lit(False)), value) for name, test, value in rules]
    told, rule = F.col("title"), F.lit("own")
    for name, test, value in reversed(fits):
        told, rule = F.when(test, value).otherwise(told), F.when(test, name).otherwise(rule)
    return rows.select("album_id", "idx", "evidence", F.col("title").alias("old_title"), told.alias("title"), rule.alias("rule"))
