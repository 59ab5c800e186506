"""Alignment of local tracks with a release's tracks.

Titles become variants by Column expressions, once for each different text: that is where the work is. Both sides then
meet in one shuffle by album, sorted, and one small function goes through them: the one-to-one choice depends on order,
and holds an album's forms as keys, so no pair of tracks becomes a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import groupby, pairwise
from operator import and_, itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import text as T

# Words after a title that make it another recording.
PROTECTED = ["live", "remix", "demo", "acoustic", "instrumental", "karaoke", "edit", "version", "现场", "現場", "伴奏"]
LOCAL_TEXTS = ("title", "filename", "artist", "artists", "artist_hint")
REMOTE_TEXTS = ("title", "match_titles")
#: Sides of an album's rows: a release's tracks, those of a source whose titles may begin longer ones, and local tracks.
REMOTE, NAMED, LOCAL = 0, 1, 2
#: Rows that the choice gives back at once.
OUT_ROWS = 10_000


def _components(title: Column) -> Column:
    """Of a title with CJK and Latin letters: its usable parts."""
    mixed = title.rlike(T.CJK) & title.rlike("[A-Za-z]")
    parts = F.transform(F.split(title, r"(?U)[()（）]|\s+(?:/|[-–—])\s+"), T.trim)

    def usable(p: Column) -> Column:
        cjk = F.length(F.regexp_replace(p, r"(?U)\s", "")) >= 2
        latin = F.exists(F.split(p, r"(?U)\s+"), lambda w: F.octet_length(w) >= 3)
        return (p != "") & (p != title) & F.when(p.rlike(T.CJK), cjk).otherwise(latin)

    return F.when(mixed, F.filter(parts, usable)).otherwise(F.array().cast("array<string>"))


def _keys(titles: Column) -> Column:
    """Comparison forms of titles: each as it is, traditional and simplified; distinct, in order."""
    scripts = lambda t: F.when(t.rlike(T.CJK), F.array(t, T.traditional(t), T.simplified(t))).otherwise(F.array(t))
    forms = F.transform(F.array_distinct(F.flatten(F.transform(titles, scripts))), T.title_key)
    return F.filter(F.array_distinct(forms), lambda x: x.isNotNull() & (x != ""))


def _variants(title: Column) -> Column:
    return _keys(F.concat(F.array(title), _components(title)))


def _without_artist(title: Column, artist_keys: Column, last: bool) -> Column:
    """The title if a dash parts it from a known artist behind it (``last``) or before it; else null."""

    def of(pieces: Column) -> Column:
        def cut(i: Column) -> Column:
            before = T.trim(F.array_join(F.slice(pieces, F.lit(1), i), ""))
            after = T.trim(F.substr(F.array_join(F.slice(pieces, i + 1, F.size(pieces)), ""), F.lit(2)))
            rest, artist = (before, after) if last else (after, before)
            return F.when((rest != "") & F.array_contains(artist_keys, T.title_key(artist)), rest)

        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        return F.when(F.size(pieces) > 1, F.get(F.filter(F.transform(places, cut), lambda x: x.isNotNull()), F.lit(0)))

    # Few titles have a dash: the others don't get to the search.
    return F.when(title.rlike("[-–—]"), F.get(F.transform(F.array(F.split(title, "(?=[-–—])")), of), F.lit(0)))


def _seconds(length: Column, source: Column) -> Column:
    return F.when(length > 0, F.when((source == "musicbrainz") & (length > 1000), length / 1000).otherwise(length))


def _number() -> Column:
    return F.coalesce("track_number", T.extract(T.stem(F.col("filename")), r"^(\d{1,3})(?:\D|$)").cast("int"))


def _local_forms(local: DataFrame, keep: tuple[str, ...] = ("album_id", "idx")) -> DataFrame:
    """Rows of the columns to keep, current title and forms: array of struct(form, evidence) in order."""
    joined = F.array_join(F.concat(F.coalesce("artists", F.array().cast("array<string>")), F.array(F.coalesce("artist", F.lit("")), F.coalesce("artist_hint", F.lit("")))), "\x1f")
    named = local.select(
        *keep,
        T.nfkc(F.col("title")).alias("_raw"), T.nfkc(T.trim(T.stem(F.col("filename")))).alias("_f"), T.nfkc(joined).alias("_a"),
    )
    # One column a step: an expression that several others use is computed once.
    named = named.withColumns({
        "_artists": F.filter(F.transform(F.split("_a", "\x1f"), T.title_key), lambda x: x != ""),
        "_t": T.strip_annotations(T.trim(F.col("_raw"))),
        "_bare": T.trim(F.regexp_replace("_f", r"^\d+[\s.‐‑‒–—―-]*", "")),
    })
    spaced = T.extract(F.col("_bare"), r"^.+?\s[-–—]\s(.+)$")
    named = named.withColumn("_name", T.strip_annotations(F.coalesce(spaced, _without_artist(F.col("_bare"), F.col("_artists"), last=False), "_bare")))
    tag = F.filter(F.array("_t", _without_artist(F.col("_t"), F.col("_artists"), last=True)), lambda x: x.isNotNull())
    by_file = F.filter(F.array("_name"), lambda x: x != "")

    def marked(titles: Column, evidence: str) -> Column:
        forms = F.array_distinct(F.flatten(F.transform(titles, _variants)))
        return F.transform(F.coalesce(forms, F.array().cast("array<string>")), lambda f: F.struct(f.alias("form"), F.lit(evidence).alias("evidence")))

    return named.select(*keep, F.concat(marked(tag, "tag_title"), marked(by_file, "filename_title")).alias("forms"), T.title_key(F.coalesce("_raw", "_name")).alias("current"))


def _remote_forms(remote: DataFrame, keep: tuple[str, ...] = ("album_id", "idx")) -> DataFrame:
    titles = F.filter(F.concat(F.array("title"), F.coalesce("match_titles", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    named = remote.withColumn("_n", T.nfkc(F.array_join(titles, "\x1f")))

    def forms(t: Column) -> Column:
        bare = T.strip_annotations(T.trim(t))
        leading = F.regexp_extract(bare, f"^(?:{T.CJK})+", 0)
        more = F.when(bare.rlike("[A-Za-z]") & (leading != "") & (leading != bare), F.array(leading)).otherwise(F.array().cast("array<string>"))
        return _keys(F.concat(F.array(bare), _components(t), more))

    variants = F.array_distinct(F.flatten(F.transform(F.split("_n", "\x1f"), forms)))
    return named.select(*keep, variants.alias("variants"))


def _with_forms(rows: DataFrame, texts: tuple[str, ...], forms: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``rows`` with what ``forms`` makes of their texts. Each different text is worked on once, in a table of its own: so
    its size is known, and few texts go to the rows, not the rows to them."""
    each = tables.written(forms(rows.select(*texts).distinct(), texts))
    each = each.withColumnsRenamed({t: f"_{t}" for t in texts})
    return rows.join(each, reduce(and_, (F.col(t).eqNullSafe(F.col(f"_{t}")) for t in texts)), "left")


def _fits(ours: float, theirs: float) -> int:
    """Whether lengths differ by max(5, 3 % of ours) at most; -1 if one is unknown (-1). NaN equals NaN, as in Spark."""
    if ours == -1 or theirs == -1:
        return -1
    part, apart = ours * 0.03, abs(ours - theirs)
    reach = 5.0 if part < 5.0 else part
    return int(apart <= reach or (apart != apart and reach != reach))


def _polluted(current: str, form: str) -> bool:
    """Whether a title is a form and words behind it, none of which makes another recording."""
    extra, more = current[len(form) :].strip(" "), len(current) - len(form)
    return extra != "" and not any(w in PROTECTED for w in extra.split(" ")) and (more >= 3 or more >= 0.25 * len(form))


class _Release:
    """A release's tracks by recording, form and beginning, and which of them are taken."""

    def __init__(self, tracks: list[tuple]) -> None:
        self.tracks, self.ids, self.titles, self.taken = tracks, {}, {}, set()
        for _, _, idx, length, _, _, ident, forms, _, _ in tracks:
            if ident is not None:
                self.ids.setdefault(ident, []).append((idx, length))
            for form in forms:
                self.titles.setdefault(form, []).append((idx, length))

    @cached_property
    def starts(self) -> dict[str, list[tuple]]:
        """Forms that a longer title may begin with: made for the first track that no title finds."""
        found = defaultdict(list)
        for _, side, idx, length, _, _, _, forms, _, _ in self.tracks:
            for form in forms if side == NAMED else ():
                if len(form.encode()) >= 2:
                    found[form].append((idx, length))
        return found

    def _free(self, length: float, tracks: list[tuple]) -> set[tuple]:
        return {(i, _fits(length, other)) for i, other in tracks if i not in self.taken}

    def _only(self, fit: list[tuple]) -> int | None:
        if len(fit) != 1:
            return None
        self.taken.add(fit[0][0])
        return fit[0][0]

    def take(self, track: tuple) -> tuple:
        """(remote_idx, evidence, skip) of a local track: the first step that leaves one track."""
        _, _, _, length, _, _, ident, forms, n_tag, current = track
        mismatch = ambiguous = False
        free = self._free(length, self.ids.get(ident, ())) if ident is not None else ()
        if free:
            taken = self._only(list(free))
            return (taken, "recording_id", None) if taken is not None else (None, None, "duplicate_ambiguous")
        for i, form in enumerate(forms):
            # A form that comes again would find the same tracks.
            free = self._free(length, self.titles[form]) if form in self.titles and form not in forms[:i] else ()
            if not free:
                continue
            lone = len(free) == 1
            taken = self._only([p for p in free if (p[1] != 0 if lone else p[1] == 1)])
            if taken is not None:
                return taken, "tag_title" if i < n_tag else "filename_title", None
            mismatch, ambiguous = mismatch or lone, ambiguous or not lone
        if current and self.starts:
            begun = [t for k in range(1, len(current)) for t in self.starts.get(current[:k], ()) if _polluted(current, current[:k])]
            fit = [p for p in self._free(length, begun) if p[1] != 0]
            taken = self._only(fit)
            if taken is not None:
                return taken, "contained_title", None
            ambiguous = ambiguous or len(fit) > 1
        return None, None, "duplicate_ambiguous" if ambiguous else "duration_mismatch" if mismatch else "no_title_match" if forms else "no_local_evidence"


def _places(tracks: list[tuple], need: bool) -> dict[tuple, int]:
    """The only track of each (disc, number)."""
    found = defaultdict(list)
    for t in tracks:
        if t[5] is not None and (t[4] is not None or not need):
            found[t[4] if need else 0, t[5]].append(t[2])
    return {place: i[0] for place, i in found.items() if len(i) == 1}


def _by_position(local: list[tuple], remote: list[tuple], taken: set) -> dict[int, int]:
    """Tracks of albums of equal size (two or more) by (disc, number), if unique on both sides; not those taken before."""
    if len(local) != len(remote) or len(local) < 2:
        return {}
    ours, theirs = ({t[4] for t in side if t[4] is not None} for side in (local, remote))
    need = len(ours) > 1 or len(theirs) > 1 or bool(ours and theirs and ours != theirs)
    there = _places(remote, need)
    return {i: there[place] for place, i in _places(local, need).items() if place in there and there[place] not in taken}


def _album(local: list[tuple], remote: list[tuple]) -> list[tuple]:
    """Local tracks in order take a release's track that no earlier one took; position is for those that are left."""
    release = _Release(remote)
    rows = [(t[0], t[2], *release.take(t)) for t in local]
    if len(release.taken) < len(rows):
        placed = _by_position(local, remote, release.taken)
        rows = [(a, i, placed[i], "position", None) if r is None and i in placed else (a, i, r, e, s) for a, i, r, e, s in rows]
    return rows


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by album and side, so that a task holds one album at a time."""
    names, kinds = ["album_id", "idx", "remote_idx", "evidence", "skip"], [None, pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def plain(column: pa.Array) -> list:
        if pa.types.is_list(column.type):
            values, ends = column.values.to_pandas().tolist(), column.offsets.tolist()
            return [values[i:k] for i, k in pairwise(ends)]
        simple = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_string(column.type)
        return column.to_pandas(integer_object_nulls=True).tolist() if simple else column.to_pylist()

    def tracks() -> Iterator[tuple]:
        for b in batches:
            kinds[0] = b.schema.field("album_id").type
            yield from zip(*map(plain, b.columns), strict=True)

    out = []
    for album, rows in groupby(tracks(), key=itemgetter(0)):
        local, remote = [], []
        for t in rows:
            (local if t[1] == LOCAL else remote).append(t)
        if local:
            out += _album(local, remote if album is not None else [])
        if len(out) >= OUT_ROWS:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def align_tracks(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(album_id, idx, remote_idx, evidence, skip): one row for each local track; unmatched ones tell why in skip.

    ``local``: album_id, idx, title, artist, artists, artist_hint, filename, track_number, disc_number,
    musicbrainz_track_id, length. ``remote``: album_id, idx, source, title, match_titles, track_number, disc_number,
    recording_id, length. Evidence, in order: recording_id, tag_title, filename_title, contained_title, position.
    Forms of titles are written to the shared folder.
    """
    places = [F.col("disc_number").cast("int").alias("disc"), F.col("number").cast("int").alias("number")]
    ours = _with_forms(local, LOCAL_TEXTS, _local_forms).withColumns({"number": _number(), "n_tag": F.size(F.filter("forms.evidence", lambda e: e == "tag_title"))}).select(
        "album_id", F.lit(LOCAL).alias("side"), F.col("idx").cast("long").alias("idx"), F.when(F.col("length") > 0, F.col("length")).otherwise(-1).cast("double").alias("length"),
        *places, F.col("musicbrainz_track_id").alias("ident"), F.col("forms.form").alias("forms"), "n_tag", "current",
    )
    theirs = _with_forms(remote, REMOTE_TEXTS, _remote_forms).withColumn("number", F.col("track_number")).select(
        "album_id", F.when(F.col("source").isin("musicbrainz", "discogs"), NAMED).otherwise(REMOTE).alias("side"), F.col("idx").cast("long").alias("idx"), F.coalesce(_seconds(F.col("length"), F.col("source")).cast("double"), F.lit(-1.0)).alias("length"),
        *places, F.when(F.col("source") == "musicbrainz", F.col("recording_id")).alias("ident"), F.col("variants").alias("forms"), F.lit(0).alias("n_tag"), F.lit(None).cast("string").alias("current"),
    )
    both = ours.unionByName(theirs)
    kind = dict(both.dtypes)["album_id"]
    chosen = both.repartition("album_id").sortWithinPartitions("album_id", "side", "idx").mapInArrow(_choose, f"album_id {kind}, idx long, remote_idx long, evidence string, skip string")
    return chosen.withColumn("album_id", F.col("album_id").cast(local.schema["album_id"].dataType))


def match_stats(aligned: DataFrame) -> DataFrame:
    """Of each album: tracks, matches, matches by title, and skips by reason."""
    reasons = ["no_title_match", "duration_mismatch", "duplicate_ambiguous", "no_local_evidence"]
    by_title = F.col("evidence").isNotNull() & (F.col("evidence") != "position")
    return aligned.groupBy("album_id").agg(F.count("*").alias("n_local"), F.count("remote_idx").alias("matched"), F.count_if(by_title).alias("title_matches"), *[F.count_if(F.col("skip") == r).alias(r) for r in reasons])
