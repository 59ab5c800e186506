"""Names of artists and albums: how they are split, cleaned and compared, as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

from . import text as T

# Fixed values.
FEATURING = r"\s+(?:feat\.?|ft\.?|featuring)\s+"
MARKS = "&/;,＋+、，；·‧"
#: Delimiters of artists: of provider credits, audited tags, planned edits, the pipeline operation, and list tags.
DELIMITERS = {
    "provider": rf"(?iU){FEATURING}|\s*[{MARKS}]\s*",
    "audit": rf"(?iU){FEATURING}|\s*[{MARKS}|]\s*",
    "edit": rf"(?iU){FEATURING}|\s*[{MARKS}]\s*",
    "pipeline": "[&,;，；]",
    "list": ";",
}
SUBTITLES = "精選|精歌|精选|精选集|新歌|新曲|首張|經典|專輯|album|edition|version|disc|remaster"
COMPILATIONS = ["compilations", "compilation", "various artists", "various", "va", "soundtracks", "soundtrack", "ost", "samplers", "sampler", "christmas"]
EDITIONS = "香港首版|台湾首版|引进版|日本版|欧版|美版|内地版|中国大陆版|大陆版|德国版|澳洲版|新加坡版|马来西亚版|韩版"
AUDIO_FORMATS = "flac|mp3|wav|aac|ogg|m4a|wma|ape"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
SELF_TITLED = ["同名专辑", "同名"]
OTHER_THAN_WORDS = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"
_NO_WORDS, _CJK = regex.compile(r"[^\p{Alphabetic}\p{N}\p{White_Space}]"), regex.compile(r"[\u3400-\u4DBF\u4E00-\u9FFF]")
_PARTED = regex.compile(rf"(?<={_CJK.pattern}) (?={_CJK.pattern})")
_ONE_FORM = str.maketrans("斉妳", "齊你")


def split_names(credit: Column, way: str = "provider") -> Column:
    """The artists of a credit by one of five ways (DELIMITERS); later spellings that differ in case only are left out.

    Provider credits, which ignore the case of ASCII letters alone, and audited tags also part CJK names at dots; planned
    edits read `` _ `` as a slash.
    """
    if way in ("provider", "audit"):
        credit = F.regexp_replace(credit, f"(?<={T.CJK})\\.(?={T.CJK})", ";")
    elif way == "edit":
        credit = F.replace(credit, F.lit(" _ "), F.lit(" / "))
    return T.distinct_ignoring_case(F.transform(F.split(credit, DELIMITERS[way]), T.trim), T.ascii_lower if way == "provider" else F.lower)


def collaborators(artist: Column, artists: Column) -> Column:
    """``artists`` if it names several, else the artists of the credit (or of the one listed name)."""
    listed = F.coalesce(artists, F.array().cast("array<string>"))
    credit = F.coalesce(F.when(~T.missing(artist), artist), F.get(listed, F.lit(0)), F.lit(""))
    parts = split_names(credit)
    return F.when((F.size(listed) > 1) | (F.size(parts) == 0), listed).otherwise(parts)


def provider_artist(name: Column) -> Column:
    """An artist's name without what tells namesakes apart, `` (2)`` or `` (band; Leeds)``; null if nothing is left."""
    bare = F.regexp_replace(T.trim(name), r"(?U)\s+\(\d+\)$", "")
    return F.nullif(T.trim(F.regexp_replace(bare, r"(?U)\s+\([^)]*[;，,][^)]*\)\s*$", "")), F.lit(""))


def same_but_for_case(a: Column, b: Column) -> Column:
    """Equal without blanks around them and without the case of ASCII letters."""
    return T.ascii_lower(T.trim(a)) == T.ascii_lower(T.trim(b))


def canonical_artists(names: Column, old: Column, canonical: Column) -> Column:
    """``names`` with ``canonical`` in place of each that is ``old`` but for case; ``???`` goes, nothing left is ``canonical``."""
    kept = F.filter(names, lambda n: T.trim(n) != "???")
    found = F.transform(kept, lambda n: F.when(same_but_for_case(n, old), canonical).otherwise(n))
    return F.when(F.size(found) > 0, found).otherwise(F.array(canonical))


def canonical_candidate(candidate: DataFrame, canonical: Column) -> DataFrame:
    """Candidates (artist, artists, album_artist, album_artists, tracks) under the artist's canonical name.

    The old name is the first artist, or else the first album artist. Tracks of that artist alone (or of the canonical one)
    get the canonical name. A null or blank canonical name, or no old one, leaves a row as it is.
    """
    name = provider_artist(canonical)
    both, albums = collaborators(F.col("artist"), F.col("artists")), collaborators(F.col("album_artist"), F.col("album_artists"))
    old = F.coalesce(F.get(both, F.lit(0)), F.get(albums, F.lit(0)), F.col("artist"))
    applies = name.isNotNull() & old.isNotNull()
    rows = candidate.withColumns({"_name": name, "_old": old, "_applies": applies, "_artists": both, "_albums": albums})
    artists, album_artists = (canonical_artists(F.col(c), F.col("_old"), F.col("_name")) for c in ("_artists", "_albums"))

    def solo(artist: Column) -> Column:
        return same_but_for_case(artist, F.col("_name")) | same_but_for_case(artist, F.col("_old"))

    def retold(track: Column) -> Column:
        listed = F.coalesce(track["artists"], F.array().cast("array<string>"))
        alone = F.coalesce(solo(track["artist"]), F.lit(True)) & F.forall(listed, lambda a: solo(a) | (T.trim(a) == "???"))
        return F.when(F.col("_applies") & alone, track.withField("artist", F.col("_name")).withField("artists", F.array("_name"))).otherwise(track)

    new = {"artists": artists, "album_artists": album_artists, "artist": F.array_join(artists, " & "), "album_artist": F.array_join(album_artists, " & ")}
    changed = {c: F.when(F.col("_applies"), v).otherwise(F.col(c)) for c, v in new.items()} | {"tracks": F.transform("tracks", retold)}
    return rows.withColumns(changed).drop("_name", "_old", "_applies", "_artists", "_albums")


def plain(text: Column) -> Column:
    """Of an NFKC text: lower case, anything but letters, digits and white space as blanks, single blanks."""
    return T.collapse(F.regexp_replace(F.lower(text), OTHER_THAN_WORDS, " "))


def normal(text: Column) -> Column:
    return plain(T.nfkc(text))


def _lookup_words(lowered: Column) -> Column:
    """Of lower-case ASCII: no marks, Roman numerals to ten as digits; one pass over the words."""
    digits = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.array_join(F.transform(F.split(plain(lowered), " "), lambda w: F.coalesce(F.try_element_at(digits, w), w)), " ")


def _key(text: str) -> str:
    """The lookup key of any text: also without combining marks and without blanks between CJK letters."""
    decomposed = unicodedata.normalize("NFKD", text.translate(_ONE_FORM))
    bare = _NO_WORDS.sub(" ", "".join(c for c in decomposed if not unicodedata.combining(c)).lower())
    return _PARTED.sub("", " ".join(ROMAN.get(w, w) for w in bare.split()))


def _keys(text: str) -> list[str]:
    """Keys of the text as it is, in traditional and in simplified letters."""
    return list(dict.fromkeys(_key(t) for t in (text, text.translate(T.TO_TRADITIONAL), text.translate(T.TO_SIMPLIFIED))))


@pandas_udf(StringType())
def _key_beyond_ascii(text: pd.Series) -> pd.Series:
    return text.map(_key, na_action="ignore")


def _alike(x: str, y: str) -> int:
    """Similarity of two keys, 0 unless either has CJK letters."""
    return T.percent(x, y) if _CJK.search(x) or _CJK.search(y) else 0


def _best(score: Callable[[str, str], int]) -> Callable:
    @pandas_udf(IntegerType())
    def best(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else max(score(x, y) for x in _keys(s) for y in _keys(t)) for s, t in zip(a, b)], dtype="Int32")

    return best


def _holds(x: str, y: str) -> int:
    return 100 if x in y or y in x else _alike(x, y)


def _is_specific(key: str) -> bool:
    return len(key.replace(" ", "")) >= 4 if _CJK.search(key) else any(len(w) >= 3 for w in key.split(" "))


def _score(x: str, y: str) -> int:
    if x == y:
        return 100
    if x in y and _is_specific(x):
        return 85
    if y in x and _is_specific(y):
        return 70
    alike = _alike(x, y)
    return (alike * 85 + 50) // 100 if alike >= 80 else 0


_best_match, _best_score = _best(_holds), _best(_score)


def lookup_key(text: Column) -> Column:
    """The form in which albums are looked up. Texts beyond ASCII travel to Python, by Arrow batches."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_key_beyond_ascii(F.when(other, text)), _lookup_words(F.lower(F.when(~other, text))))


def _compared(a: Column, b: Column, native: Callable[[Column, Column], Column], python: Callable) -> Column:
    """``native`` of the keys of two ASCII texts, which have one key each; of other pairs the best that ``python`` gives."""
    other = a.rlike(r"[^\x00-\x7F]") | b.rlike(r"[^\x00-\x7F]")
    pair = F.when(~other, F.struct(_lookup_words(F.lower(a)).alias("x"), _lookup_words(F.lower(b)).alias("y")))
    told = F.get(F.transform(F.array(pair), lambda p: F.when(p.isNotNull(), native(p["x"], p["y"]))), F.lit(0))
    return F.coalesce(told, python(F.when(other, a), F.when(other, b)))


def normal_variants(text: Column) -> list[Column]:
    return [normal(x) for x in (text, T.traditional(text), T.simplified(text))]


def albums_match(hint: Column, candidate: Column) -> Column:
    """Whether two album names mean one album: a key of one holds a key of the other, or CJK keys are 80 % alike.

    An empty key is held by every other.
    """
    return _compared(hint, candidate, lambda x, y: F.when(x.contains(y) | y.contains(x), 100).otherwise(0), _best_match) >= 80


def album_score(local: Column, remote: Column) -> Column:
    """100 of equal keys, 85 if the remote holds the local one, 70 the other way, 85 % of a CJK similarity of 80 at least."""
    specific = lambda k: k.rlike(r"\S{3}")

    def native(x: Column, y: Column) -> Column:
        return F.when(x == y, 100).when(y.contains(x) & specific(x), 85).when(x.contains(y) & specific(y), 70).otherwise(0)

    return _compared(local, remote, native, _best_score)


def artists_equal(candidate: Column, wanted: Column) -> Column:
    """Whether a form of one is a form of the other, or both are equal without blanks."""
    joined = lambda c: F.replace(normal(c), F.lit(" "), F.lit(""))
    return F.arrays_overlap(F.array(*normal_variants(candidate)), F.array(*normal_variants(wanted))) | (joined(candidate) == joined(wanted))


def artists_match(candidate: Column, wanted: Column) -> Column:
    """The loose form, of NFKC texts: one of the names that `` = `` parts equals the wanted one, or one holds the other (3 bytes
    at least). Candidates that begin with the word Various match nothing.
    """
    various = candidate.rlike(r"(?iU)^\s*various(?:\s|$)")
    variants = lambda n: F.array(*[plain(x) for x in (n, T.traditional(n), T.simplified(n))])
    forms = F.flatten(F.transform(F.split(T.trim(F.regexp_replace(candidate, r"\*+$", "")), " = "), variants))
    near = lambda x, y: (x == y) | ((F.octet_length(x) >= 3) & (F.octet_length(y) >= 3) & (x.contains(y) | y.contains(x)))
    return ~various & F.exists(forms, lambda x: F.exists(variants(wanted), lambda y: near(x, y)))


def album_equals(candidate: Column, wanted: Column, artist: Column) -> Column:
    """Whether an album has the wanted name; one called "self-titled" has its artist's."""
    own = normal(candidate).isin(SELF_TITLED) & (normal(wanted) == normal(artist))
    return F.array_contains(F.array(*normal_variants(candidate)), normal(wanted)) | F.coalesce(own, F.lit(False))


def without_subtitle(album: Column) -> Column:
    return T.trim(F.regexp_replace(album, rf"(?i)[（(][^）)]*(?:{SUBTITLES})[^）)]*[）)]", ""))


def clean_folder(name: Column) -> Column:
    """A release folder's name without year, quotes, edition and format."""
    bare = F.translate(F.regexp_replace(name, r"(?U)^\d{4}\s*[.-]\s*", ""), "《》「」【】[]", "")
    bare = F.regexp_replace(bare, rf"(?iU)\s*(?:{EDITIONS})\s*", " ")
    return T.trim(F.regexp_replace(bare, rf"(?iU)\s*(?:{AUDIO_FORMATS})(?:\s*分轨)?\s*$", ""))


def is_compilation(folder: Column) -> Column:
    return F.lower(F.regexp_replace(T.trim(folder), "[ _]+", " ")).isin(COMPILATIONS)


def is_ambiguous(album: Column, artist: Column, path: Column, year: Column) -> Column:
    """Whether a folder's hints need a second look: one is missing, or the name has brackets, dots between CJK letters or a year."""
    name = F.coalesce(F.try_element_at(T.components(path), F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(name, rf"(?iU)\[?({AUDIO_FORMATS}|flac\s*分轨|wav\s*分轨)\]?\s*$", "")
    marked = bare.rlike(r"[\[\]《》「」【】]") | name.rlike(r"\p{IsHan}\.\p{IsHan}") | name.contains("。")
    told = album.rlike(r"^\d{4}[-.]") | (album.contains(".") & year.isNull())
    return F.coalesce(album, F.lit("")).isin("") | F.coalesce(artist, F.lit("")).isin("") | F.coalesce(marked | told, F.lit(True))


def file_number(stem: Column) -> Column:
    return T.extract(stem, r"(?U)^(\d{1,3})\s*[.\-_\s]+").cast("int")


def file_title(stem: Column) -> Column:
    return F.nullif(T.trim(F.regexp_replace(stem, r"(?U)^\d{1,3}\s*[.\-_\s]+", "")), F.lit(""))


def without_title_number(title: Column) -> Column:
    return F.regexp_replace(title, r"(?U)^(?:\d+[.)]\s+|\d+\s*[-–]\s+|\d{1,3}\s+)", "")


def without_file_number(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?U)^\d+[\s.\\)-]+", "")


def told_by_file(path: Column) -> Column:
    """struct(artist, title) of ``03. Artist - Title``; a bare dash counts only behind a number. Null if either is blank."""
    number = r"(?iU)^\s*(?:disc\s*)?\d{1,3}(?:[._ -]+|\s+)"
    stem = T.stem(path)
    bare = F.regexp_replace(stem, number, "")
    spaced, dashed = r"(?U)^(.*?)\s[-–—]\s(.*)$", r"^([^-]*)-(.*)$"
    part = lambda k: T.trim(F.coalesce(T.extract(bare, spaced, k), F.when(stem.rlike(number), T.extract(bare, dashed, k))))
    artist, title = part(1), part(2)
    return F.when((artist != "") & (title != ""), F.struct(artist.alias("artist"), title.alias("title")))


def sentinel_free(value: Column) -> Column:
    """A model's answer without blanks around it; blanks alone and words for "nothing" are null."""
    text = T.trim(value)
    return F.when((text != "") & ~text.rlike(r"(?i)^(?:null|none|undefined|n/a|unknown)$"), text)


#: Forms of provider keys without ``_``, ``-`` and blanks.
PROVIDER_KEYS = {
    "MUSICBRAINZTRACKID": "MUSICBRAINZ_TRACKID", "MUSICBRAINZRECORDINGID": "MUSICBRAINZ_TRACKID", "MUSICBRAINZALBUMID": "MUSICBRAINZ_ALBUMID",
    "MUSICBRAINZRELEASEID": "MUSICBRAINZ_ALBUMID", "MUSICBRAINZARTISTID": "MUSICBRAINZ_ARTISTID", "DISCOGSARTISTID": "DISCOGS_ARTIST_ID", "DISCOGSRELEASEID": "DISCOGS_RELEASE_ID",
}
#: Keys of lyrics, and of what other fields own.
LYRICS_KEYS = ["LYRICS", "USLT", "SYLT", "SYNCEDLYRICS", "SYNCHRONIZEDLYRICS", "SYNCHRONISEDLYRICS", "UNSYNCEDLYRICS", "UNSYNCHRONISEDLYRICS", "LYRICSLANGUAGE"]
RESERVED_KEYS = ["TITLE", "ARTIST", "ARTISTS", "ALBUM", "ALBUMARTIST", "ALBUM ARTIST", "DATE", "YEAR", "GENRE", "COMPOSER", "TRACK", "TRACKNUMBER", "TRACKTOTAL", "TOTALTRACKS", "DISC", "DISCNUMBER", "DISCTOTAL", "TOTALDISCS", "METADATA_BLOCK_PICTURE"]

#: Frames and items that the fields of the editor own, besides lyrics. Extra tags read from files leave them out.
EDITOR_KEYS = [
    "TIT2", "TITLE", "TPE1", "ARTIST", "TALB", "ALBUM", "TPE2", "ALBUMARTIST", "ALBUM ARTIST", "TDRC", "TYER", "DATE", "YEAR", "TRCK", "TRACK", "TRACKNUMBER", "TRACKTOTAL",
    "TOTALTRACKS", "TPOS", "DISC", "DISCNUMBER", "DISCTOTAL", "TOTALDISCS", "TCON", "GENRE", "TCOM", "COMPOSER", "METADATA_BLOCK_PICTURE", "APIC",
]


def provider_key(key: Column) -> Column:
    """The canonical name of a provider's id, however it is spelt; null for other keys."""
    bare = F.regexp_replace(F.translate(F.upper(T.trim(key)), "_- ", ""), "^MUSICBRAINS", "MUSICBRAINZ")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PROVIDER_KEYS.items() for x in pair]), bare)


def is_lyrics_key(key: Column) -> Column:
    return F.upper(F.translate(key, " _-", "")).isin(LYRICS_KEYS)


def extra_key(key: Column) -> Column:
    """The key under which an extra tag is written: provider ids by their canonical name, COMM as COMMENT."""
    bare = T.trim(key)
    return F.coalesce(provider_key(bare), F.when(F.upper(bare) == "COMM", "COMMENT").otherwise(bare))


def is_reserved_key(key: Column) -> Column:
    return is_lyrics_key(key) | F.upper(T.trim(key)).isin(RESERVED_KEYS)


def is_editor_key(key: Column) -> Column:
    return is_lyrics_key(key) | F.upper(T.trim(key)).isin(EDITOR_KEYS)
