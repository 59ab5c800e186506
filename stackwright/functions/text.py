"""Text functions as Column expressions. Only Unicode normalization needs Python, and gets it by Arrow batches."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

# Fixed values.
AUDIO_EXTENSIONS = ["mp3", "flac", "m4a", "mp4", "wav", "ogg", "opus", "aiff", "ape"]
ANNOTATIONS = "live|remaster(?:ed)?|version|karaoke|instrumental|伴奏|现场|現場|片头|片頭|片尾|theme"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
DASHES = "-–—"
#: A small table of traditional and simplified forms, by position. Phrase dictionaries aren't at hand: give another table.
TRADITIONAL = "愛長變風飛歡國話開來樂龍馬門夢妳鳥氣情讓時書聽萬無現為學葉陽遠雲語雖說戀灣"
SIMPLIFIED = "爱长变风飞欢国话开来乐龙马门梦你鸟气情让时书听万无现为学叶阳远云语虽说恋湾"
#: The same for texts outside Columns.
TO_SIMPLIFIED = str.maketrans(TRADITIONAL, SIMPLIFIED)
TO_TRADITIONAL = str.maketrans(SIMPLIFIED.replace("你", ""), TRADITIONAL.replace("妳", ""))


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def _beyond_ascii(text: Column) -> Column:
    """The text if it isn't ASCII, else null: only such texts travel to Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null."""
    return F.coalesce(_nfkc(_beyond_ascii(text)), text)


def nfc(text: Column) -> Column:
    """Canonically composed; null stays null."""
    return F.coalesce(_nfc(_beyond_ascii(text)), text)


def nfd(text: Column) -> Column:
    """Canonically decomposed; null stays null."""
    return F.coalesce(_nfd(_beyond_ascii(text)), text)


def trim(text: Column) -> Column:
    """Trims Unicode white space; SQL's trim takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one blank, none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def missing(text: Column) -> Column:
    """Null or blank."""
    return F.coalesce(trim(text), F.lit("")) == ""


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null (not empty) where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def positive_int(text: Column) -> Column:
    number = trim(text.cast("string")).try_cast("int")
    return F.when(number > 0, number)


def number_pair(text: Column) -> Column:
    """struct(number, total) of ``3/12``; what isn't a positive number is null."""
    parts = F.split(text, "/")
    return F.struct(positive_int(F.get(parts, F.lit(0))).alias("number"), positive_int(F.get(parts, F.lit(1))).alias("total"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/?[^/]*$", "")


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def components(path: Column) -> Column:
    """The parts of a path without empty ones."""
    return F.filter(F.split(posix(path), "/"), lambda p: p != "")


def short_path(path: Column, depth: int = 4) -> Column:
    """The last parts of a path."""
    parts = components(path)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (depth - 1)), F.lit(depth)), "/")


def resolved(path: Column) -> Column:
    """The parts of a path with ``.`` and ``..`` carried out; null where that leads above its beginning."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(done.isNull(), done).when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(components(path), F.array().cast("array<string>"), step)


def inside(path: Column, folder: Column) -> Column:
    """Whether ``path`` is ``folder`` or below it, by whole parts; false where either leads above its beginning."""
    mine, its = resolved(path), resolved(folder)
    return F.coalesce((F.size(mine) >= F.size(its)) & (F.slice(mine, F.lit(1), F.greatest(F.size(its), F.lit(1))) == its) | ((F.size(its) == 0) & mine.isNotNull()), F.lit(False))


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_audio(path: Column) -> Column:
    return extension(path).isin(AUDIO_EXTENSIONS)


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone: what compares names "equal but for ASCII case"."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def distinct_ignoring_case(names: Column, fold: Callable[[Column], Column] = F.lower) -> Column:
    """The array without blanks and without later spellings that differ in case only, as ``fold`` has it; order stays."""
    names = F.filter(names, lambda n: n != "")
    folded = F.transform(names, fold)
    return F.filter(names, lambda n, i: F.array_position(folded, fold(n)) == i + 1)


def comparable(normalized: Column) -> Column:
    """Of an NFKC text: lower case, without punctuation that spellings differ by, one kind of dash, single blanks."""
    bare = F.regexp_replace(F.lower(collapse(normalized)), r"[._:：'\"`()\[\]{}《》「」【】]", "")
    return F.coalesce(collapse(F.regexp_replace(bare, r"[‐\-‒–—―]+", "-")), F.lit(""))


def title_key(normalized: Column) -> Column:
    """Of an NFKC title: lower case, punctuation and symbols as blanks, single blanks."""
    return collapse(F.regexp_replace(F.replace(F.lower(normalized), F.lit("妳"), F.lit("你")), r"[\p{P}\p{S}]+", " "))


def strip_annotations(normalized: Column) -> Column:
    """An NFKC title without a trailing (... live ...), [...] or - live."""
    for pattern in (
        rf"(?iU)[(（][^)]*(?:{ANNOTATIONS})[^)]*[)）]\s*$",
        rf"(?iU)\[[^\]]*(?:{ANNOTATIONS})[^\]]*\]\s*$",
        rf"(?iU)[\s\-–—]+(?:{ANNOTATIONS})\s*$",
    ):
        normalized = trim(F.regexp_replace(normalized, pattern, ""))
    return normalized


def simplified(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def traditional(text: Column) -> Column:
    return F.translate(text, SIMPLIFIED.replace("你", ""), TRADITIONAL.replace("妳", ""))


#: How file names tell disc, track and the rest, the first that fits; groups by name.
NAME_FORMS = [
    (r"(?U)^(\d{1,2})[-_](\d{1,3})(?:\s*[.\-_\s]+\s*|\s+)(.+)$", {"disc": 1, "track": 2, "rest": 3}),
    (r"(?U)^(\d{1,3})(?:\s*[.)_-]\s*|\s+)(.+)$", {"track": 1, "rest": 2}),
    (r"(?s)^(.*)$", {"rest": 1}),
]
CREDITED = r"(?U)^(.+?)\s[-–—]\s(.*)$"
#: Where an audited folder name states its year.
YEAR = r"((?:19|20)\d{2})"
YEAR_FORMS = [rf"^{YEAR}[-.]", rf"[《（\[]\s*{YEAR}\s*[-.]", rf"[\[(（]\s*{YEAR}\s*[\])）]", rf"(?:^|\D){YEAR}(?:\D|$)"]
#: What isn't part of an album's name.
ALBUM_NOISE = [r"(?U)^\d{4}\s*[-—]\s*", r"(?U)^\d{4}(?:[-.]\d{2}(?:[-.]\d{2})?)?\s*", r"(?iU)\s*\[?(?:flac|mp3|wav|aac|ogg|m4a|wma|ape)(?:\s*分轨)?\]?\s*$"]
AFTER_ARTIST = r"(?U)^\s*(?:[-—–._:：]+|\s{2,})\s*"


def _first_form(text: Column, part: str) -> Column:
    """What the first of NAME_FORMS that fits says of ``part``."""
    found = F.lit(None).cast("string")
    for pattern, groups in reversed(NAME_FORMS):
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, groups[part]) if part in groups else F.lit(None)).otherwise(found)
    return found


def without(text: Column, patterns: list[str]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def file_facts(filename: Column) -> Column:
    """struct(disc, track, artist, title) as a file name (no path) tells: ``1-02. Artist - Title``, ``02 Title``."""
    name = trim(F.regexp_replace(filename, r"\.[^.]*$", ""))
    rest = trim(_first_form(name, "rest"))
    artist, title = (trim(extract(rest, CREDITED, k)) for k in (1, 2))
    return F.struct(
        _first_form(name, "disc").cast("int").alias("disc"), _first_form(name, "track").cast("int").alias("track"),
        artist.alias("artist"), F.coalesce(title, F.nullif(rest, F.lit(""))).alias("title"),
    )


def folder_year(folder: Column) -> Column:
    """The year that an audited folder name states: leading, behind an opening quote, in brackets, or on its own."""
    return F.coalesce(*[extract(folder, pattern) for pattern in YEAR_FORMS])


def release_year(folder: Column) -> Column:
    """The year that a folder name begins with, or a title in quotes within it; one in brackets or behind doesn't count."""
    quoted = [rf"{a}\s*{YEAR}(?!\d)[^{b}]*{b}" for a, b in ("《》", "〈〉", "「」", "『』")]
    return F.coalesce(*[extract(folder, pattern) for pattern in (rf"^\s*{YEAR}(?!\d)", *quoted)])


def folder_album(folder: Column, artist: Column) -> Column:
    """The album that a folder name states, without its year, its format and the artist before it."""
    name = without(F.coalesce(extract(trim(folder), "《([^》]+)》"), trim(folder)), ALBUM_NOISE)
    known = trim(artist)
    rest = F.substr(name, F.length(known) + 1)
    led = (F.lower(F.substr(name, F.lit(1), F.length(known))) == F.lower(known)) & rest.rlike(AFTER_ARTIST)
    return trim(F.when(F.coalesce(led, F.lit(False)), F.regexp_replace(rest, AFTER_ARTIST, "")).otherwise(name))


def safe_name(text: Column) -> Column:
    """A folder or file name: characters that file systems refuse become blanks, runs of them one; no dots at the ends."""
    bare = collapse(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1F]', "_"), r"[_\s]+", " "))
    return F.regexp_replace(bare, r"^[.\s]+|[.\s]+$", "")


def seconds(text: Column) -> Column:
    """``1:02:03`` or ``4:05`` in seconds; null where a part is no number."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    fine = F.forall(parts, lambda p: p.isNotNull() & (p >= 0))
    return F.when(fine, F.aggregate(parts, F.lit(0), lambda total, p: total * 60 + p))


def lyric_lines(lrc: Column) -> Column:
    """array<struct(ms, text)> of LRC text in time order; lines with several stamps repeat, [offset:] shifts, 0 at least."""
    stamp = r"\[(\d{1,3}:\d{2}(?:[.:]\d{1,3})?)\]"
    offset = F.coalesce(extract(lrc, r"(?i)\[offset:\s*([+-]?\d{1,6})\s*\]").cast("int"), F.lit(0))
    lines = F.filter(F.split(lrc, "\r?\n"), lambda x: x.rlike(stamp))

    def timed(line: Column) -> Column:
        words = trim(F.regexp_replace(line, stamp, ""))

        def one(at: Column) -> Column:
            fraction = F.rpad(F.regexp_extract(at, r"^\d+:\d+[.:](\d+)$", 1), 3, "0")
            ms = F.regexp_extract(at, r"^(\d+):", 1).cast("int") * 60000 + F.regexp_extract(at, r":(\d{2})", 1).cast("int") * 1000 + fraction.cast("int")
            return F.struct(F.greatest(F.lit(0), ms - offset).alias("ms"), words.alias("text"))

        return F.transform(F.regexp_extract_all(line, F.lit(stamp), F.lit(1)), one)

    return F.array_sort(F.flatten(F.transform(lines, timed)))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each letter of ``b`` (Hyyrö, 2004)."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    open_places = every
    for c in b:
        hit = open_places & places.get(c, 0)
        open_places = (open_places + hit | open_places - hit) & every
    return len(a) - open_places.bit_count()


def percent(x: str, y: str) -> int:
    """Twice the longest common subsequence over both lengths, rounded; 100 of two empty texts."""
    both = len(x) + len(y)
    return (200 * common_length(x, y) + both // 2) // both if both else 100


@pandas_udf(IntegerType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the longest common subsequence over both lengths, rounded; 100 of two empty texts; null of a null."""
    return pd.Series([None if x is None or y is None else percent(x, y) for x, y in zip(a, b)], dtype="Int32")
