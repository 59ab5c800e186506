"""Lyrics: languages, checks of texts that were decoded wrongly, files beside tracks, and the LRC format."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import text as T

# Letters of scripts, names of languages, and encodings of East Asian texts.
HANGUL, KANA, HAN = r"\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", r"\u3040-\u30ff\u31f0-\u31ff", r"\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0002fa1f"
LANGUAGES = {"zh": "zho", "chi": "zho", "zho": "zho", "ja": "jpn", "jpn": "jpn", "ko": "kor", "kor": "kor", "en": "eng", "eng": "eng"}
UNSTATED = ["und", "xxx", ""]
ENCODINGS = ["gb18030", "big5", "shift_jis", "euc_kr"]
_EAST_ASIAN = re.compile(f"[{HANGUL}{KANA}{HAN}]")
_CONTROLS = re.compile(r"[\x01-\x08\x0b-\x1f\x7f-\x9f]")


def language(stated: Column, lyrics: Column) -> Column:
    """The three-letter code of a stated language, else the one that the text's script tells, else ``und``."""
    code = F.lower(T.trim(F.coalesce(stated, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    other = F.when(code.rlike("^[a-z]{3}$") & ~code.isin(UNSTATED), code)
    java = lambda letters: re.sub(r"\\[uU]0*([0-9a-f]+)", r"\\x{\1}", letters)
    by_script = F.when(lyrics.rlike(f"[{java(HANGUL)}]"), "kor").when(lyrics.rlike(f"[{java(KANA)}]"), "jpn").when(lyrics.rlike(f"[{java(HAN)}]"), "zho").otherwise("und")
    return F.coalesce(F.try_element_at(known, code), other, by_script)


def _repaired(text: str, encoding: str) -> str | None:
    """What the text was before UTF-8 bytes were read as ``encoding``, if it can have been."""
    try:
        found = text.encode(encoding).decode("utf-8")
    except UnicodeError:
        return None
    return found if found != text and _EAST_ASIAN.search(found) else None


def misread(text: str) -> bool:
    """Whether a text looks like UTF-8 that was read in another encoding."""
    if not _EAST_ASIAN.search(text):
        return _repaired(text, "cp1252") is not None
    bare = lambda t: len("".join(t.split()))
    return any(3 * bare(r) <= 2 * bare(text) for r in (_repaired(text, e) for e in ENCODINGS) if r is not None)


def problem_of(text: str) -> str | None:
    if "\0" in text:
        return "nul"
    if "\ufffd" in text:
        return "replacement"
    if _CONTROLS.search(text):
        return "control"
    return "misread" if misread(text) else None


@pandas_udf(StringType())
def _problem(text: pd.Series) -> pd.Series:
    return text.map(problem_of, na_action="ignore")


def unified(text: Column) -> Column:
    """Without a byte order mark, line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def problem(text: Column) -> Column:
    """Why lyrics are refused: nul, replacement, control, misread; null if they are fine. Plain texts stay in the JVM."""
    whole = unified(text)
    plain = whole.rlike(r"^[\n\t\x20-\x7E]*$")
    return _problem(F.when(~plain, whole))


def decoded(data: bytes) -> str | None:
    """The text of a file: by its byte order mark, as UTF-8, else in the first East Asian encoding that gives clean text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ("utf-8", *ENCODINGS, "cp1252"):
        try:
            found = data.decode(name)
        except UnicodeError:
            continue
        if problem_of(found.replace("\r\n", "\n").replace("\r", "\n")) is None:
            return found
    return None


@pandas_udf(StringType())
def decode(data: pd.Series) -> pd.Series:
    return data.map(lambda d: decoded(bytes(d)), na_action="ignore")


def sidecars(files: DataFrame) -> DataFrame:
    """(base, path, kind, lyrics): of each track's text files the .lrc before the .txt. ``files``: path, content."""
    ext = T.extension(F.col("path"))
    found = files.filter(ext.isin("lrc", "txt")).select(F.regexp_replace("path", r"\.[^./]+$", "").alias("base"), "path", ext.alias("kind"), decode(F.col("content")).alias("lyrics"))
    fine = found.withColumn("lyrics", unified(F.col("lyrics"))).filter(F.col("lyrics").isNotNull() & problem(F.col("lyrics")).isNull() & ~T.missing(F.col("lyrics")))
    best = F.min_by(F.struct("path", "kind", "lyrics"), F.struct("kind", "path")).alias("b")
    return fine.groupBy("base").agg(best).select("base", "b.*")


def to_lrc(lines: Column) -> Column:
    """LRC text of array<struct(ms, text)>: ``[mm:ss.cc]text``, a line each."""

    def one(line: Column) -> Column:
        ms = line["ms"]
        return F.concat(F.format_string("[%02d:%02d.%02d]", F.floor(ms / 60000), F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100), line["text"])

    return F.array_join(F.transform(lines, one), "\n")
