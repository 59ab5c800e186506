"""Patterns that users write: templates of file names, wildcards, fielded queries. Each becomes one Column."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fields of templates, and what stands for a missing one.
DEFAULTS = {
    "title": "Unknown", "artist": "Unknown Artist", "album": "Unknown Album", "year": "0000", "genre": "Unknown", "albumArtist": "Unknown Album Artist",
    "composer": "Unknown Composer", "comment": "", "track": "01", "disc": "01", "ext": "", "filename": "",
}
SHAPES = {"track": r"\d+", "disc": r"\d+", "year": r"\d{4}", "ext": r"\.[^.]+", "filename": ".+"}
_FIELD = re.compile(r"%\{([A-Za-z][A-Za-z0-9]*)\}%")


def _tokens(pattern: str) -> list[str]:
    """Literals at even places, fields at odd ones; neighbours may share a percent sign."""
    return _FIELD.split(pattern.replace("}%{", "}%%{"))


def template_regex(pattern: str) -> tuple[str, list[str]]:
    """A Java regex for ``%{track}% - %{title}%`` and the fields of its groups; blanks fit any white space."""
    tokens = _tokens(pattern)
    fields = tokens[1::2]
    if not fields:
        raise ValueError("a pattern needs a field such as %{title}%")
    if wrong := [f for f in fields if f not in DEFAULTS] or [f for f in fields if fields.count(f) > 1]:
        raise ValueError(f"field {wrong[0]} isn't known, or stands twice")
    parts = []
    for k, token in enumerate(tokens):
        if k % 2:
            parts.append(f"({SHAPES.get(token, '.+' if token == fields[-1] else '.+?')})")
        else:
            parts += [r"\s+" if x.isspace() else "".join(rf"\{c}" if not c.isalnum() and c.isascii() else c for c in x) for x in re.split(r"(\s+)", token) if x]
    return f"^{''.join(parts)}$", fields


def parse_template(pattern: str, text: Column) -> Column:
    """map<field, value> of a text; blank values, the extension and the file name are left out. Null where nothing fits."""
    regex, fields = template_regex(pattern)
    each = [F.struct(F.lit(f).alias("key"), T.trim(F.regexp_extract(text, regex, k + 1)).alias("value")) for k, f in enumerate(fields) if f not in ("ext", "filename")]
    found = F.filter(F.array(*each), lambda e: e["value"] != "") if each else F.array().cast("array<struct<key:string,value:string>>")
    return F.when(text.rlike(regex), F.map_from_entries(found))


def parse_filename(pattern: str, filename: Column) -> Column:
    return parse_template(pattern, filename if "%{ext}%" in pattern else F.regexp_replace(filename, r"\.[^.]+$", ""))


def build_filename(pattern: str, fields: dict[str, Column], filename: Column) -> Column:
    """A name from a template; missing fields get their default, numbers two digits, unknown fields nothing."""
    known = dict(fields) | {
        "ext": F.when(filename.contains("."), F.concat(F.lit("."), F.element_at(F.split(filename, r"\."), -1))).otherwise(".mp3"),
        "filename": F.regexp_replace(filename, r"\.[^.]+$", ""),
    }

    def value(name: str) -> Column:
        if name not in known:
            return F.lit(DEFAULTS.get(name, ""))
        text = known[name].cast("string")
        if name in ("track", "disc"):
            text = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
        return F.coalesce(text, F.lit(DEFAULTS[name]))

    return F.concat(*[value(t) if k % 2 else F.lit(t) for k, t in enumerate(_tokens(pattern))])


def like_glob(text: Column, pattern: str) -> Column:
    """Whether a text fits a pattern with ``*`` and ``?``, whatever its case."""
    parts = (".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.strip())
    return text.rlike(f"(?i)^{''.join(parts)}$")


def query_fields(query: str, fields: tuple[str, ...] = ("artist", "album")) -> dict[str, str]:
    """The fields of ``artist:Name album:"Some title"``: quoted, or up to the next field's marker."""
    found = {}
    for field in fields:
        at = query.lower().find(f"{field}:")
        if at < 0:
            continue
        tail = query[at + len(field) + 1 :].lstrip()
        if tail.startswith('"'):
            value, closed, _ = tail[1:].partition('"')
            if not closed:
                continue
        else:
            ends = [tail.lower().find(f" {other}:") for other in fields if other != field]
            value = tail[: min([e for e in ends if e >= 0], default=len(tail))].strip()
        if value:
            found[field] = value
    return found


def fielded(query: str, columns: dict[str, Column]) -> Column:
    """The predicate of a fielded query: each field's value is held by its column, whatever the case."""
    found = query_fields(query, tuple(columns))
    tests = [F.lower(F.coalesce(columns[f], F.lit(""))).contains(v.lower()) for f, v in found.items()]
    return F.array_min(F.array(*tests)) if tests else F.lit(True)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_struct(fields: list[str], **constants: object) -> Column:
    """JSON of columns and constants with sorted keys, nulls kept."""
    named = {f: F.col(f) for f in fields} | {k: F.lit(v) for k, v in constants.items()}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), {"ignoreNullFields": "false"})
