"""Requests in plain words that need no model: a verb, a field and a value become a command, as a Column.

``route`` gives struct(intent, field, value, source, only_if_missing, scope, uses_referent), or null where the request isn't
one of the known forms and is left to a model. The forms, in order: grouping by album folders, splitting joined artists of
selected tracks, "set them ...", then ``verb [the] [missing] field [to] value``. What tells how to derive a value is never
taken as a value: folder names are a source of their own, other derivations aren't routed. Quotes make anything a value.

``change them`` is read as ``set them``, and verbs and articles in any case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import text as T

# Fields that requests may name, as they are spelt there; words of the forms.
FIELDS = [
    "title", "artist", "album", "genre", "year", "composer", "comment", "description", "lyrics", "albumArtist", "albumArtists", "artists", "trackNumber", "trackTotal", "discNumber", "discTotal", "compilation",
]
SPELT_APART = {"album artist": "albumArtist", "album artists": "albumArtists", "track number": "trackNumber", "track total": "trackTotal", "disc number": "discNumber", "disc total": "discTotal"}
VERBS = {"set": "set", "change": "set", "remove": "remove", "clear": "remove", "fix": "fix"}
FOLDER_FORMS = r"based on|^from |^use |^using |derive|same as|folder's name|^(?:their |the |its )?folder name$"
DERIVED = "based on|derived from|derive|according to|same as|folder name|filename|file name|use the title|using the title|from the title|by title|from the|using "
GROUPING, FOLDERS = "group|organi[sz]e", "folder|file"
REPAIRING, BROKEN = "fix|repair|split|normalize", "malformed|incorrect|joined|separator|split|separate values"

COLUMN = {"albumArtist": "album_artist", "albumArtists": "album_artists", "trackNumber": "track_number", "trackTotal": "track_total", "discNumber": "disc_number", "discTotal": "disc_total"}
_NAMES = SPELT_APART | {f.lower(): f for f in FIELDS}
_FIELD = rf"(?i)^({'|'.join(SPELT_APART)}|(?:the )?(?:{'|'.join(f.lower() for f in FIELDS)}))(?: (.*))?$"


def _command(intent: str, field: Column | str | None = None, value: Column | None = None, source: str | None = None, only_if_missing: Column | bool = False, scope: Column | str = "library", uses_referent: bool = False) -> Column:
    lit = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    values = {"intent": (intent, "string"), "field": (field, "string"), "value": (value, "string"), "source": (source, "string"), "only_if_missing": (only_if_missing, "boolean"), "scope": (scope, "string"), "uses_referent": (uses_referent, "boolean")}
    return F.struct(*[lit(v, kind).alias(k) for k, (v, kind) in values.items()])


def is_quoted(text: Column) -> Column:
    return T.trim(text).rlike(r"""(?s)^(?:".*"|'.*'|["'])$""")


def unquoted(text: Column) -> Column:
    """Without blanks and one pair of quotes around it."""
    return T.trim(F.regexp_replace(T.trim(text), r"""(?s)^(["'])(.*)\1$""", "$2"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(T.collapse(text), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", ""))


def names_folder(text: Column) -> Column:
    """Whether a value's place tells to take the folder's name."""
    return _bound(_bare(text), lambda t: t.contains("folder") & t.rlike(FOLDER_FORMS))


def is_derived(text: Column) -> Column:
    return _bare(text).rlike(DERIVED)


def _named(text: Column) -> Column:
    """The canonical name of a field, however it is spelt."""
    spelt = F.regexp_replace(F.lower(text), "^the ", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), spelt)


def _regular(message: Column, lower: Column) -> Column:
    verb = F.regexp_extract(lower, rf"^({'|'.join(VERBS)}) ", 1)
    action = F.try_element_at(F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair]), verb)
    yes = lambda c: F.coalesce(c, F.lit(False))

    def of_body(body: Column) -> Column:
        told = F.regexp_replace(body, r"^(?:the )?missing ", "")
        rest = F.nullif(T.trim(F.coalesce(T.extract(told, _FIELD, 2), F.lit(""))), F.lit(""))
        parts = F.struct(body.rlike(r"^(?:the )?missing ").alias("asked"), _named(T.extract(told, _FIELD)).alias("field"), rest.alias("rest"), F.when(rest.startswith("to "), F.substr(rest, F.lit(4))).alias("after_to"))
        return _bound(parts, of_parts)

    def of_parts(p: Column) -> Column:
        asked, rest, after_to = p["asked"], p["rest"], p["after_to"]
        alone = yes(rest.isin("where missing", "missing"))
        literal = ~asked & yes(is_quoted(rest) | is_quoted(after_to))
        seen = F.struct(
            p["field"].alias("field"), rest.alias("rest"), after_to.alias("after_to"), asked.alias("asked"), alone.alias("alone"), literal.alias("literal"),
            (asked | alone | lower.contains(" where missing") | lower.contains("missing ") | lower.endswith("missing")).alias("missing"),
            (~asked & ~literal & yes(names_folder(F.coalesce(after_to, rest)))).alias("folder"),
        )
        return _bound(seen, decided)

    def decided(s: Column) -> Column:
        field, missing = s["field"], s["missing"]
        derived = ~s["asked"] & ~s["literal"] & ~s["folder"] & s["after_to"].isNull() & ~s["alone"] & yes(is_derived(s["rest"]))
        value = unquoted(F.when(s["asked"], s["after_to"]).when(s["alone"] | s["folder"], F.lit(None)).otherwise(F.coalesce(s["after_to"], s["rest"])))
        scope = F.when(missing, "library_missing").otherwise("library")
        to_set = (
            F.when(derived, F.lit(None)).when(s["folder"], _command("set_field_from", field, source="folder_name", only_if_missing=missing, scope=scope))
            .when(missing & value.isNull(), _command("set_missing", field, only_if_missing=True, scope=scope)).otherwise(_command("set_field", field, value, only_if_missing=missing, scope=scope))
        )
        known = field.isNotNull()
        return (
            F.when((action == "set") & known, to_set).when((action == "remove") & known, _command("remove_field", field))
            .when((action == "fix") & known & missing, _command("set_missing", field, only_if_missing=True, scope="library_missing"))
        )

    return _bound(T.trim(F.regexp_replace(message, r"(?is)^\w+ +(?:the )?", "")), of_body)


def _of_referent(message: Column, referent_field: Column, referent_count: Column) -> Column:
    text = F.nullif(T.trim(F.regexp_replace(message, r"(?i)^\w+ them ?", "")), F.lit(""))
    after_to = F.when(text.startswith("to "), F.substr(text, F.lit(4)))
    quoted = is_quoted(text) | F.coalesce(is_quoted(after_to), F.lit(False))
    derived = F.when(after_to.isNotNull(), names_folder(after_to)).otherwise(names_folder(text) | is_derived(text))
    wanted = (referent_count > 0) & ~F.coalesce(~quoted & derived, F.lit(False))
    return F.when(wanted, _command("set_field", referent_field, unquoted(text), only_if_missing=True, scope="referent", uses_referent=True))


def route(message: Column, referent_field: Column | None = None, referent_count: Column | None = None) -> Column:
    """The command of a request. ``referent_field`` and ``referent_count``: what an earlier request found, for "them"."""
    field, count = (F.lit(None).cast(t) if c is None else c for c, t in ((referent_field, "string"), (referent_count, "long")))

    def of(s: Column) -> Column:
        message, lower = s["message"], s["lower"]
        grouping = lower.contains("album") & lower.rlike(GROUPING) & lower.rlike(FOLDERS)
        plural = lower.rlike(r"(?:^|[^\p{L}\p{N}])artists(?:[^\p{L}\p{N}]|$)") & ~lower.rlike("album ?artists")
        splitting = lower.contains("selected") & plural & lower.rlike(REPAIRING) & lower.rlike(BROKEN)
        them = lower.rlike(r"^(?:set|change) them(?: |$)")
        return (
            F.when(grouping, _command("group_by_album", "album", scope="active")).when(splitting, _command("split_artists", "artists", scope="selected"))
            .when(them, _of_referent(message, field, count)).otherwise(_regular(message, lower))
        )

    trimmed = T.trim(message)
    return _bound(F.struct(trimmed.alias("message"), F.lower(trimmed).alias("lower")), of)


def in_scope(command: Row, selected: list[str], active_album: str | None) -> Column:
    """Which tracks a command means: of all, of those that lack its field, of the selected ones, or of what is active."""
    column = COLUMN.get(command.field, command.field)
    chosen = F.col("path").isin(*selected) if selected else F.lit(False)
    if command.scope == "selected":
        return chosen
    if command.scope == "active":
        return chosen if selected else T.inside(F.col("path"), F.lit(active_album)) if active_album else F.lit(True)
    return T.missing(F.col(column)) if command.only_if_missing else F.lit(True)


def actions(tracks: DataFrame, command: Row, selected: list[str] | None = None, active_album: str | None = None) -> DataFrame:
    """(path, field, old_value, new_value, operation): what a routed command that sets or removes a field changes."""
    if command.intent not in ("set_field", "set_field_from", "remove_field") or command.intent == "set_field" and command.value is None:
        raise ValueError(f"{command.intent} needs more than the request tells")
    column = COLUMN.get(command.field, command.field)
    new = F.lit(command.value)
    if command.intent == "set_field_from":
        new = F.nullif(T.basename(T.parent(F.col("path"))), F.lit(""))
    elif command.intent == "remove_field":
        new = F.lit(None)
    rows = tracks.filter(in_scope(command, selected or [], active_album)).select("path", F.lit(column).alias("field"), F.col(column).cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    changed = rows.filter("NOT old_value <=> new_value")
    return changed.withColumn("operation", F.when(F.col("new_value").isNull(), "remove").otherwise("set"))
