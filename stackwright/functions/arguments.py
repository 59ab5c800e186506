"""Arguments of tool calls, as JSON text, checked against schemas: the first thing that is wrong, as a Column.

A schema says which fields there are, which must be, and what their values are; fields that it doesn't know are errors with
their path. Texts are parsed once, to variants, and all checks are expressions over those, nested lists and records
included. Order: what is required and lacks, in the schema's order, then fields by name. Null values count as not given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schema:
    """A kind of value: string, number, boolean, array, object or any; ``values`` are the only ones allowed."""

    kind: str = "any"
    values: tuple[str, ...] = ()
    items: Schema | None = None
    fields: dict[str, Schema] | None = None
    required: tuple[str, ...] = field(default=())


TEXT, NUMBER, FLAG, ANY, OBJECT = Schema("string"), Schema("number"), Schema("boolean"), Schema(), Schema("object")
TEXTS = Schema("array", items=TEXT)


def one_of(*values: str) -> Schema:
    return Schema("string", values)


def list_of(items: Schema) -> Schema:
    return Schema("array", items=items)


def record(*required: str, **fields: Schema) -> Schema:
    return Schema("object", fields=fields, required=required)


def _tools() -> dict[str, Schema]:
    """The tools that a model may call, their fields, and what those may say."""
    scope = {"target_scope": one_of("selected", "active_album", "library", "explicit_paths"), "paths": TEXTS}
    shared = ["regex_replace", "regex_extract", "strip_prefix", "strip_suffix", "literal_replace", "trim", "lowercase", "uppercase", "title_case", "prettify", "chinese_to_simplified", "chinese_to_traditional"]
    given = {"pattern": TEXT, "replacement": TEXT, "group_index": NUMBER, "prefix": TEXT, "suffix": TEXT, "find": TEXT}
    operations = list_of(record("op", op=one_of(*shared), **given))
    of_tags = list_of(record("op", op=one_of(*shared[:10], "split_artists", *shared[10:]), **given))
    place = record(kind=one_of("tag", "filename"), field=TEXT)
    own = record("field", "action", field=TEXT, action=one_of("set", "remove"), value=ANY)
    change = record("field", "action", tag_kind=one_of("standard", "extra"), field=TEXT, action=one_of("set", "remove", "upsert"), value=ANY, valueFrom=one_of("folder_name"), only_if_missing=FLAG)
    step = record("id", "tool", id=TEXT, label=TEXT, tool=TEXT, args=OBJECT, depends_on=TEXTS)
    flags = {f: FLAG for f in ("missingTitle", "missingArtist", "missingAlbum", "missingYear", "missingGenre", "missingCover", "hasDuplicates")}
    texts = {f: TEXT for f in ("title", "artist", "album", "genre", "year", "codec")}
    page = {"offset": NUMBER, "limit": NUMBER}
    return {
        "library.summarize": record(),
        "query.datasetStatus": record(),
        "tracks.search": record(**texts, **flags, **page),
        "tracks.inspect": record(paths=TEXTS, **page),
        "albums.inspect": record(path=TEXT),
        "query.metadata": record(aggregate=FLAG, missingTags=one_of("title", "artist", "album", "year", "genre"), duplicates=FLAG),
        "api.musicbrainzSearch": record("query", query=TEXT, limit=NUMBER),
        "api.discogsSearch": record("query", query=TEXT, type=one_of("release", "master", "artist", "label"), limit=NUMBER),
        "api.lyricsSearch": record("artist", "title", artist=TEXT, title=TEXT),
        "tags.prettify": record(text=TEXT, fields=OBJECT),
        "metadata.patch": record("target_scope", **scope, changes=list_of(change), per_track_changes=list_of(record("path", "changes", path=TEXT, changes=list_of(own)))),
        "metadata.transform": record("target_scope", "operations", **scope, source=place, destination=place, operations=of_tags),
        "files.transform": record("target_scope", "operations", **scope, source=place, operations=operations),
        "files.relocate": record("target_scope", "destination", **scope, destination=record("template", template=TEXT, source=place, operations=operations)),
        "library.run_task": record("task", "target_scope", task=one_of("auto_tag", "audit"), **scope),
        "plan.create": record("steps", plan_description=TEXT, steps=list_of(step)),
    }


TOOLS = _tools()


def _kind(value: Column) -> Column:
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number")
    )


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _bound(value: Column, check: Callable[[Column], Column]) -> Column:
    """``check`` of a value that is computed once, however often the check names it."""
    return F.get(F.transform(F.array(value), check), F.lit(0))


def _of_value(value: Column, kind: Column, schema: Schema, path: Column) -> Column:
    checks = []
    if schema.kind != "any":
        checks.append(F.when(kind != schema.kind, F.concat(F.lit('Field "'), path, F.lit(f'" should be a {schema.kind}, got '), kind)))
    if schema.values:
        allowed = ", ".join(schema.values)
        checks.append(F.when(~value.try_cast("string").isin(*schema.values), F.concat(F.lit('Field "'), path, F.lit(f'" should be one of: {allowed}'))))
    if schema.items:
        items = F.when(kind == "array", value.try_cast("array<variant>"))
        checks.append(_first(F.transform(items, lambda x, i: _bound(_kind(x), lambda k: _of_value(x, k, schema.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))))
    if schema.fields is not None:
        checks.append(F.when(kind == "object", _of_record(value, schema, F.concat(path, F.lit(".")))))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def _of_record(value: Column, schema: Schema, prefix: Column) -> Column:
    """What is wrong with a value that is an object."""

    def entry(name: Column, error: Column) -> Column:
        return F.struct(name.alias("name"), error.alias("error"))

    def checked(held: Column) -> Column:
        given = lambda name: F.try_element_at(held, F.lit(name))
        absent = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
        lacks = [F.when(absent(given(name)), F.concat(F.lit("Missing required field: "), prefix, F.lit(name))) for name in schema.required]

        def of_field(name: str, of: Schema) -> Column:
            check = lambda v: F.when(~absent(v), _bound(_kind(v), lambda k: _of_value(v, k, of, F.concat(prefix, F.lit(name)))))
            return entry(F.lit(name), _bound(given(name), check))

        strange = F.filter(F.map_keys(held), lambda k: ~k.isin(*schema.fields)) if schema.fields else F.map_keys(held)
        wrong = F.transform(strange, lambda k: entry(k, F.concat(F.lit("Unknown field: "), prefix, k)))
        if schema.fields:
            wrong = F.concat(F.array(*[of_field(name, of) for name, of in schema.fields.items()]), wrong)
        return F.coalesce(*lacks, F.get(F.array_sort(F.filter(wrong, lambda e: e["error"].isNotNull())), F.lit(0))["error"])

    return _bound(value.try_cast("map<string,variant>"), checked)


def problem(arguments: Column, schema: Schema) -> Column:
    """What is wrong with arguments (JSON text); null if nothing is."""

    def checked(parsed: Column) -> Column:
        whole = F.coalesce(_kind(parsed) == "object", F.lit(False))
        return F.when(~whole, "Tool arguments should be an object").otherwise(_of_record(parsed, schema, F.lit("")))

    return _bound(F.try_parse_json(arguments), checked)


def call_problem(tool: Column, arguments: Column, tools: dict[str, Schema] = TOOLS) -> Column:
    """What is wrong with a call of a tool by name."""
    checks = F.lit(None).cast("string")
    for name, schema in tools.items():
        checks = F.when(tool == name, problem(arguments, schema)).otherwise(checks)
    return F.when(~F.coalesce(tool.isin(*tools), F.lit(False)), F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("")))).otherwise(checks)
