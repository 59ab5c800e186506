"""Arguments of tool calls: each schema with good and bad ones."""

import json

from pyspark.sql import functions as F

from stackwright.functions import arguments as A

SCOPE = {"target_scope": "library"}
GOOD = {
    "library.summarize": {},
    "query.datasetStatus": {},
    "tracks.search": {"title": "x", "missingCover": True, "hasDuplicates": False, "offset": 0, "limit": 10.5, "year": None},
    "tracks.inspect": {"paths": ["a", "b"], "limit": 5},
    "albums.inspect": {"path": "/m"},
    "query.metadata": {"missingTags": "genre", "aggregate": True},
    "api.musicbrainzSearch": {"query": "artist:x"},
    "api.discogsSearch": {"query": "x", "type": "master"},
    "api.lyricsSearch": {"artist": "a", "title": "t"},
    "tags.prettify": {"text": "x", "fields": {"anything": [1, {"deep": None}]}},
    "metadata.patch": SCOPE | {"changes": [{"field": "genre", "action": "set", "value": 3, "only_if_missing": True}], "per_track_changes": [{"path": "p", "changes": [{"field": "title", "action": "remove"}]}]},
    "metadata.transform": SCOPE | {"operations": [{"op": "split_artists"}, {"op": "regex_extract", "pattern": "x", "group_index": 1}], "source": {"kind": "filename"}},
    "files.transform": SCOPE | {"operations": [{"op": "trim"}]},
    "files.relocate": SCOPE | {"destination": {"template": "{value}", "source": {"kind": "tag", "field": "album"}, "operations": []}},
    "library.run_task": SCOPE | {"task": "audit"},
    "plan.create": {"steps": [{"id": "1", "tool": "tracks.search", "args": {"x": 1}, "depends_on": []}]},
}
BAD = [
    ("library.summarize", {"x": 1}, "Unknown field: x"),
    ("tracks.search", {"title": 5}, 'Field "title" should be a string, got number'),
    ("tracks.search", {"missingCover": "yes"}, 'Field "missingCover" should be a boolean, got string'),
    ("tracks.search", {"zebra": 1, "apple": 1, "limit": "x"}, "Unknown field: apple"),
    ("tracks.inspect", {"paths": "a"}, 'Field "paths" should be a array, got string'),
    ("tracks.inspect", {"paths": ["a", 5, None]}, 'Field "paths[1]" should be a string, got number'),
    ("tracks.inspect", {"paths": [None]}, 'Field "paths[0]" should be a string, got null'),
    ("albums.inspect", {"path": {"a": 1}}, 'Field "path" should be a string, got object'),
    ("query.metadata", {"missingTags": "cover"}, 'Field "missingTags" should be one of: title, artist, album, year, genre'),
    ("api.musicbrainzSearch", {}, "Missing required field: query"),
    ("api.lyricsSearch", {"artist": None, "extra": 1}, "Missing required field: artist"),
    ("metadata.patch", SCOPE | {"changes": [{"field": "genre"}]}, "Missing required field: changes[0].action"),
    ("metadata.patch", SCOPE | {"changes": [{"field": "a", "action": "set"}, {"field": "b", "action": "drop"}]}, 'Field "changes[1].action" should be one of: set, remove, upsert'),
    ("metadata.patch", SCOPE | {"per_track_changes": [{"path": "p", "changes": [{"field": "x", "action": "set", "why": 1}]}]}, "Unknown field: per_track_changes[0].changes[0].why"),
    ("metadata.transform", SCOPE | {"operations": [{"op": "explode"}]}, None),
    ("files.transform", SCOPE | {"operations": [{"op": "split_artists"}]}, None),
    ("files.relocate", SCOPE | {"destination": {"template": "x", "source": {"kind": "tag", "place": 1}}}, "Unknown field: destination.source.place"),
    ("files.relocate", SCOPE | {"destination": "x"}, 'Field "destination" should be a object, got string'),
    ("library.run_task", {"task": "audit"}, "Missing required field: target_scope"),
    ("plan.create", {"steps": [{"id": "1", "tool": "x", "args": []}]}, 'Field "steps[0].args" should be a object, got array'),
    ("no.such", {}, "Unknown tool: no.such"),
]


def test_each_schema_with_good_and_bad_arguments(spark):
    assert GOOD.keys() == A.TOOLS.keys()
    calls = [(k, t, json.dumps(a)) for k, (t, a) in enumerate([*GOOD.items(), *((t, a) for t, a, _ in BAD)])]
    texts = [(len(calls) + k, "library.summarize", t) for k, t in enumerate(["", "[1]", "5", "{bad", None])]
    rows = spark.createDataFrame(calls + texts, "k int, tool string, arguments string")
    found = {r.k: r.p for r in rows.select("k", A.call_problem(F.col("tool"), F.col("arguments")).alias("p")).collect()}
    assert {k: p for k, p in found.items() if k < len(GOOD) and p} == {}
    for k, (_, _, wanted) in enumerate(BAD):
        told = found[len(GOOD) + k]
        assert told == wanted if wanted else told.startswith('Field "operations[0].op" should be one of: regex_replace'), BAD[k]
    assert {found[k] for k, _, _ in texts} == {"Tool arguments should be an object"}
