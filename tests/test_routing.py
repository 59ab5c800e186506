"""Requests in plain words: the command of each, or none."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stackwright.functions import routing

FOLDER = ("set_field_from", "album", None, "folder_name", False, "library", False)
CASES = {
    "group files into album folders": ("group_by_album", "album", None, None, False, "active", False),
    "fix the malformed “Artists” tags from selected tracks": ("split_artists", "artists", None, None, False, "selected", False),
    "fix the singular Artist display field on selected tracks": None,
    "fix malformed Album Artists tags on selected tracks": None,
    "set genre to Pop": ("set_field", "genre", "Pop", None, False, "library", False),
    "set genre Pop": ("set_field", "genre", "Pop", None, False, "library", False),
    'set genre to "Pop, Cantopop"': ("set_field", "genre", "Pop, Cantopop", None, False, "library", False),
    "set title 'It''s'": ("set_field", "title", "It''s", None, False, "library", False),
    'set title "unclosed': ("set_field", "title", '"unclosed', None, False, "library", False),
    "set genre where missing": ("set_missing", "genre", None, None, True, "library_missing", False),
    "change title to New Title": ("set_field", "title", "New Title", None, False, "library", False),
    "remove genre": ("remove_field", "genre", None, None, False, "library", False),
    "clear comment": ("remove_field", "comment", None, None, False, "library", False),
    "fix the missing genre": ("set_missing", "genre", None, None, True, "library_missing", False),
    'set the missing genre to "Pop, Cantopop"': ("set_field", "genre", "Pop, Cantopop", None, True, "library_missing", False),
    "set album artist to Artist Name": ("set_field", "albumArtist", "Artist Name", None, False, "library", False),
    "set albumArtists to A; B": ("set_field", "albumArtists", "A; B", None, False, "library", False),
    "set Track Number 7": ("set_field", "trackNumber", "7", None, False, "library", False),
    "set albums to X": None,
    "what genres are missing?": None,
    "fix the metadata": None,
    "what genres are in this library?": None,
    "": None,
    "change the album based on their folder name": FOLDER,
    "set album from the containing folder": FOLDER,
    "set album from the parent folder": FOLDER,
    "set album use the folder name": FOLDER,
    "set album using folder name": FOLDER,
    "change the album based on their folder name.": FOLDER,
    "CHANGE THE ALBUM BASED ON THEIR FOLDER NAME": FOLDER,
    "set Album from the folder name": FOLDER,
    "change the album to their folder name": FOLDER,
    "derive album according to the catalog structure": None,
    "set album based on the title": None,
    "set album from the track filename": None,
    "set genre based on their mood": None,
    "set album to Based on a True Story": ("set_field", "album", "Based on a True Story", None, False, "library", False),
    'set comment "based on their folder name"': ("set_field", "comment", "based on their folder name", None, False, "library", False),
    "set title to Folder Songs": ("set_field", "title", "Folder Songs", None, False, "library", False),
    'set them "Pop, Cantopop"': None,
}


def commands(spark, messages, *referent):
    rows = spark.createDataFrame([(m,) for m in messages], "m string")
    return {r.m: r.c and tuple(r.c) for r in rows.select("m", routing.route(F.col("m"), *referent).alias("c")).collect()}


def test_requests_become_commands_or_are_left_to_a_model(spark):
    found = commands(spark, CASES)
    assert {m: c for m, c in found.items() if c != CASES[m]} == {}


def test_them_is_what_was_found_before(spark):
    told = ('set them "Pop, Cantopop"', "set them Rock", "set them based on the folder name", 'set them "based on the folder name"', "set them to their folder name", "set them", "change them Jazz")
    command = lambda v: ("set_field", "genre", v, None, True, "referent", True)
    assert commands(spark, told, F.lit("genre"), F.lit(12)) == {
        told[0]: command("Pop, Cantopop"), told[1]: command("Rock"), told[2]: None, told[3]: command("based on the folder name"), told[4]: None, told[5]: command(None), told[6]: command("Jazz"),
    }
    assert set(commands(spark, told, F.lit("genre"), F.lit(0)).values()) == {None}


@pytest.mark.parametrize(
    "message, wanted",
    [
        ("set genre to Pop", {("/m/A/1", "Rock", "Pop", "set"), ("/m/A/2", None, "Pop", "set"), ("/m/B/3", "", "Pop", "set")}),
        ("set the missing genre to Pop", {("/m/A/2", None, "Pop", "set"), ("/m/B/3", "", "Pop", "set")}),
        ("remove genre", {("/m/A/1", "Rock", None, "remove"), ("/m/B/3", "", None, "remove")}),
        ("set album based on their folder name", {("/m/A/2", None, "A", "set"), ("/m/B/3", "x", "B", "set")}),
    ],
)
def test_commands_become_actions(spark, message, wanted):
    tracks = spark.createDataFrame([("/m/A/1", "Rock", "A"), ("/m/A/2", None, None), ("/m/B/3", "", "x")], "path string, genre string, album string")
    command = Row(*["intent", "field", "value", "source", "only_if_missing", "scope", "uses_referent"])(*commands(spark, [message])[message])
    assert {(r.path, r.old_value, r.new_value, r.operation) for r in routing.actions(tracks, command).collect()} == wanted


def test_scopes_of_grouping(spark):
    tracks = spark.createDataFrame([("/m/A/1",), ("/m/B/2",)], "path string")
    command = Row("field", "scope", "only_if_missing")("album", "active", False)
    scope = lambda *a: [r.path for r in tracks.filter(routing.in_scope(command, *a)).collect()]
    assert (scope(["/m/B/2"], "/m/A"), scope([], "/m/A"), scope([], None)) == (["/m/B/2"], ["/m/A/1"], ["/m/A/1", "/m/B/2"])


def test_what_needs_more_is_no_action(spark):
    with pytest.raises(ValueError, match="needs more"):
        routing.actions(spark.createDataFrame([("x",)], "path string"), Row("intent", "value")("set_missing", None))
