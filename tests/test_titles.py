"""Titles after a match: what is cleaned, what stays, and by which rule."""

from pyspark.sql import functions as F

from stackwright.operators import matching, titles

LOCAL = "album_id int, idx long, title string, artist string, artists array<string>, artist_hint string, filename string, track_number int, disc_number int, musicbrainz_track_id string, length double"
REMOTE = "album_id int, idx long, source string, title string, match_titles array<string>, track_number int, disc_number int, recording_id string, length double"

REPLACED = [
    ("微光(亚特兰提斯)(24bit-48Hz)", "微光", [], "微光"),
    ("Song (Live)", "Song", [], None),
    ("Song (Acoustic version)", "Song", [], None),
    ("Song", "Song", [], None),
    ("Artist - Song (Remaster 24bit)", "Song", [], "Song"),
    ("Artist – Song – Title extra words", "Title", [], "Title"),
    ("SONG！ (bonus)", "Song!", [], "SONG！"),
    ("Songs", "Song", [], None),
    ("Other (bonus)", "Song", ["other"], "Song"),
    ("Song (bonus)", "", [], None),
    (None, "Song", [], None),
    ("  ", "Song", [], None),
    ("A bonus", "A", [], None),
]


def test_polluted_titles_are_cleaned(spark):
    rows = spark.createDataFrame([(k, t, r, f) for k, (t, r, f, _) in enumerate(REPLACED)], "k int, title string, remote_title string, remote_forms array<string>")
    found = {r.k: r.replacement for r in titles.with_replacement(rows).collect()}
    assert found == {k: c[3] for k, c in enumerate(REPLACED)}


#: (what differs of the local track, of the release's, source, evidence, title and rule); each is an album of its own.
RULES = [
    (dict(title="微光(亚特兰提斯)(24bit-48Hz)"), dict(title="微光"), "musicbrainz", ("微光", "polluted")),
    (dict(title="Song (Live)"), dict(title="Song"), "musicbrainz", ("Song (Live)", "own")),
    (dict(title="song!"), dict(title="Song"), "musicbrainz", ("song!", "own")),
    (dict(title="Der Name"), dict(title="The Name", match_titles=["Der Name"]), "musicbrainz", ("The Name", "other_title")),
    (dict(title="Der Name"), dict(title="The Name", match_titles=["Der Name"]), "dataset", ("Der Name", "own")),
    (dict(title="Whatever", musicbrainz_track_id="r1"), dict(title="Song", recording_id="r1"), "musicbrainz", ("Song", "recording")),
    (dict(title="-", filename="01. Artist - Song.flac", artist="Artist"), dict(title="Song"), "discogs", ("Song", "placeholder")),
    (dict(title=None, filename="05. 费玉清-变色湖长城.flac", artist="费玉清"), dict(title="变色湖长城"), "dataset", ("变色湖长城", "file")),
    (dict(title="小虎队 - 沙丘魔堡", filename="小虎队 - 沙丘魔堡.wav", artist_hint="小虎队"), dict(title="沙丘魔堡"), "dataset", ("沙丘魔堡", "file")),
    (dict(title="小虎队 - 沙丘魔堡", filename="小虎队 - 沙丘魔堡.wav", artist_hint="小虎队"), dict(title="沙丘魔堡"), "musicbrainz", ("沙丘魔堡", "file")),
    (dict(title="Artist - Title feat. Guest", filename="x.flac", artist="Artist"), dict(title="Title"), "musicbrainz", ("Title", "polluted")),
    (dict(title=None, filename="Artist - Title feat. Guest.flac", artist="Artist"), dict(title="Title"), "musicbrainz", ("Title", "placeholder")),
]


def test_rules_in_order(spark):
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    ours, theirs = [], []
    for k, (local, remote, source, _) in enumerate(RULES):
        ours.append(dict.fromkeys(names(LOCAL)) | {"album_id": k, "idx": 0, "filename": "x.flac", "track_number": 1, "disc_number": 1, "length": 200.0} | local)
        theirs.append(dict.fromkeys(names(REMOTE)) | {"album_id": k, "idx": 7, "source": source, "track_number": 1, "disc_number": 1, "length": 200.0} | remote)
    a = spark.createDataFrame([tuple(r.values()) for r in ours], LOCAL)
    b = spark.createDataFrame([tuple(r.values()) for r in theirs], REMOTE)
    # What titles don't match, positions do in larger albums.
    aligned = matching.align_tracks(a, b).withColumns({"evidence": F.coalesce("evidence", F.lit("position")), "remote_idx": F.coalesce("remote_idx", F.lit(7))})
    found = {r.album_id: r for r in titles.rewritten(aligned, a, b).collect()}
    assert {k: (r.title, r.rule) for k, r in found.items()} == {k: c[3] for k, c in enumerate(RULES)}
    assert all(r.old_title == ours[k]["title"] for k, r in found.items())


def test_placeholders(spark):
    rows = [("Track 01", True), ("track7", True), (" - ", True), ("n/a", True), ("NA", True), ("Untitled", True), ("", True), (None, True), ("Track A", False), ("Unknown Song", False)]
    found = spark.createDataFrame(rows, "t string, w boolean").withColumn("p", titles.is_placeholder(F.col("t")))
    assert found.filter("p <> w").collect() == []
