import json
import struct

import pytest
from pyspark.sql import functions as F

from stackwright.functions import lyrics, patterns
from stackwright.functions import names as N
from stackwright.functions import text as T
from stackwright.functions.pipeline import pipeline
from stackwright.operators import audit, candidates, health, matching, positions, rollups, scopes, state
from stackwright.plans import changes as planning
from stackwright.plans import edits
from stackwright.sources import library, providers, tags
from stackwright.streaming import incremental


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first().x


def test_text_functions(spark):
    s = F.col("s")
    assert one(spark, T.trim(s), s="　 a b 　") == "a b"
    assert one(spark, T.missing(s), s="　") and one(spark, T.missing(s), s=None)
    assert one(spark, T.extract(s, "([0-9]+)"), s="abc") is None
    assert tuple(one(spark, T.number_pair(s), s="3/0")) == (3, None)
    assert one(spark, N.split_names(s), s="王菲.那英 feat. AC/DC & ac; 王菲") == ["王菲", "那英", "AC", "DC"]
    assert one(spark, T.strip_annotations(s), s="Song (2011 Remastered)") == "Song"
    assert one(spark, T.title_key(T.nfkc(s)), s="Ｗｏｗ！  «Yes»") == "wow yes"
    assert tuple(one(spark, T.file_facts(s), s="1-02. A - B.flac")) == (1, 2, "A", "B")
    assert tuple(one(spark, T.file_facts(s), s="07 B.mp3")) == (None, 7, None, "B")
    assert one(spark, T.folder_year(s), s="Best of (1999)") == "1999"
    assert one(spark, T.folder_album(s, F.lit("Artist")), s="2020 - ARTIST - Album [FLAC]") == "Album"
    assert one(spark, T.seconds(s), s="1:02:03") == 3723 and one(spark, T.seconds(s), s="x") is None
    assert one(spark, T.similarity(s, F.lit("abxd")), s="abcd") == 75
    assert one(spark, T.simplified(s), s="愛你") == "爱你"
    assert one(spark, T.safe_name(s), s='a/b: "c"..') == "a b c"
    lines = one(spark, T.lyric_lines(s), s="[offset:100]\n[00:02.5][00:01.00]x\ny\n[00:00.05]z")
    assert [tuple(r) for r in lines] == [(0, "z"), (900, "x"), (2400, "x")]


@pytest.mark.parametrize(
    ("value", "operations", "wanted"),
    [
        ("01 - song", [("regex_replace", {"pattern": r"^\d+ - "}), ("title_case", {})], ("Song", True)),
        ("same", [("trim", {})], ("same", False)),
        ("same", [("regex_extract", {"pattern": "(same)"})], ("same", True)),
        ("same", [("regex_extract", {"pattern": "(other)"})], ("same", False)),
        (None, [("lowercase", {})], (None, False)),
        ("a; B & b", [("split_artists", {})], ("a; B", True)),
        ("03_the-song2", [("prettify", {})], ("The Song 2", True)),
    ],
)
def test_pipeline(spark, value, operations, wanted):
    assert tuple(one(spark, pipeline(F.col("s"), operations), s=value)) == wanted


def test_pipeline_refuses(spark):
    with pytest.raises(ValueError):
        pipeline(F.lit("x"), [("regex_replace", {"pattern": "(?=x)"})])
    with pytest.raises(ValueError):
        pipeline(F.lit("x"), [("literal_replace", {"find": ""})])


AUDITED = (
    "album_path string, idx int, filename string, title string, artist string, artists array<string>, album string, album_artist string, album_artists array<string>, "
    "year string, track_number int, track_total int, disc_number int, artist_hint string, album_hint string, disc_folder string"
)


def test_audit_rules(spark):
    rows = [
        ("a", 0, "01. AC/DC - Song.flac", "Wrong", "AC/DC", ["AC/DC"], "Wrong Album", "Artist", [], "2019", 9, None, None, "Artist", "2020 - Album", None),
        ("b", 0, "", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    found = {(r.album_path, r.field): r for r in audit.audit_findings(spark.createDataFrame(rows, AUDITED)).collect()}
    assert found["a", "title"].suggestion == "Song" and found["a", "album"].suggestion == "Album"
    assert (found["a", "artists"].status, found["a", "artists"].eligible) == ("warning", False)
    assert {f for _, f in found} == {"title", "album", "artists", "year", "trackNumber"}
    assert audit.audit_findings(spark.createDataFrame([], AUDITED)).count() == 0


def test_review_results(spark):
    schema = "index int, field string, status string, message string, confidence double, corrected map<string,string>"
    rows = [(0, "title", "error", "", 1.4, {"title": "x"}), (1, "title", "correct", "", 1.0, {}), (2, "title", "error", "", 0.95, {"title": "x", "album": "y"}), (3, "year", "error", "", float("nan"), {"year": "1"})]
    targets = spark.createDataFrame([(0, "title"), (2, "title")], "index int, field string")
    found = {r["index"]: r for r in audit.review_results(spark.createDataFrame(rows, schema), targets).collect()}
    assert found.keys() == {0, 2, 3} and found[0].confidence == 1.0 and found[3].confidence == 0.0
    assert [found[i].eligible for i in (0, 2, 3)] == [True, False, False] and found[2].corrected == {"title": "x"}


def test_planning(spark):
    tracks = spark.createDataFrame([("/a/1.mp3", "01 One", "Rock"), ("/a/2.mp3", None, None)], "path string, title string, genre string")
    done = {(r.path, r.field): (r.old_value, r.new_value, r.operation) for r in planning.patch(tracks, F.lit(True), {"genre": "Pop", "title": None}, only_if_missing=False).collect()}
    assert done == {("/a/1.mp3", "genre"): ("Rock", "Pop", "set"), ("/a/2.mp3", "genre"): (None, "Pop", "set"), ("/a/1.mp3", "title"): ("01 One", None, "remove")}
    only = planning.patch(tracks, F.lit(True), {"genre": "Pop"}, only_if_missing=True).collect()
    assert [r.path for r in only] == ["/a/2.mp3"]
    operations = [("regex_replace", {"pattern": r"^\d+ "})]
    assert [r.new_value for r in planning.transform(tracks, F.col("title"), "title", operations).collect()] == ["One"]
    assert planning.transform_counts(tracks, F.col("title"), "title", operations).first().asDict() == {"changed": 1, "missing_source": 1, "unmatched": 0, "blank": 0, "equal": 0}
    actions = spark.createDataFrame([("p", "f", "a", "b", "set")], "path string, field string, old_value string, new_value string, operation string")
    now = spark.createDataFrame([("p", "f", "b")], "path string, field string, value string")
    assert planning.stale(actions, now).count() == 1 and planning.unverified(actions, now).count() == 0


def test_suffixes(spark):
    moves = spark.createDataFrame([("a", "o/x.mp3", 1), ("b", "o/x.mp3", 2), ("c", "o/x.mp3", 3), ("d", "o/y.mp3", 4)], "source string, target string, ord int")
    there = spark.createDataFrame([("o/x_1.mp3",), ("o/y.mp3",)], "path string")
    assert {r.source: r.final for r in planning.with_suffixes(moves, there).collect()} == {"a": "o/x.mp3", "b": "o/x_2.mp3", "c": "o/x_3.mp3", "d": "o/y_1.mp3"}


def test_numbering(spark):
    rows = [("/x/z.flac", "Zebra", 3, 1.0), ("/x/a.flac", None, None, 2.0), ("/x/b.flac", "apple", 1, 3.0)]
    tracks = spark.createDataFrame(rows, "path string, title string, track_number int, duration double").withColumn("g", F.lit(1))
    order = lambda rule: [r.path[3] for r in planning.number_by_rule(tracks, ["g"], rule).orderBy("number").collect()]
    assert order("title-asc") == ["a", "b", "z"] and order("existing-asc") == ["b", "z", "a"] and order("existing-desc") == ["z", "b", "a"]
    whole = tracks.withColumns({"album": F.lit("A"), "album_artist": F.lit(None).cast("string"), "album_artists": F.array(F.lit("B")), "disc_number": F.lit(None).cast("int")})
    assert {r.path[3]: (r.number, r.total, r.disc, r.discs) for r in planning.number_tracks(whole).collect()} == {"b": (1, 3, 1, 1), "z": (2, 3, 1, 1), "a": (3, 3, 1, 1)}


def test_candidates(spark):
    schema = "request_id int, ord int, source string, artist string, artists array<string>, album string, album_artist string, album_artists array<string>, year string, genre string, musicbrainz_album_id string, musicbrainz_artist_id string, discogs_release_id string, discogs_artist_id string"
    rows = [(1, 0, "folder", "F", ["F"], "Folder", None, [], "1990", "Rock", None, None, None, None), (1, 1, "musicbrainz", "M", [], "Album", "M", [], "2001", None, "id", None, None, None)]
    r = candidates.merge_by_priority(spark.createDataFrame(rows, schema)).first()
    assert (r.source, r.artist, r.artists, r.album, r.year, r.genre, r.album_artists) == ("musicbrainz", "M", ["F"], "Album", "2001", "Rock", ["M"])


LOCAL = "album_id int, idx long, title string, artist string, artists array<string>, artist_hint string, filename string, track_number int, disc_number int, musicbrainz_track_id string, length double"
REMOTE = "album_id int, idx long, source string, title string, match_titles array<string>, track_number int, disc_number int, recording_id string, length double"


def test_alignment(spark):
    local = [
        (1, 0, "Song", None, [], None, "x.flac", None, None, None, 200.0),
        (2, 0, None, "费玉清", [], None, "05. 费玉清-变色湖长城.flac", None, None, None, None),
        (3, 0, "Qqq", None, [], None, "1.mp3", 1, None, None, None), (3, 1, "Other", None, [], None, "2.mp3", 2, None, None, None),
        (4, 0, "Same", None, [], None, "a.mp3", None, None, "r2", None), (4, 1, "Same", None, [], None, "b.mp3", None, None, None, None),
        (5, 0, "Hello my old friend", None, [], None, "h.mp3", None, None, None, None), (5, 1, "Hello (Live)", None, [], None, "i.mp3", None, None, None, None),
        (6, 0, None, None, None, None, None, None, None, None, None),
    ]
    remote = [
        (1, 0, "musicbrainz", "Song", [], 1, 1, None, 200000.0), (1, 1, "musicbrainz", "Song", [], 2, 1, None, 260000.0),
        (2, 0, "discogs", "变色湖长城", None, 5, None, None, None),
        (3, 0, "discogs", "Zzz", [], 1, None, None, None), (3, 1, "discogs", "Other", [], 2, None, None, None),
        (4, 0, "musicbrainz", "Same", [], 1, None, "r1", None), (4, 1, "musicbrainz", "Same", [], 2, None, "r2", None),
        (5, 0, "discogs", "Hello", [], 1, None, None, None),
    ]
    found = matching.align_tracks(spark.createDataFrame(local, LOCAL), spark.createDataFrame(remote, REMOTE))
    rows = {(r.album_id, r.idx): (r.remote_idx, r.evidence or r.skip) for r in found.collect()}
    assert rows == {
        (1, 0): (0, "tag_title"), (2, 0): (0, "filename_title"), (3, 0): (0, "position"), (3, 1): (1, "tag_title"), (4, 0): (1, "recording_id"), (4, 1): (0, "tag_title"),
        (5, 0): (0, "contained_title"), (5, 1): (None, "no_title_match"), (6, 0): (None, "no_local_evidence"),
    }
    assert {r.album_id: r.title_matches for r in matching.match_stats(found).collect()}[3] == 1


def test_health(spark):
    files = spark.createDataFrame([("A/B/1.flac",), ("A/B/C/2.flac",), ("3.flac",)], "rel string")
    named = [tuple(r.i) for r in files.select(health.identity(F.col("rel"), F.lit("/m/Top")).alias("i")).collect()]
    assert named == [("A", "B", "1.flac"), ("A", "B / C", "2.flac"), ("m", "Top", "3.flac")]
    batches = spark.createDataFrame([("3.flac", 1, "broken"), ("3.flac", 2, "clean")], "rel string, batch_id int, bucket string")
    latest = health.latest_results(batches)
    assert health.unprocessed(files, latest).count() == 2
    assert health.rollup(health.diagnoses(files, latest), []).first().asDict() == {"total": 3, "clean": 1, "minor": 0, "medium": 0, "broken": 2, "with_issues": 2}


def test_state(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in state.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    tags_ = spark.createDataFrame([("p", 0, "Mood", "x"), ("q", 0, "MOOD", "x")], "path string, ord int, key string, value string")
    assert [tuple(r) for r in state.grouped_tags(tags_).collect()] == [("Mood", "x", 2)] and {r.path for r in state.tag_paths(tags_).collect()} == {"p", "q"}
    assert state.same_tags(tags_, tags_.withColumn("key", F.upper("key"))).filter("same").count() == 2


def _flac(comments: list[str], cut: int = 0) -> bytes:
    info = bytes(10) + ((44100 << 44) | (88200)).to_bytes(8, "big") + bytes(16)
    body = struct.pack("<I", 1) + b"v" + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c.encode())) + c.encode() for c in comments)
    blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x84" + len(body).to_bytes(3, "big") + body
    return (b"fLaC" + blocks)[: -cut or None]


@pytest.fixture
def music(tmp_path):
    for path, data in {
        "Artist One/Album A/01.mp3": b"x", "Artist One/Album A/02.FLAC": _flac(["TITLE=Two", "ARTISTS=a; b", "TRACKNUMBER=2/9", "DATE=2020-01-01", "MOOD=x", "mood=x"]),
        "Artist One/Album A/cover.jpg": bytes(2000), "Flat Artist - Flat Album/01.flac": _flac(["TITLE=x"], cut=4), "roottrack.opus": b"x", "README.txt": b"x", "Artist One/.hidden.mp3": b"x",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    return str(tmp_path)


def test_library_scan(spark, music):
    listing = library.files(spark, music)
    found = {(r.path, r.artist_hint, r.album_hint, r.track_count) for r in library.albums(listing, "lib").collect()}
    assert found == {("Artist One/Album A", "Artist One", "Album A", 2), ("Flat Artist - Flat Album", "Flat Artist", "Flat Album", 1), (".", "", "lib", 1)}
    assert [tuple(r) for r in library.album_covers(listing).collect()] == [("Artist One/Album A", "Artist One/Album A/cover.jpg")]


def test_tags(spark, music):
    tagged = tags.read_tags(spark, music)
    rows = {r.path.rsplit("/", 1)[1]: r for r in tags.tracks(tagged).collect()}
    two = rows["02.FLAC"]
    assert (two.title, two.artists, two.track_number, two.track_total, two.year, two.duration, two.codec, two.error) == ("Two", ["a", "b"], 2, 9, "2020", 2.0, "FLAC", None)
    assert rows["01.flac"].codec == "unknown" and rows["01.flac"].error and rows["01.flac"].title == "01.flac"
    assert [(r.key, r.value) for r in tags.extra_tags(tagged, ["TITLE", "ARTISTS", "TRACKNUMBER", "DATE"]).collect()] == [("MOOD", "x")]


def test_incremental_scan(spark, music, tmp_path_factory):
    out, seen = (str(tmp_path_factory.mktemp(n)) for n in ("out", "seen"))
    for _ in range(2):
        incremental.scan(spark, music, out, seen)
    assert spark.read.parquet(out).count() == len(list(library.audio_files(library.files(spark, music), hidden=True).collect()))


def test_provider_answers(spark):
    track = lambda n, t: {"number": str(n), "position": n, "title": t, "recording": {"id": f"r{n}", "title": t + "!", "length": 1000}}
    medium = lambda p, f: {"position": p, "format": f, "tracks": [track(1, "One"), track(2, "Two")]}
    release = {"id": "x", "title": "T", "date": "2001-02", "artist-credit": [{"name": "A", "joinphrase": " & "}, {"name": "B"}], "media": [medium(1, "CD"), medium(2, "SACD"), {"position": 3, "tracks": []}]}
    answers = spark.createDataFrame([(json.dumps(release),), ("{}",), ("no json",)], "json string")
    found = providers.musicbrainz_tracks(answers).orderBy("idx").collect()
    assert [(r.title, r.match_titles, r.artist, r.track_number, r.track_total, r.disc_number) for r in found] == [("One", ["One!"], "A", 1, 2, 1), ("Two", ["Two!"], "A", 2, 2, 1)]
    assert tuple(providers.musicbrainz_summaries(answers).select("id", "artist", "year", "formats").first()) == ("x", "A", "2001", ["CD", "SACD"])
    other = {"id": 7, "title": "T", "year": 1999, "genres": ["Rock"], "styles": ["Rock", "Pop"], "artists": [{"name": "A (2)"}], "tracklist": [{"position": "", "title": "Side"}, {"position": "CD1-1", "title": "x", "duration": "4:05"}, {"position": "CD2-1", "title": "y", "duration": "", "artists": [{"name": "B"}]}]}
    answers = spark.createDataFrame([(json.dumps(other),)], "json string")
    found = providers.discogs_tracks(answers).orderBy("idx").collect()
    assert [(r.title, r.artist, r.track_number, r.track_total, r.disc_number, r.length) for r in found] == [("x", "A", 1, 1, 1, 245.0), ("y", "B", 1, 1, 2, None)]
    assert tuple(providers.discogs_releases(answers).first()) == ("7", "T", "1999", "Rock, Pop")


def test_similarity(spark):
    sim = lambda a, b: one(spark, T.similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert (sim("", ""), sim("", "a"), sim("a", ""), sim(None, "a"), sim("abcd", "abxd"), sim("kitten", "sitting")) == (100, 0, 0, None, 75, 62)

    def plain(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = __import__("random").Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab爱cd") for _ in range(rng.randrange(90))) for _ in range(2))
        assert T.common_length(a, b) == plain(a, b)


@pytest.mark.parametrize(
    ("folder", "year"),
    [("2004 - A", "2004"), ("Album (2004 remaster)", None), ("A《2004.B》", "2004"), ("A「 1999」", "1999"), ("20045", None), ("2004", "2004"), ("《A》《2001-B》x", "2001"), ("(2004) A", None)],
)
def test_release_year(spark, folder, year):
    assert one(spark, T.release_year(F.col("s")), s=folder) == year


def test_names(spark):
    s, two = F.col("s"), lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert one(spark, N.lookup_key(s), s="Café  del Mar III!") == "cafe del mar 3"
    assert one(spark, N.lookup_key(s), s="愛 情 X") == "愛情 10"
    assert two(N.albums_match, "Abbey Road", "ABBEY ROAD (Remastered)") and not two(N.albums_match, "Abbey Road", "Let It Be")
    assert two(N.albums_match, "愛情", "爱情 精选") and two(N.albums_match, "", "anything")
    assert (two(N.album_score, "愛情", "爱情"), two(N.album_score, "Blue", "Kind of Blue"), two(N.album_score, "Kind of Blue", "Blue"), two(N.album_score, "x", "y")) == (100, 85, 70, 0)
    assert two(N.album_score, "爱情故事集", "爱情故事全集") == 77
    assert not two(N.artists_match, "Various Artists", "Various Artists") and two(N.artists_match, "張學友 = Jacky Cheung*", "jacky cheung")
    assert two(N.artists_equal, "AC/DC", "ac dc") and not two(N.artists_equal, "AC", "DC")
    assert one(spark, N.split_names(s, "pipeline"), s="a & b / c；d") == ["a", "b / c", "d"]
    assert one(spark, N.split_names(s, "edit"), s="a _ b ft. C") == ["a", "b", "C"]
    assert one(spark, N.split_names(s, "list"), s="a & b; c;C") == ["a & b", "c"]
    assert one(spark, N.provider_artist(s), s="Genesis (band; UK)") == "Genesis" and one(spark, N.provider_artist(s), s=" (2)") == "(2)"
    assert tuple(one(spark, N.told_by_file(s), s="/x/03. A B - C.mp3")) == ("A B", "C") and one(spark, N.told_by_file(s), s="/x/A-B.mp3") is None
    assert one(spark, N.clean_folder(s), s="2001.《A》日本版 [FLAC]") == "A"
    assert one(spark, N.provider_key(s), s="MusicBrains Release-Id") == "MUSICBRAINZ_ALBUMID"
    assert one(spark, N.sentinel_free(s), s=" N/A ") is None


def test_paths(spark):
    inside = lambda a, b: one(spark, T.inside(F.col("a"), F.col("b")), a=a, b=b)
    assert inside("/a/b/c", "/a/b") and inside("/a/b", "/a/b/") and inside("/a/x/../b/c", "/a/./b")
    assert not inside("/a/bc", "/a/b") and not inside("/a/b", "/a/b/c") and not inside("/../a", "/a")
    assert one(spark, T.short_path(F.col("s")), s="a\\b/c/d/e") == "b/c/d/e" and one(spark, T.short_path(F.col("s")), s="a") == "a"


def test_patterns(spark):
    s = F.col("s")
    read = lambda p, text: one(spark, patterns.parse_filename(p, s), s=text)
    assert read("%{track}% - %{artist}% - %{title}%", "2 - ABC - XYZ.mp3") == {"track": "2", "artist": "ABC", "title": "XYZ"}
    assert read("%{title}%%{ext}%", "a.b.mp3") == {"title": "a.b"} and read("%{year}% %{title}%", "99 x.mp3") is None
    for wrong in ("plain", "%{nothing}%", "%{title}% %{title}%"):
        with pytest.raises(ValueError):
            patterns.template_regex(wrong)
    built = patterns.build_filename("%{track}% - %{title}%%{ext}%", {"track": F.lit(3), "title": F.lit(None).cast("string")}, s)
    assert one(spark, built, s="x.flac") == "03 - Unknown.flac"
    assert patterns.query_fields('artist:AC/DC album:"Back: in Black" x') == {"artist": "AC/DC", "album": "Back: in Black"}
    assert patterns.query_fields("ALBUM:One Two artist:Three") == {"artist": "Three", "album": "One Two"} and patterns.query_fields("nothing") == {}
    assert patterns.canonical_json({"b": [1, {"d": None, "c": "é"}], "a": True}) == '{"a":true,"b":[1,{"c":"é","d":null}]}'
    assert one(spark, patterns.like_glob(s, "*.FL?C"), s="a+b.flac") and not one(spark, patterns.like_glob(s, "a?"), s="abc")


def test_lyrics(spark):
    problem = lambda t: one(spark, lyrics.problem(F.col("s")), s=t)
    assert [problem(t) for t in ("fine\r\n", "愛", "a\x00", "a�", "a\x07", "﻿é", "我爱你".encode().decode("cp1252", "replace"), None)] == [None, None, "nul", "replacement", "control", None, "misread", None]
    assert lyrics.misread("愛情".encode().decode("cp1252")) and not lyrics.misread("我爱你中国") and not lyrics.misread("étoile")
    files = spark.createDataFrame([("a/1.lrc", "愛\r\n".encode("gb18030")), ("a/1.txt", b"other"), ("a/2.txt", "﻿plain".encode()), ("a/3.lrc", b" "), ("a/4.mp3", b"x")], "path string, content binary")
    assert {r.base: (r.kind, r.lyrics) for r in lyrics.sidecars(files).collect()} == {"a/1": ("lrc", "愛\n"), "a/2": ("txt", "plain")}
    assert [one(spark, lyrics.language(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("EN", "愛"), ("und", "愛"), ("xyz", ""), ("x", "かな愛"), (None, "한"), (None, "la"))] == ["eng", "zho", "xyz", "jpn", "kor", "und"]


def test_empty_tables_of_track_operators(spark):
    tracks = spark.createDataFrame([], "ord long, path string, title string, artist string, album string, album_artist string, genre string, year string, size_bytes long, duration double, disc_number int, disc_total int")
    assert rollups.library_facts(tracks).first().n_tracks == 0
    assert all(f(tracks).count() == 0 for f in (rollups.batch_suggestions, rollups.differing_fields, edits.infer_tags, edits.strip_title_numbers, positions.indexed))
    assert scopes.page_facts(tracks, "search").first().asDict() == {"total": 0, "next_offset": None}
    with pytest.raises(ValueError):
        scopes.album_paths(tracks, tracks)
    with pytest.raises(ValueError):
        edits.edit(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, title string"), F.lit(True), {"title": "z"})


def test_prettify_keeps_numbers_that_are_titles(spark):
    wanted = {
        "99problems": "99 Problems", "1999 party": "1999 Party", "2001": "2001", "(live) take": "(Live) Take", "03_the-song2": "The Song 2", "Disc 1 02 - intro": "02 Intro",
        "disc2. OPENER": "Opener", "a.c. dc": "a.c. Dc", "U.S.A. today": "U.S.A. Today", "it's ÉTÉ": "It's ÉTÉ", "ébONY": "éBony", "...": "...", "日本 ab-cd": "日本 Ab Cd",
    }
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", pipeline(F.col("t"), [("prettify", {})])["value"].alias("v"))
    assert {r.t: r.v for r in rows.collect()} == wanted


def test_canonical_names_of_whole_candidates(spark):
    track = "struct<title:string,artist:string,artists:array<string>>"
    schema = f"id int, artist string, artists array<string>, album_artist string, album_artists array<string>, tracks array<{track}>, canonical string"
    tracks = [("a", "cut", ["CUT"]), ("b", None, None), ("c", "Cut", ["Cut", "Guest"]), ("d", " The One ", ["???"]), ("e", "C ut", [])]
    rows = [
        (1, "Cut", ["Cut"], "cut & Guest", None, tracks, " The One (2)"),
        (2, "???", ["???"], None, None, [], "The One"),
        (3, None, None, None, None, tracks, "The One"),
        (4, "Cut", None, None, None, tracks, " "),
        (5, "AC/DC", ["AC/DC"], None, ["x", "ac"], [], "The One"),
    ]
    found = {r.id: r for r in N.canonical_candidate(spark.createDataFrame(rows, schema), F.col("canonical")).collect()}
    one = found[1]
    assert (one.artist, one.artists, one.album_artist, one.album_artists) == ("The One", ["The One"], "The One & Guest", ["The One", "Guest"])
    assert [(t.title, t.artist, t.artists) for t in one.tracks] == [
        ("a", "The One", ["The One"]), ("b", "The One", ["The One"]), ("c", "Cut", ["Cut", "Guest"]), ("d", "The One", ["The One"]), ("e", "C ut", []),
    ]
    assert (found[2].artist, found[2].artists) == ("The One", ["The One"])
    assert (found[3].artist, found[3].artists, found[3].tracks[0].artist) == (None, None, "cut")
    assert (found[4].artist, found[4].tracks[0].artist) == ("Cut", "cut")
    # A credit that lists one name is parted at the slash; its first part is the old name.
    assert (found[5].artists, found[5].album_artists) == (["The One", "DC"], ["x", "The One"])


def test_provider_names_fold_ascii_case_only(spark):
    row = spark.createDataFrame([("É; é; A; a",)], "c string")
    assert row.select(N.split_names(F.col("c")).alias("n")).first().n == ["É", "é", "A"]
    assert row.select(N.is_editor_key(F.lit("tit2")).alias("n"), N.is_editor_key(F.lit("MOOD")).alias("m")).first() == (True, False)


def test_keys_of_ascii_texts_are_the_same_in_both_ways(spark):
    texts = ["", " ", "A", "Abbey Road", "abbey  road!", "III", "iv.x", "vii-viii", "Disc IX (Deluxe)", "a_b", "AC/DC", "x" * 50, "~!@#$%^&*()", "1 II 3", "tab\tand\nline", "Ix i xi"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.lookup_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: N._key(t) for t in texts}
    pairs = [(a, b) for a in texts for b in texts]
    both = spark.createDataFrame(pairs, "a string, b string").select("a", "b", N.album_score(F.col("a"), F.col("b")).alias("s"), N.albums_match(F.col("a"), F.col("b")).alias("m")).collect()
    for r in both:
        x, y = N._key(r.a), N._key(r.b)
        assert (r.s, r.m) == (N._score(x, y), N._holds(x, y) >= 80), (r.a, r.b)
    assert spark.range(1).select(N.album_score(F.lit(None).cast("string"), F.lit("x"))).first()[0] is None


def test_extra_tags_are_dealt_out_before_they_are_sorted(spark):
    """Rows of one task, each pair spelt in two ways: the first stays, and several tasks have a share."""
    spelt = F.when(F.col("id") % 2 == 0, "musicbrainz track id").otherwise("MUSICBRAINZ_RECORDINGID")
    rows = spark.range(2000, numPartitions=1).select(F.floor(F.col("id") / 2).cast("string").alias("path"), "id", spelt.alias("key"))
    rows = rows.select("path", F.col("id").alias("ord"), "key", F.concat(F.lit(" "), "path").alias("value"))
    more = rows.select("path", "ord", F.explode(F.array(F.lit("title"), F.lit(" "), F.lit("Mood"), F.lit("mood"))).alias("key"), F.lit("x").alias("value"))
    found = edits.extra_tags(rows.unionByName(more.withColumn("ord", F.col("ord") + 5000)).coalesce(1))
    told = found.withColumn("at", F.spark_partition_id()).collect()
    assert {(r.path, r.ord, r.key if r.value != "x" else r.key.lower(), r.value) for r in told} == {(str(i), 2 * i, "MUSICBRAINZ_TRACKID", str(i)) for i in range(1000)} | {(str(i), 2 * i + 5000, "mood", "x") for i in range(1000)}
    assert len(told) == 2000 and len({r["at"] for r in told}) > 1


def test_alignment_makes_no_rows_of_pairs(spark):
    """An album whose titles all begin alike: one pass over the tracks, no join of them; lengths, doubles and positions as before."""
    n = 600
    local = [(1, i, f"Same {i}" if i % 3 else f"Same {i} plus", None, None, None, f"{i:03d}.flac", i, None, None, 200.0 if i % 5 else None) for i in range(n)]
    local += [(2, 0, "One", None, [], None, "1.flac", 1, None, None, 100.0), (2, 1, "One", None, [], None, "2.flac", 2, None, None, 300.0), (2, 2, "Two", None, [], None, "3.flac", 3, None, None, 300.0)]
    local += [(3, 0, "One", None, [], None, "1.flac", 1, None, None, None), (3, 1, "No", None, [], None, "2.flac", 2, None, None, None)]
    remote = [(1, i, "discogs", f"Same {i}", None, i, None, None, 203.0) for i in range(n)]
    remote += [(2, 0, "discogs", "One", None, 8, None, None, 100.0), (2, 1, "dataset", "One", None, 9, None, None, 301.0), (2, 2, "dataset", "Two", None, 7, None, None, 100.0)]
    remote += [(3, 0, "discogs", "One", None, 2, None, None, None), (3, 1, "discogs", "One", None, 2, None, None, None)]
    found = matching.align_tracks(spark.createDataFrame(local, LOCAL), spark.createDataFrame(remote, REMOTE))
    rows = {(r.album_id, r.idx): (r.remote_idx, r.evidence or r.skip) for r in found.collect()}
    wanted = {(1, i): (i, "tag_title" if i % 3 else "contained_title") for i in range(n)}
    wanted |= {(2, 0): (0, "tag_title"), (2, 1): (1, "tag_title"), (2, 2): (None, "duration_mismatch"), (3, 0): (None, "duplicate_ambiguous"), (3, 1): (None, "no_title_match")}
    assert rows == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and plan.count("Join") == 2  # texts with their forms, on either side
