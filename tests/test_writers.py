"""Tags written into files of each format and read back; audio, other tags and pictures stay."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from test_flac import AUDIO, BAD_PICTURE, GOOD_PICTURE, HEAD, TAGS, block, comments
from test_tags import FILES as FORMATS
from test_tags import HEADER, atom, text_atom

from stackwright.sources import tags, writers

STCO = atom(b"trak", atom(b"mdia", atom(b"mdhd", HEADER[:12], struct.pack(">II", 44100, 88200)), atom(b"minf", atom(b"stbl", atom(b"stco", struct.pack(">III", 0, 1, 0))))))
FILES = {k: v for k, v in FORMATS.items() if k != "items.mp3"} | {
    "padded.flac": HEAD + block(4, TAGS) + block(6, bytes(50)) + block(1, bytes(400), True) + AUDIO,
    "tight.flac": HEAD + block(6, bytes(50)) + block(4, comments(b"TITLE=x", GOOD_PICTURE, b"MOOD=x"), True) + AUDIO,
    "bare.flac": HEAD[:-38] + block(0, HEAD[8:], True) + AUDIO,
    "bare.m4a": atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"moov", atom(b"mvhd", HEADER[:12], struct.pack(">II", 1000, 2000)), STCO) + atom(b"mdat", b"sound"),
    "bare.mp3": b"\xff\xfb\x90\x00" + bytes(4000),
}
FIELDS = {"title": "Ünï " + "long " * 300, "artist": "A", "album_artist": "日本", "year": "1999", "track_number": "5", "track_total": "12", "MOOD": "calm", "genre": None, "artists": "a; b"}
READ = {"TITLE": [FIELDS["title"].strip()], "ARTIST": ["A"], "ALBUMARTIST": ["日本"], "DATE": ["1999"], "TRACKNUMBER": ["5/12"], "MOOD": ["calm"], "ARTISTS": ["a", "b"]}


def told(data):
    found = {}
    for key, value in tags.parse(data)[4]:
        found.setdefault(key, []).append(value)
    return found


@pytest.mark.parametrize("name", FILES)
def test_what_is_written_is_read_back(name):
    before = FILES[name]
    after = writers.rewritten(before, FIELDS)
    kept = {k: v for k, v in told(before).items() if k not in READ and k not in ("GENRE", "YEAR")}
    assert told(after) == kept | READ
    assert tags.parse(after)[:4] == tags.parse(before)[:4] or name == "constant.mp3" and abs(tags.parse(after)[1] - tags.parse(before)[1]) < 1e-6
    assert writers.rewritten(after, {"title": "t"}) != after
    shorter = writers.rewritten(after, {"title": None, "track_number": None, "track_total": None, "disc_total": "2"})
    found = told(shorter)
    assert "TITLE" not in found and "TRACKNUMBER" not in found and found["DISCNUMBER"] == ["0/2"]


def test_sizes_places_and_checksums_follow():
    for name in ("padded.flac", "tight.flac"):
        assert writers.rewritten(FILES[name], FIELDS).endswith(AUDIO) and tags.parse(writers.rewritten(FILES[name], FIELDS))[3]
    assert len(writers.rewritten(FILES["padded.flac"], {"title": "short"})) == len(FILES["padded.flac"])
    moved = writers.rewritten(FILES["bare.m4a"], FIELDS)
    place = moved.index(b"stco") + 12
    assert int.from_bytes(moved[place : place + 4], "big") == len(moved) - len(FILES["bare.m4a"])
    assert moved.endswith(atom(b"mdat", b"sound"))
    ogg, at, sequence = writers.rewritten(FILES["vorbis.ogg"], FIELDS | {"LYRICS": "la " * 40000}), 0, 0
    while at < len(ogg):
        sizes = ogg[at + 27 : at + 27 + ogg[at + 26]]
        page = ogg[at : at + 27 + len(sizes) + sum(sizes)]
        assert struct.unpack_from("<I", page, 18)[0] == sequence
        assert slow_checksum(page[:22] + bytes(4) + page[26:]) == struct.unpack_from("<I", page, 22)[0]
        at, sequence = at + len(page), sequence + 1
    assert sequence == 3


def slow_checksum(page):
    value = 0
    for byte in page:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if value & 0x80000000 else value << 1
    return value


def test_a_batch_reports_each_file_and_runs_again(spark, tmp_path):
    music = tmp_path / "music"
    music.mkdir()
    for name, data in FILES.items():
        (music / name).write_bytes(data)
    (music / "cut.flac").write_bytes(HEAD)
    os.chmod(music / "bare.mp3", 0o640)
    paths = [f"file:{music}/{n}" for n in [*FILES, "cut.flac", "missing.mp3"]]
    plan = [(p, f, v, "set" if v else "remove") for p in paths for f, v in FIELDS.items()]
    actions = spark.createDataFrame(plan, "path string, field string, new_value string, operation string")
    first = {os.path.basename(r.path): r.status for r in writers.write_tags(actions, str(tmp_path / "first")).collect()}
    assert first == dict.fromkeys(FILES, "written") | {"cut.flac": "failed", "missing.mp3": "failed"}
    # A task that was killed has left a file beside the other, and the batch starts again.
    (music / ".bare.mp3.rewrite").write_bytes(b"half")
    (music / "bare.mp3").write_bytes(FILES["bare.mp3"])
    again = writers.write_tags(actions, str(tmp_path / "again"))
    assert {os.path.basename(r.path): r.status for r in again.collect()} == dict.fromkeys(FILES, "unchanged") | {"bare.mp3": "written", "cut.flac": "failed", "missing.mp3": "failed"}
    assert sorted(os.listdir(music)) == sorted([*FILES, "cut.flac"]) and os.stat(music / "bare.mp3").st_mode & 0o777 == 0o640
    assert writers.write_summary(again).first() == (1, len(FILES) - 1, 2, False)
    rows = tags.tracks(tags.read_tags(spark, str(music)).filter(F.col("error").isNull())).collect()
    assert {(r.title, r.track_number, r.track_total, r.year) for r in rows} == {(READ["TITLE"][0], 5, 12, "1999")}


def test_unsafe_files_stay_as_they_are():
    for data in (HEAD + block(4, TAGS), b"fLaC" + block(4, comments(BAD_PICTURE))[:20], b"ID3\x02\0\0" + bytes(4) + FILES["bare.mp3"]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            writers.rewritten(data, {"title": "x"})
