"""FLAC structure on files built here, each fault planted in a whole file and found alone, repaired, and gone after it."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from stackwright.operators import health
from stackwright.sources import flac, tags

INFO = bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
AUDIO = b"\xff\xf8" + bytes(range(1, 200))


def block(kind: int, body: bytes, last: bool = False) -> bytes:
    return bytes([kind | 0x80 * last]) + len(body).to_bytes(3, "big") + body


def comments(*pairs: bytes) -> bytes:
    return struct.pack("<I", 1) + b"v" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)


TAGS = comments(b"TITLE=a", b"ARTIST=b")
BAD_PICTURE = b"METADATA_BLOCK_PICTURE=" + base64.b64encode(b"\xff\xd8\xff" + bytes(60))
GOOD_PICTURE = b"METADATA_BLOCK_PICTURE=" + base64.b64encode(bytes(64))
HEAD = b"fLaC" + block(0, INFO)
FILES = {
    "clean": HEAD + block(4, TAGS) + block(1, bytes(32), True) + AUDIO,
    "clean-id3": b"ID3" + bytes(500) + HEAD + block(4, comments(GOOD_PICTURE), True) + AUDIO,
    "vorbis": HEAD + block(4, TAGS + bytes(40), True) + AUDIO,
    "audio": HEAD + block(4, TAGS) + block(1, bytes(8), True) + b"\x7f" + AUDIO[1:],
    "gap": HEAD + block(4, TAGS) + block(1, bytes(8), True) + b"\x7e" * 65536 + AUDIO,
    "zeros": HEAD + block(4, TAGS) + block(1, bytes(8), True) + bytes(65536) + AUDIO,
    "picture": HEAD + block(4, comments(b"TITLE=a", BAD_PICTURE)) + block(1, bytes(8), True) + AUDIO,
    "picture-last": HEAD + block(4, comments(BAD_PICTURE, b"TITLE=a"), True) + AUDIO,
    "chain": b"fLaC" + block(0, INFO, True) + block(4, TAGS) + block(1, bytes(8), True) + AUDIO,
}
ISSUES = {name: [name.split("-")[0]] for name in FILES if not name.startswith("clean")}
ISSUES["zeros"] = ["gap", "chain"]  # zeros are blocks without a body
ISSUES["chain"] = ["gap", "chain"]  # blocks that the chain doesn't reach lie between it and the audio
ERRORS = {
    "short": (b"fLaC", flac.NOT_FLAC),
    "other": (b"RIFF" + bytes(100), flac.NOT_FLAC),
    "far": (bytes(25001) + FILES["clean"], flac.NOT_FLAC),
    "uncommented": (HEAD + block(1, bytes(8), True) + AUDIO, flac.NO_COMMENT),
    "overlong": (HEAD + block(4, struct.pack("<II", 1000, 0), True) + AUDIO, flac.BAD_COMMENT),
    "many": (HEAD + block(4, struct.pack("<II", 0, 9), True) + AUDIO, flac.BAD_COMMENT),
}


@pytest.fixture
def library(tmp_path):
    for name, data in FILES.items():
        (tmp_path / f"{name}.flac").write_bytes(data)
    for name, (data, _) in ERRORS.items():
        (tmp_path / f"{name}.flac").write_bytes(data)
    return str(tmp_path)


def diagnosed(spark, root):
    undecoded = {c: F.lit(None).cast("boolean") for c in ("strict_ran", "strict_ok", "strict_warning", "playback_ok", "probe_ok")}
    return health.diagnose(flac.structure(spark, root).withColumns(undecoded)).withColumn("name", F.regexp_extract("path", r"([^/]*)\.flac$", 1))


def test_each_fault_is_found_alone(spark, library):
    rows = {r.name: r for r in diagnosed(spark, library).collect()}
    assert rows.keys() == FILES.keys() | ERRORS.keys()
    for name in FILES:
        r = rows[name]
        kinds = [k for k in health.STRUCTURAL if r.flags[k]]
        assert kinds == ISSUES.get(name, []), name
        assert (r.bucket, r.action) == (("minor", "would_fix") if kinds else ("clean", "none")), name
        assert r.issues == [health.STRUCTURAL[k][0] for k in kinds] and r.known_repairs == [health.STRUCTURAL[k][1] for k in kinds]
        assert (r.error, r.sample_rate, r.total_samples) == (None, 44100, 88200), name
    assert (rows["vorbis"].mismatch, rows["gap"].metadata_audio_gap) == (40, 65536)
    for name, (_, error) in ERRORS.items():
        assert (rows[name].error, rows[name].bucket, rows[name].issues, rows[name].action) == (error, "broken", [health.PARSE_ERROR], "redownload"), name


def test_repairs_leave_clean_files_that_keep_their_audio_and_comments(spark, library, tmp_path_factory):
    found = diagnosed(spark, library).select("path", "bucket", "known_repairs")
    before = spark.createDataFrame(found.collect(), found.schema)
    for turn in range(2):  # repeated tasks change nothing more
        done = flac.repair_files(before, str(tmp_path_factory.mktemp("results") / str(turn)))
        assert {r.repair_error for r in done.collect()} == {None}
        assert turn or all(r.failed_repairs == [] for r in done.collect())
    after = {r.name: r for r in diagnosed(spark, library).collect()}
    assert all(after[name].bucket == "clean" for name in FILES)
    for name, data in FILES.items():
        new = (tmp_path_factory.getbasetemp() / library / f"{name}.flac").read_bytes()
        assert new.endswith(AUDIO) and (name in ISSUES or new == data)
        if name not in ("clean-id3",):
            assert ("TITLE", "a") in tags.parse(new)[4]


@pytest.mark.parametrize("name", FILES)
def test_cut_files_give_facts_or_an_error(name):
    for end in range(0, len(FILES[name]) if len(FILES[name]) < 1000 else 700):
        assert flac.facts(FILES[name][:end]).keys() == set(flac.NAMES[2:])


def test_decoders_outrank_structure(spark):
    columns = "error string, mismatch int, audio_sync_corrupted boolean, metadata_audio_gap int, corrupted_picture boolean, broken_chain boolean, strict_ran boolean, strict_ok boolean, strict_warning boolean, playback_ok boolean, probe_ok boolean"
    cases = [
        ((None, 8, False, 0, False, False, True, False, False, False, None), "broken", ["strict-decode-failed"]),
        ((None, 8, False, 0, False, False, True, False, False, True, False), "broken", ["strict-decode-failed", "ffprobe-audio-probe-failed"]),
        ((None, 0, False, 0, False, False, True, False, False, True, True), "medium", ["strict-decode-invalid-playable"]),
        ((None, 8, False, 0, False, False, True, False, False, True, True), "minor", ["vorbis-length-mismatch", "strict-decode-failed"]),
        ((None, 0, False, 0, False, False, True, True, True, None, None), "medium", ["strict-decode-warning"]),
        ((None, 0, False, 0, False, False, True, None, None, None, None), "clean", ["strict-decode-unchecked"]),
        ((flac.NO_COMMENT, 0, False, 0, False, False, True, False, False, False, None), "broken", ["strict-decode-failed"]),
        ((flac.NOT_FLAC, 0, False, 0, False, False, True, False, False, False, None), "broken", ["flac-parse-error"]),
        ((flac.BAD_COMMENT, 0, False, 0, False, True, None, None, None, None, None), "broken", ["broken-metadata-chain"]),
    ]
    rows = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], f"k int, {columns}")
    for r in health.diagnose(rows).collect():
        assert (r.bucket, r.issues) == cases[r.k][1:], r.k


def test_results_join_by_either_unicode_form(spark):
    composed, decomposed, other, parted = "\u00e9/1.flac", "e\u0301/1.flac", "\u00f6.flac", "o\u0308.flac"
    files = spark.createDataFrame([(composed,), ("a.flac",), ("gone.flac",), (other,), (parted,)], "rel string")
    rows = [(decomposed, 1, "minor"), ("a.flac", 1, "broken"), ("a.flac", 2, "clean"), (other, 1, "medium"), (parted, 1, "minor")]
    results = spark.createDataFrame(rows, "rel string, ord int, bucket string")
    found = {r.rel: (r.bucket, r.missing_result) for r in health.results_of_files(files, results).collect()}
    assert found[composed] == ("minor", False) and found["a.flac"] == ("clean", False) and found["gone.flac"] == (None, True)
    # Each spelling's result is known under both forms; of equal ord the greater path by bytes is the last.
    assert found[other] == found[parted] == ("medium", False)
