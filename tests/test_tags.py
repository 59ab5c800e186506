"""Tag readers on files of each format, built here byte by byte, whole and cut at every place."""

import struct

import pytest

from stackwright.sources import tags


def comments(*pairs: str) -> bytes:
    return struct.pack("<I", 1) + b"v" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)


def page(granule: int, *packets: bytes) -> bytes:
    sizes, body = b"", b""
    for p in packets:
        sizes += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        body += p
    return b"OggS\0\0" + struct.pack("<qIII", granule, 1, 0, 0) + bytes([len(sizes)]) + sizes + body


def id3(version: int, *frames: tuple[bytes, bytes]) -> bytes:
    body = b"".join(k + struct.pack(">I", len(v)) + b"\0\0" + v for k, v in frames)
    return b"ID3" + bytes([version, 0, 0]) + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body


def chunk(name: bytes, body: bytes, order: str) -> bytes:
    return name + len(body).to_bytes(4, order) + body + b"\0" * (len(body) & 1)


def atom(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + name + body


def text_atom(name: bytes, value: str) -> bytes:
    return atom(name, atom(b"data", struct.pack(">II", 1, 0), value.encode()))


def ape_tag(*items: tuple[str, str]) -> bytes:
    body = b"".join(struct.pack("<II", len(v.encode()), 0) + k.encode() + b"\0" + v.encode() for k, v in items)
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + bytes(8)


HEADER = struct.pack(">IIII", 0, 0, 0, 1000)
XING = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">II", 1, 100)
FILES = {
    "vorbis.ogg": page(0, b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(14)) + page(88200, b"\x03vorbis" + comments("TITLE=Öl", "TRACKNUMBER=3/7", "X=" + "y" * 600)),
    "opus.opus": page(0, b"OpusHead" + struct.pack("<BBHI", 1, 2, 0, 44100) + bytes(3)) + page(96000, b"OpusTags" + comments("TITLE=Öl", "TRACKNUMBER=3/7")),
    "frames.mp3": id3(3, (b"TIT2", b"\x01" + "Öl".encode("utf-16")), (b"TRCK", b"\x003/7")) + XING + bytes(50),
    "constant.mp3": id3(4, (b"TIT2", "\x03Öl".encode()), (b"TRCK", b"\x003/7")) + b"\xff\xfb\x90\x00" + bytes(31996),
    "items.mp3": b"\xff\xfb\x90\x00" + bytes(16000) + ape_tag(("Title", "Öl"), ("Track", "3/7")) + b"TAG" + bytes(125),
    "info.wav": b"RIFF\0\0\0\0WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16), "little")
    + chunk(b"LIST", b"INFO" + chunk(b"INAM", "Öl\0".encode(), "little") + chunk(b"ITRK", b"3/7", "little"), "little") + chunk(b"data", bytes(64000), "little"),
    "chunk.wav": b"RIFF\0\0\0\0WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16), "little") + chunk(b"data", bytes(64000), "little")
    + chunk(b"id3 ", id3(4, (b"TIT2", "\x03Öl".encode()), (b"TRCK", b"\x003/7")), "little"),
    "chunk.aiff": b"FORM\0\0\0\0AIFF" + chunk(b"COMM", struct.pack(">HIHHQ", 2, 88200, 16, 16383 + 15, 44100 << 48), "big") + chunk(b"NAME", b"Other", "big")
    + chunk(b"ID3 ", id3(4, (b"TIT2", "\x03Öl".encode()), (b"TRCK", b"\x003/7")), "big"),
    "atoms.m4a": atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"mdat", bytes(100)) + atom(
        b"moov", atom(b"mvhd", HEADER[:12], struct.pack(">II", 1000, 2000)), atom(b"trak", atom(b"mdia", atom(b"mdhd", HEADER[:12], struct.pack(">II", 44100, 88200)))),
        atom(b"udta", atom(b"meta", bytes(4), atom(b"ilst", text_atom(b"\xa9nam", "Öl"), atom(b"trkn", atom(b"data", struct.pack(">IIHHHH", 0, 0, 0, 3, 7, 0))),
             atom(b"----", atom(b"mean", bytes(4), b"m"), atom(b"name", bytes(4), b"Mood"), atom(b"data", struct.pack(">II", 1, 0), b"x")), atom(b"covr", atom(b"data", bytes(9)))))),
    ),
    "monkey.ape": b"MAC " + struct.pack("<HHI", 3990, 0, 52) + bytes(40) + struct.pack("<HHIIIHHI", 0, 0, 40000, 8200, 3, 16, 2, 44100) + ape_tag(("Title", "Öl"), ("Track", "3/7")),
}
WANTED = {
    "vorbis.ogg": ("Vorbis I", 2.0, 44100), "opus.opus": ("Opus", 2.0, 44100), "frames.mp3": ("MPEG 1 Layer 3", 100 * 1152 / 44100, 44100), "constant.mp3": ("MPEG 1 Layer 3", 2.0, 44100),
    "info.wav": ("PCM", 2.0, 8000), "chunk.wav": ("PCM", 2.0, 8000), "chunk.aiff": ("PCM", 2.0, 44100), "atoms.m4a": ("MPEG-4/AAC", 2.0, 44100), "monkey.ape": ("Monkey's Audio", 2.0, 44100),
}


def test_formats(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "cut.m4a").write_bytes(FILES["atoms.m4a"][:-5])
    tagged = tags.read_tags(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in tags.tracks(tagged).collect()}
    assert rows.keys() == FILES.keys() | {"cut.m4a"}
    for name in FILES:
        row = rows[name]
        assert (row.title, row.track_number, row.track_total, row.error) == ("Öl", 3, 7, None), name
        if name in WANTED:
            assert (row.codec, round(row.duration, 6), row.sample_rate) == (WANTED[name][0], round(WANTED[name][1], 6), WANTED[name][2]), name
    assert rows["atoms.m4a"].has_cover and not rows["monkey.ape"].has_cover
    assert [(r.key, r.value) for r in tags.extra_tags(tagged.filter("codec = 'MPEG-4/AAC'"), ["TITLE", "TRACKNUMBER"]).collect()] == [("MOOD", "x")]
    assert (rows["cut.m4a"].codec, rows["cut.m4a"].title) == ("unknown", "cut.m4a") and rows["cut.m4a"].error


@pytest.mark.parametrize("name", FILES)
def test_cut_files_end_in_known_errors(name):
    data = FILES[name]
    for end in [*range(min(len(data), 400)), *range(max(len(data) - 300, 0), len(data))]:
        try:
            tags.parse(data[:end])
        except (ValueError, IndexError, struct.error):
            pass
