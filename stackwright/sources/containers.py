"""Headers and tags of MPEG audio, WAV, AIFF, MP4 and Monkey's Audio files.

A reader takes a file's bytes and gives (codec, seconds, sample rate, has cover, [(key, value)]), keys as in Vorbis comments.
Cut or broken files raise ValueError, IndexError or struct.error. Bodies of audio are skipped, not copied.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# How codecs are named in track rows.
CODECS = {"mpeg": "MPEG 1 Layer 3", "flac": "FLAC", "pcm": "PCM", "mp4": "MPEG-4/AAC", "vorbis": "Vorbis I", "opus": "Opus", "ape": "Monkey's Audio"}
# Names of fields in each format, and the comment names that they stand for.
FRAMES = {"TIT2": "TITLE", "TPE1": "ARTIST", "TALB": "ALBUM", "TPE2": "ALBUMARTIST", "TRCK": "TRACKNUMBER", "TPOS": "DISCNUMBER", "TYER": "DATE", "TDRC": "DATE", "TCON": "GENRE", "TCOM": "COMPOSER"}
INFO = {b"INAM": "TITLE", b"IART": "ARTIST", b"IPRD": "ALBUM", b"ICRD": "DATE", b"IGNR": "GENRE", b"ITRK": "TRACKNUMBER"}
CHUNKS = {b"NAME": "TITLE", b"AUTH": "ARTIST"}
ATOMS = {b"\xa9nam": "TITLE", b"\xa9ART": "ARTIST", b"\xa9alb": "ALBUM", b"aART": "ALBUMARTIST", b"\xa9day": "DATE", b"\xa9gen": "GENRE", b"\xa9wrt": "COMPOSER", b"trkn": "TRACKNUMBER", b"disk": "DISCNUMBER"}
ITEMS = {"TRACK": "TRACKNUMBER", "DISC": "DISCNUMBER", "YEAR": "DATE", "ALBUM ARTIST": "ALBUMARTIST"}
# Kilobits a second of layer III by index, in version 1 and in versions 2 and 2.5; samples a second of version 1.
KILOBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
#: Bytes after the tag in which the first frame is sought.
SOUGHT = 1 << 16


def _sync_safe(size: bytes) -> int:
    return (size[0] << 21) | (size[1] << 14) | (size[2] << 7) | size[3]


def _told(body: bytes) -> str:
    """The text of a frame, by the encoding that its first byte names; a mark of byte order before each later value goes."""
    return body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").replace("\ufeff", "")


def user_text(body: bytes) -> tuple[str, list[str]]:
    """(description, values) of a frame of free text."""
    description, _, values = _told(body).partition("\0") if body else ("", "", "")
    return description, values.rstrip("\0").split("\0")


def id3(data: bytes) -> tuple[int, bool, list[tuple[str, str]]]:
    """Place after the ID3v2.3 or 2.4 tag that ``data`` begins with, has cover, comments."""
    version, end, at, cover, tags = data[3], 10 + _sync_safe(data[6:10]), 10, False, []
    while at + 10 <= min(end, len(data)) and data[at]:
        name, size = data[at : at + 4].decode("latin-1"), _sync_safe(data[at + 4 : at + 8]) if version >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if len(body) < size:
            raise ValueError("a frame is cut off")
        cover |= name == "APIC"
        if name in FRAMES and body:
            tags += [(FRAMES[name], v) for v in _told(body).rstrip("\0").split("\0")]
        if name == "TXXX" and body:
            key, values = user_text(body)
            tags += [(key.upper(), v) for v in values if key and v]
        at += 10 + size
    return end, cover, tags


def ape_items(data: bytes) -> tuple[bool, list[tuple[str, str]]]:
    """Has cover and text items of the APE tag that ``data`` ends with, before an ID3v1 tag if there is one."""
    end, cover, tags = len(data) - 128 * (data[-128:-125] == b"TAG"), False, []
    foot = data[max(end - 32, 0) : end]
    if len(foot) < 32 or not foot.startswith(b"APETAGEX"):
        return False, []
    size, count = struct.unpack_from("<II", foot, 12)
    at = end - size
    if at < 0:
        raise ValueError("an APE tag is longer than its file")
    for _ in range(count):
        n, flags = struct.unpack_from("<II", data, at)
        stop = data.index(0, at + 8, end)
        key = data[at + 8 : stop].decode("latin-1").upper()
        cover |= key.startswith("COVER ART")
        if not flags & 6:  # text
            tags += [(ITEMS.get(key, key), v) for v in data[stop + 1 : stop + 1 + n].decode("utf-8", "replace").split("\0")]
        at = stop + 1 + n
    return cover, tags


def _frame(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(kilobits, rate, samples, place of a Xing header) of a layer III frame header at ``at``."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, kilobits, rate = (data[at + 1] >> 3) & 3, (data[at + 1] >> 1) & 3, data[at + 2] >> 4, (data[at + 2] >> 2) & 3
    if version == 1 or layer != 1 or kilobits in (0, 15) or rate == 3:
        return None
    first, mono = version == 3, data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return KILOBITS[not first][kilobits], RATES[rate] >> {3: 0, 2: 1, 0: 2}[version], 1152 if first else 576, at + 4 + side


def mpeg(data: bytes) -> tuple:
    at, cover, tags = id3(data) if data.startswith(b"ID3") else (0, False, [])
    if not tags:
        art, tags = ape_items(data)
        cover |= art
    start, found = at, None
    while found is None and 0 <= start < at + SOUGHT:
        start = data.find(b"\xff", start, at + SOUGHT)
        found = _frame(data, start) if start >= 0 else None
        start += found is None and start >= 0
    if found is None:
        if not data.startswith(b"ID3"):
            raise ValueError("no known header")
        return CODECS["mpeg"], 0.0, None, cover, tags
    kilobits, rate, samples, xing = found
    if data[xing : xing + 4] in (b"Xing", b"Info") and data[xing + 7] & 1:
        seconds = int.from_bytes(data[xing + 8 : xing + 12], "big") * samples / rate
    else:  # a constant bit rate
        seconds = (len(data) - start - 128 * (data[-128:-125] == b"TAG")) / (kilobits * 125)
    return CODECS["mpeg"], seconds, rate, cover, tags


def _chunks(data: bytes, at: int, end: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(name, place, size) of the chunks from ``at`` to ``end``; they begin at even places."""
    while at + 8 <= min(end, len(data)):
        size = int.from_bytes(data[at + 4 : at + 8], order)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def _string(data: bytes) -> str:
    return data.split(b"\0", 1)[0].decode("utf-8", "replace").strip()


def wav(data: bytes) -> tuple:
    rate, a_second, size, cover, own, tags = None, 0, 0, False, [], []
    for name, at, n in _chunks(data, 12, len(data), "little"):
        if name == b"fmt ":
            rate, a_second = struct.unpack_from("<II", data, at + 4)
        elif name == b"data":
            size = min(n, len(data) - at)
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            own += [(INFO[k], _string(data[s : s + m])) for k, s, m in _chunks(data, at + 4, at + n, "little") if k in INFO]
        elif name.upper() == b"ID3 ":
            _, cover, tags = id3(data[at : at + n])
    if rate is None:
        raise ValueError("no format chunk")
    return CODECS["pcm"], size / a_second if a_second else 0.0, rate, cover, tags or own


def aiff(data: bytes) -> tuple:
    rate, frames, cover, own, tags = None, 0, False, [], []
    for name, at, n in _chunks(data, 12, len(data), "big"):
        if name == b"COMM":
            _, frames, _, power, mantissa = struct.unpack_from(">HIHHQ", data, at)
            rate = int(mantissa * 2.0 ** ((power & 0x7FFF) - 16383 - 63))
        elif name in CHUNKS:
            own.append((CHUNKS[name], _string(data[at : at + n])))
        elif name == b"ID3 ":
            _, cover, tags = id3(data[at : at + n])
    if rate is None:
        raise ValueError("no common chunk")
    return CODECS["pcm"], frames / rate if rate else 0.0, rate, cover, tags or own


def _atoms(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the atoms between ``at`` and ``end``."""
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("an atom is cut off")
        yield name, at + head, at + size
        at += size


def _within(data: bytes, *names: bytes) -> tuple[int, int]:
    """Start and end of the first atom at a path of names; an empty range if there is none."""
    at, end = 0, len(data)
    for name in names:
        at, end = next(((s + 4 * (name == b"meta"), e) for k, s, e in _atoms(data, at, end) if k == name), (0, 0))
    return at, end


def _timing(data: bytes, at: int) -> tuple[int, int]:
    """(units a second, units) of a movie or media header."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)


def mp4(data: bytes) -> tuple:
    movie, end = _within(data, b"moov", b"mvhd")
    if movie == end:
        raise ValueError("no movie header")
    a_second, units = _timing(data, movie)
    media, end = _within(data, b"moov", b"trak", b"mdia", b"mdhd")
    rate = _timing(data, media)[0] if media < end else None
    cover, tags = False, []
    for name, at, stop in _atoms(data, *_within(data, b"moov", b"udta", b"meta", b"ilst")):
        parts = list(_atoms(data, at, stop))
        cover |= name == b"covr"
        key = ATOMS.get(name)
        if name == b"----":
            key = "".join(data[s + 4 : e].decode("utf-8", "replace") for k, s, e in parts if k == b"name").upper()
        for _, s, e in (p for p in parts if p[0] == b"data" and key):
            if name in (b"trkn", b"disk"):
                number, total = struct.unpack_from(">HH", data, s + 10)
                tags.append((key, f"{number}/{total}" if total else str(number)))
            elif int.from_bytes(data[s : s + 4], "big") == 1:  # UTF-8
                tags.append((key, data[s + 8 : e].decode("utf-8", "replace")))
    return CODECS["mp4"], units / a_second if a_second else 0.0, rate, cover, tags


def ape(data: bytes) -> tuple:
    if struct.unpack_from("<H", data, 4)[0] < 3980:
        raise ValueError("a version of the header before 3.98")
    at = struct.unpack_from("<I", data, 8)[0]
    blocks, last, frames, _, _, rate = struct.unpack_from("<IIIHHI", data, at + 4)
    cover, tags = ape_items(data)
    return CODECS["ape"], ((frames - 1) * blocks + last) / rate if frames and rate else 0.0, rate, cover, tags
