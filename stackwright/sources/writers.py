"""Tags written into audio files: FLAC, Ogg Vorbis and Opus, MP3, MP4, WAV, AIFF and Monkey's Audio.

``rewritten`` gives a file's bytes with some keys set or removed; everything else in it stays, audio bit for bit. Sizes,
checksums and offsets that depend on the tags follow. ``write_tags`` applies planned actions: files are dealt out by
ranges of paths, so that a folder's files are written by few tasks and a huge folder by many; each file is replaced at
once by a new one beside it, and one row for each file says what became of it. A file that can't be written doesn't stop
the others. A file that already has what is wanted stays untouched, so tasks that are lost or repeated do no harm.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import containers, flac, tags

# The comment key of each field, keys that mean the same, and fields that share one numbered pair.
KEYS = {
    "title": "TITLE", "artist": "ARTIST", "artists": "ARTISTS", "album": "ALBUM", "album_artist": "ALBUMARTIST", "album_artists": "ALBUMARTISTS", "genre": "GENRE", "year": "DATE",
    "composer": "COMPOSER", "track_number": "TRACKNUMBER", "disc_number": "DISCNUMBER", "lyrics": "LYRICS", "musicbrainz_track_id": "MUSICBRAINZ_TRACKID",
}
SAME = {"DATE": {"DATE", "YEAR"}, "ALBUMARTIST": {"ALBUMARTIST", "ALBUM ARTIST"}, "TRACKNUMBER": {"TRACKNUMBER", "TRACKTOTAL", "TOTALTRACKS"}, "DISCNUMBER": {"DISCNUMBER", "DISCTOTAL", "TOTALDISCS"}}
PAIRS = {"TRACKNUMBER": ("track_number", "track_total"), "DISCNUMBER": ("disc_number", "disc_total")}
LISTS = {"ARTISTS", "ALBUMARTISTS"}
#: Bytes of padding that a FLAC file or an ID3 tag gets when its tags outgrow their room.
ROOM = 4096
FRAME_OF = {"DATE": "TDRC"} | {v: k for k, v in containers.FRAMES.items() if v != "DATE"}
ATOM_OF = {v: k for k, v in containers.ATOMS.items()}
ITEM_OF = {v: k.title() for k, v in containers.ITEMS.items()}

Tags = list[tuple[str, str]]


def wanted_tags(old: Tags, fields: dict[str, str | None]) -> tuple[Tags, set[str]]:
    """Tags to write and keys whose old tags go. ``fields``: field or key -> new value, null or empty: removed."""
    new, gone = [], set()
    first = {}
    for key, value in old:
        first.setdefault(key.upper(), value)
    for key, (number, total) in PAIRS.items():
        if number in fields or total in fields:
            had, _, of = first.get(key, "").partition("/")
            of = of or first.get(key.replace("NUMBER", "TOTAL"), first.get("TOTAL" + key.replace("NUMBER", "S"), ""))
            n, t = (fields.get(f, h) or "" for f, h in ((number, had), (total, of)))
            gone |= SAME[key]
            if n or t:
                new.append((key, f"{n or 0}/{t}" if t else n))
    for field, value in fields.items():
        if field in ("track_number", "track_total", "disc_number", "disc_total"):
            continue
        key = KEYS.get(field, field.upper())
        gone |= SAME.get(key, {key})
        values = value.split(";") if value and key in LISTS else [value]
        new += [(key, v.strip()) for v in values if v and v.strip()]
    return new, gone


def _comment_block(block: bytes, new: Tags, gone: set[str]) -> bytes:
    """A Vorbis comment block or packet without its prefix; the vendor and other comments stay as they are."""
    at = 4 + struct.unpack_from("<I", block)[0]
    count, kept, place = struct.unpack_from("<I", block, at)[0], [], at + 4
    for _ in range(count):
        size = struct.unpack_from("<I", block, place)[0]
        comment = block[place + 4 : place + 4 + size]
        if len(comment) < size:
            raise ValueError("a comment is cut off")
        if comment.partition(b"=")[0].decode("ascii", "replace").upper() not in gone:
            kept.append(comment)
        place += 4 + size
    kept += [f"{k}={v}".encode() for k, v in new]
    return block[:at] + struct.pack("<I", len(kept)) + b"".join(struct.pack("<I", len(c)) + c for c in kept)


def _flac(data: bytes, new: Tags, gone: set[str]) -> bytes:
    blocks = list(flac.chain(data))
    if not blocks or not blocks[-1].last:
        raise ValueError("the chain of metadata blocks is broken")
    start, end = blocks[0].at, blocks[-1].end
    old = next((data[b.body : b.end] for b in blocks if b.kind == flac.COMMENT), struct.pack("<II", 0, 0))
    body = _comment_block(old, new, gone)
    kept = [(b.kind, data[b.body : b.end]) for b in blocks if b.kind not in (flac.COMMENT, flac.PADDING)]
    kept.insert(1, (flac.COMMENT, body))
    room = end - start - sum(4 + len(b) for _, b in kept) - 4
    kept.append((flac.PADDING, bytes(room if room >= 0 else ROOM)))
    if any(len(b) >= 1 << 24 for _, b in kept):
        raise ValueError("a metadata block would be too long")
    chain = b"".join(bytes([kind | 0x80 * (k == len(kept) - 1)]) + len(b).to_bytes(3, "big") + b for k, (kind, b) in enumerate(kept))
    return data[:start] + chain + data[end:]


_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _ogg_checksum(page: bytes) -> int:
    """The page's checksum runs from the highest bit on; zlib's from the lowest, over bytes and result turned around."""
    return int(f"{zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(head: bytes, sequence: int, sizes: bytes, body: bytes) -> bytes:
    page = head[:18] + struct.pack("<II", sequence, 0) + bytes([len(sizes)]) + sizes + body
    return page[:22] + struct.pack("<I", _ogg_checksum(page)) + page[26:]


def _ogg(data: bytes, new: Tags, gone: set[str]) -> bytes:
    pages, at = [], 0
    while data[at : at + 4] == b"OggS":
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(sizes)
        pages.append((data[at : at + 18], sizes, data[body : body + sum(sizes)]))
        at = body + sum(sizes)
    opus = pages[0][2].startswith(b"OpusHead")
    wanted, packets, packet, used = (1 if opus else 2), [], b"", 1
    while len(packets) < wanted and used < len(pages):
        _, sizes, body = pages[used]
        place = 0
        for n in sizes:
            packet += body[place : place + n]
            place += n
            if n < 255:
                packets.append(packet)
                packet = b""
        used += 1
    if not packets or len(packets) > wanted or packet:
        raise ValueError("headers and audio share a page")
    prefix, rest = (b"OpusTags", b"") if opus else (b"\x03vorbis", b"\x01")
    if not packets[0].startswith(prefix):
        raise ValueError("no comment packet")
    packets[0] = prefix + _comment_block(packets[0].removeprefix(prefix), new, gone) + rest
    sizes = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, found = b"".join(packets), [_page(pages[0][0], 0, pages[0][1], pages[0][2])]
    for k in range(0, len(sizes), 255):
        part = sizes[k : k + 255]
        goes_on = k > 0 and sizes[k - 1] == 255
        last = k + 255 >= len(sizes)
        place = pages[used - 1][0][6:14] if last else struct.pack("<q", 0 if any(n < 255 for n in part) else -1)
        head = b"OggS\0" + bytes([goes_on]) + place + pages[1][0][14:18]
        found.append(_page(head, len(found), part, body[: sum(part)]))
        body = body[sum(part) :]
    found += [_page(head, len(found) + k, s, b) for k, (head, s, b) in enumerate(pages[used:])]
    return b"".join(found) + data[at:]


def _safe(size: int) -> bytes:
    return bytes((size >> s) & 0x7F for s in (21, 14, 7, 0))


def _id3(tag: bytes, new: Tags, gone: set[str]) -> bytes:
    """An ID3v2 tag (empty: a new one of version 2.4) with other frames kept; what fits stays in the old size."""
    version, old_end, frames, at = (tag[3], len(tag), [], 10) if tag else (4, 0, [], 0)
    if tag and (version not in (3, 4) or tag[5] & 0xC0):
        raise ValueError("an ID3 tag of another version or unsynchronised")
    names = {FRAME_OF.get(k) for k in gone} | ({"TYER", "TDRC"} if "DATE" in gone else set())
    while at + 10 <= len(tag) and tag[at]:
        size = containers._sync_safe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        name, body = tag[at : at + 4].decode("latin-1"), tag[at + 10 : at + 10 + size]
        if len(body) < size:
            raise ValueError("a frame is cut off")
        if name not in names and not (name == "TXXX" and containers.user_text(body)[0].upper() in gone):
            frames.append(tag[at : at + 10 + size])
        at += 10 + size
    together: dict[str, list[str]] = {}
    for key, value in new:
        together.setdefault(key, []).append(value)
    for key, values in together.items():
        name, text = FRAME_OF.get(key, "TXXX"), "\0".join(values)
        name = "TYER" if name == "TDRC" and version == 3 else name
        text = f"{key}\0{text}" if name == "TXXX" else text
        body = b"\x03" + text.encode() if version == 4 else b"\x01" + b"\0\0".join(t.encode("utf-16") for t in text.split("\0"))
        frames.append(name.encode() + (_safe(len(body)) if version == 4 else struct.pack(">I", len(body))) + b"\0\0" + body)
    whole = b"".join(frames)
    room = old_end - 10 - len(whole)
    whole += bytes(room if room >= 0 else ROOM)
    if len(whole) >= 1 << 28:
        raise ValueError("an ID3 tag would be too long")
    return b"ID3" + bytes([version, 0, 0]) + _safe(len(whole)) + whole


def _mpeg(data: bytes, new: Tags, gone: set[str]) -> bytes:
    end = 10 + containers._sync_safe(data[6:10]) if data.startswith(b"ID3") else 0
    return _id3(data[:end], new, gone) + data[end:]


def _chunked(data: bytes, new: Tags, gone: set[str], order: str, name: bytes) -> bytes:
    """RIFF or FORM with its ID3 chunk written anew, at the end."""
    old, parts = b"", []
    for chunk, at, size in containers._chunks(data, 12, len(data), order):
        if chunk.upper() == b"ID3 ":
            old = data[at : at + size]
        else:
            parts.append(data[at - 8 : at + size] + b"\0" * (size & 1))
    tag = _id3(old, new, gone)
    body = data[8:12] + b"".join(parts) + name + len(tag).to_bytes(4, order) + tag + b"\0" * (len(tag) & 1)
    return data[:4] + len(body).to_bytes(4, order) + body


def _atom(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name + body


def _items(data: bytes, start: int, end: int, new: Tags, gone: set[str]) -> bytes:
    """The items of a movie's list, other ones kept."""
    kept = b""
    for name, at, stop in containers._atoms(data, start, end):
        key = containers.ATOMS.get(name)
        if name == b"----":
            key = "".join(data[s + 4 : e].decode("utf-8", "replace") for k, s, e in containers._atoms(data, at, stop) if k == b"name").upper()
        if key not in gone:
            kept += _atom(name, data[at:stop])
    for key, value in new:
        if key in ("TRACKNUMBER", "DISCNUMBER"):
            number, _, total = value.partition("/")
            pair = struct.pack(">HHH", 0, int(number or 0), int(total or 0)) + (b"\0\0" if key == "TRACKNUMBER" else b"")
            kept += _atom(ATOM_OF[key], _atom(b"data", struct.pack(">II", 0, 0) + pair))
        else:
            text = _atom(b"data", struct.pack(">II", 1, 0) + value.encode())
            free = _atom(b"mean", bytes(4) + b"com.apple.iTunes") + _atom(b"name", bytes(4) + key.encode())
            kept += _atom(ATOM_OF[key], text) if key in ATOM_OF else _atom(b"----", free + text)
    return kept


def _moved(data: bytes, start: int, end: int, by: int) -> bytes:
    """Atoms with the places of audio in their tables moved."""
    found = b""
    for name, at, stop in containers._atoms(data, start, end):
        body = data[at:stop]
        if name in (b"trak", b"mdia", b"minf", b"stbl"):
            body = _moved(data, at, stop, by)
        elif name in (b"stco", b"co64"):
            width, (count,) = (4 if name == b"stco" else 8), struct.unpack_from(">I", body, 4)
            places = [int.from_bytes(body[8 + width * k : 8 + width * (k + 1)], "big") + by for k in range(count)]
            body = body[:8] + b"".join(p.to_bytes(width, "big") for p in places)
        found += _atom(name, body)
    return found


def _mp4(data: bytes, new: Tags, gone: set[str]) -> bytes:
    tops = list(containers._atoms(data, 0, len(data)))
    movie = next(((at, stop) for name, at, stop in tops if name == b"moov"), None)
    if movie is None:
        raise ValueError("no movie header")

    def put(start: int, end: int, path: tuple[bytes, ...]) -> bytes:
        """The body between ``start`` and ``end`` with the list at ``path`` below it written anew."""
        if not path:
            return _items(data, start, end, new, gone)
        head = data[start : start + 4] if path == (b"ilst",) else b""  # the version of meta
        body, there = head, False
        for name, at, stop in containers._atoms(data, start + len(head), end):
            body += _atom(name, put(at, stop, path[1:]) if name == path[0] and not there else data[at:stop])
            there |= name == path[0]
        return body if there else body + made(path)

    def made(path: tuple[bytes, ...]) -> bytes:
        handler = bytes(4) + _atom(b"hdlr", struct.pack(">III", 0, 0, int.from_bytes(b"mdir", "big")) + b"appl" + bytes(9))
        inner = _items(data, 0, 0, new, gone) if len(path) == 1 else made(path[1:])
        return _atom(path[0], (handler if path[0] == b"meta" else b"") + inner)

    body = put(*movie, (b"udta", b"meta", b"ilst"))
    by = len(body) - (movie[1] - movie[0])
    if by and any(name == b"mdat" and at > movie[1] for name, at, _ in tops):
        body = _moved(body, 0, len(body), by)
    head = data[: movie[0] - 8]
    return head + _atom(b"moov", body) + data[movie[1] :]


def _ape(data: bytes, new: Tags, gone: set[str]) -> bytes:
    """The APE tag at the file's end written anew with its footer, before an ID3v1 tag if there is one."""
    end = len(data) - 128 * (data[-128:-125] == b"TAG")
    foot, items, start = data[max(end - 32, 0) : end], [], end
    if foot.startswith(b"APETAGEX"):
        size, count, flags = struct.unpack_from("<III", foot, 12)
        at = end - size
        start = at - 32 * (flags >> 31)
        for _ in range(count):
            n = struct.unpack_from("<I", data, at)[0]
            stop = data.index(0, at + 8, end) + 1 + n
            key = data[at + 8 : data.index(0, at + 8, end)].decode("latin-1").upper()
            if containers.ITEMS.get(key, key) not in gone:
                items.append(data[at:stop])
            at = stop
    together: dict[str, list[str]] = {}
    for key, value in new:
        together.setdefault(key, []).append(value)
    for key, values in together.items():
        text = "\0".join(values).encode()
        items.append(struct.pack("<II", len(text), 0) + ITEM_OF.get(key, key).encode() + b"\0" + text)
    body = b"".join(items)
    footer = b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + bytes(8)
    return data[:start] + body + footer + data[end:]


def rewritten(data: bytes, fields: dict[str, str | None]) -> bytes:
    """The file's bytes after ``fields`` are set (removed where null or empty); a ValueError where that isn't safe."""
    new, gone = wanted_tags(tags.parse(data)[4], fields)
    if data[4:8] == b"ftyp":
        return _mp4(data, new, gone)
    if data.startswith(b"RIFF"):
        return _chunked(data, new, gone, "little", b"id3 ")
    if data.startswith(b"FORM"):
        return _chunked(data, new, gone, "big", b"ID3 ")
    for magic, writer in ((b"fLaC", _flac), (b"OggS", _ogg), (b"MAC ", _ape)):
        if data.startswith(magic):
            return writer(data, new, gone)
    return _mpeg(data, new, gone)


def _is_done(data: bytes, fields: dict[str, str | None]) -> bool:
    """Whether the file already says what ``fields`` want."""
    old = tags.parse(data)[4]
    new, gone = wanted_tags(old, fields)
    return sorted((k, v) for k, v in old if k.upper() in gone) == sorted(new)


def write_one(path: str, fields: dict[str, str | None]) -> tuple[str, str | None]:
    """(status, error) of one file: written, unchanged or failed. What was written is read back before it takes effect."""
    try:
        with open(path, "rb") as f:
            data = f.read()
        if _is_done(data, fields):
            return "unchanged", None
        new = rewritten(data, fields)
        if not _is_done(new, fields):
            return "failed", "the new file doesn't read back"
        flac.write_whole(path, new)
        return "written", None
    except (OSError, ValueError, IndexError, OverflowError, struct.error) as error:
        return "failed", str(error) or type(error).__name__


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(path, *write_one(flac.local(path), {k: v for k, v in pairs})) for path, pairs in zip(batch.path, ([(p["field"], p["value"]) for p in f] for f in batch.fields))]
        yield pd.DataFrame(rows, columns=["path", "status", "error"])


def write_tags(actions: DataFrame, results: str) -> DataFrame:
    """Carries out actions (path, field, new_value, operation: set or remove) and writes what became of each file, once.

    Returns the rows (path, status, error) that were written to ``results``. Of several actions on one field of a file the
    greatest value counts. Files must be mounted on all executors under one path.
    """
    value = F.when(F.col("operation") == "set", F.col("new_value"))
    one = actions.groupBy("path", "field").agg(F.max(value).alias("value"))
    # At most one entry for each field of a file.
    files = one.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("fields"))
    done = files.repartitionByRange("path").sortWithinPartitions("path").mapInPandas(_written, "path string, status string, error string")
    done.write.mode("overwrite").parquet(results)
    return actions.sparkSession.read.parquet(results)


def write_summary(results: DataFrame) -> DataFrame:
    """One row: files written, unchanged and failed, and whether the batch is an error (it has failures and nothing else)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("written", "unchanged", "failed")]
    return results.agg(*counts).withColumn("all_failed", F.expr("failed > 0 AND written + unchanged = 0"))
