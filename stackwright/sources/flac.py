"""The structure of FLAC files: chains of metadata blocks, their comments, and where audio begins.

``structure`` gives one row of facts for each file, by which ``operators.health`` diagnoses it; ``repaired`` gives a file's
bytes without the faults that have a safe repair, and ``repair_files`` writes them, each through a file beside it that is
renamed, so a task that is killed or repeated leaves whole files. Files come from Spark's binaryFile reader in Arrow
batches, bounded by bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How far the marker is sought, the largest kind of block that the format has, and of any that is passed over;
# how far audio is sought behind the last block, and keys of comments.
MARKER, MARKER_WITHIN = b"fLaC", 25000
KNOWN_KIND, ANY_KIND = 6, 126
AUDIO_WITHIN = 200_000
STREAM_INFO, PADDING, COMMENT, PICTURE = 0, 1, 4, 6
PICTURE_KEY, KEY_WITHIN = b"METADATA_BLOCK_PICTURE", 100
JPEG_AS_TEXT = b"/9"  # base64 of a JPEG's first bytes, where a picture's type belongs
NOT_FLAC, NO_COMMENT, BAD_COMMENT = "not a valid FLAC file", "no VORBIS_COMMENT block found", "Vorbis comment block too corrupted to parse"

FACTS = (
    "path string, size_bytes long, n_blocks int, header_len int, actual_len int, mismatch int, comment_is_last boolean, audio_offset int, audio_sync_corrupted boolean,"
    " metadata_audio_gap int, corrupted_picture boolean, broken_chain boolean, sample_rate int, total_samples long, error string"
)
NAMES = [c.split()[0] for c in FACTS.split(",")]


class Block:
    """A metadata block: its kind, the place of its header and of its body, its length, and whether it is marked last."""

    def __init__(self, data: bytes, at: int):
        self.kind, self.last, self.at, self.body = data[at] & 0x7F, data[at] > 0x7F, at, at + 4
        self.length = int.from_bytes(data[at + 1 : at + 4], "big")

    @property
    def end(self) -> int:
        return self.body + self.length


def chain(data: bytes, most_kind: int = ANY_KIND, past_last: bool = False) -> Iterator[Block]:
    """Blocks from the marker on, up to the last one (or as far as blocks go), the file's end or a kind that is none."""
    at = max(0, data.find(MARKER, 0, MARKER_WITHIN + len(MARKER))) + 4
    while at + 4 <= len(data):
        block = Block(data, at)
        if block.kind > most_kind or block.end > len(data):
            return
        yield block
        if block.last and not past_last:
            return
        at = block.end


def comment_spans(data: bytes, block: Block) -> tuple[int, list[tuple[int, int]]] | None:
    """The place after a comment block's content, and (start, end) of each comment; null if lengths lead beyond the block."""
    try:
        at = block.body + 4 + struct.unpack_from("<I", data, block.body)[0]
        (count,), spans = struct.unpack_from("<I", data, at), []
        at += 4
        for _ in range(count):
            start = at + 4
            at = start + struct.unpack_from("<I", data, at)[0]
            if start > block.end or at > block.end:
                return None
            spans.append((start, at))
        return (at, spans) if at <= block.end else None
    except struct.error:
        return None


def _is_bad_picture(data: bytes, start: int, end: int) -> bool:
    """Whether a comment says to be a picture and holds an image's bytes instead of a picture block."""
    equals = data.find(b"=", start, min(end, start + KEY_WITHIN))
    return data[start:equals] == PICTURE_KEY and equals > start and end - equals - 1 > 4 and data[equals + 1 : equals + 3] == JPEG_AS_TEXT


def _is_sync(data: bytes, at: int, first: int = 0xFF) -> bool:
    return data[at : at + 1] == bytes([first]) and at + 1 < len(data) and data[at + 1] & 0xF8 == 0xF8


def _gap(data: bytes, at: int) -> int:
    """Bytes between ``at`` and the next frame of audio; 0 if there is none near."""
    place = data.find(b"\xff", at, min(at + AUDIO_WITHIN, len(data) - 1))
    while place >= 0 and not _is_sync(data, place):
        place = data.find(b"\xff", place + 1, min(at + AUDIO_WITHIN, len(data) - 1))
    return max(0, place - at)


def _is_broken(data: bytes, blocks: list[Block]) -> bool:
    """Whether blocks go on behind one that is marked last, or something like a block behind a first one that is."""
    marks = [b.last for b in chain(data, KNOWN_KIND, past_last=True)]
    after = blocks[0].end if blocks and blocks[0].last else None
    return any(marks[:-1]) or (after is not None and after + 4 <= len(data) and data[after] & 0x7F <= KNOWN_KIND)


def facts(data: bytes) -> dict:
    """Columns of FACTS, but for path and size, of one file's bytes."""
    found = dict.fromkeys(NAMES[2:]) | {"mismatch": 0, "audio_sync_corrupted": False, "metadata_audio_gap": 0, "corrupted_picture": False, "broken_chain": False}
    if len(data) < 8 or data.find(MARKER, 0, MARKER_WITHIN + len(MARKER)) < 0:
        return found | {"error": NOT_FLAC}
    blocks = list(chain(data))
    found |= {"n_blocks": len(blocks), "broken_chain": _is_broken(data, blocks)}
    info = next((b for b in blocks if b.kind == STREAM_INFO and b.length >= 18), None)
    if info:
        packed = int.from_bytes(data[info.body + 10 : info.body + 18], "big")
        found |= {"sample_rate": packed >> 44, "total_samples": packed & (1 << 36) - 1 or None}
    comment = next((b for b in blocks if b.kind == COMMENT), None)
    if comment is None and not found["broken_chain"]:
        return found | {"error": NO_COMMENT}
    if comment:
        spans = comment_spans(data, comment)
        if spans is None:
            return found | {"error": BAD_COMMENT}
        actual = spans[0] - comment.body
        found |= {"header_len": comment.length, "actual_len": actual, "mismatch": comment.length - actual, "comment_is_last": comment.last}
        found["corrupted_picture"] = any(_is_bad_picture(data, *s) for s in spans[1])
    audio = blocks[-1].end if blocks else 4
    return found | {"audio_offset": audio, "audio_sync_corrupted": _is_sync(data, audio, 0x7F), "metadata_audio_gap": _gap(data, audio) if blocks else 0}


def _padding(size: int, last: bool) -> bytes:
    return bytes([PADDING | 0x80 * last]) + (size - 4).to_bytes(3, "big") + bytes(size - 4)


def _without_trailing(data: bytearray) -> bool:
    """Bytes after the comments become padding; only where the comments are the last block and padding has room."""
    comment = next((b for b in chain(data) if b.kind == COMMENT), None)
    spans = comment and comment_spans(data, comment)
    if not spans or not comment.last or comment.end - spans[0] < 4:
        return False
    data[comment.at : comment.body] = bytes([COMMENT]) + (spans[0] - comment.body).to_bytes(3, "big")
    data[spans[0] : comment.end] = _padding(comment.end - spans[0], True)
    return True


def _with_sync(data: bytearray) -> bool:
    audio = max((b.end for b in chain(data)), default=4)
    if not _is_sync(data, audio, 0x7F):
        return False
    data[audio] = 0xFF
    return True


def _without_gap(data: bytearray) -> bool:
    """A last block of padding takes in what lies between it and the audio."""
    last = list(chain(data))[-1:]
    gap = _gap(data, last[0].end) if last else 0
    if not gap or last[0].kind != PADDING or last[0].length + gap >= 1 << 24:
        return False
    data[last[0].at + 1 : last[0].body] = (last[0].length + gap).to_bytes(3, "big")
    return True


def _without_bad_picture(data: bytearray) -> bool:
    """Comments that hold an image's bytes go; padding of their size follows the block, or it shrinks where it can't."""
    comment = next((b for b in chain(data) if b.kind == COMMENT), None)
    spans = comment and comment_spans(data, comment)
    if not spans:
        return False
    kept = [data[s:e] for s, e in spans[1] if not _is_bad_picture(data, s, e)]
    if len(kept) == len(spans[1]):
        return False
    vendor = comment.body + 4 + struct.unpack_from("<I", data, comment.body)[0]
    body = data[comment.body : vendor] + struct.pack("<I", len(kept)) + b"".join(struct.pack("<I", len(c)) + c for c in kept)
    room = comment.length - len(body)
    block = bytes([COMMENT | 0x80 * (comment.last and room < 4)]) + len(body).to_bytes(3, "big") + body
    data[comment.at : comment.end] = block + (_padding(room, comment.last) if room >= 4 else b"")
    return True


def _with_one_last(data: bytearray) -> bool:
    blocks = list(chain(data, KNOWN_KIND, past_last=True))
    for b in blocks:
        data[b.at] = b.kind | 0x80 * (b is blocks[-1])
    return bool(blocks)


#: Fixed values are the names of repairs. Name -> (repair, the fact that tells the fault), in the order in which they are carried out:
#: a gap goes before the chain is mended, as zeros in it look like blocks.
REPAIRS = {
    "fix-vorbis-length": (_without_trailing, "mismatch"),
    "fix-audio-sync": (_with_sync, "audio_sync_corrupted"),
    "fix-metadata-audio-gap": (_without_gap, "metadata_audio_gap"),
    "fix-corrupted-picture-tag": (_without_bad_picture, "corrupted_picture"),
    "fix-broken-metadata-chain": (_with_one_last, "broken_chain"),
}


def repaired(data: bytes, repairs: list[str]) -> tuple[bytes, list[str]]:
    """The bytes after ``repairs``, and the names of those whose faults are still there."""
    new = bytearray(data)
    for name, (repair, _) in REPAIRS.items():
        if name in repairs:
            repair(new)
    now = facts(bytes(new))
    return bytes(new), [name for name, (_, fault) in REPAIRS.items() if name in repairs and (now["error"] or now[fault])]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"path": p, "size_bytes": n} | facts(bytes(d)) for p, n, d in zip(batch.path, batch.length, batch.content)]
        frame = pd.DataFrame(rows, columns=NAMES)
        numbers = ["n_blocks", "header_len", "actual_len", "mismatch", "audio_offset", "metadata_audio_gap", "sample_rate"]
        yield frame.astype({c: "Int32" for c in numbers} | {"total_samples": "Int64"})


def structure(spark: SparkSession, root: str) -> DataFrame:
    """FACTS of every FLAC file below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{flac,FLAC,Flac}").load(root)
    return found.select("path", "length", "content").mapInPandas(_rows, FACTS)


def write_whole(path: str, data: bytes) -> None:
    """Replaces a file at once: its new bytes go to a file beside it, which then takes its name and mode."""
    beside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.rewrite")
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(beside, os.stat(path).st_mode)
    os.replace(beside, path)


def local(path: str) -> str:
    """The path of a file that is mounted on the executors alike, without its scheme."""
    return path.removeprefix("file:") if not path.startswith("file:///") else path[7:]


def _repaired_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, repairs in zip(batch.path, batch.known_repairs):
            try:
                with open(local(path), "rb") as f:
                    data = f.read()
                new, failed = repaired(data, list(repairs))
                if new != data:
                    write_whole(local(path), new)
                rows.append((path, failed, None))
            except OSError as error:
                rows.append((path, list(repairs), str(error)))
        yield pd.DataFrame(rows, columns=["path", "failed_repairs", "repair_error"])


def repair_files(diagnosed: DataFrame, results: str) -> DataFrame:
    """Repairs files of bucket minor in place and writes (path, failed_repairs, repair_error) to ``results``, once.

    ``diagnosed``: path, bucket, known_repairs. Files must be mounted on all executors under one path. Repairs of a repaired
    file change nothing, so lost tasks may run again.
    """
    todo = diagnosed.filter("bucket = 'minor'").select("path", "known_repairs")
    done = todo.repartition(F.col("path")).mapInPandas(_repaired_files, "path string, failed_repairs array<string>, repair_error string")
    done.write.mode("overwrite").parquet(results)
    return diagnosed.sparkSession.read.parquet(results)
