"""Tags of audio files: whole files come from Spark's binaryFile reader, and Arrow batches of them go through a parser.

FLAC, Ogg Vorbis and Opus comments are read here, other formats in ``containers``. A file that can't be parsed keeps its path and
size, with codec ``unknown`` and the error; it never ends the job. Comments stay long rows (key, value), as keys repeat.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from . import containers
from .containers import CODECS

VORBIS = [CODECS["flac"], CODECS["vorbis"], CODECS["opus"]]
SCHEMA = "path string, size_bytes long, codec string, duration double, sample_rate int, has_cover boolean, tags array<struct<key:string,value:string>>, error string"


def _comments(block: bytes) -> list[tuple[str, str]]:
    at = 4 + struct.unpack_from("<I", block)[0]
    count, at, found = struct.unpack_from("<I", block, at)[0], at + 4, []
    for _ in range(count):
        n = struct.unpack_from("<I", block, at)[0]
        key, _, value = block[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        found.append((key.upper(), value))
        at += 4 + n
    return found


def _flac(data: bytes) -> tuple:
    at, last, tags, cover, rate, samples = 4, False, [], False, 0, 0
    while not last:
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        last, kind, body = bool(head & 0x80), head & 0x7F, data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("a metadata block is cut off")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            rate, samples = packed >> 44, packed & ((1 << 36) - 1)
        elif kind == 4:
            tags = _comments(body)
        cover |= kind == 6
        at += 4 + size
    return CODECS["flac"], samples / rate if rate else 0.0, rate, cover, tags


def _ogg(data: bytes) -> tuple:
    opus = data.find(b"OpusHead", 0, 128)
    ident = opus if opus >= 0 else data.index(b"\x01vorbis", 0, 128)
    rate = struct.unpack_from("<I", data, ident + 12)[0]
    # Packets: the segments of pages, joined where a packet runs over pages.
    at, packet, packets, granule = 0, b"", [], 0
    while data[at : at + 4] == b"OggS":
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        granule = max(granule, struct.unpack_from("<q", data, at + 6)[0])
        body = at + 27 + len(sizes)
        for n in sizes:
            if len(packets) < 2:
                packet += data[body : body + n]
                if n < 255:
                    packets.append(packet)
                    packet = b""
            body += n
        at = body
    head = packets[1].removeprefix(b"OpusTags" if opus >= 0 else b"\x03vorbis")
    tags = _comments(head)
    return CODECS["opus" if opus >= 0 else "vorbis"], granule / (48000 if opus >= 0 else rate or 1), rate, any(k == "METADATA_BLOCK_PICTURE" for k, _ in tags), tags


def parse(data: bytes) -> tuple:
    """(codec, seconds, sample rate, has cover, [(key, value)]) of a file's bytes."""
    if data[4:8] == b"ftyp":
        return containers.mp4(data)
    for magic, reader in ((b"fLaC", _flac), (b"OggS", _ogg), (b"RIFF", containers.wav), (b"FORM", containers.aiff), (b"MAC ", containers.ape)):
        if data.startswith(magic):
            return reader(data)
    return containers.mpeg(data)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, size, data in zip(batch.path, batch.length, batch.content, strict=True):
            try:
                codec, seconds, rate, cover, tags = parse(bytes(data))
                rows.append((path, size, codec, seconds, rate, cover, [{"key": k, "value": v} for k, v in tags], None))
            except (ValueError, IndexError, struct.error) as error:
                rows.append((path, size, "unknown", 0.0, None, False, [], str(error) or type(error).__name__))
        frame = pd.DataFrame(rows, columns=["path", "size_bytes", "codec", "duration", "sample_rate", "has_cover", "tags", "error"])
        yield frame.astype({"sample_rate": "Int32"})


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """Tags of all audio files below ``root``; only audio files are opened."""
    names = "*.{" + ",".join(T.AUDIO_EXTENSIONS + [e.upper() for e in T.AUDIO_EXTENSIONS]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    return found.select("path", "length", "content").mapInPandas(_parsed, SCHEMA)


def tracks(tagged: DataFrame) -> DataFrame:
    """Typed track rows: the first value of single fields, whole lists of plural ones (empty: null), n/total numbers."""

    def all_of(*keys: str) -> Column:
        return F.transform(F.filter("tags", lambda t: t["key"].isin(*keys)), lambda t: t["value"])

    def first(*keys: str) -> Column:
        return F.get(all_of(*keys), F.lit(0))

    def listed(*keys: str) -> Column:
        names = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(all_of(*keys), lambda v: F.split(v, ";"))), T.trim), lambda v: v != ""))
        return F.when(F.size(names) > 0, names)

    number, disc = T.number_pair(first("TRACKNUMBER")), T.number_pair(first("DISCNUMBER"))
    broken = F.col("error").isNotNull()
    return tagged.select(
        "path", F.when(broken, T.basename(F.col("path"))).otherwise(first("TITLE")).alias("title"), first("ARTIST").alias("artist"), listed("ARTISTS").alias("artists"),
        first("ALBUM").alias("album"), first("ALBUMARTIST", "ALBUM ARTIST").alias("album_artist"), listed("ALBUMARTISTS").alias("album_artists"),
        number["number"].alias("track_number"), F.coalesce(number["total"], T.positive_int(first("TRACKTOTAL", "TOTALTRACKS"))).alias("track_total"),
        disc["number"].alias("disc_number"), F.coalesce(disc["total"], T.positive_int(first("DISCTOTAL", "TOTALDISCS"))).alias("disc_total"),
        F.substring(first("DATE", "YEAR"), 1, 4).alias("year"), first("GENRE").alias("genre"), first("COMPOSER").alias("composer"),
        first("MUSICBRAINZ_TRACKID").alias("musicbrainz_track_id"), "has_cover", "size_bytes", "sample_rate", "codec", "duration", "error",
    )


def extra_tags(tagged: DataFrame, owned: Sequence[str] = ()) -> DataFrame:
    """(path, ord, key, value, source): comments that no field of the editor nor of ``owned`` has, provider ids by their canonical names.

    Of a provider's id the first value stays, of other keys each value once; ``ord`` tells the order in the file.
    """
    rows = tagged.select("path", "codec", F.posexplode("tags").alias("ord", "t"))
    key = F.coalesce(N.provider_key(F.col("t.key")), F.col("t.key"))
    source = F.when(F.col("codec").isin(*VORBIS), "vorbis").when(F.col("codec") == CODECS["ape"], "APEv2").when(F.col("codec") == CODECS["mp4"], "MP4").otherwise("ID3v2")
    rows = rows.select("path", "ord", key.alias("key"), F.col("t.value").alias("value"), source.alias("source"))
    rows = rows.filter((F.col("key") != "") & (F.col("value") != "") & ~N.is_editor_key(F.col("key")) & ~F.col("key").isin(*owned))
    one = F.when(N.provider_key(F.col("key")).isNull(), F.col("value"))
    kept = rows.groupBy("path", "source", "key", one.alias("_one")).agg(F.min(F.struct("ord", "value")).alias("r"))
    return kept.select("path", "r.ord", "key", "r.value", "source")
