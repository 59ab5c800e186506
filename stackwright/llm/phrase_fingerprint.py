"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the shortest string that is no phrase yet (Lempel and Ziv, 1978).
The set of phrases stands for what a compressor has learnt of the text, so the likeness of two phrase sets is one by
compression (Raff and Nicholas, "An alternative to NCD for large sequences, Lempel-Ziv Jaccard distance", 2017). Each
phrase is hashed as it grows, from the phrase it continues; a fingerprint is the row of minimum hashes of the set under
``COORDINATES`` functions, 16 bits of each as hexadecimal digits. The likeness of two fingerprints is their share of
equal coordinates: an estimate of the Jaccard similarity of the sets, with a standard error of at most 0.045.

``fingerprints`` needs no shuffle. ``neighbour_likeness`` compares each document with the next one by descending doc_id
and with a text half its own and half the next one's: one exchange by range, then documents stream in order, a
document beside its successor, and both texts share the parse of their common beginning. Only the last document of each
range waits for the first of the next, in a join on the ranges' numbers. A task holds a batch, one document's
phrases and nothing that grows with the corpus; the driver sees nothing of it.

Null text is empty; an empty text has no phrases, and two of them are alike (1). Texts are parsed whole, at any length: about
300 bytes of memory for each phrase of one text. Null doc_ids come last; rows that share a doc_id, or have none, are
ordered by a hash of their texts, and are documents of their own. A single row is its own successor. No rows give no
rows. Other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

COORDINATES = 128
#: Phrases that are hashed at once.
AT_ONCE = 4096
_EMPTY, _BASE, _MASK = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, (1 << 64) - 1
_HASH = ""  # of a phrase, among the letters that continue it
_RANDOM = np.random.Generator(np.random.PCG64(13))
_FACTORS = _RANDOM.integers(0, 1 << 32, (COORDINATES, 1), np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, (COORDINATES, 1), np.uint32)

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class Parse:
    """Phrases of a text that can go on in more than one way: a tree of letters, and the hash of each phrase."""

    def __init__(self):
        self.root = self.node = {_HASH: _EMPTY}
        self.hashes: list[int] = []

    def feed(self, text: str, added: list | None = None) -> None:
        """Parse on through ``text``; ``added`` gets the place of each new phrase. A last, known phrase stays open."""
        node, root, keep = self.node, self.root, self.hashes.append
        for letter in text:
            longer = node.get(letter)
            if longer is None:
                known = (node[_HASH] * _BASE + ord(letter)) & _MASK
                node[letter] = {_HASH: known}
                keep(known)
                if added is not None:
                    added.append((node, letter))
                node = root
            else:
                node = longer
        self.node = node

    def both(self, own: str, other: str) -> tuple[list[int], list[int]]:
        """Hashes of phrases if the text goes on as ``own``, and if it goes on as ``other``."""
        added, node, shared = [], self.node, len(self.hashes)
        self.feed(own, added)
        first, self.hashes = self.hashes, self.hashes[:shared]
        for place, letter in reversed(added):
            del place[letter]
        self.node = node
        self.feed(other)
        return first, self.hashes


def signature(hashes: list[int]) -> np.ndarray:
    """16 bits of the least value of each function over the hashed phrases; of no phrases all ones."""
    h = np.array(hashes, np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), AT_ONCE):
        np.minimum(least, (h[k : k + AT_ONCE] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype(">u2")


def fingerprint(text: str) -> str:
    parse = Parse()
    parse.feed(text)
    return signature(parse.hashes).tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fingerprint": pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(parse, "doc_id long, fingerprint string")


def likeness(a: str = "fingerprint", b: str = "other"):
    """Share of equal coordinates of two columns of fingerprints."""
    equal = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(COORDINATES)]
    return F.aggregate(F.array(*equal), F.lit(0), lambda x, y: x + y) / F.lit(float(COORDINATES))


def _compared(doc_id: int | None, text: str, following: str) -> tuple:
    """The result of one document without near_next, and its signature."""
    half = len(text) // 2
    kept, put = text[: len(text) - half], following[:half]
    parse = Parse()
    parse.feed(kept)
    own, edited = map(signature, parse.both(text[len(kept) :], put))
    return doc_id, len(text), hashlib.sha256((kept + put).encode()).hexdigest(), own, edited


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT = pa.schema(_FIELDS)
_STREAM = pa.schema([*_FIELDS, ("part", pa.int32()), ("starts", pa.bool_()), ("text", pa.string())])


def _finished(row: tuple, next_signature: np.ndarray) -> tuple:
    doc_id, n_chars, digest, own, edited = row
    return doc_id, n_chars, digest, own.tobytes(), edited.tobytes(), float((own == edited).mean()), float((own == next_signature).mean())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of ordered rows, one row behind; the first and the last row's texts go along for the ranges beside."""
    part, last, waiting, nothing = TaskContext.get().partitionId(), None, None, (None,) * 7
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if last is None:
                rows.append((*nothing, part, True, text))
            else:
                compared = _compared(*last, text)
                if waiting:
                    rows.append((*_finished(waiting, compared[3]), part, None, None))
                waiting = compared
            last = doc_id, text
        if rows:
            yield _batch(rows, _STREAM)
    if last is not None:
        parse = Parse()
        parse.feed(last[1])
        rows = [(last[0], *nothing[1:], part, False, last[1])]
        if waiting:
            rows.append((*_finished(waiting, signature(parse.hashes)), part, None, None))
        yield _batch(rows, _STREAM)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            parse = Parse()
            parse.feed(following)
            rows.append(_finished(_compared(doc_id, text, following), signature(parse.hashes)))
        if rows:
            yield _batch(rows, _RESULT)


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the latter half taken from the next one, and both likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    stream = materialize(ordered.mapInArrow(_streamed, f"{RESULT}, part int, starts boolean, text string"))
    firsts = stream.filter("starts").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    # One narrow row for each range.
    parts = Window.orderBy("next_part")
    following = F.coalesce(F.lead("next_part").over(parts), F.min("next_part").over(Window.partitionBy()))
    places = stream.filter("starts").select(F.col("part").alias("next_part")).select(F.col("next_part").alias("of_part"), following.alias("next_part"))
    lasts = stream.filter("NOT starts").select("doc_id", "text", "part")
    pairs = lasts.join(places, F.col("part") == F.col("of_part")).join(firsts, "next_part").select("doc_id", "text", "following")
    found = stream.filter("starts IS NULL").select(*_RESULT.names).unionByName(pairs.mapInArrow(_ends, RESULT))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
