"""Substring deduplication on bytes by threshold-bounded interval expansion over a Burrows-Wheeler transform.

Removes each byte that a ``LENGTH``-byte string covers which also starts earlier (smaller doc_id, or earlier in the
same document). Candidate texts come from ``repeats``: the texts of runs whose anchor stands in several places. A task
concatenates the different texts under its anchors and sorts their suffixes by doubling, which gives the Burrows-Wheeler
transform and its last-to-first mapping. Breadth-first backward extension then goes from the intervals of strings of
k bytes to those of k + 1 bytes, all intervals of a level at once in numpy, and so finds the common prefixes of
neighbouring suffixes by increasing value (after Beller, Gog, Ohlebusch, Schnattinger, "Computing the longest common
prefix array based on the Burrows-Wheeler transform", 2013). It stops at LENGTH: boundaries not found by then lie
inside intervals of suffixes that agree on LENGTH bytes or more, and all but the earliest of an interval are repeats.
The transform holds each text once. Its copies in other places (most of all repeats) are proposed by a 64-bit key and
checked against a digest of the text that went through it; they aren't sorted or compared again themselves.

Whole texts are compared, as UTF-8; matches never cross documents. Null text is empty; a null doc_id sorts first; rows
that share a doc_id but not a text are documents of their own, equal rows are one document. Texts below LENGTH bytes
stay as they are; there is no upper bound, and a text of one long period is cut into pieces. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import NO_ID, Repeats, covered, proven

LENGTH = 100
#: Anchors are hashes of so many bytes.
GRAM = 32

_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_units(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def suffix_array(text: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes, each ending at its separator (value 0); equal ones by place.

    ``text`` holds values below 2 ** 9, ``left`` the units up to and without the next separator, at most ``longest``.
    Sorting doubles the compared length; a value, its follower and its place share a 64-bit word.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    place = np.arange(n, dtype=np.uint64)
    key, done = text.astype(np.uint64), 1
    first = 4  # 36 bits
    for k in range(1, first):
        follower = np.zeros(n, np.uint64)
        follower[:-k] = text[k:]
        follower[left < k] = 0
        key = (key << np.uint64(9)) | follower
    done = first
    while True:
        packed = np.sort((key << np.uint64(bits)) | place)
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        if done >= longest + 1:
            return order
        value = packed >> np.uint64(bits)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], value[1:] != value[:-1]])).astype(np.uint64)
        if 2 * bits + bits > 64:
            raise ValueError("too much text for one block")
        follower = np.zeros(n, np.uint64)
        follower[:-done] = rank[done:]
        follower[left < done] = 0
        key = (rank << np.uint64(bits)) | follower
        done *= 2


def interval_numbers(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The texts' suffixes in order (places in the texts, each followed by a separator), and their intervals' numbers.

    Suffixes with the same number agree on ``length`` bytes, or end alike before that.
    """
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8).astype(np.uint16) + 1
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    joined[stops] = 0
    n = len(joined)
    left = np.repeat(stops, [len(t) + 1 for t in texts]) - np.arange(n)
    order = suffix_array(joined, left, int(left.max()))
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    transform = joined[order - 1]  # of the first text's first suffix: the last separator
    to_first = rank[order - 1]
    # The next and the last place in the transform of the same symbol: neighbours in the first column.
    from_first = np.empty(n, np.int32)
    from_first[to_first] = np.arange(n, dtype=np.int32)
    same = transform[from_first[1:]] == transform[from_first[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[from_first[:-1][same]] = from_first[1:][same]
    before[from_first[1:][same]] = from_first[:-1][same]
    is_text = transform > 0
    found = np.zeros(n + 1, bool)
    found[n] = True
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    level = 0
    while len(low) and level < length:
        sizes = high - low + 1
        if level == 0:
            at, owner_low, owner_high = np.arange(n, dtype=np.int32), 0, n - 1
        else:
            at = np.arange(int(sizes.sum()), dtype=np.int32) + np.repeat(low - (np.cumsum(sizes) - sizes).astype(np.int32), sizes)
            owner_low, owner_high = np.repeat(low, sizes), np.repeat(high, sizes)
        text_only = is_text[at]
        begins, ends = (before[at] < owner_low) & text_only, (after[at] > owner_high) & text_only
        new_low, new_high = np.sort(to_first[at[begins]]), np.sort(to_first[at[ends]])
        if level == 0 and n > len(stops):
            new_low, new_high = np.append(new_low, np.int32(0)), np.append(new_high, np.int32(len(stops) - 1))  # the separators
        fresh = ~found[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        found[high + 1] = True
        level += 1
    return order, np.cumsum(found[:n])


def later_starts(texts: list[bytes], starts: np.ndarray, places: dict[str, np.ndarray], length: int = LENGTH) -> np.ndarray:
    """For each start of each text in turn: whether its string also starts at an earlier place, by its interval."""
    order, number = interval_numbers(texts, length)
    of_suffix = np.empty(len(order), np.int64)
    of_suffix[order] = number
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(texts)), starts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    group = of_suffix[begin[owner] + inner]
    doc, tag, start = places["doc"][owner], places["tag"][owner], places["start"][owner] + inner
    by_place = np.lexsort((start, tag, doc))
    first = np.full(int(group.max(initial=0)) + 1, -1, np.int64)
    first[group[by_place[::-1]]] = by_place[::-1]  # the earliest is written last
    first = first[group]
    return (doc != doc[first]) | (tag != tag[first]) | (start != start[first])


def removed_repeats(docs: DataFrame, length: int = LENGTH, key_of: Callable | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (binary: the bytes that stay) of each document."""
    finder = Repeats(length, GRAM, 1, lambda text: text, byte_units, lambda texts, starts, places: later_starts(texts, starts, places, length), key_of)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, value, found in zip(batch["doc"].to_pylist(), batch["text"].cast(pa.binary()), batch["repeats"].to_pylist()):
                text = value.as_py()
                found = proven(found, lambda: text, length, 1) if found else []  # noqa: B023
                gone = covered(len(text), found, length) if found else np.zeros(len(text), bool)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                rows.append((None if doc == NO_ID else doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return finder.repeated(docs).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
