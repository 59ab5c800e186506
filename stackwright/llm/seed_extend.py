"""Substring deduplication on words by seeds and extension.

Removes each word that a window of ``WINDOW`` words covers whose word sequence also starts earlier (smaller doc_id, or
earlier in the same document). Seeds are winnowed anchors, the least hashes of 8-word grams in each window; documents
are joined on them (see ``repeats``). Under a shared anchor each text pairs with the earliest text that holds one of its
windows; the match is extended left and right from the window word by word, and its maximal repeats of WINDOW words or
more are kept. A text has at most as many partners as starts, so nothing grows with the square of an anchor's texts.
Each text under an anchor is extended once. Its copies in other places (most of all repeats) are proposed by a 64-bit
key and checked against a digest of the text that was extended; they aren't extended again themselves.

Words are maximal runs without ASCII white space, unchanged, and compared by 64-bit hashes. Null text has no words; a
null doc_id sorts first; rows that share a doc_id but not a text are documents of their own, equal rows are one
document. Texts of fewer than WINDOW words stay as they are; there is no upper bound. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .minhash_join import word_hashes
from .repeats import NO_ID, Repeats, covered, proven

WINDOW = 20
#: Anchors are hashes of so many words.
GRAM = 8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_raw(text: bytes) -> bytes:
    """Hashes of the words; bytes.split() splits at exactly the white space that ends words here."""
    return word_hashes(text.split()).tobytes()


def word_units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def later_windows(texts: list[bytes], starts: np.ndarray, places: dict[str, np.ndarray], window: int = WINDOW) -> np.ndarray:
    """For each start of each text (word hashes) in turn: whether a maximal repeat with an earlier place covers it."""
    sizes = np.array([len(t) // 8 for t in texts])
    words = np.frombuffer(b"".join(texts), np.uint64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), starts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin[owner] + inner
    seed = np.zeros(len(at), np.uint64)
    for k in range(window):
        seed = (seed ^ words[at + k]) * _GOLDEN
        seed ^= seed >> np.uint64(32)
    doc, tag, start = places["doc"][owner], places["tag"][owner], places["start"][owner] + inner
    order = np.lexsort((start, tag, doc, seed))
    new = np.concatenate([[True], seed[order][1:] != seed[order][:-1]])[: len(order)]
    partner = np.empty(len(order), np.int64)
    partner[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero((doc != doc[partner]) | (tag != tag[partner]) | (start != start[partner]))
    # One seed for each row of windows that follow each other with the same partner at the same offset.
    pair = np.stack([owner[later], owner[partner[later]], at[partner[later]] - at[later], at[later] - np.arange(len(later))])
    seeds = later[np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)])[: len(later)]]
    mine, other = at[seeds], at[partner[seeds]]
    my_low, other_low = begin[owner[seeds]], begin[owner[partner[seeds]]]
    my_high, other_high = my_low + sizes[owner[seeds]], other_low + sizes[owner[partner[seeds]]]

    def extend(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Words that agree from x and y on, going by ``step``, within both texts."""
        n = np.zeros(len(x), np.int64)
        going = np.arange(len(x))
        while len(going):
            a, b = x[going] + step * n[going], y[going] + step * n[going]
            inside = (a >= my_low[going]) & (b >= other_low[going]) & (a < my_high[going]) & (b < other_high[going])
            going, a, b = going[inside], a[inside], b[inside]
            going = going[words[a] == words[b]]
            n[going] += 1
        return n

    left, right = extend(mine - 1, other - 1, -1), extend(mine, other, 1)
    maximal = left + right >= window
    first_start = np.cumsum(starts) - starts
    steps = np.zeros(len(at) + 1, np.int64)
    base = first_start[owner[seeds]] - begin[owner[seeds]]
    low, high = base + mine - left, base + mine + right - window + 1
    np.add.at(steps, low[maximal], 1)
    np.add.at(steps, high[maximal], -1)
    return np.cumsum(steps)[:-1] > 0


def removed_repeats(docs: DataFrame, window: int = WINDOW, key_of: Callable | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``kept`` (string: the words that stay) of each document."""
    finder = Repeats(window, GRAM, 8, word_raw, word_units, lambda texts, starts, places: later_windows(texts, starts, places, window), key_of)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, value, found in zip(batch["doc"].to_pylist(), batch["text"].cast(pa.binary()), batch["repeats"].to_pylist()):
                words = value.as_py().split()
                removed = 0
                found = proven(found, lambda: word_raw(value.as_py()), window, 8) if found else []  # noqa: B023
                if found:
                    gone = covered(len(words), found, window)
                    removed = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed else words)
                rows.append((None if doc == NO_ID else doc, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return finder.repeated(docs).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
