"""Packing token sequences by exact-complement hashing.

Documents are tokenized, ended with id 0, and cut only where they exceed a sequence. What is planned is the histogram
of piece lengths, at most one count for each length up to the sequence length however large the corpus is: starting
from the longest available length, a single length, a pair or a triple that exactly fills its gap is looked up in the
index of available sums and consumed as often as all its lengths are available. Lengths without an exact complement
are then placed best fit, longest first, by classes of equal gaps. The plan is a list of patterns (lengths and a
number of sequences); a piece gets its place from its rank among the pieces of its length, looked up in sorted arrays.

Scale: only the histogram comes to the driver, and the plan (a few thousand patterns) is broadcast; both are bounded by
the sequence length, not by the data. Ranks within a length are taken in two levels (within hash buckets, then over
bucket totals), so a length that a third of all pieces share isn't one task's work.

Null text counts as empty and yields the end id alone. Rows that repeat a doc_id, or have none, are packed each on its
own. Texts of any length are encoded whole; a text longer than a sequence is cut at the sequence's length from its end
on. Pieces of a length are alike to the plan: which of them goes where follows from where their rows stand, and so
changes with the table's partitions. An empty table gives no pieces. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SEQUENCE_TOKENS = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
BUCKET_ROWS = 1 << 14
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket_key long"
#: Words whose ids a Python worker remembers.
MOST_WORDS = 1 << 18
#: Fixed value: the tokenizer's own rule for cutting texts into words, within which it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, then 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {byte: chr(byte if byte in visible else next(others)) for byte in range(256)}


def _unsettled() -> re.Pattern:
    """Matches characters that Unicode versions may class differently: all but those of version 3.2 that kept their class."""
    settled, start = [], None
    for code in range(0x10001):
        c = chr(code)
        now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        fine = code < 0x10000 and now[0] == then[0] and now not in ("Cn", "Cs", "Co") and not 0xD800 <= code < 0xE000
        if fine and start is None:
            start = code
        elif not fine and start is not None:
            settled.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    return re.compile(f"[^{''.join(settled)}]")


class Words(dict):
    """Ids of words as bytes, merged by the tokenizer's model where they aren't known yet."""

    def __init__(self, model):
        super().__init__()
        self.merge, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Encoder:
    """Token ids by the tokenizers library. A word's ids don't depend on its neighbours, so each word is encoded once."""

    def __init__(self, folder: str | None = None):
        import regex
        from tokenizers import Tokenizer

        if folder:
            path = f"{folder.rstrip('/')}/{VOCABULARY}.json"
        else:
            import public_tokenizers

            path = public_tokenizers.path(f"{VOCABULARY}.json")
        self.tokenizer, self.words, self.unsettled = Tokenizer.from_file(path), regex.compile(WORDS), _unsettled()
        self.held = Words(self.tokenizer.model)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        """Ids of the whole text, no special tokens added; where words may be cut otherwise, the text is encoded as one."""
        if SPECIAL in text or self.unsettled.search(text):
            return np.array(self.whole(text), "<u4")
        if len(self.held) > MOST_WORDS:
            self.held.clear()
        return np.frombuffer(b"".join(map(self.held.__getitem__, self.words.findall(text))), "<u4")


@lru_cache(maxsize=2)
def encoder(folder: str | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(folder)


def token_pieces(docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with a hash of the row for ranking."""

    def cut(batches):
        encode = encoder(folder)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["bucket_key"].to_pylist(), batch["text"]):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % sequence_tokens or sequence_tokens
                ends = range(first, len(ids) + 1, sequence_tokens)
                for k, end in enumerate(ends):
                    start = end - (sequence_tokens if k else first)
                    for column, value in zip(out, (doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes()), key)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bucket_key"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("bucket_key"), text_or_empty().alias("text"))
    return chosen.mapInArrow(cut, PIECE_SCHEMA)


def plan_patterns(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, sequences) that use up ``histogram`` (count by length; index 0 is unused)."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    rest = np.zeros_like(left)

    def best_pair(total: int, spare: int = 0) -> tuple[int, int] | None:
        """Available a >= b with a + b = total, the largest a; ``spare`` is a length of which one is spoken for."""
        if total < 2:
            return None
        free = left[: total].copy()
        if 0 < spare < total:
            free[spare] -= 1
        a = np.arange(total - 1, (total - 1) // 2, -1)
        ok = (free[a] > 0) & (free[total - a] > 0) & ((a != total - a) | (free[a] > 1))
        at = np.flatnonzero(ok)
        return (int(a[at[0]]), int(total - a[at[0]])) if len(at) else None

    def complement(gap: int) -> tuple[int, ...] | None:
        if left[gap] > 0:
            return (gap,)
        if pair := best_pair(gap):
            return pair
        open_lengths = np.flatnonzero(left[: max(gap - 1, 0)] > 0)
        if not len(open_lengths):
            return None
        available = (left[: gap + 1] > 0).astype(np.float64)
        width = 1 << (2 * gap + 1).bit_length()
        spectrum = np.fft.rfft(available, width)
        pair_sums = np.fft.irfft(spectrum * spectrum, width)[: gap + 1] > 0.5  # sums of two available lengths
        for a in open_lengths[pair_sums[gap - open_lengths]][::-1]:
            if pair := best_pair(gap - int(a), int(a)):
                return (int(a), *pair)
        return None

    for length in range(size, 0, -1):
        while left[length] > 0:
            gap = size - length
            if not gap:
                patterns.append(((length,), int(left[length])))
                left[length] = 0
                break
            left[length] -= 1
            found = complement(gap)
            left[length] += 1
            if not found:
                rest[length] += left[length]
                left[length] = 0
                break
            need = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            patterns.append(((length, *found), times))
    # Best fit, longest first: open sequences are held by their gap as (lengths, number of them).
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        while rest[length] > 0:
            gap = min((g for g in opened if g >= length and opened[g]), default=None)
            if gap is None:
                each = size // length
                whole, extra = divmod(int(rest[length]), each)
                if whole:
                    opened[size - each * length].append(((length,) * each, whole))
                if extra:
                    opened[size - extra * length].append(((length,) * extra, 1))
                rest[length] = 0
                break
            lengths, number = opened[gap].pop()
            used = min(number, int(rest[length]))
            if number > used:
                opened[gap].append((lengths, number - used))
            opened[gap - length].append(((*lengths, length), used))
            rest[length] -= used
    return patterns + [x for held in opened.values() for x in held]


def plan_places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Sorted arrays: pieces of a length from rank ``first`` on go to sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, number in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += number
            offset += length
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_best_fit(docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``folder``: where the vocabulary files are on the executors; by default the installed public ones.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, sequence_tokens, folder))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most a row for each length
    histogram = np.zeros(sequence_tokens + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(plan_places(plan_patterns(histogram)))
    # A length has buckets by its own number of pieces; at most a row for each length.
    buckets = spark.createDataFrame([(r["length"], max(1, math.ceil(r["n"] / BUCKET_ROWS))) for r in counted], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("bucket_key", "piece"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "bucket_key")
    ranked = dealt.withColumn("_rank", F.row_number().over(inner) - 1).join(counts.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("before")).cast("long").alias("rank"))

    def place(frames):
        plan = places.value
        span = int(plan["first"].max(initial=0)) + 1
        key = plan["length"] * span + plan["first"]
        for pdf in frames:
            rank = pdf["rank"].to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy() * span + np.minimum(rank, span - 1), side="right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=plan["sequence"][at] + rank - plan["first"][at], offset=plan["offset"][at])

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
