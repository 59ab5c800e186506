"""Exact deduplication against a minimal perfect hash of historical digests.

The history is reduced to one row per distinct SHA-256 digest, with the largest doc_id (the winner's locator) and the
number of rows. Digests are uniform, so a prefix deals them evenly into shards of about ``SHARD_DIGESTS``; each shard
is a hash-and-displace minimal perfect hash (Belazzougui, Botelho, Dietzfelbinger: "Hash, displace, and compress")
built with numpy in one task and kept as one row: a displacement for each bucket and, slot by slot, the full digests,
locators and counts. Incoming rows are reduced by digest before the shuffle, so thousands of copies cost one lookup,
and meet their shard by a co-grouping on the shard number. A lookup compares all 32 bytes: members merge with the
slot's winner, the others form groups of their own. Last, each row gets its group's outcome by an equi-join on the
digest, which adaptive execution splits if one text holds much of the table.

Null text counts as empty, empty texts equal each other; texts aren't changed. Of equal rows that also repeat doc_id,
all count in group_size and all share that doc_id. A null doc_id is less than any other: a text that only such rows
hold has keep_id null, and they are its kept row, as equal rows are. Either side may be empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Distinct digests a shard holds on average: 2 MB of digests, and as much again while it is built.
SHARD_DIGESTS = 1 << 16
#: Stands for a null doc_id while a group's largest is sought: keep_id stays a long in pandas, exact above 2**53.
NO_ID = -(1 << 63)
#: Keys for each displacement bucket.
BUCKET_KEYS = 4

#: Set in the displacement of a bucket with one key; the other bits are then the key's slot.
DIRECT = np.uint32(1 << 31)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
INDEX_SCHEMA = "shard int, n int, displacements binary, digests binary, locators binary, counts binary"
FOUND_SCHEMA = "digest binary, keep_id long, group_size long"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(digests: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """Slot of each 32-byte digest (rows of uint64[4]) under its bucket's displacement."""
    tried = _mix((digests[:, 2] + displacement.astype(np.uint64) * _GOLDEN) ^ digests[:, 3]) % np.uint64(n)
    return np.where(displacement >= DIRECT, displacement & ~DIRECT, tried).astype(np.int64) % n


def _buckets(digests: np.ndarray, n: int) -> np.ndarray:
    return (_mix(digests[:, 1]) % np.uint64(max(1, n // BUCKET_KEYS))).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket, and the slot of each digest; slots are a permutation of 0..n-1.

    Buckets are placed by falling size. All unplaced buckets of a size try their next displacement at once; of those
    that hit only free slots, the first to claim each of its slots is placed. Buckets of one key take the slots that
    are left, which they name outright.
    """
    n = len(digests)
    bucket = _buckets(digests, n)
    m = max(1, n // BUCKET_KEYS)
    size = np.bincount(bucket, minlength=m)
    order = np.argsort(bucket, kind="stable")
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    displacement, taken, slot = np.zeros(m, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for k in range(int(size.max(initial=0)), 1, -1):
        left = np.flatnonzero(size == k)
        keys = order[first[left][:, None] + np.arange(k)] if len(left) else np.zeros((0, k), np.int64)
        attempt = 0
        while len(left):
            at = _slots(digests[keys.ravel()], np.full(keys.size, attempt, np.uint32), n).reshape(keys.shape)
            held = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (held[:, 1:] != held[:, :-1]).all(axis=1)
            rows = np.flatnonzero(fits)
            if len(rows):
                flat, owner = at[rows].ravel(), np.repeat(np.arange(len(rows)), k)
                claimed = np.full(n, len(rows), np.int64)
                np.minimum.at(claimed, flat, owner)
                won = rows[(claimed[at[rows]] == np.arange(len(rows))[:, None]).all(axis=1)]
                taken[at[won].ravel()] = True
                slot[keys[won].ravel()] = at[won].ravel()
                displacement[left[won]] = attempt
                stay = np.ones(len(left), bool)
                stay[won] = False
                left, keys = left[stay], keys[stay]
            attempt += 1
    single, free = np.flatnonzero(size == 1), np.flatnonzero(~taken)
    displacement[single] = free.astype(np.uint32) | DIRECT
    slot[order[first[single]]] = free
    return displacement, slot


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(pdf["digest"]), "<u8").reshape(-1, 4)
    displacement, slot = build_mph(digests)
    by_slot = np.argsort(slot)
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]],
        "n": [len(pdf)],
        "displacements": [displacement.tobytes()],
        "digests": [digests[by_slot].tobytes()],
        "locators": [pdf["keep_id"].to_numpy(np.int64)[by_slot].tobytes()],
        "counts": [pdf["group_size"].to_numpy(np.int64)[by_slot].tobytes()],
    })


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Outcome of each distinct digest of a shard, historical or new."""
    fresh = np.frombuffer(b"".join(new["digest"]), "<u8").reshape(-1, 4)
    keep, count = new["keep_id"].to_numpy(np.int64).copy(), new["group_size"].to_numpy(np.int64).copy()
    if not len(index):
        return pd.DataFrame({"digest": new["digest"], "keep_id": keep, "group_size": count})
    row = index.iloc[0]
    n = int(row["n"])
    held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
    locators, counts = np.frombuffer(row["locators"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
    member = np.zeros(len(fresh), bool)
    if len(fresh):
        slot = _slots(fresh, np.frombuffer(row["displacements"], np.uint32)[_buckets(fresh, n)], n)
        member = (held[slot] == fresh).all(axis=1)
        locators[slot[member]] = np.maximum(locators[slot[member]], keep[member])
        counts[slot[member]] += count[member]
    flat = held.tobytes()
    return pd.concat([
        pd.DataFrame({"digest": [flat[i * 32 : i * 32 + 32] for i in range(n)], "keep_id": locators, "group_size": counts}),
        pd.DataFrame({"digest": new["digest"].to_numpy()[~member], "keep_id": keep[~member], "group_size": count[~member]}),
    ])


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    found = rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count("*").alias("group_size"))
    return found.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def digest_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The historical index, a row for each shard, from rows (doc_id, digest)."""
    return _distinct(history, shards).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def mph_dedup(history: DataFrame, incoming: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``history`` and ``incoming`` (doc_id, text).

    Of equal texts the row with the largest doc_id stays.
    """
    rows = digest_rows(history).withColumn("new", F.lit(False)).unionByName(digest_rows(incoming).withColumn("new", F.lit(True)))
    rows = materialize(rows)  # digests only: texts are read and hashed once
    shards = max(1, math.ceil(rows.count() / shard_digests))
    index = build_index(rows.filter(~F.col("new")), shards)
    found = _distinct(rows.filter("new"), shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, FOUND_SCHEMA)
    own = F.coalesce("doc_id", F.lit(NO_ID))
    return (
        rows.join(found.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
        .select("doc_id", F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"), "group_size", (own == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def dedup_by_halves(docs: DataFrame) -> DataFrame:
    """mph_dedup() of one table: the lower half of its range of doc_ids counts as history, the rest as newly come."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    return mph_dedup(docs.filter(old), docs.filter(~old))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
