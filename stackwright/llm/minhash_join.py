"""Near-duplicate components by an inverted join over MinHash signature coordinates.

1. Documents with the same shingle set form a class, numbered when classes are written; the rest works on classes. The
   numbers only tell classes apart: no result hangs on them.
2. A signature has ``COORDINATES`` coordinates of two minima each, so that unlike texts rarely agree on one. A class is
   posted under (coordinate, value) pairs. Classes that agree on at least ``MATCHES`` of the minima differ in
   ``MINIMA - MATCHES`` coordinates at most, so they share one of any ``PREFIX`` (one more than that) of them, and only that
   prefix is posted, rarest pairs first; the order comes from a fixed-size count sketch of all pairs (256k counters,
   whatever the corpus' size).
3. Collisions. Each posting is first merged with its leader only (the class whose pairs are most frequent), then, where
   it still spans several clusters, across clusters in blocks, skipping pairs already joined. Collisions are counted on the
   signatures; pairs with ``MATCHES`` minima or more are joined to clusters. So a posting of n near copies costs n pairs, not n * n.
4. Links are confirmed on full shingle sets within clusters, in blocks of ``BLOCK`` classes: first every class against
   the cluster's leader, then the classes not linked to it, in blocks of their own (turns), against all blocks. A task
   holds two blocks of sets at once, however large the cluster is. Only links that join something within the two blocks
   are kept; no link between different components is lost.

A pair with similarity 0.8 agrees on fewer than 36 of 64 minima with probability about 2e-6.

Defined results: text without words (or null, or empty) has an empty set, is its own component and is kept. Very long texts
are taken whole, in blocks of fewer classes. Rows that share a doc_id are judged each by its own text; both are kept where
that doc_id is the least of their component. A null doc_id is never a component's least while another row has one; where
none has, component_id is null and the rows are kept. Of equal sets the least doc_id stays; rows repeated as a whole come
out as often. No rows in, no rows out; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .graph import connected_components

MINIMA = 64
COORDINATES = MINIMA // 2
MATCHES = 36
PREFIX = MINIMA - MATCHES + 1
THRESHOLD = (80, 100)
SHINGLE_WORDS = 2
#: Classes in a block of confirmed comparisons; texts much longer than usual make blocks of fewer classes.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Rows of a posting's block, and comparisons of signatures made at once.
ROWS = 1 << 13
PAIRS = 1 << 16
SKETCH_SLICES, SKETCH_SLICE = 16, 1 << 14

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(range(65, 91))
_LOWER_CASE = bytes.maketrans(_UPPER, _UPPER.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = _mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_OFFSETS = _mix(np.arange(101, MINIMA + 101, dtype=np.uint64) * _GOLDEN)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    found = _WORDS.findall(text.translate(_LOWER_CASE))
    if not found:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(found)
    if len(found) < words:
        return _mix(hashes.sum(keepdims=True) * _GOLDEN + np.uint64(len(found)))
    total = np.zeros(len(hashes) - words + 1, np.uint64)
    for k in range(words):
        total = _mix(total * _GOLDEN + hashes[k : len(hashes) - words + 1 + k])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, ~np.uint64(0))
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        out = np.minimum(out, (part[None, :] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]).min(axis=1))
    return out


def _pairs(signatures: np.ndarray) -> np.ndarray:
    """Hash of each (coordinate, value) pair; ``signatures`` has a row of minima for each class."""
    mixed = _mix(signatures ^ _OFFSETS)
    return _mix(mixed[:, ::2] * _GOLDEN + mixed[:, 1::2])


def set_key(shingles: np.ndarray) -> list[int]:
    """128-bit hash of a shingle set, as two integers."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_high and set_low (128-bit hash of the set, null if empty), signature (binary)."""

    def sets(batches):
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.binary()):
                found = shingle_set(text.as_py(), words)
                rows.append((len(found), *set_key(found), signature(found).tobytes()) if len(found) else (0, None, None, None))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                ["doc_id", "text_hash", "n_shingles", "set_high", "set_low", "signature"],
            )

    return _texts(docs).mapInArrow(sets, "doc_id long, text_hash long, n_shingles long, set_high long, set_low long, signature binary")


def pair_sketch(classes: DataFrame) -> np.ndarray:
    """Counts of (coordinate, value) pairs by hash, in SKETCH_SLICES * SKETCH_SLICE counters."""

    def count(frames):
        total = np.zeros(SKETCH_SLICES * SKETCH_SLICE, np.int64)
        for pdf in frames:
            if len(pdf):
                pairs = _pairs(np.frombuffer(b"".join(pdf["signature"]), np.uint64).reshape(-1, MINIMA)).ravel()
                total += np.bincount((pairs % np.uint64(len(total))).astype(np.int64), minlength=len(total))
        for k in range(SKETCH_SLICES):
            part = total[k * SKETCH_SLICE : (k + 1) * SKETCH_SLICE]
            if part.any():
                yield pd.DataFrame({"slice": [k], "counts": [part.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0).tobytes()]})

    # Added up in 64 parts first, so that a slice stays small with very many partitions.
    parts = classes.select("signature").mapInPandas(count, "slice int, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((SKETCH_SLICES, SKETCH_SLICE), np.int64)
    for row in some.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # 2 MB at most
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def postings(classes: DataFrame, sketch) -> DataFrame:
    """pair, class_id, score: each class under its PREFIX rarest pairs. score: how frequent its pairs are altogether."""

    def post(batches):
        held = sketch.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch["class_id"].to_numpy()
            pairs = _pairs(np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint64).reshape(n, MINIMA))
            counts = held[(pairs % np.uint64(len(held))).astype(np.int64)]
            chosen = np.take_along_axis(pairs, np.lexsort((pairs, counts), axis=1)[:, :PREFIX], 1)
            score = np.minimum(counts, 1 << 40).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.ravel().view(np.int64)), pa.array(np.repeat(ids, PREFIX)), pa.array(np.repeat(score, PREFIX))],
                ["pair", "class_id", "score"],
            )

    return classes.select("class_id", "signature").mapInArrow(post, "pair long, class_id long, score long")


def _colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those whose signatures agree on MATCHES minima or more."""

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch["sa"].to_pylist()), np.uint64).reshape(-1, MINIMA)
            y = np.frombuffer(b"".join(batch["sb"].to_pylist()), np.uint64).reshape(-1, MINIMA)
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= MATCHES))

    left = classes.select(F.col("class_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("class_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def agreeing(group: np.ndarray, probe: np.ndarray, class_id: np.ndarray, cluster: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """(class, class) of each probe and one agreeing member of each other cluster that it meets in its group.

    Rows are sorted by ``group``; ``probe`` marks the probing rows, the others are members.
    """
    out = [np.zeros((0, 2), np.int64)]
    members, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    low, high = np.searchsorted(group[members], group[probes], "left"), np.searchsorted(group[members], group[probes], "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(probes):
        # As many probes as make about PAIRS comparisons.
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = high[start:stop] - low[start:stop]
        x = np.repeat(probes[start:stop], n)
        y = members[np.arange(len(x)) + np.repeat(low[start:stop] - (np.cumsum(n) - n), n)]
        other = cluster[x] != cluster[y]
        x, y = x[other], y[other]
        same = (minima[x] == minima[y]).sum(axis=1) >= MATCHES
        x, y = x[same], y[same]
        _, first = np.unique(np.stack([class_id[x], cluster[y]]), axis=1, return_index=True)
        out.append(np.stack([class_id[x[first]], class_id[y[first]]], axis=1))
        start = stop
    return np.concatenate(out)


def _merge_across(open_postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of classes in one posting but different clusters that agree on MATCHES minima or more.

    A posting is dealt out in blocks of members by blocks of probes, the classes outside its largest cluster ``most``. A
    probe yields one link for each cluster, so rows grow with the postings.
    """

    def merge(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(batch: pa.RecordBatch) -> pa.RecordBatch:
            minima = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint64).reshape(-1, MINIMA)
            key = np.stack([batch[k].to_numpy().astype(np.int64) for k in ("pair", "part", "turn")])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            found = agreeing(group, batch["probe"].to_numpy(zero_copy_only=False), batch["class_id"].to_numpy(), batch["cluster"].to_numpy(), minima)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = [whole[k][len(whole) - 1] for k in ("pair", "part", "turn")]
            open_rows = np.ones(len(whole), bool)
            for k, value in zip(("pair", "part", "turn"), last):
                open_rows &= whole[k].to_numpy() == value.as_py()
            done = len(whole) - int(open_rows.sum())
            if done:
                yield links(whole.slice(0, done))
            held, rows = [whole.slice(done)], len(whole) - done
        if rows:
            yield links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    signed = open_postings.select("pair", "class_id", "cluster", "most", F.ceil(F.col("members") / ROWS).cast("int").alias("blocks"))
    signed = signed.join(classes.select("class_id", "signature"), "class_id")
    own, every = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    members = signed.select("pair", own.alias("part"), F.explode(every).alias("turn"), F.lit(False).alias("probe"), "class_id", "cluster", "signature")
    probes = signed.filter("cluster <> most").select("pair", F.explode(every).alias("part"), own.alias("turn"), F.lit(True).alias("probe"), "class_id", "cluster", "signature")
    dealt = members.unionByName(probes).repartition("pair", "part", "turn").sortWithinPartitions("pair", "part", "turn")
    return dealt.mapInArrow(merge, "a long, b long").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class_id and the full shingle set (binary) of the classes in ``wanted``, each from a row that it names.

    A row is named by doc_id (null equals null) and hash of its text; a text with another set than the class is passed over.
    """

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch["text"].cast(pa.binary())]
            same = [set_key(x) == [high, low] for x, high, low in zip(found, batch["set_high"].to_pylist(), batch["set_low"].to_pylist())]
            out = pa.RecordBatch.from_arrays([batch["class_id"], pa.array([x.tobytes() for x in found], pa.binary())], ["class_id", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

    named = wanted.select("class_id", "set_high", "set_low", F.col("row.doc_id").alias("_doc_id"), F.col("row.text_hash").alias("_hash"))
    chosen = _texts(docs).join(named, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_hash")))
    return chosen.select("class_id", "set_high", "set_low", "text").mapInArrow(sets, "class_id long, shingles binary").dropDuplicates(["class_id"])


def confirmed_links(members: list[np.ndarray], probes: list[np.ndarray]) -> list[np.ndarray]:
    """For each probe, the members whose sets link with it: exact intersections by an inverted index of the members."""
    sizes = np.array([len(m) for m in members], np.int64)
    owner = np.repeat(np.arange(len(members)), sizes)
    values = np.concatenate(members)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for probe in probes:
        low, high = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        n = high - low
        hit = n > 0
        low, n = low[hit], n[hit]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        both = np.bincount(owner[at], minlength=len(members))
        out.append(np.flatnonzero(THRESHOLD[1] * both >= THRESHOLD[0] * (len(probe) + sizes - both)))
    return out


def _confirm(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Links (a, b) between ``probes`` and ``members``, both (cluster, block, turn, class_id, group, shingles).

    Those of the same (cluster, block, turn) are compared: a block of members by a block of probes. Of their links, those
    are kept that join something not yet joined; classes with the same group are.
    """

    def run(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ids, groups = held["class_id"].to_numpy(), held["group"].to_numpy()
        found = confirmed_links([np.frombuffer(x, np.uint64) for x in held["shingles"]], [np.frombuffer(x, np.uint64) for x in asked["probe_shingles"]])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for probe, group, at in zip(asked["probe_id"], asked["probe_group"], found):
            for k in at:
                x, y = root(int(group)), root(int(groups[k]))
                if x != y:
                    parent[x] = y
                    out.append((int(probe), int(ids[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    members = members.select("cluster", "block", "turn", "class_id", "group", "shingles")
    probes = probes.select(F.col("cluster").alias("_cluster"), F.col("block").alias("_block"), F.col("turn").alias("_turn"), F.col("class_id").alias("probe_id"), F.col("group").alias("probe_group"), F.col("shingles").alias("probe_shingles"))
    return members.groupBy("cluster", "block", "turn").cogroup(probes.groupBy("_cluster", "_block", "_turn")).applyInPandas(run, "a long, b long")


def _blocks(members, shingles):
    """Number of blocks for so many classes with so many shingles altogether."""
    return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sets = materialize(document_sets(docs, words))
    classes = sets.filter("n_shingles > 0").groupBy("set_high", "set_low", "n_shingles")
    classes = classes.agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("signature").alias("signature"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()))
    sketch = spark.sparkContext.broadcast(pair_sketch(classes))
    posted = postings(classes, sketch)
    heads = posted.groupBy(F.col("pair").alias("_pair")).agg(F.count("*").alias("n"), F.max(F.struct("score", "class_id")).alias("head")).filter("n > 1")
    shared = materialize(posted.join(heads, F.col("pair") == F.col("_pair")).select("pair", "class_id", "score", "n", F.col("head.class_id").alias("head")))
    stars = shared.filter("class_id <> head").select(F.least("class_id", "head").alias("a"), F.greatest("class_id", "head").alias("b")).distinct()
    joined = materialize(_colliding(stars, classes))
    clusters = materialize(connected_components(joined))

    # Postings that still span several clusters are merged across them, the largest cluster's members not with each other.
    placed = shared.join(clusters.withColumnRenamed("vertex", "class_id"), "class_id", "left").withColumn("cluster", F.coalesce("component", "class_id")).drop("component")
    spans = placed.groupBy("pair", "cluster").agg(F.count("*").alias("m"))
    mixed = spans.groupBy("pair").agg(F.count("*").alias("parts"), F.max(F.struct("m", "cluster")).alias("most"), F.sum("m").alias("members")).filter("parts > 1")
    open_postings = placed.join(mixed.select("pair", F.col("most.cluster").alias("most"), "members"), "pair")
    more = materialize(_merge_across(open_postings, classes))
    clusters = materialize(connected_components(joined.unionByName(more)))

    # Confirmation. A cluster's leader is the class whose pairs are most frequent: the text its copies derive from.
    scores = shared.groupBy(F.col("class_id").alias("vertex")).agg(F.max("score").alias("score"))
    sized = clusters.join(scores, "vertex").join(classes.select(F.col("class_id").alias("vertex"), "n_shingles"), "vertex")
    leaders = sized.groupBy("component").agg(F.max(F.struct("score", "vertex")).alias("head"), F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    leaders = leaders.select(F.col("component").alias("cluster"), F.col("head.vertex").alias("leader"), _blocks(F.col("members"), F.col("shingles")).alias("blocks"))
    full = _sets_of(docs, classes.join(clusters.select(F.col("vertex").alias("class_id")), "class_id"), words)
    members = clusters.select(F.col("vertex").alias("class_id"), F.col("component").alias("cluster")).join(leaders, "cluster").join(full, "class_id")
    members = members.withColumn("n_shingles", (F.octet_length("shingles") / 8).cast("long"))
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")))

    def asked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    own = members.withColumns({"group": F.col("class_id"), "turn": F.lit(0)})
    first = materialize(_confirm(own, asked(own.filter("class_id = leader"))))
    # Turns are blocks of the unlinked classes of a cluster; ids only, so that sets are dealt out once.
    to_leader = first.select(F.col("a").alias("_leader"), F.col("b").alias("_member"))
    placed = members.select("class_id", "cluster", "leader", "n_shingles").join(to_leader, F.col("class_id") == F.col("_member"), "left")
    placed = placed.withColumn("unlinked", F.expr("_leader IS NULL AND class_id <> leader"))
    turns = placed.filter("unlinked").groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("turns"))
    placed = placed.join(turns, "cluster").select("class_id", "unlinked", "turns", F.when(F.col("unlinked"), F.col("class_id")).otherwise(F.col("leader")).alias("group"))
    grouped = members.join(materialize(placed), "class_id")
    probes = grouped.filter("unlinked").withColumn("turn", F.pmod(F.xxhash64("class_id"), F.col("turns")).cast("int"))
    rest = _confirm(grouped.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))), asked(probes))
    components = connected_components(materialize(first.unionByName(rest)))

    placed = components.join(classes.select(F.col("class_id").alias("vertex"), "least"), "vertex")
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(heads, "component").select(F.col("vertex").alias("class_id"), "component_id")
    placed = classes.select("set_high", "set_low", "class_id", "least").join(placed, "class_id", "left")
    found = sets.select("doc_id", "n_shingles", "set_high", "set_low").join(placed, ["set_high", "set_low"], "left")
    component = F.coalesce("component_id", "least", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
