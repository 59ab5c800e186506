"""Cross-tokenizer alignment by a cogroup of postings.

Every text is encoded by two public tokenizers, A (byte-level BPE) and B (pieces), over the same bytes: a space, then
the text. Where tokens of both end at one byte, a *group* closes; two tokens are *linked* if their bytes overlap. What
is asked of each document depends on the whole corpus: how many documents hold an id pair linked, and which pairs are
their A id's most frequent.

1. Encode: both tokenizers treat the parts of a text that start with spaces after a visible character apart, so a worker
   encodes and aligns each part when it first meets it. A batch of documents gives one row a document, and for each A id
   one block: its postings (B id, document within the batch, multiplicity) as three arrays. Written once.
2. Postings meet by A id, sorted by Spark, and stream through a task group by group: counts of its pairs, their maximum
   and the contributions to each document come from the group alone.
3. An A id with over ``slice_postings`` postings is dealt out in slices of about that many, by block. Its pair counts
   are summed beforehand, combined within tasks before they are shuffled, and join each of its slices as a second stream.
4. Contributions go to their batch of documents, as arrays, and are summed there beside the documents' rows.

A task holds one batch, one slice, and the pairs of one A id (at most B's vocabulary). Broadcast are slice numbers of A
ids, at most A's vocabulary.

Ids of A come from the same vocabulary as ranks, by tiktoken, which splits words as the tokenizer does but for characters
that Unicode versions class differently: parts with such characters are encoded by the tokenizer itself.

Null and empty texts, and texts that B changes (such as those with U+2581), have no tokens: zeros and ''. Texts are
encoded whole at any length. Rows that repeat a doc_id, or have none, are documents of their own; repeated rows give
repeated results. No rows, no results. Other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packing import VOCABULARY, Encoder

PIECES = "piece_bpe_32k"
#: Postings of one group; an A id that has more is dealt out in slices.
SLICE_POSTINGS = 1 << 20
#: Characters of texts that become blocks together, and of parts that are encoded together.
BATCH_CHARS, RUN_CHARS = 2 << 20, 1 << 16
#: Parts, and their characters, over which a worker forgets all before its next batch.
MOST_PARTS, MOST_CHARS = 3 << 17, 1 << 23
#: Starts at spaces, ends before a space after a visible character: no token of either vocabulary crosses such an end.
PARTS = re.compile(r" +(?:\S+|[^\S ]+ *)*")

FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
BLOCKS = "a int, n long, first long, bs array<int>, docs array<int>, ms array<int>"


def _file(folder: str | None, name: str) -> str:
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Parts:
    """Aligned parts of texts by number, in flat arrays; ``same`` is false of parts that B changes."""

    def __init__(self, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, pairs: np.ndarray, texts: list[str]):
        self.same, self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs, self.texts = same, n_a, n_b, n_groups, n_links, pairs, texts

    def and_then(self, more: Parts) -> Parts:
        arrays = [np.concatenate([getattr(self, c), getattr(more, c)]) for c in ("same", "n_a", "n_b", "n_groups", "n_links", "pairs")]
        self.texts.extend(more.texts)
        return Parts(*arrays, self.texts)


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, folder: str | None = None):
        import sentencepiece
        import tiktoken

        self.model = Encoder(folder)
        self.model.tokenizer.encode_special_tokens = True
        with open(_file(folder, f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(VOCABULARY, pat_str=self.model.words.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=_file(folder, f"{PIECES}.model"))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.vocab_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        #: Ids as text with what follows them: within a group's half, at its end, at the end of a part.
        self.told = [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b] + [f"{i}\n" for i in b]
        self.forget()

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text).astype(np.int64)

    def ids_b(self, text: str) -> np.ndarray:
        """Encoding adds a space, but not to nothing."""
        ids = self.pieces.encode(text[1:], num_threads=1) if len(text) > 1 else [self.pieces.piece_to_id("▁")]
        return np.array(ids, np.int64)

    def _ids(self, parts: list[str], encode: Callable, alone: Callable, odd: np.ndarray, token_bytes: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids part by part, their number in each part, and whether they spell it. Parts go together unless ``odd``."""
        n, same, found, of = len(parts), np.ones(len(parts), bool), [], []
        together = np.flatnonzero(~odd)
        chars = np.array([len(parts[k]) for k in together], np.int64)
        single = np.flatnonzero(odd).tolist()
        for run in np.split(together, np.flatnonzero(np.diff(np.cumsum(chars) // RUN_CHARS)) + 1):
            if not len(run):
                continue
            own = [parts[k].encode() for k in run]
            whole = b"".join(own)
            ids = encode(whole.decode())
            stops, ends = np.cumsum([len(x) for x in own]), np.cumsum(sizes[ids])
            if b"".join([token_bytes[i] for i in ids.tolist()]) == whole and np.isin(stops, ends).all():
                found.append(ids)
                of.append(run[np.searchsorted(stops, ends)])
            else:
                single += run.tolist()
        for k in single:
            ids = alone(parts[k])
            same[k] = b"".join([token_bytes[i] for i in ids.tolist()]) == parts[k].encode()
            found.append(ids)
            of.append(np.full(len(ids), k))
        ids, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, of))
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=n), same

    def align(self, parts: list[str]) -> Parts:
        trailing = np.array([p[-1].isspace() for p in parts], bool)
        odd = self.model.unsettled
        unsettled = np.array([bool(odd.search(p)) for p in parts], bool) if odd.search("".join(parts)) else np.zeros(len(parts), bool)
        a, n_a, _ = self._ids(parts, self.ids_a, lambda p: np.array(self.model.whole(p), np.int64), trailing | unsettled, self.bytes_a, self.sizes_a)
        b, n_b, same = self._ids(parts, self.ids_b, self.ids_b, trailing | np.array(["▁" in p for p in parts], bool), self.bytes_b, self.sizes_b)
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        part = np.flatnonzero(same)
        stops = np.cumsum([len(parts[k].encode()) for k in part]).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        ends = np.union1d(ends_a, ends_b)  # each stretch between two ends is one link
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        group_ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        last_a, last_b, last = group_ends[group_a] == ends_a, group_ends[group_b] == ends_b, np.isin(ends_b, stops)
        told = np.empty(len(a) + len(b), np.int64)
        told[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + last_a * len(self.bytes_a)
        told[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(self.bytes_a) + b + (last_b.astype(np.int64) + last) * len(self.bytes_b)
        texts = [""] * len(parts)
        for k, text in zip(part.tolist(), "".join(map(self.told.__getitem__, told.tolist())).split("\n")):
            texts[k] = text
        count = lambda at: np.bincount(part[np.searchsorted(stops, at)], minlength=len(parts))
        return Parts(same, n_a, n_b, count(group_ends), count(ends), a[in_a] * len(self.bytes_b) + b[in_b], texts)

    def forget(self) -> None:
        self.numbers, self.chars, self.parts = {}, 0, self.align([])

    def numbered(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all parts of ``texts``, those that are new aligned."""
        if len(self.numbers) > MOST_PARTS or self.chars > MOST_CHARS:
            self.forget()
        new = [p for p in dict.fromkeys(chain.from_iterable(texts)) if p not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            self.parts = self.parts.and_then(self.align(new))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64)


@lru_cache(1)
def _aligner(folder: str | None) -> Aligner:
    return Aligner(folder)


def _lists(values: np.ndarray, ends: np.ndarray, before: int = 0) -> pa.Array:
    """Lists of ``values`` up to each of ``ends``, after ``before`` nulls."""
    offsets = pa.array([None] * before + [0, *ends.tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of runs of equal values."""
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return starts, np.append(starts[1:], len(values)).astype(np.int64)[: len(starts)]


def _encoded(batch: pa.RecordBatch, aligner: Aligner, with_groups: bool) -> pa.RecordBatch:
    """A row for each document, then a block for each A id."""
    docs = batch.num_rows
    told = [PARTS.findall(" " + text) if text else [] for text in batch.column("text").to_pylist()]
    used = aligner.numbered(told)
    parts, size = aligner.parts, max(1, len(aligner.numbers))
    stops = np.cumsum([len(t) for t in told])
    doc = np.repeat(np.arange(docs), [len(t) for t in told])
    fine = np.bincount(doc, ~parts.same[used], docs) == 0
    digests, groups = [], []
    for ok, start, stop in zip(fine, np.append(0, stops), stops):
        joined = ";".join(map(parts.texts.__getitem__, used[start:stop].tolist())) if ok else ""
        digests.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        groups.append(joined if with_groups else None)
    used, doc = used[fine[doc]], doc[fine[doc]]
    sums = [np.bincount(doc, x[used], docs).astype(np.int64) for x in (parts.n_a, parts.n_b, parts.n_groups, parts.n_links)]
    held, times = np.unique(doc * size + used, return_counts=True)
    of, part = np.divmod(held, size)
    n, ends = parts.n_links[part], np.cumsum(parts.n_links)
    at = np.repeat(ends[part] - np.cumsum(n), n) + np.arange(n.sum())
    keys = parts.pairs[at] * docs + np.repeat(of, n)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.repeat(times, n)[order]
    starts, _ = _runs(keys)
    ms = np.add.reduceat(times, starts) if len(starts) else times[:0]
    codes, doc = np.divmod(keys[starts], docs)
    a, b = np.divmod(codes, len(aligner.bytes_b))
    starts, stops = _runs(a)
    blocks = len(starts)
    small = lambda x: _lists(x.astype(np.int32), stops, docs)
    both = lambda values, kind: pa.array([*values, *[None] * blocks], kind)
    first = batch.column("row")[0].as_py()
    columns = {
        "row": pa.concat_arrays([batch.column("row"), pa.nulls(blocks, pa.int64())]),
        "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(blocks, pa.int64())]),
        **{c: both(v.tolist(), pa.int64()) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), sums)},
        "groups_sha256": both(digests, pa.string()),
        "groups": both(groups, pa.string()),
        "a": pa.array([*[None] * docs, *a[starts].tolist()], pa.int32()),
        "n": pa.array([*[None] * docs, *(stops - starts).tolist()], pa.int64()),
        "first": pa.array([first] * (docs + blocks), pa.int64()),
        "bs": small(b),
        "docs": small(doc),
        "ms": small(ms),
    }
    return pa.record_batch(columns)


def encoded(docs: DataFrame, folder: str | None = None, with_groups: bool = False) -> DataFrame:
    """Facts of documents (row not null) and blocks of postings (a not null), written to the shared folder.

    Both name their batch by the row of its first document; the postings' documents count from there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(folder)
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(chars // BATCH_CHARS)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if stop > start:
                    yield _encoded(batch.slice(start, stop - start), aligner, with_groups)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(numbered.mapInArrow(encode, f"row long, {FACTS}, {BLOCKS}"))


def _flat(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair of ids within a batch of blocks."""
    for batch in batches:
        a = np.repeat(batch.column("a").to_numpy(zero_copy_only=False).astype(np.int64), _sizes(batch, "bs"))
        codes, n = np.unique(a << 32 | _flat(batch, "bs"), return_counts=True)
        yield pa.record_batch({"a": pa.array(codes >> 32, pa.int32()), "b": pa.array(codes & (1 << 32) - 1, pa.int32()), "documents": pa.array(n, pa.int64())})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, documents): in how many documents the two ids are linked. Combined within tasks, then shuffled."""
    return blocks.filter("a IS NOT NULL").select("a", "bs").mapInArrow(_counted, "a int, b int, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))


def _contributions(groups: pa.Table) -> pa.RecordBatch:
    """What whole groups (a, slice) give to documents: links with their A id's highest count, and counts of links."""
    a, part = (groups.column(c).to_numpy().astype(np.int64) for c in ("a", "slice"))
    group = np.cumsum((np.diff(a, prepend=a[0]) != 0) | (np.diff(part, prepend=part[0]) != 0))
    is_counts = groups.column("docs").is_null().to_numpy(zero_copy_only=False)
    postings, known = groups.filter(pa.array(~is_counts)), groups.filter(pa.array(is_counts))
    sizes = _sizes(postings, "bs")
    of = np.repeat(group[~is_counts], sizes)
    key = of << 32 | _flat(postings, "bs")
    keys, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    if known.num_rows:
        summed = np.repeat(group[is_counts], _sizes(known, "bs")) << 32 | _flat(known, "bs")
        order = np.argsort(summed)
        summed, totals = summed[order], _flat(known, "counts")[order]
        place = np.minimum(np.searchsorted(summed, keys), len(summed) - 1)
        counts = np.where(summed[place] == keys, totals[place], counts)
    most = np.zeros(int(group[-1]) + 1, np.int64)
    np.maximum.at(most, keys >> 32, counts)
    if known.num_rows:
        np.maximum.at(most, summed >> 32, totals)
    firsts, batch = np.unique(postings.column("first").to_numpy(), return_inverse=True)
    m, count = _flat(postings, "ms").astype(np.int64), counts[at]
    docs, where = np.unique(np.repeat(batch, sizes) << 32 | _flat(postings, "docs"), return_inverse=True)
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(best, where, m * (count == most[of]))
    np.add.at(total, where, m * count)
    starts, stops = _runs(docs >> 32)
    return pa.record_batch({"first": pa.array(firsts[docs[starts] >> 32], pa.int64()), "docs": _lists((docs & (1 << 32) - 1).astype(np.int32), stops), "best": _lists(best, stops), "total": _lists(total, stops)})


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order; the last one of a batch may go on in the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        a, part = (table.column(c).to_numpy() for c in ("a", "slice"))
        other = np.flatnonzero((a != a[-1:]) | (part != part[-1:]))
        start = int(other[-1]) + 1 if len(other) else 0
        if start:
            yield _contributions(table.slice(0, start).combine_chunks())
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield _contributions(held.combine_chunks())


def contributions(blocks: DataFrame, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """(first, docs, best, total) from written blocks: sums over A ids of a task, for documents of the batch ``first``."""
    blocks = blocks.filter("a IS NOT NULL").select(*[c.split()[0] for c in BLOCKS.split(", ")])
    # At most A's vocabulary.
    hot = blocks.groupBy("a").agg(F.ceil(F.sum("n") / slice_postings).alias("slices")).filter("slices > 1").collect()
    postings = blocks.select("a", F.lit(0).alias("slice"), "first", "bs", "docs", "ms", F.lit(None).cast("array<bigint>").alias("counts"))
    if hot:
        slices = F.broadcast(blocks.sparkSession.createDataFrame([(r.a, r.slices) for r in hot], "hot_a int, slices long"))
        dealt = blocks.join(slices, F.col("a") == F.col("hot_a"), "left")
        number = F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("first"), F.col("slices"))).cast("int")
        postings = dealt.select("a", number.alias("slice"), "first", "bs", "docs", "ms", F.lit(None).cast("array<bigint>").alias("counts"))
        # One row for each of an A id's pairs: at most B's vocabulary.
        pairs = F.sort_array(F.collect_list(F.struct("b", "documents")))
        counts = pair_counts(dealt.filter("slices IS NOT NULL")).groupBy("a").agg(pairs.alias("pairs")).join(slices, F.col("a") == F.col("hot_a"))
        each = counts.select("a", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice"), "pairs")
        none = F.lit(None)
        of_slice = each.select("a", "slice", none.cast("long").alias("first"), F.col("pairs.b").alias("bs"), none.cast("array<int>").alias("docs"), none.cast("array<int>").alias("ms"), F.col("pairs.documents").alias("counts"))
        postings = postings.unionByName(of_slice)
    streams = postings.repartition("a", "slice").sortWithinPartitions("a", "slice")
    return streams.mapInArrow(_streamed, "first long, docs array<int>, best array<long>, total array<long>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the sums of their batch's contributions, which come before them."""
    now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        first, given = batch.column("first").to_numpy(), batch.column("row").is_null().to_numpy(zero_copy_only=False)
        for start, stop in zip(*_runs(first)):
            if first[start] != now:
                now, best, total = first[start], np.zeros(0, np.int64), np.zeros(0, np.int64)
            run = batch.slice(start, stop - start)
            n = int(given[start:stop].sum())
            if n:
                docs = _flat(run.slice(0, n), "docs")
                more = max(0, int(docs.max(initial=-1)) + 1 - len(best))
                best, total = np.pad(best, (0, more)), np.pad(total, (0, more))
                np.add.at(best, docs, _flat(run.slice(0, n), "best"))
                np.add.at(total, docs, _flat(run.slice(0, n), "total"))
            rows = run.slice(n)
            if rows.num_rows:
                at = rows.column("row").to_numpy() - now
                sums = (pa.array(np.pad(x, (0, max(0, int(at.max()) + 1 - len(x))))[at]) for x in (best, total))
                kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
                yield pa.record_batch([*kept.columns, *sums], names=[*kept.schema.names, "n_best", "count_sum"])


def align_tokens(docs: DataFrame, folder: str | None = None, slice_postings: int = SLICE_POSTINGS, with_groups: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``with_groups`` adds the groups themselves, ``a1,a2|b1;a3|b2,b3``; ``folder`` holds the vocabulary files.
    """
    table = encoded(docs, folder, with_groups)
    facts = table.filter("row IS NOT NULL").select("row", "first", *[c.split()[0] for c in FACTS.split(", ")])
    both = facts.unionByName(contributions(table, slice_postings), allowMissingColumns=True)
    found = both.repartition("first").sortWithinPartitions("first", F.col("row").asc_nulls_first()).mapInArrow(_summed, f"{FACTS}, n_best long, count_sum long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
