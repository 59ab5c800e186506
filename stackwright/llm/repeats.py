"""Repeats of fixed length across documents: what the suffix-array and the seed-and-extend operator share.

A string of ``length`` units (bytes or words) is owned by its anchor, the least hash of the grams in it, so all
occurrences of one string have the same anchor, wherever they stand. A *run* is a maximal row of starts with the same
anchor, with the text that its strings cover (``starts + length - 1`` units). The steps:

1. Scan: every document gives its runs as (anchor, key, place), key being 64 bits of a hash of the run's text. Of equal
   runs of one batch the earliest is a row for step 2, the others are its copies and stay out of it: so a passage that a
   third of all documents hold costs step 2 one row for each batch.
2. Group: rows meet by anchor and are streamed in the order (anchor, text, place). The earliest run of each text is a
   *head*, equal ones are its copies. A head without copies goes no further if it is the only text under its anchor
   and can't repeat itself. Nothing is held but the last head, however hot an anchor is.
3. Heads fetch their texts and meet again by anchor: the caller's method compares the texts under an anchor, or under
   several at once up to a fixed size, and says which starts of a head also stand earlier. Of a head with copies it passes
   on a digest of the text (128 bits of SHA-256), which its copies get by an equi-join that adaptive execution can split.
   Copies themselves don't go through the method: beside their document's text they are checked against that digest, and
   count only if it is theirs. So a key (64 bits of a fast hash) proposes a copy, and the text that was compared decides.
4. Heads of anchors with over ``MOST_HEADS`` different texts take steps 2 and 3 again under anchors from longer grams:
   twice as long, and last as long as the strings themselves, where all texts under an anchor are the same string.

Documents are shuffled twice, for step 3 and for the result; the texts of heads go along to deeper anchors. Places are (doc_id, tag, start): the tag, 64 bits
of a hash of the text, tells rows apart that share a doc_id or have none, and deals them out. Rows equal in both are the
same document. Of texts whose keys collide under one anchor only the earliest is compared: the others aren't removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: A null doc_id sorts first.
NO_ID = -(2**63)
#: Runs are cut into pieces of so many starts at most (only periodic texts have longer ones).
MOST_STARTS = 128
#: Different texts under an anchor that one task compares.
MOST_HEADS = 2048
#: Anchors with more texts than that (8 bytes each) that are broadcast; more of them are joined by shuffling.
MOST_BROADCAST = 1 << 20
#: Units of text that are compared at once, under several anchors: with MOST_HEADS texts more at most.
BLOCK_UNITS = 1 << 19

DIGEST_BYTES = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)

PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("starts", "<i4")])
RUN_COLUMNS = ["kind", "anchor", "key", "copies", "alone", "doc", "tag", "start", "starts", "units"]
RUN_SCHEMA = "kind int, anchor long, key long, copies boolean, alone boolean, doc long, tag long, start int, starts int, units binary"
TEXT_SCHEMA = "anchor long, key long, copies boolean, doc long, tag long, start int, starts int, units binary"
JUDGED_SCHEMA = "is_text boolean, anchor long, key long, doc long, tag long, start int, starts int, digest binary"
COPY, RUN, HEAD, HOT = 0, 1, 2, 3


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes (uint64) of all grams of ``size`` units, put together from grams of powers of two."""
    factor, out, width = _ODD, units, 1
    while 2 * width <= size:
        if len(out) <= width:
            return np.zeros(0, np.uint64)
        out = out[:-width] * factor + out[width:]
        out ^= out >> np.uint64(29)
        factor = np.uint64(int(factor) * int(_GOLDEN) % 2**64 | 1)
        width *= 2
    if width < size:
        if len(out) <= size - width:
            return np.zeros(0, np.uint64)
        out = out[: width - size] * factor + out[size - width :]
        out ^= out >> np.uint64(29)
    return out


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width`` values."""
    if len(x) < width:
        return np.zeros(0, x.dtype)
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def runs_of(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, number of starts) of each run."""
    anchors = window_minima(gram_hashes(units, gram), length - gram + 1)
    if not len(anchors):
        return anchors, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    starts = np.diff(np.append(first, len(anchors)))
    if starts.max() > MOST_STARTS:
        pieces = -(-starts // MOST_STARTS)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(starts, pieces)
        first = np.repeat(first, pieces) + inner * MOST_STARTS
        starts = np.minimum(MOST_STARTS, whole - inner * MOST_STARTS)
    return anchors[first], first, starts


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, a number for null), tag and text (empty for null)."""
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], RUN_COLUMNS)


def _same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["tag"] == b["tag"]) & (a["start"] == b["start"])


class Repeats:
    """Finds repeated strings of ``length`` units.

    raw_of(text) gives a text's units as bytes, ``unit_bytes`` each, and units_of(raw) their hashes (uint64).
    judge(texts, starts, places) flags the starts whose string also stands at an earlier place. ``key_of`` gives 64 bits
    for a text, by which copies are proposed.
    """

    def __init__(self, length: int, gram: int, unit_bytes: int, raw_of: Callable, units_of: Callable, judge: Callable, key_of: Callable | None = None):
        self.length, self.unit_bytes = length, unit_bytes
        self.grams = [gram, 2 * gram, length]
        self.raw_of, self.units_of, self.judge, self.key_of = raw_of, units_of, judge, key_of

    # Step 1

    def runs(self, texts: Iterable[tuple], gram: int, carry: bool) -> pa.RecordBatch | None:
        """RUN and COPY rows of texts (doc, tag, number of the first unit, raw, has copies); RUN rows with text if ``carry``."""
        import xxhash

        key_of, unit, length = self.key_of or xxhash.xxh3_64_intdigest, self.unit_bytes, self.length
        held: list[tuple] = []
        carried: list[bytes] = []
        for doc, tag, base, raw, copied in texts:
            if len(raw) < length * unit:
                continue
            anchors, first, starts = runs_of(self.units_of(raw), length, gram)
            low, high = first * unit, (first + starts + length - 1) * unit
            # The units that all strings of a run share: found earlier in it, the run may repeat itself.
            core_low, core_high = (first + starts - 1) * unit, (first + length) * unit
            keys, alone = [], []
            for a, b, c, d in zip(low.tolist(), high.tolist(), core_low.tolist(), core_high.tolist()):
                keys.append(key_of(raw[a:b]))
                alone.append(c < d and raw.find(raw[c:d], a, b) == c)
            if carry:
                carried += [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]
            place = np.empty(len(anchors), PLACE)
            place["doc"], place["tag"], place["start"], place["starts"] = doc, tag, first + base, starts
            held.append((anchors.view(np.int64), np.array(keys, np.uint64).view(np.int64), np.array(alone), place, np.full(len(anchors), copied)))
        if not held:
            return None
        anchors, keys, alone, place, copied = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place["start"], place["tag"], place["doc"], keys, anchors))
        anchors, keys, alone, place, copied = anchors[order], keys[order], alone[order], place[order], copied[order]
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (keys[1:] != keys[:-1])])
        head = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        # A row that is the head itself again (from a repeated row of the table) isn't its copy.
        copy = ~new & ~_same_place(place, place[head][of])
        copies = (np.bincount(of, weights=copy | copied, minlength=len(head)) > 0)[of]
        stay = new | copy
        kind = np.where(copy, COPY, RUN).astype(np.int32)
        columns = [kind, anchors, keys, copies, alone, place["doc"], place["tag"], place["start"], place["starts"]]
        at = order[stay]
        units = pa.array([carried[i] for i in at], pa.binary()) if carry else pa.nulls(len(at), pa.binary())
        return _rows([*(np.ascontiguousarray(c[stay]) for c in columns), units])

    def scan(self, keyed_docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"].cast(pa.binary()))
                found = self.runs(((d, t, 0, self.raw_of(v.as_py()), False) for d, t, v in texts), self.grams[0], False)
                if found is not None:
                    yield found

        return keyed_docs.select("doc", "tag", "text").mapInArrow(run, RUN_SCHEMA)

    def scan_again(self, texts: DataFrame, gram: int) -> DataFrame:
        """scan() of heads with their texts, which stay with the runs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch[c].to_pylist() for c in ("doc", "tag", "start", "units", "copies")))
                found = self.runs(rows, gram, True)
                if found is not None:
                    yield found

        return texts.mapInArrow(run, RUN_SCHEMA)

    # Step 2

    def group(self, runs: DataFrame) -> DataFrame:
        """Rows HEAD (a text to compare, with whether it has copies), COPY and HOT (an anchor with many heads)."""

        def stream(batches):
            last = None  # the last head: its row, whether it has copies, is first under its anchor, and its number there

            def head_rows(kind, anchor, key, copies, place, units) -> pa.RecordBatch:
                n = len(anchor)
                return _rows([np.full(n, kind, np.int32), anchor, key, copies, np.zeros(n, bool), *(np.ascontiguousarray(place[k]) for k in PLACE.names), units])

            def last_row() -> pa.RecordBatch:
                return head_rows(HEAD, *(np.array([last[k]]) for k in ("anchor", "key", "copies")), last["place"], last["units"])

            for batch in batches:
                kinds = batch["kind"].to_numpy()
                if (kinds == COPY).any():
                    yield batch.filter(pa.array(kinds == COPY))
                    batch = batch.filter(pa.array(kinds != COPY))
                if not batch.num_rows:
                    continue
                place = np.empty(batch.num_rows, PLACE)
                for k in PLACE.names:
                    place[k] = batch[k].to_numpy()
                anchor, key = batch["anchor"].to_numpy(), batch["key"].to_numpy()
                copies, alone = (batch[k].to_numpy(zero_copy_only=False) for k in ("copies", "alone"))
                before = (last["anchor"], last["key"]) if last else (None, None)
                new_anchor = np.concatenate([[anchor[0] != before[0]], anchor[1:] != anchor[:-1]])
                new = new_anchor | np.concatenate([[key[0] != before[1]], key[1:] != key[:-1]])
                heads, of = np.flatnonzero(new), np.cumsum(new)  # 0: rows of the last batch's head
                head_place = np.concatenate([last["place"] if last else place[:1], place[heads]])
                copy = ~new & ~_same_place(place, head_place[of])
                if copy.any():
                    yield head_rows(COPY, anchor[copy], key[copy], copies[copy], place[copy], pa.nulls(int(copy.sum()), pa.binary()))
                has = np.bincount(of, weights=copy | copies, minlength=len(heads) + 1) > 0
                if last:
                    last["copies"] |= bool(has[0])
                if not len(heads):
                    continue
                first = new_anchor[heads]
                before_first = np.cumsum(first)
                number = np.arange(len(heads)) - np.concatenate([[-(last["number"] + 1) if last else 0], np.flatnonzero(first)])[before_first]
                if last and (last["copies"] or not last["first"] or not last["alone"] or not first[0]):
                    yield last_row()
                goes = has[1:] | ~first | ~alone[heads] | np.concatenate([~first[1:], [False]])
                goes[-1] = False
                for kind, chosen in ((HEAD, goes), (HOT, number == MOST_HEADS)):
                    if chosen.any():
                        at = heads[chosen]
                        yield head_rows(kind, anchor[at], key[at], has[1:][chosen], place[at], batch["units"].take(pa.array(at)))
                z = heads[-1]
                last = {"anchor": anchor[z], "key": key[z], "place": place[z : z + 1].copy(), "units": batch["units"].slice(z, 1), "copies": bool(has[-1]), "alone": bool(alone[z]), "first": bool(first[-1]), "number": int(number[-1])}
            if last and (last["copies"] or not last["first"] or not last["alone"]):
                yield last_row()

        # Copies go by their documents: they aren't grouped.
        dealt = runs.repartition(F.when(F.col("kind") == RUN, F.col("anchor")).otherwise(F.xxhash64("doc", "tag", "start")))
        return dealt.sortWithinPartitions("kind", "anchor", "key", "doc", "tag", "start").mapInArrow(stream, RUN_SCHEMA)

    # Step 3

    def texts(self, heads: DataFrame, dealt_docs: DataFrame) -> DataFrame:
        """Each head with its text (bytes of its units)."""
        length, unit, raw_of = self.length, self.unit_bytes, self.raw_of

        def fetch(batches):
            for batch in batches:
                columns: list[list] = [[] for _ in range(8)]
                for doc, tag, value, runs in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"].cast(pa.binary()), batch["runs"].to_pylist()):
                    raw = raw_of(value.as_py())
                    for r in runs:
                        held = raw[r["start"] * unit : (r["start"] + r["starts"] + length - 1) * unit]
                        for column, x in zip(columns, (r["anchor"], r["key"], r["copies"], doc, tag, r["start"], r["starts"], held)):
                            column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "key", "copies", "doc", "tag", "start", "starts", "units"])

        by_doc = heads.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "key", "copies", "start", "starts")).alias("runs"))
        return dealt_docs.join(by_doc, ["doc", "tag"]).select("doc", "tag", "text", "runs").mapInArrow(fetch, TEXT_SCHEMA)

    def compare(self, texts: DataFrame) -> DataFrame:
        """Ranges of starts of heads that stand earlier too, and rows ``is_text`` with the digests of texts that have copies."""
        judge, unit = self.judge, self.unit_bytes

        def judged(rows: list[dict]) -> pa.RecordBatch:
            held = {k: np.array([r[k] for r in rows], np.int64) for k in ("anchor", "key", "doc", "tag", "start", "starts")}
            copies = np.array([r["copies"] for r in rows])
            starts = held["starts"]
            flags = judge([r["units"] for r in rows], starts, held)
            owner = np.repeat(np.arange(len(rows)), starts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
            hit = np.flatnonzero(flags)
            begins = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])[: len(hit)]
            first = hit[begins]
            sizes = np.diff(np.append(np.flatnonzero(begins), len(hit)))
            texts = np.flatnonzero(copies)
            at = np.concatenate([owner[first], texts])
            shift = np.concatenate([inner[first], np.zeros(len(texts), np.int64)])
            n = np.concatenate([sizes, starts[texts]])
            digests = pa.array([None] * len(first) + [digest(rows[k]["units"]) for k in texts], pa.binary())
            is_text = pa.array(np.arange(len(at)) >= len(first))
            places = [pa.array(held[k][at]) for k in ("anchor", "key", "doc", "tag")]
            columns = [is_text, *places, pa.array((held["start"][at] + shift).astype(np.int32)), pa.array(n.astype(np.int32)), digests]
            return pa.RecordBatch.from_arrays(columns, ["is_text", "anchor", "key", "doc", "tag", "start", "starts", "digest"])

        def run(batches):
            block: list[dict] = []
            group: list[dict] = []
            in_block = 0
            for batch in batches:
                for row in batch.to_pylist():
                    if group and row["anchor"] != group[-1]["anchor"]:
                        block += group
                        in_block += sum(len(r["units"]) // unit for r in group)
                        group = []
                        if in_block >= BLOCK_UNITS:
                            yield judged(block)
                            block, in_block = [], 0
                    group.append(row)
            if block + group:
                yield judged(block + group)

        return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, JUDGED_SCHEMA)

    # All steps

    def _judged(self, runs: DataFrame, dealt: DataFrame, level: int) -> DataFrame:
        """Ranges of repeated starts (doc, tag, start, starts) among ``runs``, under anchors from grams of a level."""
        found = materialize(self.group(runs))
        heads = found.filter(F.col("kind") == HEAD).drop("kind", "alone")
        copies = found.filter(F.col("kind") == COPY).select("anchor", "key", "doc", "tag", "start", "starts")
        hot = found.filter(F.col("kind") == HOT).select("anchor").distinct()
        n_hot = hot.count() if level + 1 < len(self.grams) else 0
        with_text = (lambda rows: self.texts(rows, dealt)) if level == 0 else (lambda rows: rows)
        if not n_hot:
            judged = materialize(self.compare(with_text(heads)))
            texts_of, out = judged.filter("is_text").select("anchor", "key", "digest"), judged.filter("NOT is_text")
        else:
            hot = F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot
            texts = materialize(with_text(heads))
            judged = materialize(self.compare(texts.join(hot, "anchor", "left_anti")))
            deeper = texts.join(hot, "anchor", "left_semi")
            again = self._judged(self.scan_again(deeper, self.grams[level + 1]), dealt, level + 1)
            own = F.substring(F.unhex(F.sha2("units", 256)), 1, DIGEST_BYTES)
            texts_of = judged.filter("is_text").select("anchor", "key", "digest").unionByName(deeper.filter("copies").select("anchor", "key", own.alias("digest")))
            out = judged.filter("NOT is_text").select("doc", "tag", "start", "starts", "digest").unionByName(again)
        columns = ["doc", "tag", "start", "starts", "digest"]
        return out.select(*columns).unionByName(copies.join(texts_of.distinct(), ["anchor", "key"]).select(*columns))

    def repeated(self, docs: DataFrame) -> DataFrame:
        """doc, text and ``repeats`` of each row of ``docs``: ranges of repeated starts, proposed ones with a digest; or null."""
        whole = keyed(docs)
        dealt = whole.repartition("doc", "tag")
        ranges = self._judged(self.scan(whole), dealt, 0)
        by_doc = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "starts", "digest")).alias("repeats"))
        return dealt.join(by_doc, ["doc", "tag"], "left").select("doc", "text", "repeats")


def digest(units: bytes) -> bytes:
    return hashlib.sha256(units).digest()[:DIGEST_BYTES]


def proven(repeats: list[dict], raw: Callable[[], bytes], length: int, unit_bytes: int) -> list[dict]:
    """``repeats`` without proposed copies whose units aren't those of the text that was compared."""
    if all(r["digest"] is None for r in repeats):
        return repeats
    units = raw()
    own = lambda r: digest(units[r["start"] * unit_bytes : (r["start"] + r["starts"] + length - 1) * unit_bytes])
    return [r for r in repeats if r["digest"] is None or r["digest"] == own(r)]


def covered(n: int, repeats: list[dict], length: int) -> np.ndarray:
    """Flags of the ``n`` units that strings of ``length`` at the repeated starts cover."""
    steps = np.zeros(n + 1, np.int32)
    for r in repeats:
        steps[r["start"]] += 1
        steps[min(n, r["start"] + r["starts"] - 1 + length)] -= 1
    return np.cumsum(steps)[:n] > 0
