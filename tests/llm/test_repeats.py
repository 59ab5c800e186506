"""Byte and word repeats against brute force; the language and toxicity models; revisits; edge rows for every operator."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.llm import (
    bwt_repeats, hierarchical_language, line_quality, minhash_join, mixing, mph_dedup, pu_toxicity, repeats, revisit, seed_extend,
)

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, anchor int, shard int, _doc int"


def edge_rows():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(6))
    passage = " ".join(word() for _ in range(45))
    texts = [None, "", "   \n ", "a", "...", "abc " * 100, "x" * 1000, "ab" * 300, passage, passage, "long " + " ".join(word() for _ in range(30_000))]
    texts += [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30)) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"s{i % 2}", None, "no", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[8], (None, passage, None, None, None, None, None, None, None), (7, "another text for a doc_id " * 20, "de", "s1", 1, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 1)) for i in range(20)] + [(None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")


def brute_repeats(rows, tags, length, by_word):
    """tags: Spark's hash of each text, which orders texts that share a doc_id or have none."""
    key = lambda r: (-(2**63) if r[0] is None else r[0], tags[r[1] or ""])
    seen, done, out = set(), {}, Counter()
    for row in sorted(rows, key=key):
        text = (row[1] or "").encode()
        units = text.split() if by_word else text
        if key(row) not in done:
            gone = np.zeros(len(units), bool)
            for i in range(len(units) - length + 1):
                s = tuple(units[i : i + length]) if by_word else units[i : i + length]
                gone[i : i + length] |= s in seen
                seen.add(s)
            stay = [u for u, g in zip(units, gone) if not g]
            spans = () if by_word else (int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),)
            done[key(row)] = (row[0], len(units), int(gone.sum()), *spans, hashlib.sha256(b" ".join(stay) if by_word else bytes(stay)).hexdigest())
        out[done[key(row)]] += 1
    return out


def check_repeats(docs, rows):
    tags = {r.text: r.tag for r in repeats.keyed(docs).collect()}
    found = bwt_repeats.removed_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_repeats(rows, tags, 100, False)
    found = seed_extend.removed_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_repeats(rows, tags, 20, True)


@pytest.mark.parametrize("most_heads", [2048, 4, 1])
def test_repeats_equal_brute_force(edge, monkeypatch, most_heads):
    """Also where anchors go one or two levels deeper."""
    monkeypatch.setattr(repeats, "MOST_HEADS", most_heads)
    check_repeats(edge, edge_rows())


def test_repeats_of_a_hot_passage_and_null_ids(spark, monkeypatch):
    """A passage in most texts, its neighbourhood differing, over several batches and partitions; many null doc_ids."""
    monkeypatch.setattr(repeats, "MOST_HEADS", 8)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(120):
        cut = rng.randrange(15)
        text = " ".join([word() for _ in range(rng.randrange(40))] + passage[cut : 40 - rng.randrange(10)] + [word() for _ in range(rng.randrange(30))])
        rows.append((i if i % 3 else None, text if i % 10 else rows[i // 2][1] if i else text))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_repeats_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_repeats(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("keys", [1, 2])
def test_colliding_keys_remove_nothing_that_stands_once(spark, keys):
    """Under such keys every text of an anchor is proposed as a copy of the first; only true ones may go."""
    key_of = lambda text: len(text) % keys
    rng = random.Random(9)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    rows = [(k, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(30))} {shared} {' '.join(f'b{rng.randrange(10**6)}' for _ in range(30))}") for k in range(12)]
    rows += [(50 + k, rows[k][1]) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for finder, unit in ((bwt_repeats.removed_repeats, "bytes"), (seed_extend.removed_repeats, "words")):
        right = {r.doc_id: r for r in finder(docs).collect()}
        weak = {r.doc_id: r for r in finder(docs, key_of=key_of).collect()}
        size = f"n_{unit}"
        assert right[0].n_removed == 0 and right[50].n_removed == right[50][size] and right[3].n_removed > 0
        for k, r in weak.items():
            assert r.n_removed <= right[k].n_removed, (unit, k)
            # What is removed is removed rightly: the rest holds all that the right answer keeps, in order.
            rest = iter(r.kept if unit == "bytes" else r.kept.split())
            assert all(any(x == y for y in rest) for x in (right[k].kept if unit == "bytes" else right[k].kept.split()))


def test_intervals_of_small_texts():
    rng = np.random.default_rng(1)
    for trial in range(100):
        texts = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(5, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        starts = np.array([len(t) - 4 for t in texts])
        places = {"doc": np.arange(len(texts)) * 7 % 5, "tag": np.arange(len(texts)), "start": np.zeros(len(texts), int)}
        first = {}
        held = [((places["doc"][k], k, i), t[i : i + 5]) for k, t in enumerate(texts) for i in range(starts[k])]
        for place, s in held:
            first[s] = min(first.get(s, place), place)
        assert list(bwt_repeats.later_starts(texts, starts, places, 5)) == [first[s] != place for place, s in held]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = hierarchical_language.predict_language(docs).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_toxicity_finds_planted_words(spark):
    rows = [(i, f"plain words {i % 7} of text number {i}" + (" nastyword" if i % 5 == 1 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in pu_toxicity.toxicity(docs, marks).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert np.mean([found[i].predicted == int(i % 5 == 1) for i in found]) > 0.97


def test_revisits(spark):
    page = spark.read.parquet(f"{DATA}/pages.parquet")
    found = revisit.page_revisits(page)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    wanted = con.execute(revisit.SQL).fetchall()
    assert Counter((r.record_id, r.canonical_url, r.outcome, r.response_id, r.headers) for r in found.collect()) == Counter(wanted)
    schema = "record_id long, url string, date long, type string, status int, headers array<struct<name:string,value:string>>, part int"
    h = lambda *x: [{"name": a, "value": b} for a, b in x]
    rows = [
        (1, "http://A.com/x/?utm_source=f", 10, "response", 200, h(("ETag", '"1"'), ("Content-Type", "t")), 0),
        (2, "https://www.a.com:443/x#top", 20, "revisit", 304, h(("etag", 'W/"1"'), ("Content-Type", "no"), ("Expires", "later")), 0),
        (3, "a.com/x", 30, "response", 200, None, 0),
        (4, "a.com/x", 30, "revisit", 304, h(("etag", '"1"')), 0),
        (5, None, 30, "revisit", 304, None, 0),
        (6, "b.com", 30, "revisit", 304, None, 0),
        (7, "a.com/x", None, "response", 200, None, None),
    ]
    found = {r.record_id: r for r in revisit.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in found.items()} == {2: ("resolved", 1), 4: ("no_validator", 3), 5: ("no_earlier_response", None), 6: ("no_earlier_response", None)}
    assert [(x.name, x.value) for x in found[2].headers] == [("content-type", "t"), ("etag", 'W/"1"'), ("expires", "later")]
    assert revisit.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


OPERATORS = {
    "mixing": lambda d, x: mixing.mix_sources(d),
    "toxicity": pu_toxicity.toxicity,
    "bytes": lambda d, x: bwt_repeats.removed_repeats(d),
    "near": lambda d, x: minhash_join.near_duplicates(d),
    "exact": lambda d, x: mph_dedup.dedup_by_halves(d),
    "language": lambda d, x: hierarchical_language.predict_language(d),
    "quality": lambda d, x: line_quality.line_quality(d),
    "words": lambda d, x: seed_extend.removed_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(edge, nothing, labels, name):
    assert OPERATORS[name](nothing, labels).count() == 0
    assert Counter(r.doc_id for r in OPERATORS[name](edge, labels).collect()) == Counter(r[0] for r in edge_rows())
