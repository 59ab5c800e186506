import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackwright.llm import phrase_fingerprint as lz
from stackwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def phrases(text):
    """The plain parse: the shortest prefix of the rest that isn't in the set yet."""
    known, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in known:
            known.add(text[start:end])
            start = end
    return known


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_hash(phrase):
    known = lz._EMPTY
    for letter in phrase:
        known = (known * lz._BASE + ord(letter)) % 2**64
    return known


@settings(max_examples=200, deadline=None)
@given(st.text("abcé日🙂 ", max_size=80), st.text("abcé日🙂 ", max_size=80), st.text("abcé日🙂 ", max_size=80))
def test_parses_that_share_a_beginning_equal_plain_parses(kept, own, other):
    parse = lz.Parse()
    parse.feed(kept)
    for found, text in zip(parse.both(own, other), (kept + own, kept + other)):
        assert sorted(found) == sorted(map(plain_hash, phrases(text)))
        assert lz.signature(found).tobytes().hex() == lz.fingerprint(text)


def checked(rows, found):
    """``found`` against plain text work over ``rows`` (doc_id, text) in their order."""
    assert len(found) == len(rows)
    by_edit = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in found}
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by_edit[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert (r.fingerprint, r.edited_fingerprint) == (lz.fingerprint(text), lz.fingerprint(edited))
        assert abs(r.near_edited - jaccard(phrases(text), phrases(edited))) < 0.25
        assert abs(r.near_next - jaccard(phrases(text), phrases(following))) < 0.25


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_phrase_fingerprint"](spark, SMALL).collect()
    checked([(d.doc_id, d.text or "") for d in sorted(docs, key=lambda d: -d.doc_id)], found)
    long = [r for r in found if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_edge_rows(spark, partitions):
    rows = [(9, "a long text, a long text", 1), (8, None, 2), (7, "", 3), (6, "日本🙂" * 9, 4), (5, "x", 5), (4, "repeat" * 4000, 6), (None, "last", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        checked([(r[0], r[1] or "") for r in rows], lz.neighbour_likeness(docs.repartition(3)).collect())
        same = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None), (None, None)], "doc_id long, text string")
        found = lz.neighbour_likeness(same).collect()
        assert sorted((r.doc_id or 0, r.n_chars) for r in found) == [(0, 0), (0, 0), (1, 10), (1, 10)]
        assert len({r.fingerprint for r in found}) == 2
        alone = lz.neighbour_likeness(docs.limit(1)).first()
        assert alone.near_next == 1.0
        assert lz.neighbour_likeness(docs.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_likeness_of_columns_equals_that_of_the_operator(spark):
    docs = spark.createDataFrame([(2, "some words here"), (1, "some words there")], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in lz.neighbour_likeness(docs).collect()}
    a, b = (lz.fingerprints(docs.filter(f"doc_id = {k}")) for k in (2, 1))
    found = a.crossJoin(b.select(F.col("fingerprint").alias("other"))).select(lz.likeness().alias("near")).first()
    assert found.near == near[2]
