import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stackwright.llm import token_alignment
from stackwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def brute(texts):
    """Whole texts by both libraries, and the owner of each byte: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) for each."""
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    of_piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in a_of.id_to_token(i))) for i in a_of.encode(whole.decode(), add_special_tokens=False).ids]
        b = [(i, of_piece(b_of.id_to_piece(i))) for i in b_of.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(None)
            continue
        owner_a = [k for k, (_, x) in enumerate(a) for _ in x]
        owner_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = Counter((a[i][0], b[j][0]) for i, j in set(zip(owner_a, owner_b)))
        ends = [p for p in range(1, len(whole) + 1) if p == len(whole) or (owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1])]
        groups, start = [], 0
        for end in ends:
            own = lambda ids, owner: ",".join(str(ids[k][0]) for k in range(owner[start], owner[end - 1] + 1))  # noqa: E731, B023
            groups.append(f"{own(a, owner_a)}|{own(b, owner_b)}")
            start = end
        docs.append((len(a), len(b), groups, links))
    counts, most = Counter(p for d in docs if d for p in d[3]), defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    found = []
    for d in docs:
        if d is None:
            found.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        found.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return found


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    wanted = [(d.doc_id, *v) for d, v in zip(docs, brute([d.text for d in docs]))]
    assert rows_of(QUERIES["op12_token_alignment"](spark, SMALL)) == sorted(wanted, key=repr)


EDGES = [
    "", None, " ", "a", "a", "  two  spaces ", "line\n  indented\n\n\ttab", "<|endoftext|> <s> </s> <0x41> in a text", "with ▁ inside", "日本語の文章 です、", "é é ﬁ   x",
    "it's I'll 1234567 !!! ??", "\x00 nul", "word word 　 x", "x" * 5000, "Привет, мир", "🙂 👨‍👩‍👧 \U0001f9ff", "\x1c\x1d a \x85 b", "a \n b \r\n c  \n", "𞤀𞤁 ᠎ x",
]


@pytest.mark.parametrize("slices", [token_alignment.SLICE_POSTINGS, 3])
def test_edge_texts_and_hot_ids(spark, slices):
    texts = EDGES * 3
    rows = [(None if k % 7 == 0 else k % 11, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, row long").repartition(5)
    wanted = [(r[0], *v) for r, v in zip(rows, brute(texts))]
    assert rows_of(token_alignment.align_tokens(docs, slice_postings=slices)) == sorted(wanted, key=repr)


def test_groups_hash_to_the_digest_and_pairs_are_counted(spark):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, "things"), (3, None)], "doc_id long, text string")
    for r in token_alignment.align_tokens(docs, with_groups=True).collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    counts = token_alignment.pair_counts(token_alignment.encoded(docs)).collect()
    assert max(r.documents for r in counts) == 2


def test_nothing_gives_nothing(spark):
    assert token_alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
