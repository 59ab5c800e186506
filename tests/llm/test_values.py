"""Values of the operators without SQL against plain Python versions, and the SQL of the others, on edge rows and a table."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_repeats import DATA, SCHEMA, edge_rows

import corpus_pipeline
from stackwright.llm import hierarchical_language, mixing, packing, queries


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    found = queries.QUERIES[name](spark, DATA)
    wanted = con.execute(queries.ORACLE_SQL[name])
    order = [found.columns.index(d[0]) for d in wanted.description]
    assert Counter(tuple(r[i] for i in order) for r in found.collect()) == Counter(wanted.fetchall())


# Packing


def plain_pieces(rows):
    """(doc_id, piece, start, length, ids_crc32) by the tokenizers library alone."""
    encode, out = packing.Encoder().whole, Counter()
    for doc_id, text in rows:
        ids = np.array([*encode(text or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        out.update((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return out


def best_fit_sequences(lengths):
    """Sequences that best-fit decreasing makes of the pieces."""
    gaps = Counter()
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n and gaps[g]), default=None)
        if fit is None:
            fit = 2048
        else:
            gaps[fit] -= 1
        gaps[fit - n] += 1
    return sum(gaps.values())


def check_packed(docs, rows):
    found = packing.pack_best_fit(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == plain_pieces(rows)
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    lengths = [r.length for r in found]
    assert math.ceil(sum(lengths) / 2048) <= len(by_sequence) <= best_fit_sequences(lengths)


def test_packing_edge_rows(spark, edge, nothing, monkeypatch):
    assert packing.pack_best_fit(nothing).count() == 0
    monkeypatch.setattr(packing, "BUCKET_ROWS", 4)
    texts = ["<|endoftext|>", "a <|endoftext|>b", "naïve café  ½ ²    x", "日本語のテキスト。", "🙂🙃 ՘࢏", "don't WE'LL\n\n\t x  ", "\x1c \x85 ​", "कि न्यू", "a" * 5000, "퟿￿"]
    more = [(100 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    check_packed(edge.unionByName(spark.createDataFrame(more, SCHEMA)), [r[:2] for r in edge_rows() + more])


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_packed(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_words_are_cut_as_the_tokenizer_does():
    encode = packing.Encoder()
    for code in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        text = f"a{c}b {c}1{c}{c} ?{c}!  {c}"
        if not encode.unsettled.search(text):
            cut = encode.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            assert [text[a:b] for _, (a, b) in cut] == encode.words.findall(text), hex(code)


# Mixing


def plain_mix(rows, block_words):
    """{row number: (size, source_size, target, taken)} by going through the slots one by one; rows (place, doc_id, source, size)."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in rows if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, target, open_sources = sum(size.values()), {}, list(sources)
    while open_sources:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if weight[s] * level > 3 * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_sources}
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_sources = [s for s in open_sources if s not in full]
    upper = dict(zip(sources, np.cumsum([target[s] for s in sources]) / sum(target.values())))
    goal = {s: math.floor(target[s] + 0.5) for s in sources}
    drawn: Counter = Counter()
    words = {s: Counter() for s in sources}  # words of the stream by place, taken how often

    def take(s):
        blocks = -(-size[s] // block_words)
        epoch, block = divmod(drawn[s], blocks)
        drawn[s] += 1
        n = min(block_words, size[s] - block * block_words, goal[s] - epoch * size[s] - block * block_words)
        words[s].update(range(block * block_words, block * block_words + max(0, n)))

    for n in range(math.ceil(total / block_words) + len(sources)):
        u = n * mixing.GOLDEN % 1.0
        take(next(s for s in sources if u < upper[s] or s == sources[-1]))
    for s in sources:
        while size[s] and sum(words[s].values()) < goal[s]:
            take(s)
    out, end = {}, Counter()
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] % 2**64 >> 33, rows[k][0], rows[k][1])):
        _, _, s, n = rows[k]
        out[k] = (n, size[s], target[s], sum(words[s][x] for x in range(end[s], end[s] + n)))
        end[s] += n
    return out


@pytest.mark.parametrize("block_words", [7, 2048])
def test_mix_equals_plain_schedule(spark, block_words, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, " ".join(["w"] * ((i * 37) % 90)), (None, "a", "b", "b", "b", "c", "é", "z")[i % 8]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    placed = [tuple(r) for r in mixing.sizes(docs).select(F.xxhash64("doc_id"), "doc_id", "source", "size").collect()]
    wanted = {placed[k][1]: v for k, v in plain_mix(placed, block_words).items()}
    found = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_sources(docs, block_words).collect()}
    assert found.keys() == wanted.keys()
    for k, (size, source_size, target, taken) in found.items():
        assert (size, source_size, taken) == (wanted[k][0], wanted[k][1], wanted[k][3]) and target == pytest.approx(wanted[k][2])
        assert taken <= 3 * size
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(2), block_words).collect()}
    assert again == {k: v[3] for k, v in found.items()}


def test_numerals_are_no_letters(spark):
    docs = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["le chat dort ici", "the cat sleeps here"] * 20)]
    docs += [(100, "½ ²", None), (101, "...", None), (102, None, None), (103, "١٢", None)]
    found = hierarchical_language.predict_language(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    guess = {r.doc_id: r.lang_pred for r in found.collect()}
    assert all(guess[i] == "und" for i in range(100, 104)) and all(guess[i] == ("en" if i % 2 else "fr") for i in range(40))


def test_languages_outside_the_table_share_families():
    langs = [f"x{i:03d}" for i in range(100)] + ["en", "de", "fr"]
    pairs = hierarchical_language.machines(langs)
    assert len(pairs) < 8 * len(langs)
    assert {a for _, a, b in pairs} | {b for _, a, b in pairs} >= set(langs) - {"fr"}


def test_pipeline_stages(spark, edge, nothing):
    """Each stage keeps the columns; the last returns the pieces of the rows that came to it."""
    for docs in (nothing, edge):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == edge.columns
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        found = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found.collect()) == plain_pieces(rows)
    assert rows and all(t and len(t.split()) > 0 for _, t in rows)
