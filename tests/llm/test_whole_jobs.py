"""The operators against brute force on small blocks, repeated rows and shared doc_ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stackwright.llm import line_quality, minhash_join, mixing, mph_dedup, pu_toxicity

DATA = "/root/testdata/sf0.001"


def brute_components(rows, words):
    """Least doc_id of each row's component; rows (doc_id, text) with unique doc_ids."""
    sets = {i: set(minhash_join.shingle_set((t or "").encode(), words).tolist()) for i, t in rows}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def template_family(n, seed=5):
    """Texts of a template that are about 0.65 alike, near copies of some, and a chain of versions."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(160)]
    texts = [template + [word() for _ in range(40)] for _ in range(n)]
    texts += [t[:-4] + [word() for _ in range(4)] for t in texts[: n // 4]]
    version = template + [word() for _ in range(40)]
    for _ in range(10):
        version = version[8:] + [word() for _ in range(8)]
        texts.append(version)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_in_blocks(spark, monkeypatch, words):
    """Equal to brute force, and no task holds more than a few blocks of members and of probes."""
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    largest, confirm = [], minhash_join._confirm

    def counted(members, probes):
        for side in (members, probes):
            largest.append(max(Counter(tuple(r) for r in side.select(*[c for c in ("cluster", "block", "turn") if c in side.columns]).collect()).values(), default=0))
        return confirm(members, probes)

    monkeypatch.setattr(minhash_join, "_confirm", counted)
    rows = template_family(60) + [(1000, None), (1001, ""), (1002, "alone")]
    found = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()
    wanted = brute_components(rows, words)
    assert {r.doc_id: (r.component_id, r.kept) for r in found} == {i: (c, c == i) for i, c in wanted.items()}
    assert 1 < len(set(wanted.values())) < len(rows)
    assert max(largest) <= 3 * minhash_join.BLOCK


def test_near_duplicates_of_shared_and_null_ids(spark):
    """Texts that share a doc_id, or have none, are linked each by its own set; a component's id is its least doc_id."""
    rng = random.Random(11)
    base = [[f"w{k}x{rng.randrange(10**6)}" for _ in range(60)] for k in range(5)]
    near = lambda k: " ".join(base[k][:-3] + ["some", "other", "end"])
    text = lambda k: " ".join(base[k])
    rows = [(7, text(0)), (7, text(1)), (8, near(0)), (9, near(1)), (None, text(2)), (None, near(2)), (None, text(3)), (4, near(3))]
    rows += [(None, text(4)), (None, None), (5, text(2) + " and quite another text " + text(4)), (2**60 + 1, near(4)), (8, near(0))]
    wanted = [7, 7, 7, 7, None, None, 4, 4, 2**60 + 1, None, 5, 2**60 + 1, 7]
    found = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    wanted = Counter((i, len(minhash_join.shingle_set((t or "").encode())), c, i == c) for (i, t), c in zip(rows, wanted))
    assert Counter(tuple(r) for r in found.collect()) == wanted


def test_lines_above_limits_are_removed(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(80):
        lines = [" ".join(word() for _ in range(30)) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(1, "  Menu \t HOME about " if i % 8 else "menu home about")
        if i < 40:
            lines.insert(2, "read more")  # common, but in one host of two
        lines.insert(1, "")
        rows.append((i, "\n".join(lines), "a" if i < 40 else "b", None, "x"))
    rows += [rows[0], (5, "\n".join(["read more"] * 60 + ["x"]), "a", None, None), (None, None, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, gone string")
    for most, everywhere in ((None, False), (15, True)):
        removed = {"a": {"read more"}, "b": set()}
        if everywhere:
            removed = {h: {"menu home about", "read more"} for h in "ab"}
        wanted = Counter()
        for i, t, host, n, x in rows[:-2]:
            stay = "\n".join(line for line in t.split("\n") if " ".join(line.split()).lower() not in removed[host])
            wanted[i, stay, host, n if stay == t else len(stay), x] += 1
        found = line_quality.kept_texts(docs, min_documents=11, max_line_documents=most)
        assert Counter(tuple(r) for r in found.collect()) == wanted
    n = docs.select("text").distinct().count()
    share = line_quality.kept_texts(docs, min_documents=11, max_line_fraction=15.5 / n)
    assert Counter(tuple(r) for r in share.collect()) == wanted


def test_quality_stage_removes_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in line_quality.line_quality(docs).filter("kept").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in line_quality.kept_texts(docs).collect()}
    assert set(after) == kept
    words = {r.doc_id: r.n_boilerplate_words for r in line_quality.line_quality(docs).collect()}
    assert {i: len(before[i].split()) - len(t.split()) for i, t in after.items()} == {i: words[i] for i in after}


def test_exact_dedup_of_null_and_large_ids(spark):
    """A text that only null doc_ids hold keeps its row, and ids over 2**53 in the same shard stay exact."""
    big = 2**60 + 1
    rows = [(None, "only null"), (None, "twice"), (None, "twice"), (None, "both"), (3, "both"), (big, "big"), (big - 1, "big"), (-5, "low"), (None, None)]
    found = mph_dedup.mph_dedup(*[spark.createDataFrame(r, "doc_id long, text string") for r in (rows[:4], rows[4:])]).collect()
    wanted = [(None, None, 1, True), (None, None, 2, True), (None, None, 2, True), (None, 3, 2, False), (3, 3, 2, True)]
    wanted += [(big, big, 2, True), (big - 1, big, 2, False), (-5, -5, 1, True), (None, None, 1, True)]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == Counter(wanted)


def repeated_rows():
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60 + rng.randrange(40)))
    rows = [(i, text(), "en", f"s{i % 2}") for i in range(30)]
    rows += [rows[3]] * 4 + [(4, rows[4][1], "de", "s1")]  # rows repeated as a whole, and but for a column
    rows += [(5, text(), "en", "s0"), (6, "too short", "en", "s0"), (7, rows[2][1] + " end", "en", "s0")]  # shared doc_ids
    rows += [(None, text(), "en", "s0"), (None, text(), "en", "s1")]
    return rows


def test_pipeline_with_repeated_rows_equals_brute_force(spark):
    """Repeated rows are one, texts that share a doc_id are judged each, and no text is taken over MAX_EPOCHS times."""
    rows = repeated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality_rules"](spark, docs, DATA)
    wanted = Counter(r for r in rows if r[1] != "too short")
    assert Counter(tuple(r) for r in docs.collect()) == wanted
    docs = stages["exact_dedup"](spark, docs, DATA)
    one: dict = {}
    for r in sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True):
        one[r[1]] = r if r[1] not in one or one[r[1]][0] == r[0] else one[r[1]]
    assert Counter(tuple(r) for r in docs.collect()) == Counter(one.values())
    docs = stages["near_dedup"](spark, docs, DATA)
    numbered = list(enumerate(sorted(one.values(), key=lambda r: (r[0] is not None, r[0] or 0))))
    least = brute_components([(n, r[1]) for n, r in numbered], minhash_join.SHINGLE_WORDS)
    kept = [r for n, r in numbered if least[n] == n]
    assert len(kept) == len(one) - 1
    assert Counter(tuple(r) for r in docs.collect()) == Counter(kept)
    mixed = stages["mix_sources"](spark, docs, DATA)
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    whole = {(r[0], r[1]) for r in kept}
    assert all(n <= mixing.MAX_EPOCHS for k, n in taken.items() if k in whole)
    cut = [k for k in taken if k not in whole]
    assert all(taken[k] == 1 and any(i == k[0] and t.startswith(k[1] + " ") for i, t in whole) for k in cut)
    # The mix takes each source's target to the word.
    total = Counter()
    for r in mixed.collect():
        total[r.source] += len(r.text.split())
    size = Counter()
    for r in kept:
        size[r[3]] += len(r[1].split())
    share = sum(size.values()) / 7  # weights 5 and 2
    target = {"s0": min(5 * share, 3 * size["s0"])}
    target["s1"] = sum(size.values()) - target["s0"]
    assert all(abs(total[s] - target[s]) <= 1 for s in target)


@pytest.mark.parametrize("script", ["unspaced", "joined", "tail"])
def test_toxicity_sees_whole_words(spark, script):
    """A toxic word inside a clause of an unspaced script, inside a joined token, or behind a long word's 32nd letter."""
    rng = random.Random(6)
    letters, bad, glue = ("的一是不了人我在有他这中大来上国", "毒蠢", "") if script == "unspaced" else ("abcdeimnorst", "qxzvjk", "_")
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))

    def text(toxic):
        clauses = [glue.join([word(40 if script == "tail" else 8), bad if toxic and k == 2 else word(len(bad)), word(5)]) for k in range(6)]
        return ", ".join(clauses)

    docs = spark.createDataFrame([(i, text(i % 5 == 1)) for i in range(600)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    found = pu_toxicity.toxicity(docs, marks).collect()
    assert sum(r.predicted == int(r.doc_id % 5 == 1) for r in found) > 0.97 * len(found)
