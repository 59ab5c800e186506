"""Plans of moves carried out on a set of names: chains, rings, problems and the way back."""

import random

import pytest
from pyspark.sql import functions as F

from stackwright.plans import moves


def carried_out(names, steps):
    """Names -> contents after the steps; an overwritten or missing name is a failure."""
    held = dict(names)
    for source, target in steps:
        assert source in held and target not in held, (source, target)
        held[target] = held.pop(source)
    return held


def ordered(rows):
    """Steps in an order that the plan allows: chains interleaved at random, ranks ascending."""
    rng, waiting = random.Random(1), {}
    for r in sorted(rows, key=lambda r: r.rank):
        waiting.setdefault(r.chain, []).append(r)
    out = []
    while waiting:
        chain = rng.choice(sorted(waiting))
        out.append(waiting[chain].pop(0))
        if not waiting[chain]:
            del waiting[chain]
    return out


CASES = {
    "apart": [("a", "x"), ("b", "y")],
    "chain": [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(70)],
    "swap": [("b", "a"), ("a", "b")],
    "ring": [(f"r{k:02d}", f"r{(k + 1) % 37:02d}") for k in range(37)] + [("s2", "s3"), ("s3", "s1"), ("s1", "s2")],
}
rng = random.Random(7)
shuffled = [f"f{k:03d}" for k in range(150)]
CASES["mixed"] = list(zip(rng.sample(shuffled, 110), rng.sample(shuffled, 110)))
CASES["mixed"] = [(s, t) for s, t in CASES["mixed"] if s != t]


@pytest.mark.parametrize("name", CASES)
def test_plans_move_everything_and_lose_nothing(spark, name):
    wanted = CASES[name]
    sources, targets = {s for s, _ in wanted}, {t for _, t in wanted}
    names = {s: s for s in sources}
    found = moves.plan(spark.createDataFrame(wanted, "source string, target string")).collect()
    held = carried_out(names, [(r.source, r.target) for r in ordered(found)])
    assert held == {t: s for s, t in wanted}
    assert set(held) == targets


@pytest.mark.parametrize("fails_at", [0, 1, 5, 11])
def test_what_was_done_is_taken_back(spark, fails_at):
    wanted = [("b", "a"), ("a", "b"), ("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("d", "e"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    steps = moves.plan(spark.createDataFrame(wanted, "source string, target string")).cache()
    order = ordered(steps.collect())
    names = {s: s for s, _ in wanted}
    half = carried_out(names, [(r.source, r.target) for r in order[:fails_at]])
    told = [(r.chain, r.rank, k < fails_at) for k, r in enumerate(order[: fails_at + 1])]
    back = moves.undone(steps, spark.createDataFrame(told, "chain string, rank long, done boolean")).collect()
    complete = fails_at >= len(order)
    assert carried_out(half, [(r.source, r.target) for r in ordered(back)]) == (half if complete else names)
    assert len(back) == (0 if complete else fails_at)
    steps.unpersist()


def test_problems_are_told_for_each_move(spark):
    files = spark.createDataFrame([(f"/lib/{n}",) for n in "abcdefg"] + [("/other/x",)], "path string")
    wanted = [
        ("/lib/a", "/lib/b"), ("/lib/b", "/lib/new"),  # fine: b leaves
        ("/lib/c", "/lib/d"),  # d stays
        ("/lib/e", "/lib/z"), ("/lib/f", "/lib/z"),
        ("/lib/none", "/lib/y"),
        ("/lib/g", "/lib/../other/g"),
        ("/other/x", "/lib/x"),
        ("/lib/same", "/lib/same"),
    ]
    found = moves.problems(spark.createDataFrame(wanted, "source string, target string"), files, F.lit("/lib"))
    assert sorted((r.source, r.problem) for r in found.collect()) == [
        ("/lib/c", "occupied"), ("/lib/e", "repeated_target"), ("/lib/f", "repeated_target"), ("/lib/g", "outside"),
        ("/lib/none", "missing_source"), ("/lib/same", "missing_source"), ("/lib/same", "same"), ("/other/x", "outside"),
    ]


def test_no_moves(spark):
    assert moves.plan(spark.createDataFrame([], "source string, target string")).collect() == []
