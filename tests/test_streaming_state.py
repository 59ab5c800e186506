"""Keyed state of streams: the same rows from one batch and from many, and state that shrinks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stackwright.operators import state
from stackwright.streaming import limits, sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, rows, schema, build, batches, folder):
    """All rows that ``build`` gives of a stream of files, each a batch, and the state rows at the end of each batch."""
    step, source = -(-len(rows) // batches), folder / "in"
    source.mkdir(parents=True)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.parquet(str(folder / "parts" / str(k)))
        part = next((folder / "parts" / str(k)).glob("*.parquet"))
        part.rename(source / f"{k:05d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "seen")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(folder / "out")).collect(), held


def events():
    rng, rows = random.Random(5), []
    for seq in range(120):
        kind = rng.choice(["turn", "clarified", "clarified", "answered", "submitted", "finished"])
        turn = [None] * 9
        if kind == "turn":
            turn = [rng.choice(["set", None]), '{"a": 1}', rng.choice(["router", "llm"]), rng.randrange(5), "q", None, rng.choice(["x", None]), rng.choice([True, False, None]), rng.choice([0, 2, None])]
        rows.append((f"s{rng.randrange(4)}", seq, f"t{seq:03d}", kind, f"b{rng.randrange(3)}", *turn))
    return rows


def folded(rows):
    """The log folded by hand, without the library."""
    held, out = {}, []
    for session, seq, at, kind, batch, *turn in rows:
        r = held.setdefault(session, {"turn": [None, None, "llm", None, None, None, None, None], "n": 0, "pending": [], "created": at})
        if kind == "turn":
            r["turn"], r["n"] = turn[:8], turn[8]
        if kind == "clarified":
            r["n"] = (r["n"] or 0) + 1
        if kind == "answered":
            r["n"] = 0
        if kind == "submitted" and batch not in r["pending"]:
            r["pending"] = r["pending"] + [batch]
        if kind == "finished":
            r["pending"] = [b for b in r["pending"] if b != batch]
        out.append((session, seq, *r["turn"], r["n"], r["created"], at, tuple(r["pending"])))
    return sorted(out, key=repr)


def plain(rows):
    return sorted(((*tuple(r)[:-1], tuple(r[-1])) for r in rows), key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_sessions_of_a_stream_equal_a_plain_fold(rocks, tmp_path, batches):
    schema = ", ".join(f"{c} {t}" for c, t in sessions.EVENT.items())
    found, held = run(rocks, events(), schema, sessions.live, batches, tmp_path)
    assert plain(found) == folded(events())
    assert held[-1] == 4


def test_sessions_of_a_finished_log_equal_a_plain_fold(spark):
    schema = ", ".join(f"{c} {t}" for c, t in sessions.EVENT.items())
    found = sessions.replay(spark.createDataFrame(events(), schema))
    assert found.columns == list(sessions.OUTPUT) and plain(found.collect()) == folded(events())
    last = sessions.latest(found).first()
    assert (last.updated_at, last.seq) == ("t119", 119)


START = datetime(2024, 1, 1)


@pytest.mark.parametrize("batches", [1, 6])
def test_window_counts_equal_those_of_the_finished_log(rocks, tmp_path, batches):
    rng, rows, now = random.Random(3), [], START
    for k in range(200):
        now += timedelta(seconds=rng.choice([0, 0, 1, 5, 20, 90]))
        rows.append((f"c{rng.randrange(3)}", k, now))
    # Long after: the others' windows are empty, and their state goes.
    rows += [("late", 1000 + k, now + timedelta(days=1, minutes=5 * k)) for k in range(3)]
    schema = "client string, request_id long, at timestamp"
    found, held = run(rocks, rows, schema, limits.window_counts, batches, tmp_path)
    log = rocks.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("long"))
    wanted = {r.request_id: r.n for r in state.requests_in_window(log, ["client"]).collect()}
    assert {r.request_id: r.n for r in found} == wanted
    assert max(wanted.values()) > 4
    assert all(r.admitted == (r.n <= 25) for r in limits.admitted(rocks.createDataFrame([("c", 25), ("c", 26)], "client string, n long")).collect())
    if batches > 1:
        assert held[-1] < max(held)


def test_answers_are_fresh_for_a_day_and_then_leave(rocks, tmp_path):
    hour = timedelta(hours=1)
    rows = [("k", 1, START, None), ("k", 2, START + hour, "v1"), ("k", 3, START + 2 * hour, None), ("k", 4, START + 24.99 * hour, None), ("k", 5, START + 25 * hour, None)]
    rows += [("k", 6, START + 26 * hour, "v2"), ("k", 7, START + 27 * hour, None), ("other", 8, START + 90 * hour, None), ("other", 9, START + 95 * hour, None)]
    found, held = run(rocks, rows, "key string, request_id long, at timestamp, value string", limits.fresh_answers, 9, tmp_path)
    assert {r.request_id: (r.value, r.hit) for r in found} == {1: (None, False), 3: ("v1", True), 4: ("v1", True), 5: (None, False), 7: ("v2", True), 8: (None, False), 9: (None, False)}
    assert max(held) == 1 and held[-1] == 0
