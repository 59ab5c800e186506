import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from stackwright.llm import drake_clusters as drake
from stackwright.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()


def plain(rows, clusters, rounds, dimensions):
    """Lloyd's algorithm in Python integers over (vec_id, components)."""
    kept = [(i, [math.floor(drake.SCALE * v) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x)]
    hashed = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [x for _, x in sorted(kept, key=lambda r: (hashed(r[0]), r[0] is None, r[1]))[:clusters]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        found = [nearest(x) for _, x in kept]
        for k in range(len(at)):
            mine = [x for (_, x), (_, c) in zip(kept, found) if c == k]
            if mine:
                at[k] = [sum(v) // len(mine) for v in zip(*mine)]
    found = [nearest(x) for _, x in kept]
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found))


def rows_of(df):
    return Counter(tuple(r[c] for c in NAMES) for r in df.collect())


def test_query_equals_sql_and_plain_form(spark):
    found = rows_of(QUERIES["op11_drake_clusters"](spark, SMALL))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    wanted = con.execute(ORACLE_SQL["op11_drake_clusters"])
    at = [[d[0] for d in wanted.description].index(c) for c in NAMES]
    assert found == Counter(tuple(r[k] for k in at) for r in wanted.fetchall())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert found == plain(rows, 8, 10, 64)


@pytest.mark.parametrize("clusters, rounds", [(1, 2), (3, 4), (12, 6), (40, 10)])
def test_edge_rows_and_ties(spark, clusters, rounds):
    random = np.random.default_rng(clusters)
    rows = [(k % 31 if k % 9 else None, [float(v) / 1024 for v in random.integers(-4, 4, 3)]) for k in range(150)]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0] * 4), (206, [0.25, -7e3, 1.5])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, cluster int").repartition(5)
    found = rows_of(drake.drake_clusters(vectors, clusters, rounds, 3, bucket_rows=40))
    assert found == plain(rows, clusters, rounds, 3)


def test_nothing_and_fewer_vectors_than_centroids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert drake.drake_clusters(empty).collect() == []
    two = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.distance) for r in sorted(drake.drake_clusters(two).collect())] == [(1, 0), (2, 0)]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        drake.drake_clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_save_work(seed):
    random = np.random.default_rng(seed)
    x = np.concatenate([random.normal(m, 60, (80, 8)) for m in random.integers(-900, 900, (12, 1))]).round().astype(np.int64)
    centroids, state, measured = drake.Centroids(x[random.permutation(len(x))[:12]]), None, []
    for turn in range(12):
        bounds = max(1, 4 - turn // 2)
        state = drake.assign(x, state, centroids, bounds)
        exact = np.square(x[:, None, :] - centroids.at).sum(2)
        assert (state["cluster"] == exact.argmin(1)).all() and (state["distance"] == exact.min(1)).all()
        roots = np.sqrt(exact)
        assert (np.take_along_axis(roots, state["near"], 1) >= state["lower"]).all()
        others = np.ones_like(exact, bool)
        np.put_along_axis(others, np.concatenate([state["cluster"][:, None], state["near"]], 1), False, 1)
        assert (np.where(others, roots, np.inf).min(1) >= state["rest"]).all()
        measured.append(state["measured"].mean())
        sums = {k: (int((state["cluster"] == k).sum()), x[state["cluster"] == k].sum(0).tolist()) for k in set(state["cluster"].tolist())}
        centroids = centroids.updated(sums)
    assert measured[-1] < measured[0] / 2
