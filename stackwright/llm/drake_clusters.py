"""Centroid clustering with Drake's adaptive bounds, exact in integers.

After Drake and Hamerly, "Accelerated k-means with adaptive distance bounds" (2012). Each vector keeps an upper bound of
the distance to its centroid, the numbers of its several next nearest centroids in order with a lower bound for each,
and one remainder bound for all others. When centroids have moved, bounds move with them; the first bound that the
upper bound stays strictly below certifies that all centroids from there on are farther, and only those before it are
measured, exactly, in integers. Where no bound certifies the order, the vector is measured against all centroids.
The number of bounds adapts: after each round it falls to the largest place that any vector needed (from a quarter of
the centroids down to an eighth, at least one).

Squared distances are exact integers and ties go to the smaller number, so the result is that of the plain algorithm.
Bounds are doubles, widened by a relative 1e-9 each time they move: far more than rounding can add up to.

Scale: vectors are written once, as integers under a row number, bucketed by it; each round writes the bounds alone,
bucketed alike, so that both meet again without an exchange and the vectors are never shuffled after the first time. A
task sums its batch's vectors by centroid; centroids times components sums meet on the driver each round, and the
centroids go back with the tasks: their number times the number of components is all that either holds. Rounds end early
if no centroid moves.

Kept are vectors with exactly ``dimensions`` components, none null or non-finite. Rows that repeat a vec_id, or have
none, are vectors of their own (a null vec_id hashes as if it were the empty text, and numbers centroids last among
equal hashes). Fewer kept vectors than centroids: each starts one. None kept: no rows. A component over 2**27 in magnitude
after scaling is an error, as squared distances would not fit a long. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
#: Magnitude up to which squared distances of scaled components fit a long.
MOST = 1 << 27
#: Vectors of one bucket.
BUCKET_ROWS = 1 << 20
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9

BOUNDS = "row long, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double, measured int"
SUMS = "of_cluster int, n long, sums array<long>"


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that count, as integers floor(scale * component)."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    fits = F.forall(x, lambda v: F.abs(v.cast("double") * scale) <= MOST)
    floors = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size(x) == dimensions) & whole)
    return kept.select("vec_id", F.when(fits, floors).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("x"))


class Centroids:
    """Integer centroids, and how far each moved in the last update."""

    def __init__(self, at: np.ndarray, moved: np.ndarray | None = None):
        self.at, self.moved = at, np.zeros(len(at)) if moved is None else moved

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of every row of ``x`` to every centroid."""
        if max(np.abs(x).max(initial=0), np.abs(self.at).max(initial=0)) <= 1 << 22 and x.shape[1] <= 128:
            # All terms are integers below 2**53: exact in doubles.
            a, c = x.astype(np.float64), self.at.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
        return np.stack([np.square(x - c).sum(1) for c in self.at], axis=1)

    def updated(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        """Floors of means; centroids without vectors stay."""
        at = self.at.copy()
        for k, (n, of) in sums.items():
            at[k] = [s // n for s in of]
        return Centroids(at, np.sqrt(np.square(at - self.at).sum(1).astype(np.float64)))

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.at[k].tolist())).encode()).hexdigest()


def rescan(x: np.ndarray, centroids: Centroids, bounds: int) -> dict[str, np.ndarray]:
    """Bounds of vectors measured against all centroids."""
    squared = centroids.squared(x)
    order = np.argsort(squared, axis=1, kind="stable")  # equal distances: the smaller number first
    ranked = np.take_along_axis(squared, order, 1)
    roots = np.sqrt(ranked.astype(np.float64))
    n, k = squared.shape
    rest = roots[:, bounds + 1] * _DOWN if bounds + 1 < k else np.full(n, np.inf)
    return {"cluster": order[:, 0], "distance": ranked[:, 0], "upper": roots[:, 0] * _UP, "near": order[:, 1 : bounds + 1], "lower": roots[:, 1 : bounds + 1] * _DOWN, "rest": rest, "measured": np.full(n, k)}


def assign(x: np.ndarray, state: dict[str, np.ndarray] | None, centroids: Centroids, bounds: int) -> dict[str, np.ndarray]:
    """Nearest centroids of ``x`` and their bounds after the centroids moved; measured: centroids compared for a vector."""
    bounds = min(bounds, len(centroids.at) - 1)
    if state is None or not len(x):
        return rescan(x, centroids, bounds)
    # Fewer bounds than before: the first one dropped bounds all after it.
    rest = np.minimum(state["rest"], state["lower"][:, bounds:].min(axis=1, initial=np.inf))
    near = state["near"][:, :bounds]
    upper = (state["upper"] + centroids.moved[state["cluster"]]) * _UP
    lower = np.maximum(0, (state["lower"][:, :bounds] - centroids.moved[near]) * _DOWN)
    rest = np.maximum(0, (rest - centroids.moved.max()) * _DOWN)
    # Bound i certifies that centroids from i on are farther: it and all later ones lie above the upper bounds of those before it.
    later = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    certain = upper[:, None] < later
    place = np.where(certain.any(1), certain.argmax(1), bounds + 1)
    found = {"cluster": state["cluster"].copy(), "distance": np.zeros(len(x), np.int64), "upper": upper, "near": near.copy(), "lower": lower, "rest": rest, "measured": place + 1}
    for p in np.unique(place):
        rows = np.flatnonzero(place == p)
        if p > bounds:
            for name, values in rescan(x[rows], centroids, bounds).items():
                found[name][rows] = values
            continue
        # Those before the place are measured, and stand in their new order before it.
        members = np.concatenate([found["cluster"][rows, None], near[rows, :p]], axis=1)
        squared = np.square(x[rows, None, :] - centroids.at[members]).sum(2)
        order = np.lexsort((members, squared), axis=1)
        members, squared = np.take_along_axis(members, order, 1), np.take_along_axis(squared, order, 1)
        roots = np.sqrt(squared.astype(np.float64))
        found["cluster"][rows], found["distance"][rows], found["upper"][rows] = members[:, 0], squared[:, 0], roots[:, 0] * _UP
        found["near"][rows, :p] = members[:, 1:]
        found["lower"][rows, :p] = roots[:, 1:] * _DOWN
    return found


def _matrix(batch: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, width)


def _round(centroids: Centroids, bounds: int, held: int | None, dimensions: int):
    """A mapInArrow function: rows of bounds, and for each batch the sums of its vectors by centroid.

    ``held`` is the number of bounds in the state that the rows carry, None before the first round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, state = _matrix(batch, "x", np.int64, dimensions), None
            if held is not None:
                state = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest")}
                state |= {"near": _matrix(batch, "near", np.int64, held), "lower": _matrix(batch, "lower", np.float64, held)}
            found = assign(x, state, centroids, bounds)
            used, n = np.unique(found["cluster"], return_counts=True)
            sums = [x[found["cluster"] == k].sum(0).tolist() for k in used]
            rows, more = batch.num_rows, len(used)
            row = batch.column("row").to_pylist()
            flat = lambda v, kind: pa.array([*v, *[None] * more], kind)
            yield pa.record_batch(
                {
                    "row": pa.array(row + row[:1] * more, pa.int64()),
                    "cluster": flat(found["cluster"].tolist(), pa.int32()),
                    "distance": flat(found["distance"].tolist(), pa.int64()),
                    "upper": flat(found["upper"].tolist(), pa.float64()),
                    "near": flat(found["near"].tolist(), pa.list_(pa.int32())),
                    "lower": flat(found["lower"].tolist(), pa.list_(pa.float64())),
                    "rest": flat(found["rest"].tolist(), pa.float64()),
                    "measured": flat(found["measured"].tolist(), pa.int32()),
                    "of_cluster": pa.array([None] * rows + used.tolist(), pa.int32()),
                    "n": pa.array([None] * rows + n.tolist(), pa.int64()),
                    "sums": pa.array([None] * rows + sums, pa.list_(pa.int64())),
                }
            )

    return run


class Buckets:
    """Tables in the shared folder that are bucketed by row alike, so that they join without an exchange."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.database = spark, n, f"clusters_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{shared_dir(spark)}/{self.database}'")

    def write(self, rows: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        """``dealt``: the rows come from joined buckets, and each task has those of one."""
        rows = rows if dealt else rows.repartition(self.n, "row")
        rows.write.bucketBy(self.n, "row").sortBy("row").saveAsTable(f"{self.database}.{name}")
        return self.spark.table(f"{self.database}.{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.database}.{name}")


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes, in their order; equal hashes in the order of their components."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = kept.select(place.alias("place"), F.col("vec_id").isNull().alias("none"), "x").orderBy("place", "none", "x").limit(clusters).collect()
    return np.array([r.x for r in least], np.int64)


def drake_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, measured.

    ``measured`` is the number of centroids that the last assignment compared the vector with.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions)
    start = first_centroids(kept, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured int"
    if not len(start):
        return spark.createDataFrame([], schema)
    buckets = Buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // bucket_rows)))
    table = buckets.write(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")
    centroids, state, held = Centroids(start), None, None
    bounds = max(1, len(start) // 4)
    for turn in range(rounds + 1):
        rows = table.select("row", "x")
        if state is not None:
            rows = rows.join(state.filter("cluster IS NOT NULL").select("row", "cluster", "upper", "near", "lower", "rest"), "row")
        state = buckets.write(rows.mapInArrow(_round(centroids, bounds, held, dimensions), f"{BOUNDS}, {SUMS}"), f"bounds_{turn}", dealt=True)
        if turn:
            buckets.drop(f"bounds_{turn - 1}")
        held = min(bounds, len(start) - 1)
        if turn == rounds:
            break
        component = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(dimensions)]
        # One row for each centroid.
        totals = state.filter("of_cluster IS NOT NULL").groupBy("of_cluster").agg(F.sum("n").alias("n"), F.array(*component).alias("sums")).collect()
        centroids = centroids.updated({r.of_cluster: (r.n, [int(v) for v in r.sums]) for r in totals})
        if turn:
            needed = state.filter(F.col("measured") <= held + 1).agg(F.max("measured")).first()[0]
            bounds = max(1, len(start) // 8, min(bounds, (needed or held + 1) - 1))
        if not centroids.moved.any():
            break
    assigned = state.filter("cluster IS NOT NULL").select("row", "cluster", "distance", "measured")
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of")).collect()
    total = sum(int(r.of) for r in by_cluster)
    facts = spark.createDataFrame([(r.cluster, int(r.of), total, centroids.digest(r.cluster)) for r in by_cluster], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = table.select("row", "vec_id").join(assigned, "row").join(F.broadcast(facts), "cluster")
    return found.select(*[c.split()[0] for c in schema.split(", ")])


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The plain algorithm in DuckDB SQL, round after round, over long tables of components."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dimensions})""",
        f"""xs AS MATERIALIZED (SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)""",
        f"""first AS (SELECT vec_id, r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {clusters})""",
        """c0 AS MATERIALIZED (SELECT c, i, x AS v FROM first JOIN xs USING (r))""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""d{k} AS MATERIALIZED (SELECT r, c, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM xs JOIN c{k} USING (i) GROUP BY r, c)"""
        )
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM xs JOIN a{k} USING (r) GROUP BY c, i)""")
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM c{k} LEFT JOIN s{k} USING (c, i))"""
            )
    return f"""WITH {", ".join(steps)},
        hashed AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN hashed USING (c) JOIN kept USING (r)"""


SQL = clusters_sql()
