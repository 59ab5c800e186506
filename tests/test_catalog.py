from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stackwright import queries
from stackwright.operators import catalog as op

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(value):
    """``value`` so that equal values of both engines are equal and hashable: rows and maps by name, lists as tuples."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    rows = Counter(tuple(_plain(r[c]) for c in names) for r in found.collect())
    wanted = duck.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in wanted.description].index(c) for c in names]
    assert rows == Counter(tuple(_plain(r[i]) for i in order) for r in wanted.fetchall())


def test_completeness_of_nothing_is_100(spark):
    assert op.completeness(spark.createDataFrame([], "a string"), F.col("a").isNull()).first().percent == 100


def test_blank_rows_are_duplicates(spark):
    rows = spark.createDataFrame([(1, None, " A"), (2, "", "a "), (3, None, "b")], "id int, x string, y string")
    assert {r.id for r in op.duplicate_members(rows, ["x", "y"]).collect()} == {1, 2}


def test_page_holds_its_limits(spark):
    rows = spark.range(300)
    assert op.page(rows, ["id"], -5, 1000).count() == 100
    assert [r.id for r in op.page(rows, ["id"], 10, 0).collect()] == [10]


def test_pairs_of_a_frequent_key_are_dealt_out(spark, tmp_path):
    """One file's rows of one key and size: all pairs, from several partitions, none held back by the file's single one."""
    spark.range(2500, numPartitions=1).selectExpr("id", "'a' AS k", "CAST(id % 2 * 200 AS double) AS size").write.parquet(str(tmp_path / "rows"))
    pairs = op.band_pairs(spark.read.parquet(str(tmp_path / "rows")), "k", "id", "size")
    found = pairs.withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.count("*").alias("n"), F.count_distinct("left_id", "right_id").alias("different"))
    counts = found.collect()
    assert sum(r.n for r in counts) == sum(r.different for r in counts) == 2 * 1250 * 1249
    assert len(counts) > 1


def _joined_rows(plan):
    """Rows that the merge joins of an executed plan put out."""
    name = plan.nodeName()
    below = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if name == "SortMergeJoin" else 0) + sum(map(_joined_rows, below))


def test_pairs_of_a_frequent_size_meet_as_arrays(spark):
    """One key and size: a row for each first row and block comes out of the join; it was one for each pair."""
    pairs = op.band_pairs(spark.range(1500).selectExpr("id", "'a' AS k", "1D AS size"), "k", "id", "size").groupBy().agg(F.count("*").alias("n"), F.sum(F.hash("left_id", "right_id")).alias("s"))
    wanted = spark.range(1500).alias("a").crossJoin(spark.range(1500).alias("b")).filter("a.id <> b.id").agg(F.count("*").alias("n"), F.sum(F.hash("a.id", "b.id")).alias("s"))
    assert pairs.collect() == wanted.collect()
    assert 0 < _joined_rows(pairs._jdf.queryExecution().executedPlan().executedPlan()) <= 2 * 1500


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_pairs_of_odd_rows(spark, monkeypatch, block):
    """Sizes below zero and over 5 / 3 %, ids twice and under two sizes, nulls; blocks of any length."""
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    sizes = [-7.0, -2.0, 0.0, 3.0, 3.0, 3.0, 5.0, 8.0, 200.0, 205.9, 206.0, 206.1, 212.1, 300.0, 309.0, 309.2, 318.3]
    rows = [(i, k, s) for k in "ab" for i, s in enumerate(sizes)] + [(3, "a", 3.0), (3, "a", 4.0), (None, "a", 3.0), (50, None, 3.0), (51, "a", None)]
    found = op.band_pairs(spark.createDataFrame(rows, "id long, k string, size double"), "k", "id", "size")
    known = [r for r in rows if None not in r]
    wanted = Counter((k, i, j) for i, k, s in known for j, other, t in known if k == other and i != j and abs(s - t) <= max(5.0, s * 0.03))
    assert Counter(map(tuple, found.collect())) == wanted
    assert found.columns == ["key", "left_id", "right_id"]
