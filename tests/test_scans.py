"""Scans that stop half-way and go on: each file once, new files in batches of their own."""

import pytest
from pyspark.sql import functions as F

from stackwright.streaming import scans


def checked(rows):
    return rows.select("rel", "batch_id", F.when(F.col("size") > 50, "broken").otherwise("clean").alias("bucket"))


def table(spark, n, start=0):
    return spark.createDataFrame([(f"d{k % 7}/{k:03d}.flac", k) for k in range(start, n)], "rel string, size int")


@pytest.mark.parametrize("stop_after", [1, 3])
def test_a_stopped_scan_goes_on(spark, tmp_path, stop_after):
    files, folder = table(spark, 101), str(tmp_path / "scan")
    half = scans.run(files, checked, folder, batch_size=10, batches_at_once=3, most_rounds=stop_after)
    assert 0 < half.count() < 101
    state = scans.summary(folder, spark).first()
    assert (state.planned, state.done) == (101, half.count()) and state.waiting == 101 - half.count()
    before = {(r.rel, r.batch_id) for r in half.collect()}
    touched = []

    def counted(rows):
        touched.extend(r.rel for r in rows.collect())
        return checked(rows)

    # Files came in meanwhile, and the plan of the others stays.
    whole = scans.run(table(spark, 120), counted, folder, batch_size=10, batches_at_once=3)
    rows = [(r.rel, r.batch_id, r.bucket) for r in whole.collect()]
    assert sorted(r[0] for r in rows) == sorted(r.rel for r in table(spark, 120).collect())
    assert before <= {(r[0], r[1]) for r in rows}
    assert not set(touched) & {rel for rel, _ in before} and len(touched) == len(set(touched))
    assert {r[2] for r in rows if int(r[0][3:6]) > 50} == {"broken"}
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    assert (manifest.total_files, manifest.mode, manifest.batch_size) == (120, "doctor", 10)


def test_a_batch_written_twice_counts_once_and_a_half_one_waits(spark, tmp_path):
    files, folder = table(spark, 20), str(tmp_path)
    planned = scans.plan(files, folder, 5)
    first = checked(files.join(planned, "rel")).filter("batch_id = 0")
    for _ in range(2):
        scans.write_results(first, folder)
    assert spark.read.parquet(f"{folder}/results").count() == 5
    scans.write_results(first.limit(2), folder)
    assert scans.waiting(planned, folder).filter("batch_id = 0").count() == 5
    whole = scans.run(files, checked, folder, batch_size=5)
    assert whole.count() == 20 and whole.select("rel").distinct().count() == 20


def test_nothing_to_scan(spark, tmp_path):
    assert scans.run(table(spark, 0), checked, str(tmp_path / "scan")).count() == 0
