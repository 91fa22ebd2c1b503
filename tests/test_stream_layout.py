"""Streams give the same rows however the input is cut into files and batches."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from meshspark import catalog, fixtures
from meshspark.streaming import live


@pytest.fixture(scope="module")
def cut(spark, sf):
    """A copy of the tables as folders of four part files each, newest rows in the first file."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, key in (("lineitem", "l_orderkey"), ("events", "event_id"), ("part", "p_partkey")):
        d = fixtures.table(spark, sf, name)
        d.repartitionByRange(4, F.desc(key)).sortWithinPartitions(F.desc(key)).write.parquet(f"{base}/{name}.parquet")
    return base


def one_file_a_batch(monkeypatch):
    plain = live.file_stream
    monkeypatch.setattr(live, "file_stream", lambda s, p, schema, files_per_batch=1: plain(s, p, schema, 1))


@pytest.mark.parametrize("name", ["stream_claim", "stream_confirm", "stream_waypoints", "stream_throughput"])
def test_same_rows_in_many_batches(spark, sf, cut, monkeypatch, name):
    want = sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))
    one_file_a_batch(monkeypatch)
    got = sorted(map(str, catalog.QUERIES[name](spark, cut).collect()))
    assert got == want and want


def test_horizon_closes_cycles_and_counts_late_rows(spark):
    rows = [(0, c, 3, 5) for c in (1, 2, 3, 9, 2, 4)]
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "run_id bigint, cycle bigint, label bigint, n bigint").coalesce(1).write.mode("append").parquet(base)
        for f in os.listdir(base):
            if f.startswith("part") and os.path.getmtime(f"{base}/{f}") > 1e6:
                os.utime(f"{base}/{f}", (1000 + i, 1000 + i))
    s = live.file_stream(spark, base, spark.read.parquet(base).schema, 1)
    t = live.run_to_table(live.confirm_labels(s, 1, 3, horizon=4), tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "update")
    assert [tuple(r) for r in live.confirmed(t).collect()] == [(0, 3, 3)]
    assert t.agg(F.max("late_rows")).first()[0] == 1


def test_rows_behind_a_watermark_are_counted(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, day in enumerate((20, 10, 1)):
        spark.sql(f"select 0L run_id, 'mesh' frame_type, timestamp'2024-01-{day:02d}' ts, 8L bytes").write.mode("append").parquet(base)
        for f in os.listdir(base):
            if f.startswith("part") and os.path.getmtime(f"{base}/{f}") > 1e6:
                os.utime(f"{base}/{f}", (1000 + i, 1000 + i))
    out = lambda: tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = lambda: live.file_stream(spark, base, spark.read.parquet(base).schema, 1)
    assert live.run_to_table(live.throughput(s(), "1 day"), out(), "update").count() == 3
    lost = []
    t = live.run_to_table(live.throughput(s(), "1 day", "2 days"), out(), "update", losses=lost.append)
    assert t.count() + lost[0] == 3 and lost[0] > 0  # one file a batch, one window a row: what is not counted is reported
    with pytest.raises(ValueError):
        live.run_to_table(live.throughput(s(), "1 day", "2 days"), out(), "update")


def test_many_small_files_are_one_batch(spark):
    base, batches = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), []
    spark.range(400).repartition(40).write.parquet(f"{base}/in")
    t = live.run_to_table(live.file_stream(spark, f"{base}/in", "id bigint"), f"{base}/out", each=lambda d, n: batches.append(n) or d)
    assert batches == [0] and t.count() == 400
