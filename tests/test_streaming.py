"""Streams over several files give what a batch over all of them gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadlake.streaming import online

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def folder(spark, tmp_path):
    kinds = ["view", "click", "error", "purchase", "signup"]
    for part in range(3):
        rows = [(part * 100 + k, START + dt.timedelta(minutes=part * 300 + k * 7), k % 4, kinds[(k // 4 + part) % 5], float(k), "{}") for k in range(20)]
        spark.createDataFrame(rows, online.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def test_windows(spark, folder):
    got = online.drained(online.congestion_windows(online.event_stream(spark, folder), delay="2 days"), "update")
    last = got.groupBy("begin", "edge_id").agg(F.max_by(F.struct("n", "milli"), "batch").alias("v")).select("begin", "edge_id", "v.*")
    second = F.unix_timestamp("ts")
    want = spark.read.parquet(folder).groupBy((second - second % 900).alias("begin"), F.col("user_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 1000).cast("bigint")).alias("milli"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_smoothed_times(spark, folder):
    got = online.drained(online.smoothed_times(online.event_stream(spark, folder)), "update")
    counts = {r["edge_id"]: r["n"] for r in got.groupBy("edge_id").agg(F.max("n").alias("n")).collect()}
    assert counts == {k: 15 for k in range(4)}


def test_vehicles_arrive_or_fall_silent(spark, folder):
    got = online.drained(online.vehicle_states(online.event_stream(spark, folder)), "append").collect()
    assert {r["state"] for r in got} <= {"departed", "queued", "planned", "arrived", "silent"}
    assert {r["vehicle_id"] for r in got} == {0, 1, 2, 3}
    assert any(r["state"] == "arrived" for r in got)


def test_files_out_of_order_lose_nothing(spark, tmp_path):
    import datetime

    from roadlake.streaming import online

    base = datetime.datetime(2024, 1, 10)
    for k, hours in enumerate((48, 0, 24)):
        rows = [(k * 10 + j, base + datetime.timedelta(hours=hours, minutes=j), 1, "view", 1.0, "{}") for j in range(5)]
        spark.createDataFrame(rows, online.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = online.drained(online.congestion_windows(online.event_stream(spark, str(tmp_path / "in")), None), "update")
    assert sum(r["n"] for r in got.collect()) == 15
