"""The metric log as a table and as a stream."""

from __future__ import annotations

from datetime import datetime

from weftline.streaming import metrics

AT = datetime(2024, 1, 1, 10)
ROWS = [("r", "loss", {"a": "1", "b": "2"}, 0, 3.0, AT), ("r", "loss", {"b": "2", "a": "1"}, 1, 1.0, AT), ("r", "loss", None, 0, None, AT), ("r", "loss", {}, 2, 7.0, AT), ("s", "acc", {"a": "1"}, 5, 0.5, AT)]
WANT = [("r", "loss", '{"a":"1","b":"2"}', 2, 2.0, 1.0, 1.0), ("r", "loss", "{}", 1, 7.0, 7.0, 7.0), ("s", "acc", '{"a":"1"}', 1, 0.5, 0.5, 0.5)]


def test_a_stream_sums_up_what_a_batch_does(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    metrics.append(spark.createDataFrame(ROWS[:2], metrics.SCHEMA), log)
    query = metrics.keep_summary(metrics.read(spark, log, streaming=True), out, f"{tmp_path}/state")
    query.awaitTermination()
    metrics.append(spark.createDataFrame(ROWS[2:], metrics.SCHEMA), log)
    query = metrics.keep_summary(metrics.read(spark, log, streaming=True), out, f"{tmp_path}/state")  # goes on where it was
    query.awaitTermination()
    last = spark.read.parquet(out).selectExpr("max(batch) as n").first()["n"]
    assert sorted(map(tuple, spark.read.parquet(f"{out}/batch={last}").collect())) == sorted(WANT)
    assert sorted(map(tuple, metrics.summary(metrics.read(spark, log)).collect())) == sorted(WANT)


def test_windows(spark):
    rows = [("r", "loss", None, k, float(k), datetime(2024, 1, 1, 10, 20 * k)) for k in range(3)] + [("r", "loss", None, 9, 5.0, datetime(2024, 1, 1, 11, 5))]
    got = metrics.windowed(spark.createDataFrame(rows, metrics.SCHEMA), "1 hour", "10 minutes").select("n", "mean").collect()
    assert sorted(map(tuple, got)) == [(1, 5.0), (3, 1.0)]
    assert metrics.summary(spark.createDataFrame([], metrics.SCHEMA)).count() == 0
