"""Metric series: an append-only log of Parquet files, summed up in batch or as a stream by the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run string, name string, context map<string,string>, step long, value double, ts timestamp"
COLUMNS = ("run", "name", "context", "step", "value", "ts")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows of SCHEMA to the log; what is there stays."""
    rows.select(*COLUMNS).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, streaming: bool = False, files: int = 100) -> DataFrame:
    """The log as a table, or as a stream that takes up to ``files`` new files at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path) if streaming else spark.read.schema(SCHEMA).parquet(path)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``series``: the context as JSON, its keys in order, so that equal contexts are one series; null is {}."""
    entries = F.array_sort(F.map_entries(F.coalesce("context", F.create_map().cast("map<string,string>"))))
    return rows.withColumn("series", F.to_json(F.map_from_entries(entries)))


def summary(rows: DataFrame) -> DataFrame:
    """run, name, series, n, mean, best (least) and last (of the highest step, the largest value if steps tie).

    Null values are left out. All are partial aggregates: a stream keeps one row of state a series.
    """
    known = keyed(rows).where("value is not null")
    out = known.groupBy("run", "name", "series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("best"), F.max(F.struct("step", "value")).alias("at"))
    return out.select("run", "name", "series", "n", "mean", "best", F.col("at.value").alias("last"))


def windowed(rows: DataFrame, width: str, late: str) -> DataFrame:
    """start, run, name, n, mean over windows of ``width``; a stream drops what comes later than ``late`` after its window."""
    known = rows.where("value is not null").withWatermark("ts", late)
    out = known.groupBy(F.window("ts", width).alias("w"), "run", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "run", "name", "n", "mean")


def keep_summary(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the summary of a stream after each of its batches to ``path``/batch=N, until what is there now is read."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return summary(rows).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
