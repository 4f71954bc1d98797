"""Expectation steps over a stream: each batch's sums are written once, and merged they are those of all rows together.

Sums under the same parameters add up, so that a pass over a stream, in whatever batches and with whatever restarts, gives
the step that a batch run over the same rows gives. A batch's sums lie under its number; a batch that runs again after a
failure writes the same place again, so that nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import mixture


def accumulate(stream: DataFrame, statistics: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> None:
    """Runs ``statistics`` on each batch of what ``stream`` has by now and writes the results under ``folder``.

    ``checkpoint`` remembers which rows have been read; both lie where driver and executors see them. Called again, it
    goes on with rows that have come since. ``statistics`` must add up: its rows over two batches together are the sums of
    those over each.
    """

    def merge(batch: DataFrame, number: int) -> None:
        statistics(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The sums of all batches by ``keys``: every other column is added up."""
    rows = spark.read.parquet(folder).drop("batch")
    sums = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def mixture_step(stream: DataFrame, value: str, params: list[tuple[float, float, float]], folder: str, checkpoint: str) -> DataFrame:
    """One row: the sums of ``mixture.em_step`` over a stream of observations, under ``params``. Nulls say nothing."""
    accumulate(stream, lambda rows: mixture.em_step(mixture.coded(rows.where(F.col(value).isNotNull()), value), params), folder, checkpoint)
    return merged(stream.sparkSession, folder, [])


def fit_mixture(source: Callable[[], DataFrame], value: str, params: list[tuple[float, float, float]], steps: int, folder: str, floor: float = 1e-12) -> tuple[list[tuple[float, float, float]], list[float]]:
    """``steps`` EM steps, each a pass over the stream that ``source`` opens; the parameters and log likelihoods, as
    ``mixture.fit_gaussians`` over the same rows in one batch. A pass that was cut off goes on where it stood."""
    trace = []
    for step in range(steps):
        r = mixture_step(source(), value, params, f"{folder}/sums-{step}", f"{folder}/read-{step}").first()
        if r["log_likelihood"] is None:
            break
        trace.append(r["log_likelihood"])
        params = mixture.next_gaussians(r, params, floor)
    return params, trace
