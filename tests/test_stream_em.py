"""EM over a stream of files equals EM over the same rows in one batch, also after a restart and a batch that ran twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import mixture
from weftline.streaming import em

START = [(0.5, 0.0, 4.0), (0.5, 8.0, 4.0)]


@pytest.fixture
def rows(spark):
    return spark.range(600).select(F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise((F.col("id") % 2) * 6 + F.sin("id") * 2).alias("x"))


def test_a_stream_ends_where_the_batch_run_does(spark, rows, tmp_path):
    data, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    rows.repartition(5).write.parquet(data)
    source = lambda: spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(data)
    params, trace = em.fit_mixture(source, "x", START, 3, folder)
    want, likelihoods = mixture.fit_gaussians(mixture.coded(rows.where("x is not null"), "x"), START, 3)
    assert trace == pytest.approx(likelihoods)
    assert [v for p in params for v in p] == pytest.approx([v for p in want for v in p])
    assert spark.read.parquet(f"{folder}/sums-0").count() == 5  # a row a batch


def test_a_restart_goes_on_and_counts_nothing_twice(spark, rows, tmp_path):
    data, sums, read = f"{tmp_path}/in", f"{tmp_path}/sums", f"{tmp_path}/read"
    rows.limit(200).coalesce(1).write.parquet(data)
    stream = lambda: spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(data)
    first = em.mixture_step(stream(), "x", START, sums, read).first()
    assert em.mixture_step(stream(), "x", START, sums, read).first() == first  # nothing new
    rows.subtract(rows.limit(200)).repartition(3).write.mode("append").parquet(data)
    failed = {"n": 0}

    def broken(batch):
        if failed["n"] == 1:
            failed["n"] += 1
            raise RuntimeError("lost")
        failed["n"] += 1
        return mixture.em_step(mixture.coded(batch.where("x is not null"), "x"), START)

    with pytest.raises(Exception, match="lost"):
        em.accumulate(stream(), broken, sums, read)
    got = em.mixture_step(stream(), "x", START, sums, read).first()
    whole = spark.read.parquet(data).where("x is not null")
    want = mixture.em_step(mixture.coded(whole, "x"), START).first()
    assert list(got) == pytest.approx(list(want))
