"""Mixture operators: count and Gaussian log densities, E and M steps, clustering cost, seeds, coded observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weftline.functions.columns import keyed_uniform, log_gamma
from weftline.operators.segments import numbered
from weftline.sources.shared import cut


def coded(rows: DataFrame, value: str) -> DataFrame:
    """value, n: the distinct observations and how often each occurs; families are evaluated once per code."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def _counted(x: Column, most: Column | float | None, log: Column) -> Column:
    """``log`` for whole x from 0 to ``most``; -inf for others, null for null."""
    outside = (x < 0) | (x != F.floor(x)) if most is None else (x < 0) | (x > most) | (x != F.floor(x))
    return F.when(outside, F.lit(float("-inf"))).otherwise(log)


def _log_binomial(n: Column, x: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1)


def poisson_log(x: Column, rate: float) -> Column:
    """The log density of counts of any size; -inf for what is no count."""
    return _counted(x, None, x * F.lit(math.log(rate)) - F.lit(rate) - log_gamma(x + 1))


def binomial_log(x: Column, n: int, p: float) -> Column:
    return _counted(x, n, _log_binomial(F.lit(float(n)), x) + x * F.lit(math.log(p)) + (F.lit(n) - x) * F.lit(math.log1p(-p)))


def negative_binomial_log(x: Column, size: float, p: float) -> Column:
    """The count of failures before ``size`` successes of probability ``p``; counts of any size."""
    return _counted(x, None, log_gamma(x + size) - F.lit(math.lgamma(size)) - log_gamma(x + 1) + F.lit(size * math.log(p)) + x * F.lit(math.log1p(-p)))


def beta_binomial_log(x: Column, n: int, a: float, b: float) -> Column:
    top = F.lit(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.lgamma(a + b + n))
    return _counted(x, n, _log_binomial(F.lit(float(n)), x) + log_gamma(x + a) + log_gamma(F.lit(n) - x + b) + top)


def gaussian_log(x: Column, mean: Column | float, var: Column | float) -> Column:
    mean, var = (F.lit(float(v)) if not isinstance(v, Column) else v for v in (mean, var))
    return -0.5 * (F.log(2 * math.pi * var) + (x - mean) * (x - mean) / var)


def em_step(codes: DataFrame, params: list[tuple[float, float, float]]) -> DataFrame:
    """One row with, for each component k of (weight, mean, var): n{k}, s{k}, q{k} (the sums of its posterior, of that times
    the value, and times its square), and log_likelihood.

    Components are unrolled into the projection, so a step is one scan and one partial aggregate of distinct values.
    """
    x = F.col("value").cast("double")
    logs = [F.lit(math.log(w)) + gaussian_log(x, m, v) for w, m, v in params]
    codes = codes.select("n", x.alias("value"), *(c.alias(f"l{k}") for k, c in enumerate(logs)))
    top = F.greatest(*(f"l{k}" for k in range(len(params)))) if len(params) > 1 else F.col("l0")
    codes = codes.withColumn("top", top)
    total = sum((F.exp(F.col(f"l{k}") - F.col("top")) for k in range(len(params))), F.lit(0.0))
    codes = codes.withColumn("total", total)
    post = [F.col("n") * F.exp(F.col(f"l{k}") - F.col("top")) / F.col("total") for k in range(len(params))]
    sums = [F.sum(p * f).alias(f"{name}{k}") for k, p in enumerate(post) for name, f in (("n", F.lit(1.0)), ("s", F.col("value")), ("q", F.col("value") * F.col("value")))]
    return codes.agg(*sums, F.sum(F.col("n") * (F.col("top") + F.log("total"))).alias("log_likelihood"))


def fit_gaussians(codes: DataFrame, params: list[tuple[float, float, float]], steps: int, floor: float = 1e-12) -> tuple[list[tuple[float, float, float]], list[float]]:
    """``steps`` EM steps; the driver sees three sums a component and step. Returns the parameters and log likelihoods.

    Variances stay at ``floor`` or above. A component that nothing belongs to keeps its mean and variance and the least
    weight that a double can hold, so that it is never the only one.
    """
    trace = []
    for _ in range(steps):
        r = em_step(codes, params).first()
        if r["log_likelihood"] is None:  # no rows
            break
        trace.append(r["log_likelihood"])
        params = next_gaussians(r, params, floor)
    return params, trace


def next_gaussians(r: Row, params: list[tuple[float, float, float]], floor: float = 1e-12) -> list[tuple[float, float, float]]:
    """The parameters after the M step on the sums ``r`` of ``em_step``."""
    n, new = sum(r[f"n{k}"] for k in range(len(params))), []
    for k, (_, mean, var) in enumerate(params):
        own = r[f"n{k}"]
        if own > 0:
            mean = r[f"s{k}"] / own
            var = max(r[f"q{k}"] / own - mean**2, floor)
        new.append((max(own / n, 5e-324), mean, var))
    return new


def merge_criterion(codes: DataFrame, params: list[tuple[float, float, float]]) -> DataFrame:
    """i < j, cosine: how alike two components share out the observations; null where one has none.

    One scan and one aggregate of the products of all pairs of components.
    """
    x, k = F.col("value").cast("double"), len(params)
    logs = [F.lit(math.log(w)) + gaussian_log(x, m, v) for w, m, v in params]
    rows = codes.select("n", *(c.alias(f"l{j}") for j, c in enumerate(logs)))
    rows = rows.withColumn("top", F.greatest(*(f"l{j}" for j in range(k))) if k > 1 else F.col("l0"))
    rows = rows.withColumn("total", sum((F.exp(F.col(f"l{j}") - F.col("top")) for j in range(k)), F.lit(0.0)))
    rows = rows.select("n", *((F.exp(F.col(f"l{j}") - F.col("top")) / F.col("total")).alias(f"r{j}") for j in range(k)))
    sums = rows.agg(*(F.sum(F.col("n") * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)))
    told = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.try_divide(F.col(f"s{i}_{j}"), F.sqrt(F.col(f"s{i}_{i}") * F.col(f"s{j}_{j}"))).alias("cosine")) for i in range(k) for j in range(i + 1, k)]
    return sums.select(F.explode(F.array(*told)).alias("e")).select("e.i", "e.j", "e.cosine")


def clustering_cost(rows: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """cluster, n, cost: rows by their nearest centre (ties to the first) and the sum of their squared distances."""
    far = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d) for c in centres]
    best = F.least(*(F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(far)))
    return rows.select(best.alias("b")).groupBy(F.col("b.k").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.sum("b.d").alias("cost"))


def quantile_seeds(rows: DataFrame, value: str, k: int) -> DataFrame:
    """seed, location: the quantiles (i + 1/2) / k of a column, exact, between its values where they fall between places.

    Values are ranked by range partitions; only those at the wanted places are picked. Nulls are left out; without values
    there are no rows.
    """
    laid = numbered(rows.select(F.lit(0).alias("all"), F.col(value).cast("double").alias("v")).where("v is not null"), "all", ["v"])
    n = laid.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "seed long, location double")
    wanted = [(i, (n - 1) * (i + 0.5) / k) for i in range(k)]
    places = rows.sparkSession.createDataFrame([(i, int(at) + up, (at - int(at)) if up else 1 - (at - int(at))) for i, at in wanted for up in (0, 1)], "seed long, k long, share double")
    return laid.select("k", "v").join(F.broadcast(places), "k").groupBy("seed").agg(F.sum(F.col("v") * F.col("share")).alias("location"))


def _race(share: Column, key: str, seed: int, turn: int) -> Column:
    """When a row of weight ``share`` arrives: the first to arrive is a draw in proportion to the weights."""
    return -F.log(keyed_uniform(F.lit(seed), F.lit(turn), F.col(key)) + 2.0**-33) / share


def plus_plus_seeds(rows: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """seed, ``key``, ``vector``: k rows drawn as starts, each in proportion to its squared distance from the nearest so far.

    A draw is a race of exponential times whose keyed uniforms depend on the seed, the turn and the row's key alone, so that
    partitions don't matter; ties go to the smaller key. The first is drawn evenly, and so is one that finds all rows on
    starts already. The squared distances are kept from turn to turn, and one row a turn comes to the driver. Rows without
    a key or a vector take no part; of fewer than k rows, rows repeat, and without rows there are no starts.
    """
    spark = rows.sparkSession
    left = cut(rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("d")))
    chosen = []
    for turn in range(k):
        even = F.struct(_race(F.lit(1.0), key, seed, turn).alias("t"), F.col(key).alias("key"))
        far = F.struct(_race(F.col("d"), key, seed, turn).alias("t"), F.col(key).alias("key"))
        r = left.agg(F.min(F.when(F.col("d") > 0, F.struct(far.alias("o"), F.col("v")))).alias("far"), F.min(F.struct(even.alias("o"), F.col("v"))).alias("even"), F.max("d").alias("most")).first()
        best = r["far"] if (r["most"] or 0) > 0 else r["even"]
        if best is None:
            break
        chosen.append((turn, best["o"]["key"], best["v"]))
        if turn < k - 1:
            centre = F.array(*map(F.lit, best["v"]))
            d = F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
            left = cut(left.select(key, "v", F.least(d, "d").alias("d")))
    kind = rows.schema[key].dataType.simpleString()
    return spark.createDataFrame(chosen, f"seed long, `{key}` {kind}, `{vector}` array<double>")
