"""Queries on the M steps of count families and on the seeding of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.columns import uniform_sql
from weftline.operators import families, mixture
from weftline.plans.common import table

STEPS, SEEDS = 200, 5


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("state"), F.col("l_quantity").cast("double").alias("n"), (1 + F.pmod("l_linenumber", F.lit(3))).cast("double").alias("w"))


def _dispersions(spark: SparkSession, sf: str) -> DataFrame:
    out = families.negative_binomial_m_step(_counts(spark, sf), "state", "n", "w")
    return out.select("state", "weight", F.round("mean", 6).alias("mean"), F.round("dispersion", 5).alias("dispersion"), "at_boundary")


def _concentrations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("string").alias("state"), F.col("l_quantity").cast("double").alias("n"), (50 + F.pmod("l_suppkey", F.lit(3))).cast("double").alias("of"))
    out = families.beta_binomial_m_step(rows, "state", "n", "of")
    return out.select("state", "weight", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), "at_boundary")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.plus_plus_seeds(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", SEEDS).select("seed", "vec_id")


def _tail_sql(value: str, cells: str, name: str) -> str:
    """For each state, the weight of the counts above 0, 1, ... as a list."""
    return f"{name} AS (SELECT state, list(t ORDER BY j) AS {name} FROM (SELECT state, j, coalesce(sum(w) FILTER ({value} > j), 0) AS t FROM {cells} CROSS JOIN (SELECT unnest(range(0, 60)) AS j) GROUP BY state, j) GROUP BY state)"


def _sum(name: str, x: str, square: bool = False) -> str:
    x = f"({x} + i - 1)"
    return f"list_sum(list_transform({name}, lambda t, i: t / ({x} * {x})))" if square else f"list_sum(list_transform({name}, lambda t, i: t / {x}))"


_DISPERSIONS = f"""WITH RECURSIVE c AS (SELECT l_returnflag || l_linestatus AS state, CAST(l_quantity AS DOUBLE) AS n, CAST(1 + l_linenumber % 3 AS DOUBLE) AS w FROM lineitem),
{_tail_sql("n", "c", "tl")}, s AS (SELECT state, sum(w) AS weight, sum(w * n) / sum(w) AS mean FROM c GROUP BY state),
b AS (SELECT state, weight, mean, tl, mean * sqrt(weight / 2) AS upper FROM s JOIN tl USING (state)),
r AS (SELECT state, weight, mean, tl, ln(greatest(upper * 1e-9, pow(2, -52))) AS lo, ln(upper) AS hi, 0 AS k FROM b
 UNION ALL SELECT state, weight, mean, tl, CASE WHEN {_sum("tl", "exp((lo + hi) / 2)")} + weight * ln(exp((lo + hi) / 2) / (exp((lo + hi) / 2) + mean)) > 0 THEN (lo + hi) / 2 ELSE lo END,
 CASE WHEN {_sum("tl", "exp((lo + hi) / 2)")} + weight * ln(exp((lo + hi) / 2) / (exp((lo + hi) / 2) + mean)) > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM r WHERE k < 60)
SELECT state, weight, round(mean, 6) AS mean, round(exp((lo + hi) / 2), 5) AS dispersion, {_sum("tl", "exp(hi)")} + weight * ln(exp(hi) / (exp(hi) + mean)) > 0 AS at_boundary FROM r WHERE k = 60"""
#: Minka's fixed point, which climbs slowly but surely.
_CONCENTRATIONS = f"""WITH RECURSIVE c AS (SELECT CAST(l_linenumber AS VARCHAR) AS state, CAST(l_quantity AS DOUBLE) AS n, CAST(50 + l_suppkey % 3 AS DOUBLE) AS o, 1.0::DOUBLE AS w FROM lineitem),
{_tail_sql("n", "c", "sa")}, {_tail_sql("o - n", "c", "sb")}, {_tail_sql("o", "c", "sn")}, s AS (SELECT state, sum(w) AS weight, sum(n) / sum(o) AS p FROM c GROUP BY state),
r AS (SELECT state, weight, sa, sb, sn, 2 * p AS a, 2 * (1 - p) AS b, 0 AS k FROM s JOIN sa USING (state) JOIN sb USING (state) JOIN sn USING (state)
 UNION ALL SELECT state, weight, sa, sb, sn, a * {_sum("sa", "a")} / {_sum("sn", "(a + b)")}, b * {_sum("sb", "b")} / {_sum("sn", "(a + b)")}, k + 1 FROM r WHERE k < {STEPS})
SELECT state, weight, round(a, 5) AS alpha, round(b, 5) AS beta, false AS at_boundary FROM r WHERE k = {STEPS}"""


def _seeds_sql() -> str:
    d = lambda t: f"list_sum(list_transform(list_zip(e.v, s{t}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    race = lambda t, share: f"-ln({uniform_sql('0', str(t), 'vec_id')} + pow(2, -33)) / {share}"
    out = [f"e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s0 AS (SELECT vec_id, v FROM e ORDER BY {race(0, '1')}, vec_id LIMIT 1)"]
    for t in range(1, SEEDS):
        near = d(t - 1) if t == 1 else f"least({', '.join(d(j) for j in range(t))})"
        joins = " ".join(f"CROSS JOIN s{j}" for j in range(t))
        out.append(f"d{t} AS (SELECT e.vec_id, e.v, {near} AS d FROM e {joins}), s{t} AS (SELECT vec_id, v FROM d{t} WHERE d > 0 ORDER BY {race(t, 'd')}, vec_id LIMIT 1)")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS seed, vec_id FROM s{t}" for t in range(SEEDS))


QUERIES = {
    "dispersion_m_step": (_dispersions, _DISPERSIONS),
    "concentration_m_step": (_concentrations, _CONCENTRATIONS),
    "plus_plus_seeds": (_seeds, _seeds_sql()),
}
