"""Queries on count families, Gaussian mixtures and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import codes, mixture
from weftline.plans.common import table
from weftline.sources.shared import new_folder
from weftline.streaming import em

START = [(0.3, 20_000.0, 1e8), (0.4, 40_000.0, 2e8), (0.3, 60_000.0, 3e8)]
CENTRES = [[(1.0 if j % 4 == k else -1.0) * 0.1 for j in range(64)] for k in range(4)]


def _coded(spark, sf, value="l_quantity"):  # noqa: ANN001, ANN202
    return mixture.coded(table(spark, sf, "lineitem"), value).withColumn("value", F.col("value").cast("double"))


def _summed(family):  # noqa: ANN001, ANN202
    return lambda s, d: _coded(s, d).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * family(F.col("value"))), 4).alias("log_likelihood"))


def _sql(density: str) -> str:
    return f"WITH c AS (SELECT CAST(l_quantity AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * ({density})), 4) AS log_likelihood FROM c"


def _components(params) -> list[str]:  # noqa: ANN001
    return [f"(ln({w}::DOUBLE) - 0.5 * (ln(2 * pi() * {v!r}::DOUBLE) + (x - {m!r}::DOUBLE) * (x - {m!r}::DOUBLE) / {v!r}::DOUBLE))" for w, m, v in params]


def _e_step(spark, sf):  # noqa: ANN001, ANN202
    r = mixture.em_step(_coded(spark, sf, "l_extendedprice"), START)
    return r.select(*(F.round(F.col(f"n{k}"), 4).alias(f"n{k}") for k in range(3)), F.round(F.col("log_likelihood"), 3).alias("log_likelihood"))


def _stream_step(spark, sf):  # noqa: ANN001, ANN202
    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/lineitem.parquet*")
    folder = new_folder(spark, "stream-em")
    r = em.mixture_step(stream, "l_extendedprice", START, f"{folder}/sums", f"{folder}/read")
    return r.select(*(F.round(F.col(f"n{k}"), 4).alias(f"n{k}") for k in range(3)), F.round(F.col("log_likelihood"), 3).alias("log_likelihood"))


_L = _components(START)
_E_STEP = f"WITH c AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT n, {', '.join(f'{e} AS l{k}' for k, e in enumerate(_L))} FROM c), t AS (SELECT *, greatest(l0, l1, l2) AS m FROM l), z AS (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS s FROM t) SELECT {', '.join(f'round(sum(n * exp(l{k} - m) / s), 4) AS n{k}' for k in range(3))}, round(sum(n * (m + ln(s))), 3) AS log_likelihood FROM z"
_LISTS = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in c) + "]" for c in CENTRES) + "]"
STEPS = 3


def _fitted(spark, sf):  # noqa: ANN001, ANN202
    params, _ = mixture.fit_gaussians(_coded(spark, sf, "l_extendedprice"), START, STEPS)
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(params)], "k long, weight double, mean double, var double")
    return rows.select("k", F.round("weight", 6).alias("weight"), F.round("mean", 3).alias("mean"), F.round(F.col("var") / 1e6, 3).alias("var_millions"))


def _em_sql() -> str:
    q = range(len(START))
    out = [f"c AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY ALL), t0 AS (SELECT {', '.join(f'{w}::DOUBLE AS w{k}, {m!r}::DOUBLE AS m{k}, {v!r}::DOUBLE AS v{k}' for k, (w, m, v) in enumerate(START))})"]
    for t in range(STEPS):
        logs = ", ".join(f"ln(w{k}) - 0.5 * (ln(2 * pi() * v{k}) + (x - m{k}) * (x - m{k}) / v{k}) AS l{k}" for k in q)
        top = f"greatest({', '.join(f'l{k}' for k in q)})"
        total = " + ".join(f"exp(l{k} - top)" for k in q)
        out.append(f"r{t} AS (SELECT n, x, {', '.join(f'n * exp(l{k} - top) / ({total}) AS r{k}' for k in q)} FROM (SELECT *, {top} AS top FROM (SELECT n, x, {logs} FROM c CROSS JOIN t{t})))")
        out.append(f"t{t + 1} AS (SELECT {', '.join(f'sum(r{k}) / sum(n) AS w{k}, sum(r{k} * x) / sum(r{k}) AS m{k}, sum(r{k} * x * x) / sum(r{k}) - pow(sum(r{k} * x) / sum(r{k}), 2) AS v{k}' for k in q)} FROM r{t})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(w{k}, 6) AS weight, round(m{k}, 3) AS mean, round(v{k} / 1e6, 3) AS var_millions FROM t{STEPS}" for k in q)


_POST = f"WITH c AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT n, {', '.join(f'exp({e}) AS l{k}' for k, e in enumerate(_L))} FROM c), r AS (SELECT n, l0 / (l0 + l1 + l2) AS r0, l1 / (l0 + l1 + l2) AS r1, l2 / (l0 + l1 + l2) AS r2 FROM l)"


def _min_sum(spark, sf):  # noqa: ANN001, ANN202
    checks = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("long").alias("chk"), F.col("l_suppkey").cast("long").alias("bit")).distinct()
    llr = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("bit"), (F.col("s_acctbal").cast("double") / 1000).alias("llr"))
    return codes.min_sum_pass(checks, llr).withColumn("total", F.round("total", 6))


def _rates(spark, sf, hit):  # noqa: ANN001, ANN202
    """The share of each supplier's lines of which ``hit`` holds."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("channel")).agg(F.avg(F.when(F.expr(hit), 1.0).otherwise(0.0)).alias("p"))


def _rates_sql(column: str, value: str) -> str:
    return f"c AS (SELECT CAST(l_suppkey AS BIGINT) AS channel, avg(CASE WHEN {column} = '{value}' THEN 1::DOUBLE ELSE 0 END) AS p FROM lineitem GROUP BY 1)"


QUERIES = {
    "gmm_em_3": (_fitted, _em_sql()),
    "merge_criterion": (
        lambda s, d: mixture.merge_criterion(_coded(s, d, "l_extendedprice"), START).withColumn("cosine", F.round("cosine", 9)),
        _POST + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(sum(n * r{i} * r{j}) / sqrt(sum(n * r{i} * r{i}) * sum(n * r{j} * r{j})), 9) AS cosine FROM r" for i in range(3) for j in range(i + 1, 3)),
    ),
    "min_sum_1": (
        _min_sum,
        "WITH c AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS chk, CAST(l_suppkey AS BIGINT) AS bit FROM lineitem), m AS (SELECT chk, bit, CAST(s_acctbal AS DOUBLE) / 1000 AS llr FROM c JOIN supplier ON s_suppkey = bit), "
        "x AS (SELECT a.chk, a.bit, any_value(a.llr) AS llr, coalesce(min(abs(b.llr)), 0) AS size, count(*) FILTER (b.llr < 0) AS neg FROM m a LEFT JOIN m b ON b.chk = a.chk AND b.bit <> a.bit GROUP BY a.chk, a.bit) "
        "SELECT bit, round(any_value(llr) + sum(CASE WHEN neg % 2 = 1 THEN -size ELSE size END), 6) AS total FROM x GROUP BY bit",
    ),
    "coded_counts": (lambda s, d: _coded(s, d), "SELECT CAST(l_quantity AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY ALL"),
    "poisson_loglik": (_summed(lambda x: mixture.poisson_log(x, 25.5)), _sql("x * ln(25.5::DOUBLE) - 25.5 - lgamma(x + 1)")),
    "binomial_loglik": (_summed(lambda x: mixture.binomial_log(x, 60, 0.4)), _sql("lgamma(61::DOUBLE) - lgamma(x + 1) - lgamma(61 - x) + x * ln(0.4::DOUBLE) + (60 - x) * ln(0.6::DOUBLE)")),
    "negbin_loglik": (_summed(lambda x: mixture.negative_binomial_log(x, 3.5, 0.12)), _sql("lgamma(3.5::DOUBLE + x) - lgamma(3.5::DOUBLE) - lgamma(x + 1) + 3.5 * ln(0.12::DOUBLE) + x * ln(0.88::DOUBLE)")),
    "betabin_loglik": (_summed(lambda x: mixture.beta_binomial_log(x, 60, 2.0, 3.0)), _sql("lgamma(61::DOUBLE) - lgamma(x + 1) - lgamma(61 - x) + lgamma(2 + x) - lgamma(2::DOUBLE) + lgamma(63 - x) - lgamma(3::DOUBLE) - lgamma(65::DOUBLE) + lgamma(5::DOUBLE)")),
    "gmm_e_step": (_e_step, _E_STEP),
    "stream_em_step": (_stream_step, _E_STEP),
    "kmeans_cost": (
        lambda s, d: mixture.clustering_cost(table(s, d, "embeddings"), "embedding", CENTRES).withColumn("cost", F.round("cost", 6)),
        f"WITH c AS (SELECT unnest(range(0, 4)) AS k), f AS (SELECT vec_id, k, list_sum(list_transform(list_zip(embedding, list_extract({_LISTS}, k + 1)), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM embeddings CROSS JOIN c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM f) SELECT CAST(k AS BIGINT) AS cluster, count(*) AS n, round(sum(d), 6) AS cost FROM b WHERE r = 1 GROUP BY k",
    ),
    "quantile_seeds": (
        lambda s, d: mixture.quantile_seeds(table(s, d, "customer").select(F.col("c_acctbal").cast("double").alias("x")), "x", 5).withColumn("location", F.round("location", 6)),
        "WITH q AS (SELECT quantile_cont(CAST(c_acctbal AS DOUBLE), [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM customer) SELECT CAST(i AS BIGINT) AS seed, round(q[i + 1], 6) AS location FROM q CROSS JOIN (SELECT unnest(range(0, 5)) AS i)",
    ),
    "erasure_evolution": (
        lambda s, d: codes.erasure_evolution(_rates(s, d, "l_returnflag = 'R'"), "p", 3, 6, 30).select("channel", "step", F.round("x", 9).alias("x")),
        f"WITH RECURSIVE {_rates_sql('l_returnflag', 'R')}, r AS (SELECT channel, p, CAST(0 AS BIGINT) AS step, p AS x FROM c UNION ALL SELECT channel, p, step + 1, p * pow(1 - pow(1 - x, 5), 2) FROM r WHERE step < 30) SELECT channel, step, round(x, 9) AS x FROM r",
    ),
    "binary_entropy": (
        lambda s, d: codes.channel_capacity(_rates(s, d, "l_linestatus = 'O'"), "p").select("channel", F.round("entropy", 9).alias("entropy"), F.round("capacity", 9).alias("capacity")),
        f"WITH {_rates_sql('l_linestatus', 'O')}, h AS (SELECT channel, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2::DOUBLE) END AS h FROM c) SELECT channel, round(h, 9) AS entropy, round(1 - h, 9) AS capacity FROM h",
    ),
    "syndrome": (
        lambda s, d: codes.syndrome(table(s, d, "lineitem").select(F.col("l_partkey").cast("long").alias("chk"), F.col("l_suppkey").cast("long").alias("bit")).distinct(), table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("bit"), F.pmod(F.col("s_nationkey"), F.lit(2)).cast("long").alias("value"))),
        "WITH c AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS chk, l_suppkey AS bit FROM lineitem) SELECT chk, CAST(bit_xor(CAST(s_nationkey % 2 AS BIGINT)) AS BIGINT) AS parity FROM c JOIN supplier ON s_suppkey = bit GROUP BY chk",
    ),
}
