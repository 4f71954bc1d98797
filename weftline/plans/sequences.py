"""Queries on event sequences and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import sequence
from weftline.plans.common import table
from weftline.streaming import metrics

ORDER = ["ts", "event_id"]
LAGS = 3


def _events(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id", "event_type", F.col("value").cast("double").alias("value"))


def _rounded(df, *columns):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.round(c, 6) for c in columns})


_D = "d AS (SELECT CAST(user_id AS BIGINT) AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, CAST(value AS DOUBLE) AS v, CAST(value AS DOUBLE) - avg(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id) AS d FROM events)"


def _metrics(spark, sf):  # noqa: ANN001, ANN202
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), F.pmod(F.col("user_id"), F.lit(5)).cast("string")).alias("run"), F.col("event_type").alias("name"), F.create_map(F.lit("odd"), F.pmod(F.col("event_id"), F.lit(2)).cast("string")).alias("context"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return _rounded(metrics.summary(rows), "mean")


QUERIES = {
    "metric_summary": (
        _metrics,
        """WITH m AS (SELECT 'u' || (user_id % 5) AS run, event_type AS name, '{"odd":"' || (event_id % 2) || '"}' AS series, event_id, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL) SELECT run, name, series, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS best, arg_max(v, event_id) AS last FROM m GROUP BY ALL""",
    ),
    "ragged_offsets": (lambda s, d: sequence.ragged_offsets(_events(s, d), "user_id"), "SELECT CAST(user_id AS BIGINT) AS segment, count(*) AS length, CAST(sum(count(*)) OVER (ORDER BY user_id) - count(*) AS BIGINT) AS start FROM events GROUP BY user_id"),
    "transition_mle": (
        lambda s, d: _rounded(sequence.transition_mle(_events(s, d), "user_id", ORDER, "event_type"), "p"),
        "WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), c AS (SELECT source, target, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY ALL) SELECT source, target, n, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS p FROM c",
    ),
    "coarsen_bins": (
        lambda s, d: _rounded(sequence.coarsen(_events(s, d), "user_id", ORDER, F.col("value"), 5), "total"),
        "SELECT CAST(user_id AS BIGINT) AS segment, CAST((k - 1) // 5 AS BIGINT) AS bin, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY ALL",
    ),
    "returns_to_go": (
        lambda s, d: _rounded(sequence.returns_to_go(_events(s, d), "user_id", ORDER, "value"), "to_go").select("event_id", "to_go"),
        "SELECT event_id, round(sum(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS to_go FROM events",
    ),
    "best_so_far": (
        lambda s, d: sequence.best_so_far(_events(s, d), "user_id", ORDER, "value").select("event_id", "best"),
        "SELECT event_id, min(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events",
    ),
    "autocorrelation": (
        lambda s, d: _rounded(sequence.autocorrelation(_events(s, d), "user_id", ORDER, "value", LAGS), "rho").select("chain", F.col("lag").cast("long").alias("lag"), "rho"),
        f"WITH {_D}, l AS (SELECT unnest(range(1, {LAGS + 1})) AS lag), s AS (SELECT chain, sum(d * d) AS v FROM d GROUP BY chain) SELECT a.chain, lag, round(sum(a.d * b.d) / max(s.v), 6) AS rho FROM d a CROSS JOIN l JOIN d b ON b.chain = a.chain AND b.k = a.k + lag JOIN s ON s.chain = a.chain WHERE s.v > 0 GROUP BY a.chain, lag",
    ),
    "split_rhat": (
        lambda s, d: _rounded(sequence.split_rhat(_events(s, d), "user_id", ORDER, "value"), "rhat"),
        f"WITH {_D}, h AS (SELECT chain, v, CASE WHEN k <= n // 2 THEN 0 WHEN k > n - n // 2 THEN 1 END AS half FROM d), p AS (SELECT chain, half, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM h WHERE half IS NOT NULL GROUP BY ALL) SELECT count(*) AS halves, round(sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(s)), 6) AS rhat FROM p",
    ),
}
