"""Queries on hidden states, predictions, paired methods and temperature rungs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from weftline.operators import comparison, hidden
from weftline.plans.common import table

#: A chain of two states that mostly stay, and how often each emits a value over 50.
INITIAL, TRANSITION, EMISSION = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.25, 0.75]]


def _forward(spark, sf):  # noqa: ANN001, ANN202
    events = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id", (F.coalesce(F.col("value"), F.lit(0)) > 50).cast("int").alias("symbol"))
    out = hidden.forward_log_likelihood(events, "user_id", ["ts", "event_id"], "symbol", INITIAL, TRANSITION, EMISSION)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 6))


def _rungs(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("replica"), (F.col("l_linenumber") / 8).alias("beta")).agg(F.sum(F.col("l_quantity").cast("double")).alias("energy"))


_LINES = "SELECT CAST(l_orderkey AS BIGINT) AS g, CAST(l_linenumber AS BIGINT) AS i, CAST(l_quantity AS DOUBLE) AS p, CAST(l_extendedprice AS DOUBLE) AS t FROM lineitem"
_ORDERS = "SELECT o_custkey AS g, o_orderkey AS i, CAST(o_totalprice AS DOUBLE) AS p, CAST(o_orderdate AS DATE) AS t FROM orders"
_E = "CASE s WHEN 0 THEN {0} ELSE {1} END"
_E0, _E1 = (_E.format(*e) for e in EMISSION)
_T = TRANSITION

DECAY, TOP, LABELS = 0.9137283746, 3, 3


def _symbols(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id", (F.coalesce(F.col("value"), F.lit(0)) > 50).cast("int").alias("symbol"))


def _model():  # noqa: ANN202
    return "user_id", ["ts", "event_id"], "symbol", INITIAL, TRANSITION, EMISSION


def _band(spark, sf):  # noqa: ANN001, ANN202
    events = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("trial"), "ts", F.col("value").cast("double").alias("value")).where("value is not null")
    events = events.groupBy("trial", "ts").agg(F.max("value").alias("value"))
    grid = events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    return comparison.curve_band(events, "trial", "ts", "value", grid).select("time", "trials", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def _trips(spark, sf):  # noqa: ANN001, ANN202
    trace = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("walker"), "ts", "event_id", F.pmod(F.col("event_id") * 7, F.lit(TOP + 1)).cast("long").alias("rung"))
    return comparison.round_trips(trace, "walker", ["ts", "event_id"], "rung", TOP)


def _advantages(spark, sf):  # noqa: ANN001, ANN202
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    out = comparison.advantages(table(spark, sf, "events"), "user_id", ["ts", "event_id"], value, value / 2, DECAY)
    return out.select("event_id", F.round("advantage", 6).alias("advantage"))


def _draws(spark, sf):  # noqa: ANN001, ANN202
    draws = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("draw"), F.col("l_orderkey").cast("long").alias("obs")).agg(F.pmod(F.min("l_partkey") + F.col("draw"), F.lit(LABELS)).cast("long").alias("label"))
    return comparison.relabel(draws, draws.where("draw = 1").select("obs", "label"), LABELS)


_BEST = lambda i: f"(CASE WHEN a + ln({_T[0][i]}::DOUBLE) >= b + ln({_T[1][i]}::DOUBLE) THEN 0 ELSE 1 END)"
_OBS = "o AS (SELECT CAST(user_id AS BIGINT) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN coalesce(value, 0) > 50 THEN 1 ELSE 0 END AS s FROM events)"
_VITERBI = (
    f"WITH RECURSIVE {_OBS}, f AS (SELECT g, k, ln({INITIAL[0]}::DOUBLE * {_E0}) AS a, ln({INITIAL[1]}::DOUBLE * {_E1}) AS b, 0 AS pa, 0 AS pb FROM o WHERE k = 1 UNION ALL "
    f"SELECT o.g, o.k, greatest(a + ln({_T[0][0]}::DOUBLE), b + ln({_T[1][0]}::DOUBLE)) + ln({_E0}::DOUBLE), greatest(a + ln({_T[0][1]}::DOUBLE), b + ln({_T[1][1]}::DOUBLE)) + ln({_E1}::DOUBLE), {_BEST(0)}, {_BEST(1)} FROM f JOIN o ON o.g = f.g AND o.k = f.k + 1), "
    "r AS (SELECT f.g, f.k, CASE WHEN a >= b THEN 0 ELSE 1 END AS x, CASE WHEN a >= b THEN pa ELSE pb END AS p FROM f JOIN o ON o.g = f.g AND o.k = f.k WHERE o.k = o.n UNION ALL SELECT f.g, f.k, r.p, CASE r.p WHEN 0 THEN f.pa ELSE f.pb END FROM r JOIN f ON f.g = r.g AND f.k = r.k - 1) "
    "SELECT g AS segment, CAST(k - 1 AS BIGINT) AS k, CAST(x AS BIGINT) AS state FROM r"
)
_EM = lambda j, c: f"(CASE {c} WHEN 0 THEN {EMISSION[j][0]} ELSE {EMISSION[j][1]} END)"
_COUNTS = (
    f"WITH RECURSIVE {_OBS}, f AS (SELECT g, k, {INITIAL[0]}::DOUBLE * {_EM(0, 's')} AS a, {INITIAL[1]}::DOUBLE * {_EM(1, 's')} AS b FROM o WHERE k = 1 UNION ALL "
    f"SELECT o.g, o.k, (a * {_T[0][0]} + b * {_T[1][0]}) / (a + b) * {_EM(0, 's')}, (a * {_T[0][1]} + b * {_T[1][1]}) / (a + b) * {_EM(1, 's')} FROM f JOIN o ON o.g = f.g AND o.k = f.k + 1), "
    "w AS (SELECT g, k, 1::DOUBLE AS c, 1::DOUBLE AS d FROM o WHERE k = n UNION ALL "
    f"SELECT w.g, w.k - 1, ({_T[0][0]} * {_EM(0, 's')} * c + {_T[0][1]} * {_EM(1, 's')} * d) / (c + d), ({_T[1][0]} * {_EM(0, 's')} * c + {_T[1][1]} * {_EM(1, 's')} * d) / (c + d) FROM w JOIN o ON o.g = w.g AND o.k = w.k WHERE w.k > 1), "
    "h AS (SELECT o.g, o.k, s, a * c / (a * c + b * d) AS p, b * d / (a * c + b * d) AS q, a, b, c, d FROM o JOIN f ON f.g = o.g AND f.k = o.k JOIN w ON w.g = o.g AND w.k = o.k), "
    + "x AS (SELECT "
    + ", ".join(f"{'ab'[i]}0 * {_T[i][j]} * {_EM(j, 's')} * {'cd'[j]} AS x{i}{j}" for i in range(2) for j in range(2))
    + " FROM (SELECT h.s, h.c, h.d, y.a AS a0, y.b AS b0 FROM h JOIN h y ON y.g = h.g AND y.k = h.k - 1)) "
    + " UNION ALL ".join(
        [f"SELECT 'initial' AS kind, CAST(0 AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(sum({'pq'[j]}), 4) AS n FROM h WHERE k = 1" for j in range(2)]
        + [f"SELECT 'transition', {i}, {j}, round(sum(x{i}{j} / (x00 + x01 + x10 + x11)), 4) FROM x" for i in range(2) for j in range(2)]
        + [f"SELECT 'emission', {i}, {s}, round(sum({'pq'[i]}), 4) FROM h WHERE s = {s}" for i in range(2) for s in range(2)]
    )
)
_PERMS = list(itertools.permutations(range(LABELS)))

def _ends(spark, sf):  # noqa: ANN001, ANN202
    """nation, hot, cold: a first and a last temperature from each nation's customers."""
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg((1 + F.max(F.col("c_acctbal").cast("double")) / 1000).alias("hot"), (0.1 + F.pmod(F.count("*"), F.lit(5)) * 0.1).alias("cold"))


QUERIES = {
    "hmm_viterbi": (lambda s, d: hidden.viterbi(_symbols(s, d), *_model()), _VITERBI),
    "baum_welch_counts": (lambda s, d: hidden.expected_counts(_symbols(s, d), *_model()).withColumn("n", F.round("n", 4)), _COUNTS),
    "asof_curve_band": (
        _band,
        "WITH e AS (SELECT CAST(user_id AS BIGINT) AS trial, ts, max(CAST(value AS DOUBLE)) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT trial FROM e), g AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time FROM e), "
        "a AS (SELECT time, t.trial, (SELECT arg_max(value, ts) FROM e WHERE e.trial = t.trial AND e.ts <= g.time) AS value FROM t CROSS JOIN g) "
        "SELECT time, count(*) AS trials, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END, 6) AS sd FROM a GROUP BY time HAVING count(value) = count(*)",
    ),
    "round_trips": (
        _trips,
        f"WITH e AS (SELECT CAST(user_id AS BIGINT) AS walker, ts, event_id, event_id * 7 % {TOP + 1} AS rung FROM events), x AS (SELECT walker, rung, lag(rung) OVER (PARTITION BY walker ORDER BY ts, event_id) AS last FROM e WHERE rung IN (0, {TOP})), c AS (SELECT walker, count(*) AS n FROM x WHERE rung = 0 AND last = {TOP} GROUP BY walker) SELECT e.walker, CAST(coalesce(max(n), 0) AS BIGINT) AS trips FROM e LEFT JOIN c USING (walker) GROUP BY e.walker",
    ),
    "gae": (
        _advantages,
        "WITH v AS (SELECT user_id AS g, event_id, row_number() OVER w AS k, coalesce(CAST(value AS DOUBLE), 0) AS r, coalesce(lead(coalesce(CAST(value AS DOUBLE), 0)) OVER w, 0) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
        f"d AS (SELECT g, event_id, k, r + x / 2 - r / 2 AS gain FROM v) SELECT a.event_id, round(sum(pow({DECAY}::DOUBLE, b.k - a.k) * b.gain), 6) AS advantage FROM d a JOIN d b ON b.g = a.g AND b.k >= a.k GROUP BY a.event_id",
    ),
    "relabel_ecr": (
        _draws,
        f"WITH a AS (SELECT CAST(l_linenumber AS BIGINT) AS draw, CAST(l_orderkey AS BIGINT) AS obs, (min(l_partkey) + l_linenumber) % {LABELS} AS label FROM lineitem GROUP BY l_linenumber, l_orderkey), m AS (SELECT a.draw, p.label AS want, a.label FROM a JOIN a p ON p.obs = a.obs AND p.draw = 1), "
        f"s AS (SELECT draw, {', '.join(f"CAST(count(*) FILTER ({' OR '.join(f'(want = {i} AND label = {j})' for i, j in enumerate(p))}) AS BIGINT) AS s{k}" for k, p in enumerate(_PERMS))} FROM m GROUP BY draw), "
        f"u AS ({' UNION ALL '.join(f"SELECT draw, {k} AS k, '{','.join(map(str, p))}' AS labels, s{k} AS agreement FROM s" for k, p in enumerate(_PERMS))}) "
        "SELECT draw, labels, agreement FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY agreement DESC, k) AS r FROM u) WHERE r = 1",
    ),
    "schedule_table": (
        lambda s, d: (lambda t: t.select("nation", "step", *(F.round(c, 9).alias(c) for c in ("linear", "exponential", "cosine", "inverse", "power"))))(comparison.temperatures(_ends(s, d), "hot", "cold", 40, 0.7)),
        "WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, 1 + max(c_acctbal) / 1000 AS hot, 0.1::DOUBLE + count(*) % 5 * 0.1 AS cold FROM customer GROUP BY 1), s AS (SELECT nation, hot, cold, range AS step, range / 39.0::DOUBLE AS f FROM n CROSS JOIN range(40)) SELECT nation, step, round((1 - f) * hot + f * cold, 9) AS linear, round(exp((1 - f) * ln(hot) + f * ln(cold)), 9) AS exponential, round(cold + (hot - cold) * (1 + cos(pi() * f)) / 2, 9) AS cosine, round(1 / ((1 - f) / hot + f / cold), 9) AS inverse, round(hot / pow(1 + step, 0.7::DOUBLE), 9) AS power FROM s",
    ),
    "hmm_forward_2state": (
        _forward,
        "WITH RECURSIVE o AS (SELECT CAST(user_id AS BIGINT) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN coalesce(value, 0) > 50 THEN 1 ELSE 0 END AS s FROM events), "
        f"f AS (SELECT g, k, ln({INITIAL[0]}::DOUBLE * {_E0}) AS a, ln({INITIAL[1]}::DOUBLE * {_E1}) AS b FROM o WHERE k = 1 UNION ALL "
        f"SELECT o.g, o.k, greatest(a, b) + ln((exp(a - greatest(a, b)) * {_T[0][0]} + exp(b - greatest(a, b)) * {_T[1][0]}) * {_E0}), greatest(a, b) + ln((exp(a - greatest(a, b)) * {_T[0][1]} + exp(b - greatest(a, b)) * {_T[1][1]}) * {_E1}) FROM f JOIN o ON o.g = f.g AND o.k = f.k + 1) "
        "SELECT g AS segment, round(arg_max(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), k), 6) AS log_likelihood FROM f GROUP BY g",
    ),
    "r_squared": (
        lambda s, d: comparison.r_squared(table(s, d, "lineitem"), F.col("l_quantity").cast("double") * 1500, F.col("l_extendedprice").cast("double")).select(F.round("r2", 6).alias("r2")),
        f"SELECT round(1 - sum((t - 1500 * p) * (t - 1500 * p)) / (var_pop(t) * count(t)), 6) AS r2 FROM ({_LINES})",
    ),
    "argmax_agreement": (
        lambda s, d: comparison.argmax_agreement(table(s, d, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice").cast("double"), F.unix_date(F.col("o_orderdate").cast("date"))).select("groups", F.round("agreement", 6).alias("agreement")),
        f"WITH r AS (SELECT g, i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY p DESC, i) AS rp, row_number() OVER (PARTITION BY g ORDER BY t DESC, i) AS rt FROM ({_ORDERS})), h AS (SELECT g, max(CASE WHEN rp = 1 AND rt = 1 THEN 1 ELSE 0 END) AS hit FROM r WHERE n > 1 GROUP BY g) SELECT count(*) AS groups, round(avg(CAST(hit AS DOUBLE)), 6) AS agreement FROM h",
    ),
    "paired_wins": (
        lambda s, d: comparison.paired_wins(table(s, d, "orders"), F.col("o_totalprice") > 150000, F.col("o_custkey") % 2 == 0),
        "SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT o_totalprice > 150000 AS a, o_custkey % 2 = 0 AS b FROM orders)",
    ),
    "swap_log_ratio": (
        lambda s, d: comparison.swap_log_ratios(_rungs(s, d), "replica", "beta", "energy").withColumn("log_ratio", F.round("log_ratio", 6) + 0.0),
        "WITH r AS (SELECT CAST(l_orderkey AS BIGINT) AS replica, l_linenumber / 8.0::DOUBLE AS beta, sum(CAST(l_quantity AS DOUBLE)) AS energy FROM lineitem GROUP BY ALL), x AS (SELECT replica, beta, (beta - lead(beta) OVER w) * (energy - lead(energy) OVER w) AS q FROM r WINDOW w AS (PARTITION BY replica ORDER BY beta)) SELECT replica, beta, round(q, 6) + 0.0 AS log_ratio FROM x WHERE q IS NOT NULL",
    ),
}
