"""Queries on enumerated models, chains and belief propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import enumeration
from weftline.plans.common import LATTICE_SQL, STATES, labelled_lattice, table

#: The open 3 x 3 lattice with two states, with the coupling and the field that each nation's customers give.
SIDE, Q = 3, 2
EDGES = [(3 * r + c, 3 * r + c + 1, 1.0) for r in range(SIDE) for c in range(SIDE - 1)] + [(3 * r + c, 3 * r + c + 3, 1.0) for r in range(SIDE - 1) for c in range(SIDE)]
COUPLING, CHAIN = 0.75, [0.4, -0.1, -0.3]
OWN, SWEEPS, DAMPING = 0.4, 3, 0.5


def _weights(spark, sf):  # noqa: ANN001, ANN202
    rich = F.avg(F.when(F.col("c_acctbal") > 4000, 1.0).otherwise(0.0))
    graphs = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("graph")).agg((F.pmod(F.count("*"), F.lit(7)) * 0.15).alias("scale"), rich.alias("rich"))
    return enumeration.configurations(graphs.select("graph", "scale", F.array(F.lit(0.0), F.col("rich") - 0.5).alias("field")), SIDE * SIDE, Q, EDGES)


def _marginals(spark, sf):  # noqa: ANN001, ANN202
    return enumeration.site_marginals(_weights(spark, sf), SIDE * SIDE, Q)


_LABEL = "(id // {0} % 2)"
_EQUAL = " + ".join(f"CASE WHEN {_LABEL.format(Q**i)} = {_LABEL.format(Q**j)} THEN 1 ELSE 0 END" for i, j, _ in EDGES)
_OWN = " + ".join(_LABEL.format(Q**s) for s in range(SIDE * SIDE))
_ALL = f"g AS (SELECT CAST(c_nationkey AS BIGINT) AS graph, count(*) % 7 * 0.15::DOUBLE AS scale, avg(CASE WHEN c_acctbal > 4000 THEN 1::DOUBLE ELSE 0 END) - 0.5 AS h FROM customer GROUP BY 1), c AS (SELECT graph, id, scale * ({_EQUAL}) + h * ({_OWN}) AS log_weight FROM g CROSS JOIN (SELECT range AS id FROM range({Q ** (SIDE * SIDE)})))"
_SITES = f"{_ALL}, m AS (SELECT graph, site, id // CAST(pow({Q}, site) AS BIGINT) % {Q} AS label, sum(exp(log_weight)) AS w FROM c CROSS JOIN (SELECT range AS site FROM range({SIDE * SIDE})) GROUP BY ALL), p AS (SELECT graph, site, label, w / sum(w) OVER (PARTITION BY graph, site) AS p FROM m)"


def _chains(spark, sf):  # noqa: ANN001, ANN202
    chains = table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("segment")).agg(F.count("*").alias("length"))
    return enumeration.chain_log_partition(chains, COUPLING, CHAIN).withColumn("log_z", F.round("log_z", 6))


def _chain_sql() -> str:
    q = range(len(CHAIN))
    step = ", ".join(f"top + ln({' + '.join(f'exp(x{i} - top + {COUPLING if i == j else 0.0}::DOUBLE)' for i in q)}) + {CHAIN[j]}::DOUBLE AS x{j}" for j in q)
    top = lambda cols: f"greatest({', '.join(cols)})"
    return (
        "WITH RECURSIVE s AS (SELECT CAST(user_id AS BIGINT) AS segment, count(*) AS length FROM events GROUP BY user_id), z AS (SELECT CAST(1 AS BIGINT) AS n, "
        + ", ".join(f"{h}::DOUBLE AS x{i}" for i, h in enumerate(CHAIN))
        + f" UNION ALL SELECT n + 1, {', '.join(f'x{i}' for i in q)} FROM (SELECT n, {step} FROM (SELECT *, {top([f'x{i}' for i in q])} AS top FROM z WHERE n < (SELECT max(length) FROM s)))) "
        + f"SELECT segment, length, round({top([f'x{i}' for i in q])} + ln({' + '.join(f'exp(x{i} - {top([f"x{i}" for i in q])})' for i in q)}), 6) AS log_z FROM s JOIN z ON n = length"
    )


def _beliefs(spark, sf):  # noqa: ANN001, ANN202
    edges, labels = labelled_lattice(spark, sf)
    field = labels.select("site", *(F.when(F.col("label") == s, F.lit(OWN)).otherwise(0.0).alias(f"h{s}") for s in range(STATES)))
    return enumeration.propagate(edges, field, STATES, SWEEPS, DAMPING).withColumn("p", F.round("p", 6))


def _beliefs_sql() -> str:
    q = range(STATES)
    each = lambda text: ", ".join(text.format(s=s) for s in q)
    lse = lambda text: "ln(" + " + ".join(f"exp({text.format(s=s)})" for s in q) + ")"
    out = [f"arc AS (SELECT eid, i AS a, j AS b, w FROM e UNION ALL SELECT eid, j, i, w FROM e), h AS (SELECT site, {each(f'CASE WHEN label = {{s}} THEN {OWN}::DOUBLE ELSE 0::DOUBLE END AS h{{s}}')} FROM v), m0 AS (SELECT *, {each(f'-ln({STATES}::DOUBLE) AS m{{s}}')} FROM arc)"]
    for t in range(SWEEPS):
        out.append(f"r{t} AS (SELECT site, {each(f'h{{s}} + coalesce(sum(m{{s}}), 0) AS t{{s}}')} FROM h LEFT JOIN m{t} ON b = site GROUP BY site, {each('h{s}')})")
        out.append(f"u{t} AS (SELECT x.eid, x.a, x.b, x.w, {each('x.m{s}')}, {each('t{s} - y.m{s} AS u{s}')} FROM m{t} x JOIN r{t} ON site = x.a JOIN m{t} y ON y.eid = x.eid AND y.a = x.b)")
        out.append(f"p{t} AS (SELECT *, {', '.join('ln(' + ' + '.join(f'exp(u{s} + {"w" if s == k else "0"})' for s in q) + f') AS p{k}' for k in q)} FROM u{t})")
        out.append(f"n{t} AS (SELECT eid, a, b, w, {each(f'{DAMPING} * m{{s}} + {1 - DAMPING} * (p{{s}} - {lse("p{s}")}) AS n{{s}}')} FROM p{t})".replace("{s}", "{s}"))
        out.append(f"m{t + 1} AS (SELECT eid, a, b, w, {each(f'n{{s}} - {lse("n{s}")} AS m{{s}}')} FROM n{t})")
    out.append(f"r{SWEEPS} AS (SELECT site, {each(f'h{{s}} + coalesce(sum(m{{s}}), 0) AS t{{s}}')} FROM h LEFT JOIN m{SWEEPS} ON b = site GROUP BY site, {each('h{s}')})")
    return f"WITH {LATTICE_SQL}, {', '.join(out)} " + " UNION ALL ".join(f"SELECT site, CAST({s} AS BIGINT) AS label, round(exp(t{s} - {lse('t{s}')}), 6) AS p FROM r{SWEEPS}" for s in q)


QUERIES = {
    "enumerate_potts": (lambda s, d: enumeration.log_partition(_weights(s, d)).withColumn("log_z", F.round("log_z", 9)), f"WITH {_ALL} SELECT graph, count(*) AS states, round(ln(sum(exp(log_weight))), 9) AS log_z FROM c GROUP BY graph"),
    "site_marginals": (lambda s, d: _marginals(s, d).withColumn("p", F.round("p", 9)), f"WITH {_SITES} SELECT graph, site, label, round(p, 9) AS p FROM p"),
    "marginal_decode": (lambda s, d: enumeration.marginal_decode(_marginals(s, d).withColumn("p", F.round("p", 9))), f"WITH {_SITES} SELECT graph, site, arg_max(label, (round(p, 9), -label)) AS label FROM p GROUP BY graph, site"),
    "chain_log_partition": (_chains, _chain_sql()),
    "bp_flooding_3": (_beliefs, _beliefs_sql()),
}
