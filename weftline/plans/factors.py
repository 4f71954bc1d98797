"""Queries on factor graphs: an order's state and those of its lines, two lines to a factor."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import factors
from weftline.plans.common import table
from weftline.sources.shared import laid

#: States of an order and of a line.
OF_ORDER, OF_LINE = 3, 2


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("k")).agg(F.min("l_suppkey").cast("long").alias("s"))
    lines = laid(lines, "lines")
    lines = lines.withColumn("f", F.expr("o * 8 + (k + 1) div 2"))
    orders = lines.select((F.col("o") * 8).alias("v")).distinct()
    variables = orders.withColumn("card", F.lit(OF_ORDER)).union(lines.select((F.col("o") * 8 + F.col("k")).alias("v"), F.lit(OF_LINE).alias("card")))
    heads = lines.groupBy("f").agg(F.first("o").alias("o"), F.count("*").alias("n"), F.sum("s").alias("s"), F.min("k").alias("k"))
    # the order, the line or both lines of the pair
    own = F.array(F.col("o") * 8, F.col("o") * 8 + F.col("k"), F.when(F.col("n") == 2, F.col("o") * 8 + F.col("k") + 1))
    axes = heads.select("f", F.posexplode(F.filter(own, lambda v: v.isNotNull())).alias("axis", "v"))
    places = lambda n: itertools.product(range(OF_ORDER), *[range(OF_LINE)] * n)
    codes = F.when(F.col("n") == 1, _codes(places(1))).otherwise(_codes(places(2)))
    code = lambda x: x + F.col("s")
    weights = F.transform(codes, lambda x: F.when(code(x) % 11 == 0, F.lit(float("-inf"))).otherwise((code(x) % 7) * 0.3))
    return variables, axes, heads.select("f", weights.alias("weights"))


def _codes(places) -> Column:  # noqa: ANN001
    return F.array(*(F.lit(reduce(lambda acc, x: acc * 3 + x, p, 0)).cast("long") for p in places))


def _log_partition(spark: SparkSession, sf: str) -> DataFrame:
    return factors.log_partition(*_graph(spark, sf)).withColumn("log_z", F.round("log_z", 6))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    out = factors.max_marginals(*_graph(spark, sf)).where("v % 8 = 0")
    return out.select("v", "state", F.round("m", 6).alias("m"))


def _marginals(spark: SparkSession, sf: str) -> DataFrame:
    out = factors.marginals(*_graph(spark, sf)).where("v % 8 > 0")
    return out.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("p"))


_W = "CASE WHEN code % 11 = 0 THEN '-infinity'::DOUBLE ELSE (code % 7) * 0.3::DOUBLE END"
_SQL = f"""WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS o, (CAST(l_linenumber AS BIGINT) + 1) // 2 AS g, count(*) AS n, CAST(sum(s) AS BIGINT) AS s FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM lineitem GROUP BY ALL) GROUP BY 1, 2),
a AS (SELECT unnest(range(0, {OF_ORDER})) AS a), b AS (SELECT unnest(range(0, {OF_LINE})) AS b), c AS (SELECT unnest(range(0, {OF_LINE})) AS c),
e AS (SELECT o, g, a, b, c, n, CASE WHEN n = 1 THEN a * 3 + b ELSE (a * 3 + b) * 3 + c END + s AS code FROM l CROSS JOIN a CROSS JOIN b CROSS JOIN c WHERE n > 1 OR c = 0),
w AS (SELECT o, g, a, b, c, n, {_W} AS w FROM e)"""

QUERIES = {
    "factor_log_partition": (
        _log_partition,
        _SQL + ", f AS (SELECT o, g, a, sum(exp(w)) AS z FROM w GROUP BY ALL), q AS (SELECT o, a, CASE WHEN min(z) = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN z > 0 THEN z ELSE 1 END))) END AS z FROM f GROUP BY ALL) "
        "SELECT o * 8 AS component, CASE WHEN sum(z) > 0 THEN round(ln(sum(z)), 6) ELSE '-infinity'::DOUBLE END AS log_z FROM q GROUP BY o",
    ),
    "factor_best": (_best, _SQL + ", f AS (SELECT o, g, a, max(w) AS m FROM w GROUP BY ALL) SELECT o * 8 AS v, a AS state, round(sum(m), 6) AS m FROM f GROUP BY o, a"),
    "factor_marginals": (
        _marginals,
        _SQL + ", f AS (SELECT o, g, a, sum(exp(w)) AS z FROM w GROUP BY ALL), q AS (SELECT o, a, CASE WHEN min(z) = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN z > 0 THEN z ELSE 1 END))) END AS z FROM f GROUP BY ALL), t AS (SELECT o, sum(z) AS t FROM q GROUP BY o), "
        "r AS (SELECT w.o, w.g, w.a, b, c, n, CASE WHEN f.z > 0 THEN q.z / t * exp(w) / f.z ELSE 0 END AS p FROM w JOIN f USING (o, g, a) JOIN q ON q.o = w.o AND q.a = w.a JOIN t ON t.o = w.o), "
        "m AS (SELECT o, g, b AS state, sum(p) AS p FROM r GROUP BY o, g, b UNION ALL SELECT o, g, c, sum(p) FROM r WHERE n > 1 GROUP BY o, g, c) SELECT state, count(*) AS n, round(avg(p), 6) AS p FROM m GROUP BY state",
    ),
}
