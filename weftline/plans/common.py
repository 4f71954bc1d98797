"""Tables for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.generated import lattice

WIDTH, STATES = 10, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A lattice whose sites are the customers in rows of WIDTH: edges (i, j, w) and labels (site, label)."""
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("site"), F.pmod(F.col("c_nationkey"), F.lit(STATES)).cast("long").alias("label"))
    edges = lattice(labels.select("site"), WIDTH).withColumn("w", 1 + F.pmod(F.col("eid"), F.lit(3)) * 0.5)
    return edges, labels


LATTICE_SQL = f"""
v AS (SELECT CAST(c_custkey AS BIGINT) AS site, CAST(c_nationkey % {STATES} AS BIGINT) AS label FROM customer),
e0 AS (SELECT 2 * site AS eid, site AS i, site + 1 AS j FROM v WHERE site % {WIDTH} < {WIDTH - 1} UNION ALL SELECT 2 * site + 1, site, site + {WIDTH} FROM v),
e AS (SELECT eid, i, j, 1 + (eid % 3) * 0.5::DOUBLE AS w FROM e0 WHERE j IN (SELECT site FROM v)),
x AS (SELECT e.*, a.label AS li, b.label AS lj FROM e JOIN v a ON a.site = i JOIN v b ON b.site = j),
n AS (SELECT i AS site, j AS other, w FROM e UNION ALL SELECT j, i, w FROM e)
"""
