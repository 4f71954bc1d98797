"""Queries on elimination over GF(2) and on Reed-Solomon words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import fields
from weftline.plans.common import table

ROWS, COLUMNS = 16, 12
M, CHECKS, LENGTH = 4, 6, 15
_G = fields.rs_generator(M, CHECKS)


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity < 3").select(F.pmod("l_partkey", F.lit(ROWS)).cast("long").alias("row"), F.pmod(F.col("l_suppkey") * 5 + F.col("l_partkey"), F.lit(COLUMNS)).cast("long").alias("col"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """word, place, symbol: a multiple of the generator for each customer, with up to three symbols changed."""
    field = fields.Field(M)
    w = F.col("c_custkey").cast("long")
    rows = table(spark, sf, "customer").select(w.alias("word"), F.posexplode(F.array(*map(F.lit, _G))).alias("j", "g"))
    sent = rows.select("word", (F.pmod("word", F.lit(LENGTH - CHECKS)) + F.col("j")).alias("place"), field.times(F.col("g"), field.power(F.pmod("word", F.lit(field.n)))).alias("x"))
    wrong = table(spark, sf, "customer").select(w.alias("word"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")).where("q < word % 4")
    wrong = wrong.select("word", F.pmod(F.col("word") * 7 + F.col("q") * 4, F.lit(LENGTH)).alias("place"), (1 + F.pmod(F.col("word") + F.col("q"), F.lit(field.n))).cast("int").alias("x"))
    return sent.union(wrong).groupBy("word", "place").agg(F.bit_xor("x").alias("symbol"))


def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    out = fields.rs_corrected(_words(spark, sf), "word", "place", "symbol", M, CHECKS, LENGTH)
    return out.groupBy("word", "corrected").agg(F.sum((F.col("place") + 1) * F.col("symbol")).cast("long").alias("digest"))


_RANK = f"""WITH RECURSIVE o AS (SELECT l_partkey % {ROWS} AS r, (l_suppkey * 5 + l_partkey) % {COLUMNS} AS c FROM lineitem WHERE l_quantity < 3 GROUP BY ALL HAVING count(*) % 2 = 1),
k AS (SELECT list(m) AS rows FROM (SELECT r, CAST(sum(1::BIGINT << CAST(c AS INTEGER)) AS BIGINT) AS m FROM o GROUP BY r)),
s AS (SELECT 0 AS b, 0::BIGINT AS rank, rows FROM k
 UNION ALL SELECT b + 1, rank + CASE WHEN p IS NULL THEN 0 ELSE 1 END, CASE WHEN p IS NULL THEN rows ELSE list_filter(list_transform(rows, lambda x: CASE WHEN x & (1::BIGINT << b) <> 0 THEN xor(x, p) ELSE x END), lambda x: x <> 0) END
 FROM (SELECT b, rank, rows, list_filter(rows, lambda x: x & (1::BIGINT << b) <> 0)[1] AS p FROM s WHERE b < {COLUMNS})),
z AS (SELECT count(DISTINCT l_partkey % {ROWS}) AS rows, count(DISTINCT (l_suppkey * 5 + l_partkey) % {COLUMNS}) AS columns FROM lineitem WHERE l_quantity < 3)
SELECT rank, z.rows, columns, columns - rank AS free FROM s CROSS JOIN z WHERE b = {COLUMNS}"""


def _powers() -> list[int]:
    x, out = 1, []
    for _ in range((1 << M) - 1):
        out.append(x)
        x <<= 1
        x ^= fields.PRIMITIVE[M] if x >> M else 0
    return out


_DIGEST = " + ".join(f"(custkey % {LENGTH - CHECKS} + {j + 1}) * {_powers()!r}[({_powers().index(g)} + custkey % {(1 << M) - 1}) % {(1 << M) - 1} + 1]" for j, g in enumerate(_G) if g)

QUERIES = {
    "gf2_rank": (lambda s, d: fields.gf2_rank(_checks(s, d), "row", "col"), _RANK),
    "rs_corrected": (_corrected, f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS custkey FROM customer) SELECT custkey AS word, CASE WHEN custkey % 4 > 0 THEN true END AS corrected, CAST({_DIGEST} AS BIGINT) AS digest FROM c"),
}
