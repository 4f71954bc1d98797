"""Operators on ragged sequences and traces: offsets, transitions, coarse bins, returns, trace statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.segments import carried, numbered, offsets, placed


def ragged_offsets(rows: DataFrame, segment: str) -> DataFrame:
    """segment, length, start: where each segment begins in the flat order of segments."""
    lengths = rows.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("length"))
    return offsets(lengths, "segment", "length").select("segment", "length", "start")


def transition_mle(rows: DataFrame, segment: str, order: list[str], state: str) -> DataFrame:
    """source, target, n, p: the counts and shares of steps from one state to the next within segments.

    Steps within a range partition are a window's; one row a segment and part says where it begins and ends, and gives the
    steps from part to part. Rows that tie in ``order`` stand by state. Steps to a null state are not counted.
    """
    laid = placed(rows.select(F.col(segment).alias("segment"), F.col(state).alias("source"), *order), "segment", order)
    inside = Window.partitionBy("segment", "_part").orderBy(*order, "source")
    steps = laid.select("source", F.lead("source").over(inside).alias("target"))
    at = F.struct(*order, "source")
    ends = laid.groupBy("segment", "_part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    across = ends.select(F.col("last.source").alias("source"), F.lead("first.source").over(Window.partitionBy("segment").orderBy("_part")).alias("target"))
    counts = steps.union(across).where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def coarsen(rows: DataFrame, segment: str, order: list[str], value: Column, factor: int) -> DataFrame:
    """segment, bin, n, total: sums over ``factor`` positions in a row; the last bin of a segment may be short."""
    laid = numbered(rows.select(F.col(segment).alias("segment"), value.alias("v"), *order), "segment", order)
    return laid.groupBy("segment", F.floor(F.col("k") / factor).alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def returns_to_go(rows: DataFrame, segment: str, order: list[str], reward: str) -> DataFrame:
    """``rows`` with ``to_go``: the rewards of a segment from each row on."""
    return carried(placed(rows, segment, order), segment, order, F.col(reward), "sum", "to_go", reverse=True).drop("_part")


def best_so_far(rows: DataFrame, chain: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``best``: the least value of a chain up to each row."""
    return carried(placed(rows, chain, order), chain, order, F.col(value), "min", "best").drop("_part")


def autocorrelation(rows: DataFrame, chain: str, order: list[str], value: str, lags: int) -> DataFrame:
    """chain, lag, rho for lags 1 to ``lags``: the share of the chain's variance that values at that lag have in common."""
    laid = numbered(rows.select(F.col(chain).alias("segment"), F.col(value).alias("v"), *order), "segment", order)
    mean = laid.groupBy("segment").agg(F.avg("v").alias("mean"))
    d = laid.join(mean, "segment").select("segment", "k", (F.col("v") - F.col("mean")).alias("d"))
    # each deviation goes to the places whose lag it is; a place sums what meets there
    sent = d.select("segment", F.explode(F.array(*(F.struct((F.col("k") + g).alias("k"), F.lit(g).alias("g"), F.col("d").alias("d")) for g in range(lags + 1)))).alias("e"))
    at = lambda g: F.sum(F.when(F.col("e.g") == g, F.col("e.d")))
    met = sent.groupBy("segment", "e.k").agg(*(at(g).alias(f"d{g}") for g in range(lags + 1)))
    sums = met.groupBy("segment").agg(*(F.sum(F.col("d0") * F.col(f"d{g}")).alias(f"c{g}") for g in range(lags + 1)))
    stack = ", ".join(f"{g}, c{g}" for g in range(1, lags + 1))
    return sums.selectExpr("segment as chain", "c0 as v", f"stack({lags}, {stack}) as (lag, c)").where("v > 0 and c is not null").select("chain", "lag", (F.col("c") / F.col("v")).alias("rho"))


def split_rhat(rows: DataFrame, chain: str, order: list[str], value: str) -> DataFrame:
    """One row: rhat over the halves of all chains (an odd middle row is left out), and the number of halves."""
    r = numbered(rows.select(F.col(chain).alias("segment"), F.col(value).alias("v"), *order), "segment", order)
    r = r.join(r.groupBy("segment").agg(F.count("*").alias("n")), "segment")
    half = F.expr("n div 2")
    r = r.withColumn("half", F.when(F.col("k") < half, 0).when(F.col("k") >= F.col("n") - half, 1)).where("half is not null")
    parts = r.groupBy("segment", "half").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.count("*").alias("n"))
    out = parts.agg(F.avg("s").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"), F.count("*").alias("halves"))
    return out.select("halves", F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.col("w")).alias("rhat"))
