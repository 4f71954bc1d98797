"""Operators on codes and channels: syndromes, one min-sum pass, erasure evolution, entropies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.columns import binary_entropy


def syndrome(checks: DataFrame, bits: DataFrame) -> DataFrame:
    """chk, parity: the sum over GF(2) of each check's bits; checks (chk, bit), bits (bit, value)."""
    return checks.join(bits, "bit").groupBy("chk").agg(F.bit_xor("value").cast("long").alias("parity"))


def min_sum_pass(checks: DataFrame, llr: DataFrame) -> DataFrame:
    """bit, total: one pass of min-sum. A check sends each bit the sign product and the least magnitude of its others.

    The two least magnitudes and the sign product of a check serve all its bits, so no pairs of bits are made; each is a
    partial aggregate, so that no task sorts a check's bits. A bit that a check lists twice counts as two.
    """
    met = checks.join(llr, "bit").withColumn("size", F.abs("llr"))
    least = met.groupBy("chk").agg(F.min("size").alias("m1"), F.sum(F.when(F.col("llr") < 0, 1).otherwise(0)).alias("neg"))
    # of bits of the least magnitude, one takes the second least: where there are several, it is the same
    second = met.join(least, "chk").groupBy("chk", "m1", "neg").agg(F.min(F.when(F.col("size") > F.col("m1"), F.col("size"))).alias("more"), F.sum(F.when(F.col("size") == F.col("m1"), 1).otherwise(0)).alias("ties"))
    sent = met.join(second, "chk")
    others = F.col("neg") - F.when(F.col("llr") < 0, 1).otherwise(0)
    size = F.when((F.col("size") == F.col("m1")) & (F.col("ties") == 1), F.coalesce("more", F.lit(0.0))).otherwise(F.col("m1"))
    message = F.when(F.pmod(others, F.lit(2)) == 1, -size).otherwise(size)
    return sent.groupBy("bit").agg((F.first("llr") + F.sum(message)).alias("total"))


def erasure_evolution(rates: DataFrame, erased: str, dv: int, dc: int, steps: int) -> DataFrame:
    """``rates`` with step and x: the erasure probability of messages of a (dv, dc)-regular code after each step, from the
    share ``erased`` of a channel's symbols."""
    step = lambda acc, _: F.concat(acc, F.array(F.col(erased) * F.pow(1 - F.pow(1 - F.element_at(acc, -1), dc - 1), dv - 1)))
    out = rates.select("*", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col(erased)), step)).alias("step", "x"))
    return out.withColumn("step", F.col("step").cast("long"))


def channel_capacity(points: DataFrame, p: str) -> DataFrame:
    """``points`` with ``entropy`` and ``capacity`` of the binary symmetric channel, in bits."""
    return points.withColumn("entropy", binary_entropy(F.col(p))).withColumn("capacity", 1 - F.col("entropy"))
