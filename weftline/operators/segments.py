"""Order within segments, where no task has to hold a segment: range partitions, carried sums, scans by blocks.

A segment that holds most of the rows is dealt out over many tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.sources.shared import cut

#: So many positions in a row are folded in one row of a scan; no group holds more.
BLOCK = 64


def placed(rows: DataFrame, segment: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_part``: the range partition of segment and order that a row lies in.

    Checkpointed, so that what is summed up of the parts fits the rows that read it. Rows that tie in ``order`` share a
    part. Null segments are one segment.
    """
    return cut(rows.repartitionByRange(segment, *order).withColumn("_part", F.spark_partition_id()))


def carried(rows: DataFrame, segment: str, order: list[str], value: Column, kind: str, name: str, reverse: bool = False) -> DataFrame:
    """``rows`` of ``placed`` with ``name``: the sum, min or last value (nulls left out) of a segment up to each row.

    Each part is windowed on its own, and one row a segment and part carries what comes before. ``reverse`` goes from
    the last row back. Sums and minima over no values are null.
    """
    by = [F.col(c).desc() if reverse else F.col(c) for c in order]
    inside = Window.partitionBy(segment, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(segment).orderBy(F.desc("_part") if reverse else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    fold: dict[str, tuple[Callable, Callable, Callable]] = {
        "sum": (F.sum, F.sum, lambda old, new: F.coalesce(old + new, new, old)),
        "min": (F.min, F.min, lambda old, new: F.least(old, new)),
        "last": (lambda v: F.last(v, ignorenulls=True), lambda v: F.last(v, ignorenulls=True), lambda old, new: F.coalesce(new, old)),
    }
    over, across, both = fold[kind]
    rows = rows.withColumn("_value", value)
    at = F.struct(*order, "_value")
    whole = {"sum": F.sum("_value"), "min": F.min("_value"), "last": (F.min if reverse else F.max)(F.when(F.col("_value").isNotNull(), at))["_value"]}[kind]
    parts = rows.groupBy(segment, "_part").agg(whole.alias("_whole"))
    parts = parts.select(F.col(segment).alias("_segment"), F.col("_part").alias("_of"), across("_whole").over(before).alias("_before"))
    local = rows.withColumn("_own", over("_value").over(inside))
    met = local.join(parts, F.col(segment).eqNullSafe(F.col("_segment")) & (F.col("_part") == F.col("_of")))
    return met.withColumn(name, both(F.col("_before"), F.col("_own"))).drop("_value", "_own", "_segment", "_of", "_before")


def numbered(rows: DataFrame, segment: str, order: list[str], name: str = "k") -> DataFrame:
    """``rows`` with ``_part`` and ``name``: their place in the segment, from 0."""
    return carried(placed(rows, segment, order), segment, order, F.lit(1).cast("long"), "sum", name).withColumn(name, F.col(name) - 1)


def offsets(rows: DataFrame, key: str, length: str, name: str = "start") -> DataFrame:
    """``rows`` with ``name``: the sum of ``length`` over all rows with a smaller key."""
    laid = placed(rows.withColumn("_all", F.lit(0)), "_all", [key])
    return carried(laid, "_all", [key], F.col(length), "sum", name).withColumn(name, F.col(name) - F.col(length)).drop("_all", "_part")


def shifted(rows: DataFrame, name: str, value: str, by: int) -> DataFrame:
    """(segment, k) with ``name``: what ``value`` is ``by`` places further on in the segment, where there is such a row."""
    return rows.select("segment", (F.col("k") - by).alias("k"), F.col(value).alias(name))


def scan(rows: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """segment, k, x: the values x of a segment combined from place 0 to k; ``combine`` is associative.

    BLOCK places are folded in one row, and the blocks' totals are scanned in the same way, so that a segment of any
    length takes logarithmically many rounds.
    """
    step = lambda acc, p: F.concat(acc, F.array(combine(F.element_at(acc, -1), p["x"])))
    blocks = rows.groupBy("segment", F.expr(f"k div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts"))
    blocks = cut(blocks.select("segment", "b", F.transform("parts", lambda p: p["k"]).alias("ks"), F.aggregate(F.slice("parts", 2, BLOCK), F.array(F.col("parts")[0]["x"]), step).alias("xs")))
    each = lambda df, *more: df.select("segment", *more, F.explode(F.arrays_zip("ks", "xs")).alias("e"))
    if (blocks.agg(F.max("b")).first()[0] or 0) == 0:
        return each(blocks).select("segment", F.col("e.ks").alias("k"), F.col("e.xs").alias("x"))
    before = scan(blocks.select("segment", F.col("b").alias("k"), F.element_at("xs", -1).alias("x")), combine)
    met = blocks.join(before.select("segment", (F.col("k") + 1).alias("b"), F.col("x").alias("before")), ["segment", "b"], "left")
    return each(met, "before").select("segment", F.col("e.ks").alias("k"), F.when(F.col("before").isNull(), F.col("e.xs")).otherwise(combine(F.col("before"), F.col("e.xs"))).alias("x"))
