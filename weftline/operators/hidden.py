"""Hidden Markov operators on ragged segments: forward likelihood, best paths, expected counts, by scans of small matrices.

Each step is a matrix and products are associative, so that a segment of any length takes logarithmically many rounds and
no task holds a whole segment. A symbol that is null or out of range says nothing: any state may emit it.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.segments import BLOCK, numbered, scan, shifted
from weftline.sources.shared import cut

Matrix = list[list[float]]


def _scaled(entries: Column, scale: Column) -> Column:
    """Entries with their log scale, so that the largest is 1; the scale of zeros is -inf."""
    raw = F.struct(entries.alias("m"), F.array_max(entries).alias("top"), scale.alias("scale"))
    # bound to a variable, so that the entries are computed once
    return F.transform(F.array(raw), lambda r: F.struct(F.transform(r["m"], lambda x: F.when(r["top"] > 0, x / r["top"]).otherwise(0.0)).alias("m"), F.when(r["top"] > 0, r["scale"] + F.log(r["top"])).otherwise(float("-inf")).alias("scale")))[0]


def _times(states: int):  # noqa: ANN202
    """The product of two row-major matrices with their log scales."""

    def times(a: Column, b: Column) -> Column:
        entries = F.array(*(sum((a["m"][i * states + k] * b["m"][k * states + j] for k in range(1, states)), a["m"][i * states] * b["m"][j]) for i, j in product(range(states), repeat=2)))
        return _scaled(entries, a["scale"] + b["scale"])

    return times


def _best(states: int):  # noqa: ANN202
    """The max-plus product of two row-major matrices of logs."""
    return lambda a, b: F.array(*(F.greatest(*(a[i * states + k] + b[k * states + j] for k in range(states))) for i, j in product(range(states), repeat=2)))


def _matrices(initial: list[float], transition: Matrix, emission: Matrix, logs: bool = False) -> tuple[Column, Column, Column]:
    """The first steps' and later steps' matrices by symbol, and the place of column ``symbol`` in them: the last for a symbol
    that says nothing."""
    n = len(initial)
    seen = [[emission[j][s] for j in range(n)] for s in range(len(emission[0]))] + [[1.0] * n]
    told = (lambda v: math.log(v) if v > 0 else float("-inf")) if logs else float
    literal = lambda m: F.array(*(F.lit(told(v)) for v in m))
    later = F.array(*(literal([transition[i][j] * e[j] for i in range(n) for j in range(n)]) for e in seen))
    first = F.array(*(literal([initial[j] * e[j] for _ in range(n) for j in range(n)]) for e in seen))
    return first, later, F.when((F.col("symbol") >= 0) & (F.col("symbol") < len(seen) - 1), F.col("symbol")).otherwise(len(seen) - 1)


def _steps(rows: DataFrame, segment: str, order: list[str], symbol: str, initial: list[float], transition: Matrix, emission: Matrix, logs: bool = False) -> DataFrame:
    """segment, k, symbol and x: the matrix of each step. Every row of a first matrix is the initial distribution."""
    first, later, code = _matrices(initial, transition, emission, logs)
    laid = numbered(rows.select(F.col(segment).alias("segment"), F.col(symbol).cast("int").alias("symbol"), *order), "segment", order)
    m = F.when(F.col("k") == 0, F.get(first, code)).otherwise(F.get(later, code))
    return laid.select("segment", "k", "symbol", (m if logs else F.struct(m.alias("m"), F.lit(0.0).alias("scale"))).alias("x"))


def forward_log_likelihood(rows: DataFrame, segment: str, order: list[str], symbol: str, initial: list[float], transition: Matrix, emission: Matrix) -> DataFrame:
    """segment, log_likelihood of its symbols (0 to n - 1) by the forward recursion; -inf where no path can emit them."""
    states = len(initial)
    times = _times(states)
    first, later, code = _matrices(initial, transition, emission)
    laid = numbered(rows.select(F.col(segment).alias("segment"), F.col(symbol).cast("int").alias("symbol"), *order), "segment", order)
    laid = laid.select("segment", "k", code.alias("symbol"))
    longest = laid.agg(F.max("k")).first()[0] or 0
    # symbols, not matrices, are gathered and folded
    matrix = lambda p: F.struct(F.when(p["k"] == 0, F.get(first, p["symbol"])).otherwise(F.get(later, p["symbol"])).alias("m"), F.lit(0.0).alias("scale"))
    blocks = laid.groupBy("segment", F.expr(f"k div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("k", "symbol"))).alias("parts"))
    level = blocks.select("segment", F.col("b").alias("k"), F.aggregate(F.slice("parts", 2, BLOCK), matrix(F.col("parts")[0]), lambda a, p: times(a, matrix(p))).alias("x"))
    while longest >= BLOCK:
        level, longest = cut(level), longest // BLOCK
        blocks = level.groupBy("segment", F.expr(f"k div {BLOCK}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts"))
        level = blocks.select("segment", "k", F.aggregate(F.slice("parts", 2, BLOCK), F.col("parts")[0]["x"], lambda a, p: times(a, p["x"])).alias("x"))
    # every row of the first matrix is the initial distribution, so any row of the product holds the forward weights
    last = sum((F.col("x.m")[j] for j in range(1, states)), F.col("x.m")[0])
    return level.select("segment", F.when(last > 0, F.col("x.scale") + F.log(last)).otherwise(float("-inf")).alias("log_likelihood"))


def viterbi(rows: DataFrame, segment: str, order: list[str], symbol: str, initial: list[float], transition: Matrix, emission: Matrix) -> DataFrame:
    """segment, k, state: the most likely path of each segment; ties go to the lower state, from the end backwards.

    Best scores are a scan of max-plus products. What state a step comes from, given where it goes, is then a map of each
    place alone; the path is a scan of those maps from the last place back.
    """
    n = len(initial)
    steps = _steps(rows, segment, order, symbol, initial, transition, emission, logs=True)
    best = cut(scan(steps.select("segment", "k", "x"), _best(n)).select("segment", "k", F.slice("x", 1, n).alias("d")))

    def first_best(scores: list[Column]) -> Column:
        return F.array_position(F.array(*scores), F.greatest(*scores)).cast("int") - 1

    log = lambda v: math.log(v) if v > 0 else float("-inf")
    come = F.array(*(first_best([F.col("d")[i] + log(transition[i][j]) for i in range(n)]) for j in range(n)))
    end = F.array_repeat(first_best([F.col("d")[i] for i in range(n)]), n)
    last = best.groupBy("segment").agg(F.max("k").alias("last"))
    maps = best.join(last, "segment").select("segment", "last", (F.col("last") - F.col("k")).alias("k"), F.when(F.col("k") == F.col("last"), end).otherwise(come).alias("x"))
    path = scan(maps.select("segment", "k", "x"), lambda a, b: F.transform(a, lambda j: F.get(b, j)))
    return path.join(last, "segment").select("segment", (F.col("last") - F.col("k")).alias("k"), F.col("x")[0].cast("long").alias("state"))


def expected_counts(rows: DataFrame, segment: str, order: list[str], symbol: str, initial: list[float], transition: Matrix, emission: Matrix) -> DataFrame:
    """kind, i, j, n: the expected counts of a Baum-Welch step over all segments.

    ``initial`` counts first states j (i is 0), ``transition`` steps from i to j, ``emission`` symbols j of state i;
    places whose symbol says nothing have no emission. Normalised, they are the next parameters.
    """
    n = len(initial)
    times = _times(n)
    steps = cut(_steps(rows, segment, order, symbol, initial, transition, emission))
    ahead = scan(steps.select("segment", "k", "x"), times).withColumn("a", F.slice("x.m", 1, n))
    last = steps.groupBy("segment").agg(F.max("k").alias("last"))
    turned = steps.join(last, "segment").select("segment", (F.col("last") - F.col("k")).alias("k"), "x")
    back = scan(turned, lambda a, b: times(b, a)).join(last, "segment").withColumn("k", F.col("last") - F.col("k"))
    back = back.withColumn("b", F.array(*(sum((F.col("x.m")[i * n + j] for j in range(1, n)), F.col("x.m")[i * n]) for i in range(n))))
    met = steps.join(shifted(ahead, "a", "a", -1), ["segment", "k"], "left").join(shifted(ahead, "own", "a", 0), ["segment", "k"]).join(shifted(back, "b", "b", 1), ["segment", "k"], "left")
    met = met.withColumn("b", F.coalesce("b", F.array(*[F.lit(1.0)] * n)))
    here = [F.col("own")[i] * F.col("b")[i] for i in range(n)]
    pair = [F.col("a")[i] * F.col("x.m")[i * n + j] * F.col("b")[j] for i in range(n) for j in range(n)]
    met = met.select("k", "symbol", F.array(*here).alias("here"), F.when(F.col("k") > 0, F.array(*pair)).alias("pair"))
    share = lambda c: F.transform(F.array(F.struct(F.col(c).alias("v"), F.aggregate(c, F.lit(0.0), lambda x, y: x + y).alias("t"))), lambda r: F.transform(r["v"], lambda v: F.when(r["t"] > 0, v / r["t"]).otherwise(0.0)))[0]
    met = met.select("k", "symbol", share("here").alias("here"), share("pair").alias("pair"))
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("i"), j.cast("long").alias("j"))
    told = [F.struct(F.when(F.col("k") == 0, key("initial", 0, F.lit(j))).alias("key"), F.col("here")[j].alias("v")) for j in range(n)]
    told += [F.struct(F.when(F.col("k") > 0, key("transition", i, F.lit(j))).alias("key"), F.get("pair", F.lit(i * n + j)).alias("v")) for i in range(n) for j in range(n)]
    told += [F.struct(F.when((F.col("symbol") >= 0) & (F.col("symbol") < len(emission[0])), key("emission", i, F.col("symbol"))).alias("key"), F.col("here")[i].alias("v")) for i in range(n)]
    return met.select(F.explode(F.array(*told)).alias("e")).where("e.key is not null").groupBy("e.key").agg(F.sum("e.v").alias("n")).select("key.kind", "key.i", "key.j", "n")
