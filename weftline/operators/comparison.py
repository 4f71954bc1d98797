"""Operators that compare predictions, methods and temperatures."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.segments import carried, numbered, placed, scan, shifted

#: So many times of a grid at most.
TIMES = 10_000


def r_squared(rows: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """One row, r2: the share of the target's variance that the prediction explains; null where it has none."""
    sums = rows.select(predicted.alias("p"), target.alias("t")).agg(F.sum((F.col("t") - F.col("p")) ** 2).alias("residual"), (F.var_pop("t") * F.count("t")).alias("total"))
    return sums.select(F.when(F.col("total") > 0, 1 - F.col("residual") / F.col("total")).alias("r2"))


def argmax_agreement(rows: DataFrame, group: str, item: str, predicted: Column, target: Column) -> DataFrame:
    """One row (groups, agreement): groups of two or more, and the share whose first largest target is the first largest prediction."""
    flat = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), predicted.alias("p"), target.alias("t"))
    best = flat.groupBy("g").agg(F.max(F.struct("p", (-F.col("i")).alias("i"))).alias("p"), F.max(F.struct("t", (-F.col("i")).alias("i"))).alias("t"), F.count("*").alias("n"))
    return best.where("n > 1").agg(F.count("*").alias("groups"), F.avg((F.col("p.i") == F.col("t.i")).cast("double")).alias("agreement"))


def paired_wins(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """One row (only_first, only_second, both, neither): on how many instances two methods hit."""
    hits = rows.select(first.alias("a"), second.alias("b"))
    return hits.agg(F.count_if(F.expr("a and not b")).alias("only_first"), F.count_if(F.expr("b and not a")).alias("only_second"), F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("not a and not b")).alias("neither"))


def swap_log_ratios(rungs: DataFrame, replica: str, beta: str, energy: str) -> DataFrame:
    """replica, beta, log_ratio: the log acceptance of an exchange between each rung and the next higher beta."""
    up = Window.partitionBy(replica).orderBy(beta)
    ratio = (F.col(beta) - F.lead(beta).over(up)) * (F.col(energy) - F.lead(energy).over(up))
    return rungs.select(F.col(replica).alias("replica"), F.col(beta).alias("beta"), ratio.alias("log_ratio")).where("log_ratio is not null")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` (key, time) with ``value``: the last non-null one of ``right`` at or before that time, null if there is none.

    Both sides are laid in one order and the value is carried over the parts of a key, so that no pairs of times are made
    and a hot key is dealt out. Rows of ``right`` that tie in time count by value; rows of ``left`` stay as often as they occur.
    """
    at = lambda df, side, v: df.select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(side).alias("side"), v.alias("value"))
    kind = right.schema[value].dataType
    order = ["time", "side", "value"]
    both = at(right, 0, F.col(value)).union(at(left, 1, F.lit(None).cast(kind)))
    out = carried(placed(both, "key", order), "key", order, F.col("value"), "last", "_found").where("side = 1")
    return out.select(F.col("key").alias(key), F.col("time").alias(time), F.col("_found").alias(value))


def curve_band(traces: DataFrame, trial: str, time: str, value: str, grid: DataFrame) -> DataFrame:
    """time, trials, mean, sd over the trials' last values at each time of ``grid``, where every trial has started.

    The grid is a report's: each trial gets a row for each of its times, of which more than TIMES raise.
    """
    trials = traces.select(trial).distinct()
    times = sorted(r[0] for r in grid.select(time).where(F.col(time).isNotNull()).distinct().limit(TIMES + 1).collect())
    if len(times) > TIMES:
        raise ValueError(f"a grid has at most {TIMES} times")
    kind = grid.schema[time].dataType.simpleString()
    asked = trials.withColumn(time, F.explode(F.array(*map(F.lit, times)).cast(f"array<{kind}>")))
    met = as_of(asked, traces, trial, time, value).groupBy(time).agg(F.count("*").alias("trials"), F.count(value).alias("started"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return met.where("started = trials").select(F.col(time).alias("time"), "trials", "mean", F.when(F.col("trials") > 1, F.col("sd")).otherwise(0.0).alias("sd"))


def round_trips(trace: DataFrame, walker: str, order: list[str], rung: str, top: int) -> DataFrame:
    """walker, trips: how often a walker comes to rung 0 having reached ``top`` since it was there."""
    ends = trace.where(F.col(rung).isin(0, top)).select(F.col(walker).alias("segment"), F.col(rung).alias("rung"), *order)
    ends = numbered(ends, "segment", order)
    met = ends.join(shifted(ends, "last", "rung", -1), ["segment", "k"])
    trips = met.where((F.col("rung") == 0) & (F.col("last") == top)).groupBy("segment").agg(F.count("*").alias("trips"))
    return trace.select(F.col(walker).alias("segment")).distinct().join(trips, "segment", "left").select(F.col("segment").alias("walker"), F.coalesce("trips", F.lit(0)).alias("trips"))


def advantages(rows: DataFrame, episode: str, order: list[str], reward: Column, worth: Column, decay: float) -> DataFrame:
    """``episode``, ``order`` and ``advantage``: the decayed sum of what each later step gains over the worth of its state.

    The gain of a step is its reward and the next state's worth less its own; the state after the last step is worth 0. The
    sums are a scan from the last step back, so that episodes may be of any length.
    """
    laid = rows.select(F.col(episode).alias("segment"), *order, reward.cast("double").alias("reward"), worth.cast("double").alias("worth"))
    laid = numbered(laid, "segment", order)
    last = laid.groupBy("segment").agg(F.max("k").alias("last"))
    met = laid.join(shifted(laid, "next", "worth", 1), ["segment", "k"], "left").join(last, "segment")
    gain = F.col("reward") + F.coalesce("next", F.lit(0.0)) - F.col("worth")
    turned = met.select("segment", (F.col("last") - F.col("k")).alias("k"), F.struct(F.lit(decay).alias("p"), gain.alias("v")).alias("x"))
    sums = scan(turned, lambda a, b: F.struct((a["p"] * b["p"]).alias("p"), (b["v"] + b["p"] * a["v"]).alias("v"))).join(last, "segment")
    sums = sums.select("segment", (F.col("last") - F.col("k")).alias("k"), F.col("x.v").alias("advantage"))
    return laid.join(sums, ["segment", "k"]).select(F.col("segment").alias(episode), *order, "advantage")


def relabel(draws: DataFrame, pivot: DataFrame, k: int) -> DataFrame:
    """draw, labels, agreement: the renaming of each draw's labels that agrees with ``pivot`` on most observations.

    ``draws`` are (draw, obs, label), ``pivot`` (obs, label). ``labels`` lists, for each label of the pivot, the draw's own;
    of equal ones the first in order wins. Only the k * k counts of a draw meet the k! renamings; more than 6 labels raise.
    """
    if k > 6:
        raise ValueError("more than 6 labels have too many renamings")
    met = draws.join(pivot.select("obs", F.col("label").alias("want")), "obs").where(F.col("label").between(0, k - 1) & F.col("want").between(0, k - 1))
    cell = [F.sum(F.when((F.col("want") == i) & (F.col("label") == j), 1).otherwise(0)).alias(f"n{i}_{j}") for i in range(k) for j in range(k)]
    counts = met.groupBy("draw").agg(*cell)
    told = [F.struct(sum((F.col(f"n{i}_{j}") for i, j in list(enumerate(p))[1:]), F.col(f"n0_{p[0]}")).alias("agreement"), F.lit(-at).alias("back"), F.lit(",".join(map(str, p))).alias("labels")) for at, p in enumerate(itertools.permutations(range(k)))]
    return counts.select("draw", F.greatest(*told).alias("best")).select("draw", "best.labels", "best.agreement")


def mcnemar(wins: DataFrame) -> DataFrame:
    """``paired_wins`` rows with ``p``: the exact two-sided binomial of the discordant pairs; 1 if there are none."""
    m, n = F.least("only_first", "only_second"), F.col("only_first") + F.col("only_second")
    log2n = n * math.log(2)
    # log(n over i) grows from i - 1 by log((n - i + 1) / i); probabilities add up as they go
    step = lambda acc, i: F.struct((acc["c"] + F.log((n - i + 1) / i)).alias("c"), (acc["t"] + F.exp(acc["c"] + F.log((n - i + 1) / i) - log2n)).alias("t"))
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-log2n).alias("t"))
    tail = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, step, lambda a: a["t"])).otherwise(F.exp(-log2n))
    return wins.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def temperatures(rows: DataFrame, hot: str, cold: str, steps: int, power: float = 1.0) -> DataFrame:
    """``rows`` with step and a column for each ramp from ``hot`` to ``cold``, both above 0: linear, exponential, cosine,
    inverse (linear in 1 / T), and power."""
    f, h, c = F.col("step") / max(steps - 1, 1), F.col(hot), F.col(cold)
    mix = lambda a, b: (1 - f) * a + f * b
    return rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).select(
        "*",
        mix(h, c).alias("linear"),
        F.exp(mix(F.log(h), F.log(c))).alias("exponential"),
        (c + (h - c) * (1 + F.cos(math.pi * f)) / 2).alias("cosine"),
        (1 / mix(1 / h, 1 / c)).alias("inverse"),
        (h / F.pow(1 + F.col("step"), F.lit(power))).alias("power"),
    )
