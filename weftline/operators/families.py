"""M steps of the count families: sums over a state's counts become sums over tails, solved for all states in one projection.

``digamma(u + x) - digamma(x)`` is the sum of 1 / (x + j) over the counts j below u. Summed over weighted counts it is the sum
of T(j) / (x + j), where T(j) is the weight of the counts above j: tails between distinct counts are all that is kept of a
state, and no step of a solve meets the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.columns import digamma, trigamma

#: A span of tails up to this long is summed term by term.
TERMS = 16
NEWTON, HALVINGS = 40, 60
#: How far below its upper bound a dispersion is looked for, and what it never goes below.
BRACKET, FLOOR = 1e-9, 2.0**-52
MARGIN = 1e-12


def tails(cells: DataFrame, state: str, count: str, name: str) -> DataFrame:
    """``state`` and ``name``: the spans (a, b, t) of counts over which t is the weight of the counts above, by a.

    ``cells`` are (state, count, w), distinct counts from 0 up. Their number a state is at most its largest count.
    """
    rows = cells.groupBy(state, F.col(count).cast("double").alias("b")).agg(F.sum("w").alias("w"))
    order = Window.partitionBy(state).orderBy("b")
    rows = rows.select(state, F.coalesce(F.lag("b").over(order), F.lit(0.0)).alias("a"), "b", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("t"))
    return rows.groupBy(state).agg(F.array_sort(F.collect_list(F.when(F.col("b") > 0, F.struct("a", "b", "t")))).alias(name))


def rising(spans: Column, x: Column) -> Column:
    """The sum of t / (x + j) over the places j of all spans."""

    def of(s: Column) -> Column:
        few = F.aggregate(F.sequence(s["a"].cast("long"), s["b"].cast("long") - 1), F.lit(0.0), lambda acc, j: acc + 1 / (x + j))
        return s["t"] * F.when(s["b"] - s["a"] <= TERMS, few).otherwise(digamma(x + s["b"]) - digamma(x + s["a"]))

    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + of(s))


def bending(spans: Column, x: Column) -> Column:
    """The sum of t / (x + j) ** 2 over the places j of all spans."""

    def of(s: Column) -> Column:
        few = F.aggregate(F.sequence(s["a"].cast("long"), s["b"].cast("long") - 1), F.lit(0.0), lambda acc, j: acc + 1 / ((x + j) * (x + j)))
        return s["t"] * F.when(s["b"] - s["a"] <= TERMS, few).otherwise(trigamma(x + s["a"]) - trigamma(x + s["b"]))

    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + of(s))


def _once(x: Column, f) -> Column:  # noqa: ANN001
    return F.transform(F.array(x), f)[0]


def _halved(score, low: Column, high: Column) -> Column:  # noqa: ANN001
    """Where a falling ``score`` crosses 0 between the bounds."""

    def step(acc: Column, _: Column) -> Column:
        return _once((acc["low"] + acc["high"]) / 2, lambda m: _once(score(m) > 0, lambda up: F.struct(F.when(up, m).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(m).alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.alias("low"), high.alias("high")), step, lambda acc: (acc["low"] + acc["high"]) / 2)


def negative_binomial_m_step(rows: DataFrame, state: str, count: str, weight: str | None = None) -> DataFrame:
    """``state``, weight, mean, dispersion, at_boundary: the weighted maximum of each state's negative binomial.

    Its variance is mean + mean ** 2 / dispersion. The mean is the weighted mean; the dispersion is where the score of the
    profile crosses 0, by Newton steps in its logarithm that a bracket holds, all states in one projection. Where the score
    is still above 0 at mean * sqrt(weight / 2), beyond which no excess over a Poisson shows, that bound is the answer and
    ``at_boundary`` is true; FLOOR is the other end. Null counts or states, and rows of no weight, say nothing; a state
    whose counts are all 0 has no dispersion. Counts below 0 or between whole numbers raise.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = _cells(rows, state, [count], w)
    sums = cells.groupBy(state).agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col(count)) / F.sum("w")).alias("mean"))
    met = sums.join(tails(cells, state, count, "spans"), state)
    mean, total, spans = F.col("mean"), F.col("weight"), F.col("spans")
    score = lambda r: rising(spans, r) + total * F.log(r / (r + mean))
    slope = lambda r: total * (1 / r - 1 / (r + mean)) - bending(spans, r)

    def step(acc: Column, _: Column) -> Column:
        def moved(r: Column) -> Column:
            def told(s: Column) -> Column:
                low, high = F.when(s > 0, acc["x"]).otherwise(acc["low"]), F.when(s > 0, acc["high"]).otherwise(acc["x"])
                ends = F.struct(low.alias("low"), high.alias("high"))
                newton = acc["x"] - s / (r * slope(r))
                return _once(ends, lambda e: _once(newton, lambda n: F.struct(e["low"].alias("low"), e["high"].alias("high"), F.when((n > e["low"]) & (n < e["high"]), n).otherwise((e["low"] + e["high"]) / 2).alias("x"), (F.abs(n - acc["x"]) < 1e-14).alias("done"))))

            return _once(score(r), told)

        return F.when(acc["done"], acc).otherwise(_once(F.exp(acc["x"]), moved))

    met = met.withColumn("upper", mean * F.sqrt(total / 2)).withColumn("lower", F.greatest(F.col("upper") * BRACKET, F.lit(FLOOR)))
    met = met.withColumns({"over": F.when(mean > 0, score(F.col("upper")) > 0), "under": F.when(mean > 0, score(F.col("lower")) < 0)})
    start = F.struct(F.log("lower").alias("low"), F.log("upper").alias("high"), ((F.log("lower") + F.log("upper")) / 2).alias("x"), F.lit(False).alias("done"))
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, step, lambda acc: F.exp(acc["x"]))
    found = F.when(mean > 0, F.when(F.col("over"), F.col("upper")).when(F.col("under"), F.col("lower")).otherwise(inside))
    return met.select(state, "weight", "mean", found.alias("dispersion"), (F.coalesce("over", F.lit(False)) & (mean > 0)).alias("at_boundary"))


def beta_binomial_m_step(rows: DataFrame, state: str, count: str, trials: str, weight: str | None = None) -> DataFrame:
    """``state``, weight, alpha, beta, at_boundary: the weighted maximum of each state's beta-binomial.

    Rows have their own numbers of trials. Newton steps in the logarithms of alpha and beta, from the moments, solve all
    states in one projection; where the likelihood bends the wrong way, a step follows its slope. Beyond an alpha + beta of
    (mean trials - 1) * sqrt(weight / 2) no excess over a binomial shows: such states get that sum, with the rate that is
    best for it, and ``at_boundary`` is true. Null counts, trials or states, and rows of no weight, say nothing; states all
    of whose rows have no success or no failure have no alpha. Counts that are not whole from 0 to the trials raise.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = _cells(rows, state, [count, trials], w)
    wrong = F.when(F.col(count) > F.col(trials), F.raise_error(F.lit("more successes than trials")).cast("double")).otherwise(F.col("w"))
    cells = cells.withColumn("w", wrong)
    p = F.sum(F.col("w") * F.col(count)) / F.sum(F.col("w") * F.col(trials))
    sums = cells.groupBy(state).agg(F.sum("w").alias("weight"), p.alias("p"), (F.sum(F.col("w") * F.col(trials)) / F.sum("w")).alias("n"))
    part = lambda value, name: tails(cells.select(state, value.alias("u"), "w"), state, "u", name)
    met = sums.join(part(F.col(count), "sa"), state).join(part(F.col(trials) - F.col(count), "sb"), state).join(part(F.col(trials), "sn"), state)
    sa, sb, sn = F.col("sa"), F.col("sb"), F.col("sn")

    def step(acc: Column, _: Column) -> Column:
        def moved(at: Column) -> Column:
            a, b = at["a"], at["b"]
            down = F.struct(rising(sa, a).alias("ga"), rising(sb, b).alias("gb"), rising(sn, a + b).alias("gn"), bending(sa, a).alias("ha"), bending(sb, b).alias("hb"), bending(sn, a + b).alias("hn"))

            def told(d: Column) -> Column:
                ga, gb = a * (d["ga"] - d["gn"]), b * (d["gb"] - d["gn"])
                haa, hbb, hab = ga + a * a * (d["hn"] - d["ha"]), gb + b * b * (d["hn"] - d["hb"]), a * b * d["hn"]
                parts = F.struct(ga.alias("ga"), gb.alias("gb"), haa.alias("aa"), hbb.alias("bb"), hab.alias("ab"), (haa * hbb - hab * hab).alias("det"))

                def taken(q: Column) -> Column:
                    bent = (q["aa"] < 0) & (q["det"] > 0)
                    dx = F.when(bent, -(q["bb"] * q["ga"] - q["ab"] * q["gb"]) / q["det"]).otherwise(F.signum(q["ga"]) * 0.5)
                    dy = F.when(bent, -(q["aa"] * q["gb"] - q["ab"] * q["ga"]) / q["det"]).otherwise(F.signum(q["gb"]) * 0.5)
                    held = lambda d_: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d_))
                    return _once(F.struct(held(dx).alias("dx"), held(dy).alias("dy")), lambda m: F.struct((acc["x"] + m["dx"]).alias("x"), (acc["y"] + m["dy"]).alias("y"), ((F.abs(m["dx"]) + F.abs(m["dy"]) < 1e-13) | (F.exp(acc["x"]) + F.exp(acc["y"]) > 100 * F.col("bound"))).alias("done")))

                return _once(parts, taken)

            return _once(down, told)

        return F.when(acc["done"], acc).otherwise(_once(F.struct(F.exp(acc["x"]).alias("a"), F.exp(acc["y"]).alias("b")), moved))

    met = met.withColumn("bound", F.greatest(F.col("n") - 1, F.lit(MARGIN)) * F.sqrt(F.col("weight") / 2))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    start = F.struct(F.log(2 * F.col("p")).alias("x"), F.log(2 * (1 - F.col("p"))).alias("y"), F.lit(False).alias("done"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(2 * NEWTON)), start, step, lambda acc: F.struct(F.exp(acc["x"]).alias("a"), F.exp(acc["y"]).alias("b")))
    met = met.withColumn("s", F.when(open_, solved)).withColumn("at_boundary", F.coalesce(F.col("s.a") + F.col("s.b") > F.col("bound"), F.lit(False)))
    rate = _halved(lambda q: rising(sa, q * F.col("bound")) - rising(sb, (1 - q) * F.col("bound")), F.lit(MARGIN), F.lit(1 - MARGIN))
    met = met.withColumn("rate", F.when(F.col("at_boundary"), rate))
    alpha = F.when(F.col("at_boundary"), F.col("rate") * F.col("bound")).otherwise(F.col("s.a"))
    beta = F.when(F.col("at_boundary"), (1 - F.col("rate")) * F.col("bound")).otherwise(F.col("s.b"))
    return met.select(state, "weight", alpha.alias("alpha"), beta.alias("beta"), "at_boundary")


def _cells(rows: DataFrame, state: str, counts: list[str], weight: Column) -> DataFrame:
    """The weight of each state's distinct counts."""
    whole = lambda c: F.when((F.col(c) < 0) | (F.col(c) != F.floor(c)), F.raise_error(F.lit(f"{c} is not a count")).cast("double")).otherwise(F.col(c).cast("double"))
    used = rows.select(state, *(whole(c).alias(c) for c in counts), weight.alias("w")).dropna(subset=[state, *counts]).where("w > 0")
    return used.groupBy(state, *counts).agg(F.sum("w").alias("w"))
