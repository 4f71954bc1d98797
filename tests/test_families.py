"""Count families and seeding against plain sums: densities of any count, M steps on a fine grid, draws in distribution."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.columns import digamma, log_gamma, trigamma
from weftline.operators import families, mixture


def test_gamma_columns_to_double_precision(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 9.99, 10.0, 25.0, 1e3, 1e6, 1e12]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("l"), digamma(F.col("x")).alias("d"), trigamma(F.col("x")).alias("t"), digamma(F.col("x") + 1).alias("d1"), trigamma(F.col("x") + 1).alias("t1")).collect()
    for r in got:
        assert r["l"] == pytest.approx(math.lgamma(r["x"]), rel=1e-13, abs=1e-13)
        assert r["d1"] - r["d"] == pytest.approx(1 / r["x"], rel=1e-9, abs=1e-13)
        assert r["t"] - r["t1"] == pytest.approx(1 / r["x"] ** 2, rel=1e-9, abs=1e-13)
    one = next(r for r in got if r["x"] == 1.0)
    assert one["d"] == pytest.approx(-0.5772156649015329, rel=1e-14) and one["t"] == pytest.approx(math.pi**2 / 6, rel=1e-14)


def test_no_count_is_lost(spark):
    rows = spark.createDataFrame([(0.0,), (60.0,), (1e7,), (-1.0,), (2.5,), (None,)], "x double")
    x = F.col("x")
    got = rows.select("x", mixture.poisson_log(x, 25.5).alias("p"), mixture.negative_binomial_log(x, 3.5, 0.12).alias("n"), mixture.binomial_log(x, 60, 0.4).alias("b"), mixture.beta_binomial_log(x, 60, 2.0, 3.0).alias("bb")).collect()
    for r in got:
        v = r["x"]
        if v is None:
            assert [r[k] for k in ("p", "n", "b", "bb")] == [None] * 4
        elif v < 0 or v != int(v):
            assert [r[k] for k in ("p", "n", "b", "bb")] == [-math.inf] * 4
        else:
            assert r["p"] == pytest.approx(v * math.log(25.5) - 25.5 - math.lgamma(v + 1), rel=1e-12)
            assert r["n"] == pytest.approx(math.lgamma(3.5 + v) - math.lgamma(3.5) - math.lgamma(v + 1) + 3.5 * math.log(0.12) + v * math.log1p(-0.12), rel=1e-10)
            inside = v <= 60
            assert math.isfinite(r["b"]) == math.isfinite(r["bb"]) == inside


def nb(counts, weights, mean, r):
    return sum(w * (math.lgamma(u + r) - math.lgamma(r) - math.lgamma(u + 1) + r * math.log(r / (r + mean)) + u * math.log(mean / (r + mean))) for u, w in zip(counts, weights, strict=True))


def test_dispersion_is_the_best_of_a_grid(spark):
    draw = np.random.default_rng(2)
    rows = [("wide", int(c), float(w)) for c, w in zip(draw.negative_binomial(2.5, 0.1, 400), draw.uniform(0.2, 2, 400), strict=True)]
    rows += [("large", int(c), 1.0) for c in draw.negative_binomial(0.7, 1e-5, 60)]
    rows += [("poisson", int(c), 1.0) for c in draw.binomial(40, 0.5, 300)]
    rows += [("zero", 0, 1.0), ("zero", 0, 2.0), (None, 3, 1.0), ("wide", None, 1.0), ("wide", 9, 0.0), ("one", 4, 1.0)]
    got = {r["state"]: r for r in families.negative_binomial_m_step(spark.createDataFrame(rows, "state string, n long, w double"), "state", "n", "w").collect()}
    assert set(got) == {"wide", "large", "poisson", "zero", "one"}
    for name in ("wide", "large"):
        mine = [(c, w) for s, c, w in rows if s == name and c is not None and w > 0]
        counts, weights = zip(*mine, strict=True)
        mean = sum(c * w for c, w in mine) / sum(weights)
        assert got[name]["mean"] == pytest.approx(mean, rel=1e-12) and not got[name]["at_boundary"]
        best = got[name]["dispersion"]
        assert all(nb(counts, weights, mean, best) >= nb(counts, weights, mean, best * f) for f in (0.5, 0.9, 0.999, 1.001, 1.1, 2))
    assert got["poisson"]["at_boundary"] and got["poisson"]["dispersion"] == pytest.approx(got["poisson"]["mean"] * math.sqrt(150), rel=1e-12)
    assert got["zero"]["dispersion"] is None and not got["zero"]["at_boundary"]
    empty = families.negative_binomial_m_step(spark.createDataFrame([], "state string, n long"), "state", "n")
    assert empty.count() == 0
    with pytest.raises(Exception, match="not a count"):
        families.negative_binomial_m_step(spark.createDataFrame([("a", -1)], "state string, n long"), "state", "n").collect()


def bb(rows, a, b):
    return sum(math.lgamma(u + a) - math.lgamma(a) + math.lgamma(n - u + b) - math.lgamma(b) - math.lgamma(n + a + b) + math.lgamma(a + b) for u, n in rows)


def test_concentration_is_the_best_of_a_grid(spark):
    draw = np.random.default_rng(3)
    rows = []
    for name, a, b in (("low", 0.4, 2.0), ("mid", 6.0, 3.0)):
        for _ in range(300):
            n = int(draw.integers(5, 70))
            rows.append((name, int(draw.binomial(n, draw.beta(a, b))), n))
    rows += [("plain", int(draw.binomial(30, 0.3)), 30) for _ in range(200)]
    rows += [("none", 0, 5), ("none", 0, 7), (None, 1, 2)]
    got = {r["state"]: r for r in families.beta_binomial_m_step(spark.createDataFrame(rows, "state string, k long, n long"), "state", "k", "n").collect()}
    for name in ("low", "mid"):
        mine, r = [(u, n) for s, u, n in rows if s == name], got[name]
        assert not r["at_boundary"]
        best = bb(mine, r["alpha"], r["beta"])
        assert all(best >= bb(mine, r["alpha"] * f, r["beta"] * g) for f in (0.9, 0.999, 1, 1.001, 1.1) for g in (0.9, 0.999, 1, 1.001, 1.1))
    plain = got["plain"]
    assert not plain["at_boundary"] or plain["alpha"] + plain["beta"] == pytest.approx(29 * math.sqrt(100), rel=1e-9)
    assert got["none"]["alpha"] is None


def test_seeds_are_drawn_in_proportion_to_squared_distances(spark):
    points = [(0, [0.0]), (1, [1.0]), (2, [3.0]), (3, [3.0])]
    table = spark.createDataFrame(points, "id long, v array<double>")
    seconds, firsts, turns = Counter(), Counter(), 40
    for seed in range(turns):
        got = [r["id"] for r in mixture.plus_plus_seeds(table, "id", "v", 2, seed).collect()]
        firsts[got[0]] += 1
        if got[0] == 0:
            seconds[got[1]] += 1
    assert all(n > turns / 4 * 0.3 for n in firsts.values()) and len(firsts) == 4
    assert seconds[0] == 0 and seconds[2] + seconds[3] > 2 * seconds[1]  # 18 to 1


def test_seeds_do_not_depend_on_partitions(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(200)] + [(None, [1.0, 1.0]), (300, None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    one, many = (mixture.plus_plus_seeds(table.repartition(n), "id", "v", 4, 3).collect() for n in (1, 7))
    assert one == many and len({r["id"] for r in one}) == 4
    same = spark.createDataFrame([(i, [1.0]) for i in range(3)], "id long, v array<double>")
    assert len(mixture.plus_plus_seeds(same, "id", "v", 3).collect()) == 3
    assert mixture.plus_plus_seeds(table.limit(0), "id", "v", 3).count() == 0
