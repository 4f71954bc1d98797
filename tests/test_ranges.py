"""Range joins, draws and merged segments against plain loops, with hot groups and odd values."""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from weftline.operators import ranges


def test_range_join_against_all_pairs(spark):
    rng = random.Random(1)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e300, 2.5]
    points = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-9, 9))]), i % 3) for i in range(150)] + [(200 + k, x, 0) for k, x in enumerate(odd)]
    spans = []
    for j in range(120):
        a = rng.choice([rng.uniform(-60, 50), float(rng.randint(-9, 9))])
        spans.append((j, a, a + rng.choice([0.0, 1e-9, 0.3, 4.0, 40.0, 1e6, -1.0]), j % 3))
    spans += [(200, -math.inf, math.inf, 0), (201, None, 3.0, 0), (202, 1.0, math.nan, 0), (203, 1e299, 1e301, 0), (204, 0.0, 0.0, 0)]
    p, s = spark.createDataFrame(points, "p long, at double, g long"), spark.createDataFrame(spans, "s long, lo double, hi double, g long")
    far = lambda x: max(min(x, 1.7e308), -1.7e308)
    want = sorted((i, j) for i, x, g in points for j, a, b, h in spans if g == h and None not in (x, a, b) and not any(map(math.isnan, (x, a, b))) and far(a) <= far(x) <= far(b) and a <= b)
    got = ranges.range_join(p, s, "at", "lo", "hi", ["g"])
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.range_join(p, s.limit(0), "at", "lo", "hi", ["g"]).count() == 0


def test_draws_follow_the_cumulative_weights(spark):
    rng = random.Random(2)
    weights = {(r, s): rng.choice([0.0, rng.uniform(0, 3)]) for r in range(3) for s in range(40 if r == 0 else 4)} | {(1, 3): 2.0, (9, 0): 0.0}
    entries = [(i, 0 if i < 250 else i % 3, rng.random()) for i in range(330)] + [(400, 1, 0.0), (401, 1, 1.0), (402, 9, 0.5), (403, 7, 0.5), (404, 1, None)]
    w = spark.createDataFrame([(r, s, x) for (r, s), x in weights.items()], "row long, state long, w double")
    got = {r["e"]: r["state"] for r in ranges.categorical_draws(spark.createDataFrame(entries, "e long, row long, u double"), w, "e", "row", "u", "state", "w").collect()}
    assert set(got) == {e for e, *_ in entries}
    for e, row, u in entries:
        live = [(s, x) for (r, s), x in sorted(weights.items()) if r == row and x > 0]
        if not live or u is None:
            assert got[e] is None
            continue
        starts = [0.0, *accumulate(x for _, x in live)]
        assert got[e] == live[min(bisect_right(starts, u * starts[-1]), len(live)) - 1][0]
    with pytest.raises(Exception, match="below 0"):
        ranges.categorical_draws(spark.createDataFrame([(1, 1, 0.5)], "e long, row long, u double"), spark.createDataFrame([(1, 1, -1.0)], "row long, state long, w double"), "e", "row", "u", "state", "w").collect()


def greedy(segments, least, heavy):
    out, now, length, weight, start = [], 0, 0.0, 0.0, 0
    for k, (n, w) in enumerate(segments):
        length, weight = length + n, weight + w
        out.append(now)
        if length >= least and weight >= heavy:
            now, length, weight, start = now + 1, 0.0, 0.0, k + 1
    if start < len(segments) and now:
        out[start:] = [now - 1] * (len(segments) - start)
    return out


@pytest.mark.parametrize(("least", "heavy"), [(5.0, 0.0), (12.0, 3.0), (0.0, 2.0), (1e6, 0.0), (0.0, 0.0)])
def test_merged_segments_equal_the_greedy_rule(spark, least, heavy):
    rng = random.Random(3)
    groups = {"hot": 300, "a": 1, "b": 7, "c": 20, None: 9}
    rows = {g: [(float(rng.randint(0, 6)), float(rng.randint(0, 2))) for _ in range(n)] for g, n in groups.items()}
    table = spark.createDataFrame([(g, k, n, w, "x") for g, own in rows.items() for k, (n, w) in enumerate(own)], "g string, k long, len double, w double, more string")
    got = ranges.floored(table, "g", ["k"], "len", least, "w", heavy)
    assert got.columns == ["g", "k", "len", "w", "more", "merged"]
    held = {(r["g"], r["k"]): r["merged"] for r in got.collect()}
    assert held == {(g, k): m for g, own in rows.items() for k, m in enumerate(greedy(own, least, heavy))}
    assert ranges.floored(table.limit(0), "g", ["k"], "len", least).count() == 0
    assert got.where(F.col("merged").isNull()).count() == 0


def test_range_totals_equal_those_of_the_pairs(spark):
    rng = random.Random(4)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e300]
    points = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-9, 9))]), i % 3) for i in range(300)] + [(400 + k, x, 0) for k, x in enumerate(odd)] + [(450, 1.0, None)]
    spans = []
    for j in range(120):
        a = rng.choice([rng.uniform(-60, 50), float(rng.randint(-9, 9))])
        spans.append((j // 2 if j < 20 else j, a, a + rng.choice([0.0, 1e-9, 0.3, 4.0, 40.0, 1e6, -1.0]), j % 3))
    spans += [(200, -math.inf, math.inf, 0), (201, None, 3.0, 0), (202, 1.0, math.nan, 0), (203, 0.0, 0.0, 0), (204, -9.0, 9.0, None)]
    p, s = spark.createDataFrame(points, "p long, at double, g long"), spark.createDataFrame(spans, "s long, lo double, hi double, g long")
    for on in (["g"], []):
        want = ranges.range_join(p, s, "at", "lo", "hi", on).groupBy("s").agg(F.count("*").alias("n"), F.min("p").alias("first"))
        got = ranges.range_totals(p, s, "at", "lo", "hi", "s", "p", on)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ranges.range_totals(p, s.limit(0), "at", "lo", "hi", "s", "p").count() == 0
