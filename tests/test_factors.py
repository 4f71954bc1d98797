"""Factor graphs against sums over all labellings: random forests of any arity, forbidden entries, loops."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from weftline.operators import factors

NEVER = float("-inf")


def forest(rng: random.Random, n: int):
    card = {v: rng.randint(1, 3) for v in range(n)}
    axes, free, f = [], list(range(1, n)), 0
    placed = [0]
    while free:
        if rng.random() < 0.15:  # a new tree
            placed = [free.pop()]
            continue
        arity = min(rng.randint(1, 3), len(free))
        own = [rng.choice(placed), *(free.pop() for _ in range(arity))]
        rng.shuffle(own)
        axes += [(f, k, v) for k, v in enumerate(own)]
        placed += own
        f += 1
    for v in rng.sample(range(n), n // 2):  # fields
        axes.append((f, 0, v))
        f += 1
    return card, axes, tables(rng, card, axes, f)


def tables(rng, card, axes, count):
    out = {}
    for f in range(count):
        own = [v for g, _, v in sorted(axes) if g == f]
        for idx in itertools.product(*(range(card[v]) for v in own)):
            r = rng.random()
            if r < 0.8:
                out[f, idx] = NEVER if r < 0.1 and any(idx) else rng.uniform(-2, 2)
    return out


def enumerated(card, axes, entries):
    own: dict = {}
    for f, _, v in sorted(axes):
        own.setdefault(f, []).append(v)
    for x in itertools.product(*(range(card[v]) for v in sorted(card))):
        yield x, sum(entries.get((f, tuple(x[v] for v in vs)), 0.0) for f, vs in own.items())


def frames(spark, card, axes, entries):
    return (
        spark.createDataFrame(sorted(card.items()), "v long, card int"),
        spark.createDataFrame(axes, "f long, axis int, v long"),
        spark.createDataFrame([(f, list(i), w) for (f, i), w in entries.items()], "f long, idx array<int>, logv double"),
    )


def logsum(xs):
    top = max(xs, default=NEVER)
    return NEVER if top == NEVER else top + math.log(sum(math.exp(x - top) for x in xs))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forests_are_exact(spark, seed):
    rng = random.Random(seed)
    card, axes, entries = forest(rng, 8)
    graph = frames(spark, card, axes, entries)
    every = list(enumerated(card, axes, entries))
    z = sum(r["log_z"] for r in factors.log_partition(*graph).collect())
    assert z == pytest.approx(logsum([w for _, w in every]), abs=1e-9)
    p = {(r["v"], r["state"]): r["p"] for r in factors.marginals(*graph).collect()}
    assert set(p) == {(v, s) for v, n in card.items() for s in range(n)}
    for (v, s), got in p.items():
        assert got == pytest.approx(math.exp(logsum([w for x, w in every if x[v] == s]) - logsum([w for _, w in every])), abs=1e-9)
    best = {r["v"]: r["state"] for r in factors.max_marginals(*graph).where("best").collect()}
    assert dict(every)[tuple(best[v] for v in sorted(card))] == pytest.approx(max(w for _, w in every), abs=1e-9)


def test_loops_raise_and_flood(spark):
    card = dict.fromkeys(range(4), 2)
    axes = [(f, k, v) for f, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 0)]) for k, v in enumerate((a, b))] + [(4, 0, 0)]
    entries = {(f, (s, s)): 0.3 for f in range(4) for s in range(2)} | {(4, (1,)): 0.5}
    graph = frames(spark, card, axes, entries)
    with pytest.raises(ValueError, match="loop"):
        factors.solve(*graph)
    sums, change, rounds = factors.loopy(*graph, rounds=40, settle=1e-6)
    assert change <= 1e-6 and rounds < 40
    m = {(r["v"], r["state"]): r["m"] for r in sums.collect()}
    every = list(enumerated(card, axes, entries))
    for v in card:
        true = logsum([w for x, w in every if x[v] == 1]) - logsum([w for x, w in every if x[v] == 0])
        assert m[v, 1] - m[v, 0] == pytest.approx(true, abs=0.06)
    assert factors.loopy(*graph, rounds=2, settle=0.0)[2] == 2


def test_odd_graphs(spark):
    alone = frames(spark, {0: 2, 1: 3}, [(0, 0, 0)], {(0, (0,)): NEVER, (0, (1,)): NEVER})
    assert {r["component"]: r["log_z"] for r in factors.log_partition(*alone).collect()} == {0: NEVER, 1: pytest.approx(math.log(3))}
    assert {r["p"] for r in factors.marginals(*alone).where("v = 0").collect()} == {None}
    with pytest.raises(ValueError, match="twice"):
        factors.solve(*frames(spark, {0: 2}, [(0, 0, 0), (0, 1, 0)], {(0, (0, 0)): 1.0}))


def test_whole_tables_stay_one_row_a_factor(spark):
    """A chain with a variable of many states, from tables in row-major order: a row a factor, not one for each entry and axis."""
    rng = random.Random(7)
    card = {v: 20 if v == 3 else 2 for v in range(8)}
    axes = [(f, k, v) for f in range(7) for k, v in enumerate((f + 1, f) if f % 2 else (f, f + 1))]
    entries = {(f, idx): NEVER if rng.random() < 0.1 and any(idx) else rng.uniform(-2, 2) for f in range(7) for idx in itertools.product(*(range(card[v]) for g, _, v in sorted(axes) if g == f))}
    variables, rows, _ = frames(spark, card, axes, entries)
    weights = spark.createDataFrame([(f, [w for (g, _), w in sorted(entries.items()) if g == f]) for f in range(7)], "f long, weights array<double>")
    parts, _ = factors._packed(variables, rows, weights)
    assert parts.count() == 7
    every = list(enumerated(card, axes, entries))
    m = {(r["v"], r["state"]): r["m"] for r in factors.solve(variables, rows, weights).collect()}
    assert m == {(v, s): pytest.approx(logsum([w for x, w in every if x[v] == s]), abs=1e-9) for v, n in card.items() for s in range(n)}
    assert [tuple(r) for r in factors.log_partition(variables, rows, weights).collect()] == [(0, pytest.approx(logsum([w for _, w in every]), abs=1e-9))]
