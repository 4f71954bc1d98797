"""Trees of any depth, taxa of any name, states out of range."""

from __future__ import annotations

import math
import random

import pytest

from weftline.operators import tree


def test_paths_in_forests_against_plain_walks(spark):
    rng = random.Random(2)
    parent = {0: None, 100: None}
    for v in range(1, 60):
        parent[v] = rng.choice([max(v - 1, 0), rng.randrange(v)])
    for v in range(101, 110):
        parent[v] = rng.randrange(100, v)
    length = {v: round(rng.uniform(0, 2), 3) for v in parent}

    def up(v):
        out = [v]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    def between(a, b):
        x, y = up(a), up(b)
        both = set(x) & set(y)
        return sum(length[v] for v in x + y if v not in both) if both else None

    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(150)] + [(3, 3), (0, 0), (7, 999)]
    nodes = spark.createDataFrame([(v, p, length[v]) for v, p in parent.items()], "node long, parent long, length double")
    got = tree.path_distances(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(pairs)
    for r in got:
        want = between(r["a"], r["b"]) if r["b"] in parent else None
        assert r["distance"] is None if want is None else math.isclose(r["distance"], want, abs_tol=1e-9)


def test_a_path_of_many_nodes_keeps_rows_linear(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("id as node", "if(id = 0, null, id - 1) as parent", "1.0D as length")
    pairs = spark.createDataFrame([(0, n - 1), (n // 2, n - 1), (17, 17), (n - 1, n - 2)], "a long, b long")
    got = {(r["a"], r["b"]): r["distance"] for r in tree.path_distances(nodes, pairs).collect()}
    assert got == {(0, n - 1): n - 1, (n // 2, n - 1): n - 1 - n // 2, (17, 17): 0, (n - 1, n - 2): 1}


def test_taxa_of_any_name_and_number(spark):
    rng = random.Random(3)
    for names in (["a", "ab", "b", "bb"], [f"t.{k}" for k in range(35)]):
        rows = [tuple(rng.choice([0, 1, 2, None]) for _ in names) for _ in range(30)]
        table = spark.createDataFrame(rows, ", ".join(f"`{x}` long" for x in names))
        got = {(r["a"], r["b"]): r["p"] for r in tree.distance_matrix(table, names).collect()}
        want = {(names[i], names[j]): sum(None not in (r[i], r[j]) and r[i] != r[j] for r in rows) / len(rows) for i in range(len(names)) for j in range(i + 1, len(names))}
        assert got == pytest.approx(want)
        assert {r["p"] for r in tree.distance_matrix(table.limit(0), names).collect()} == {None}


def test_states_out_of_range_raise(spark):
    shape = [("root", None, 0.0), ("a", "root", 0.1), ("b", "root", 0.2)]
    bad = spark.createDataFrame([(4, 1, 1)], "a long, b long, weight long")
    for run in (lambda: tree.pruning_log_likelihood(bad, shape), lambda: tree.sankoff_score(bad, shape, [[0.0, 1.0], [1.0, 0.0]]), lambda: tree.fitch_score(bad.selectExpr("99L as a", "b", "weight"), shape)):
        with pytest.raises(Exception, match="a state of a"):
            run().collect()


def test_splits_that_sites_support(spark):
    rng = random.Random(6)
    names = ["t1", "t2", "t3", "x", "yy"]
    rows = [(*(rng.choice([0, 0, 1, 1, rng.choice([2, None])]) for _ in names), rng.randint(1, 3)) for _ in range(80)]
    want: dict = {}
    for *states, n in rows:
        own = [x for x, s in zip(names, states, strict=True) if s == states[0]]
        other = [x for x in names if x not in own]
        if None not in states and len(set(states)) == 2 and min(len(own), len(other)) > 1:
            split = ",".join(own) + "|" + ",".join(other)
            want[split] = want.get(split, 0) + n
    table = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in [*names, "weight"]))
    assert dict(tree.split_support(table, names).collect()) == want and want
