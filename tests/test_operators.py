"""Operators against brute force on small inputs, and their edge cases."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from weftline.operators import codes, comparison, enumeration, graph, hidden, mixture, segments, sequence, tree


FOUR = [("root", None, 0.0), ("x", "root", 0.15), ("a", "x", 0.1), ("b", "x", 0.2), ("c", "root", 0.3), ("d", "root", 0.25)]
SITES = [(0, 1, 2, 3, 2), (0, 0, 1, 1, 5), (3, 3, 3, 3, 7), (0, None, 2, 2, 1)]


def by_enumeration(row, step, pi):
    """The likelihood of one pattern, summed over all states of inner nodes and of leaves without a state."""
    free = [range(4) if v is None else (v,) for v in row[:4]]
    return sum(pi[r] * step["x"][r][x] * step["a"][x][a] * step["b"][x][b] * step["c"][r][c] * step["d"][r][d] for r, x, a, b, c, d in itertools.product(range(4), range(4), *free))


@pytest.mark.parametrize("model", ["jc", "gtr"])
def test_pruning_sums_over_all_inner_states(spark, model):
    pi = [0.25] * 4 if model == "jc" else [0.1, 0.2, 0.3, 0.4]
    matrix = tree.jc_matrix if model == "jc" else tree.gtr_matrix([1.0, 2.0, 0.5, 1.5, 3.0, 0.7], pi)
    step = {node: matrix(t) for node, _, t in FOUR}
    for p in step.values():
        assert all(math.isclose(sum(row), 1, rel_tol=1e-9) for row in p)
        assert all(math.isclose(pi[i] * p[i][j], pi[j] * p[j][i], rel_tol=1e-9, abs_tol=1e-12) for i in range(4) for j in range(4))
    want = sum(r[4] * math.log(by_enumeration(r, step, pi)) for r in SITES)
    df = spark.createDataFrame(SITES, "a long, b long, c long, d long, weight long")
    got = tree.pruning_log_likelihood(df, FOUR, 4, matrix, pi).first()
    assert (got["n_patterns"], got["n_sites"]) == (4, 15) and math.isclose(got["log_likelihood"], want, rel_tol=1e-10)
    assert tree.pruning_log_likelihood(df.limit(0), FOUR).first()["n_patterns"] == 0


def test_deep_trees_do_not_underflow(spark):
    comb = [("n0", None, 0.0)] + [(f"n{i}", f"n{i - 1}", 0.5) for i in range(1, 40)] + [(f"t{i}", f"n{i}", 2.0) for i in range(40)] + [("t40", "n39", 2.0)]
    row = {f"t{i}": i % 4 for i in range(41)}
    df = spark.createDataFrame([{**row, "weight": 1}])
    below, step = tree.children_of(comb), {n: tree.jc_matrix(t) for n, _, t in comb}
    part, scale = {f"t{i}": [float(s == i % 4) for s in range(4)] for i in range(41)}, 0.0
    for node, kids in below.items():
        x = [math.prod(sum(step[c][s][r] * part[c][r] for r in range(4)) for c in kids) for s in range(4)]
        scale += math.log(max(x))
        part[node] = [v / max(x) for v in x]
    assert math.isclose(tree.pruning_log_likelihood(df, comb).first()["log_likelihood"], scale + math.log(sum(part["n0"]) / 4), rel_tol=1e-10)


def test_parsimony_against_all_inner_states(spark):
    shape = [("r", None, 0.0), ("x", "r", 0.0), ("a", "x", 0.0), ("b", "x", 0.0), ("y", "r", 0.0), ("c", "y", 0.0), ("d", "y", 0.0)]
    cost = [[abs(i - j) * 1.5 for j in range(4)] for i in range(4)]
    unit = [[float(i != j) for j in range(4)] for i in range(4)]
    df = spark.createDataFrame(SITES[:3], "a long, b long, c long, d long, weight long")

    def least(m):
        return sum(w * min(m[r][x] + m[r][y] + m[x][a] + m[x][b] + m[y][c] + m[y][d] for r, x, y in itertools.product(range(4), repeat=3)) for a, b, c, d, w in SITES[:3])

    assert tree.sankoff_score(df, shape, cost).first()["score"] == least(cost)
    assert tree.sankoff_score(df, shape, unit).first()["score"] == tree.fitch_score(df, shape).first()["score"] == least(unit)


def test_trees_are_checked():
    for bad in ([("a", "b", 1.0), ("b", "a", 1.0)], [("a", None, 0.0), ("b", None, 0.0)], [("r", None, 0.0), ("a", "b", 1.0), ("b", "a", 1.0)]):
        with pytest.raises(ValueError, match="root"):
            tree.children_of(bad)


def test_parallel_edges_are_doubled_bonds(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0), (1, 2, 0.5)], "i long, j long, w double")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "site long, label long")
    assert graph.potts_energy(edges, labels).first()["energy"] == -2.0
    assert graph.cut_value(edges, labels).first()["cut"] == 0.5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "i long, j long, w double")
    assert {r["root"] for r in graph.bond_components(edges).collect()} == {0, 100}


def test_em_never_lowers_the_likelihood(spark):
    rows = spark.createDataFrame([(float(x % 17), 1 + x % 3) for x in range(60)], "value double, n long")
    _, trace = mixture.fit_gaussians(rows, [(0.5, 2.0, 4.0), (0.5, 12.0, 4.0)], 4)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(trace))


def test_min_sum_against_all_pairs(spark):
    checks = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)]
    llr = {0: 1.5, 1: -0.5, 2: 2.0, 3: -3.0}
    want = {}
    for b, own in llr.items():
        want[b] = own
        for c in {c for c, x in checks if x == b}:
            rest = [llr[x] for k, x in checks if k == c and x != b]
            want[b] += math.prod(1 if v > 0 else -1 for v in rest) * min(map(abs, rest))
    got = codes.min_sum_pass(spark.createDataFrame(checks, "chk long, bit long"), spark.createDataFrame(list(llr.items()), "bit long, llr double"))
    assert {r["bit"]: r["total"] for r in got.collect()} == want


def test_empty_edges(spark):
    edges = spark.createDataFrame([], "i long, j long, w double")
    labels = spark.createDataFrame([], "site long, label long")
    assert graph.potts_energy(edges, labels).first()["energy"] == 0.0
    assert graph.bond_components(edges).count() == 0


def test_forward_over_several_blocks(spark):
    initial, step, emit = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.25, 0.75]]
    symbols = {0: [k * k % 3 % 2 for k in range(hidden.BLOCK * 3 + 5)], 1: [1], 2: [0] * (hidden.BLOCK + 1)}
    want = {}
    for g, seen in symbols.items():
        w, total = [initial[j] * emit[j][seen[0]] for j in range(2)], 0.0
        for s in seen[1:]:
            scale = sum(w)
            total += math.log(scale)
            w = [sum(w[i] / scale * step[i][j] for i in range(2)) * emit[j][s] for j in range(2)]
        want[g] = total + math.log(sum(w))
    rows = spark.createDataFrame([(g, k, s) for g, seen in symbols.items() for k, s in enumerate(seen)], "g long, k long, s long")
    got = dict(hidden.forward_log_likelihood(rows, "g", ["k"], "s", initial, step, emit).collect())
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], want[g], rel_tol=1e-12) for g in want)


MODEL = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.25, 0.75]]


@pytest.fixture(scope="module")
def hot(spark):
    """One segment holds most of the rows, dealt out over many partitions; symbols may be null or unknown."""
    draw = random.Random(2)
    symbols = {0: [draw.randrange(2) for _ in range(700)], 1: [1], 2: [0, None, 1, 1, 5, 0]}
    rows = [(g, k, s, draw.random()) for g, seen in symbols.items() for k, s in enumerate(seen)]
    draw.shuffle(rows)
    return symbols, {(g, k): v for g, k, _, v in rows}, spark.createDataFrame(rows, "g long, k long, s long, v double").repartition(8)


def test_paths_of_a_hot_segment(hot):
    symbols, _, df = hot
    initial, step, emit = MODEL
    says = lambda j, s: emit[j][s] if s in (0, 1) else 1.0
    got = {(r[0], r[1]): r[2] for r in hidden.viterbi(df, "g", ["k"], "s", *MODEL).collect()}
    for g, seen in symbols.items():
        d, back = [math.log(initial[j] * says(j, seen[0])) for j in range(2)], []
        for s in seen[1:]:
            come = [[d[i] + math.log(step[i][j]) for i in range(2)] for j in range(2)]
            back.append([x.index(max(x)) for x in come])
            d = [max(come[j]) + math.log(says(j, s)) for j in range(2)]
        path = [d.index(max(d))]
        for b in reversed(back):
            path.append(b[path[-1]])
        assert [got[g, k] for k in range(len(seen))] == path[::-1]


def test_expected_counts_of_a_hot_segment(hot):
    symbols, _, df = hot
    initial, step, emit = MODEL
    says = lambda j, s: emit[j][s] if s in (0, 1) else 1.0
    want: dict = {}
    for seen in symbols.values():
        a, b = [[initial[j] * says(j, seen[0]) for j in range(2)]], [[1.0, 1.0]]
        for s in seen[1:]:
            x = [sum(a[-1][i] * step[i][j] for i in range(2)) * says(j, s) for j in range(2)]
            a.append([v / sum(x) for v in x])
        for s in reversed(seen[1:]):
            x = [sum(step[i][j] * says(j, s) * b[-1][j] for j in range(2)) for i in range(2)]
            b.append([v / sum(x) for v in x])
        b.reverse()
        for k, s in enumerate(seen):
            total = sum(a[k][j] * b[k][j] for j in range(2))
            for j in range(2):
                for key in (("initial", 0, j) if k == 0 else None, ("emission", j, s) if s in (0, 1) else None):
                    if key:
                        want[key] = want.get(key, 0) + a[k][j] * b[k][j] / total
            if k:
                pair = {("transition", i, j): a[k - 1][i] * step[i][j] * says(j, s) * b[k][j] for i in range(2) for j in range(2)}
                for key, v in pair.items():
                    want[key] = want.get(key, 0) + v / sum(pair.values())
    got = {tuple(r)[:3]: r[3] for r in hidden.expected_counts(df, "g", ["k"], "s", *MODEL).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_running_values_of_a_hot_segment(hot):
    symbols, values, df = hot
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert segments.placed(df, "g", ["k"]).where("g = 0").select("_part").distinct().count() > 3
        rows = {(r["g"], r["k"]): r for r in sequence.returns_to_go(sequence.best_so_far(df, "g", ["k"], "v"), "g", ["k"], "v").collect()}
        for g, seen in symbols.items():
            for k in range(len(seen)):
                assert rows[g, k]["best"] == min(values[g, x] for x in range(k + 1))
                assert math.isclose(rows[g, k]["to_go"], sum(values[g, x] for x in range(k, len(seen))), rel_tol=1e-9)
        assert {(r["g"], r["k"]): r["n"] for r in segments.numbered(df, "g", ["k"], "n").collect()} == {key: key[1] for key in values}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_takes_the_last_value_at_or_before(spark):
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("a", 3, 2.0), ("b", 5, 9.0), (None, 1, 4.0)], "id string, t long, v double")
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 9), ("a", 9), ("b", 4), ("c", 1), (None, 2)], "id string, t long")
    got = sorted(map(tuple, comparison.as_of(left, right, "id", "t", "v").collect()), key=repr)
    assert got == sorted([("a", 0, None), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 9, 2.0), ("a", 9, 2.0), ("b", 4, None), ("c", 1, None), (None, 2, 4.0)], key=repr)


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (3, 9), (40, 61)], "only_first long, only_second long")
    want = [1.0 if a + b == 0 else min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) for a, b in ((0, 0), (1, 0), (3, 9), (40, 61))]
    got = [r["p"] for r in comparison.mcnemar(rows).orderBy("only_second", "only_first").collect()]
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(sorted(got), sorted(want), strict=True))


def test_belief_propagation_is_exact_on_a_chain(spark):
    edges, field, q = [(0, 1, 0.7), (1, 2, -0.4), (2, 3, 0.9)], [[0.2, -0.1], [0.0, 0.5], [0.3, 0.0], [-0.2, 0.1]], 2
    weight = {x: math.exp(sum(w for i, j, w in edges if x[i] == x[j]) + sum(field[s][x[s]] for s in range(4))) for x in itertools.product(range(q), repeat=4)}
    want = {(s, v): sum(w for x, w in weight.items() if x[s] == v) / sum(weight.values()) for s in range(4) for v in range(q)}
    got = enumeration.propagate(spark.createDataFrame(edges, "i long, j long, w double"), spark.createDataFrame([(s, *h) for s, h in enumerate(field)], "site long, h0 double, h1 double"), q, 4, 0.0)
    assert all(math.isclose(r["p"], want[r["site"], r["label"]], rel_tol=1e-9) for r in got.collect())
    one = spark.createDataFrame([(1, 0.5, [0.3, -0.1])], "graph long, scale double, field array<double>")
    chain = enumeration.configurations(one, 4, q, [(i, i + 1, 1.2) for i in range(3)])
    z = enumeration.log_partition(chain).first()["log_z"]
    assert math.isclose(enumeration.chain_log_partition(spark.createDataFrame([(4,)], "length long"), 0.6, [0.3, -0.1]).first()["log_z"], z, rel_tol=1e-12)
    with pytest.raises(ValueError, match="too many"):
        enumeration.configurations(one, 60, 3, [])


def test_a_component_that_nothing_belongs_to(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 4)], "value double, n long")
    params, _ = mixture.fit_gaussians(rows, [(0.5, 1.5, 1.0), (0.5, 1e9, 1e-6)], 3)
    assert all(math.isfinite(x) for p in params for x in p) and params[0][0] > 0.99
    params, _ = mixture.fit_gaussians(spark.createDataFrame([(7.0, 5)], "value double, n long"), [(1.0, 0.0, 1.0)], 2, floor=1e-6)
    assert params == [(1.0, 7.0, 1e-6)]


def test_paths_turn_at_the_nearest_common_ancestor(spark):
    nodes = spark.createDataFrame([(1, None, 9.0), (2, 1, 1.0), (3, 1, 2.0), (4, 2, 4.0), (5, 2, 8.0), (6, 4, 16.0), (50, None, 1.0)], "node long, parent long, length double")
    pairs = {(4, 5): 12.0, (6, 3): 23.0, (6, 2): 20.0, (3, 3): 0.0, (6, 50): None, (6, 77): None}
    assert {(r["a"], r["b"]): r["distance"] for r in tree.path_distances(nodes, spark.createDataFrame(list(pairs), "a long, b long")).collect()} == pairs
    ring = spark.createDataFrame([(1, 3, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, None, 1.0), (5, 4, 1.0)], nodes.schema)
    with pytest.raises(ValueError, match="cycle"):
        tree.path_distances(ring, spark.createDataFrame([(1, 2)], "a long, b long"))


def test_plans_have_no_nested_loops(spark):
    from weftline.plans import registry

    for name in ("degree_csr", "ragged_offsets", "transition_mle", "asof_curve_band", "gae"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
