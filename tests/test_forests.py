"""Spanning forests, forests' log partitions and the bounds on those of graphs, against enumeration and plain union-find."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import forests


def enumerated(sites, edges, h, q) -> float:
    total = []
    for s in itertools.product(range(q), repeat=len(sites)):
        x = dict(zip(sites, s, strict=True))
        total.append(sum(h[v][x[v]] for v in sites) + sum(w for i, j, w in edges if x[i] == x[j]))
    top = max(total)
    return top + math.log(sum(math.exp(t - top) for t in total))


def parts(sites, edges) -> dict:
    root = {v: v for v in sites}
    for _ in sites:
        for i, j, *_ in edges:
            root[i] = root[j] = min(root[i], root[j])
    return root


def kruskal(edges) -> set:
    root, out = {}, set()

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for _, i, j in sorted((o, i, j) for i, j, o in edges):
        if find(i) != find(j):
            root[find(i)] = find(j)
            out.add((i, j))
    return out


def rows(spark, data, kind):
    return spark.createDataFrame(data, kind)


def test_forest_log_partition(spark):
    rng, q = random.Random(3), 3
    nodes, edges, want = [], [], {}
    for tree in range(6):
        sites = list(range(8))
        h = {v: [rng.choice([0.0, 1.5, -2.0, float("-inf") if rng.random() < 0.2 else 0.3]) for _ in range(q)] for v in sites}
        h[0][0] = h[5][1] = 0.0
        own = [(rng.randrange(v), v, rng.choice([-1.0, 0.5, 2.0])) for v in sites[1:] if v != 5 or tree % 2]
        nodes += [(tree, v, h[v]) for v in sites]
        edges += [(tree, i, j, [w if s == t else 0.0 for s in range(q) for t in range(q)]) for i, j, w in own]
        root = parts(sites, own)
        for c in set(root.values()):
            inside = [v for v in sites if root[v] == c]
            try:
                want[tree, c] = (len(inside), enumerated(inside, [e for e in own if root[e[0]] == c], h, q))
            except ValueError:
                want[tree, c] = (len(inside), float("-inf"))
    got = forests.forest_log_partition(rows(spark, nodes, "tree int, site long, field array<double>"), rows(spark, edges, "tree int, i long, j long, pair array<double>"), q)
    got = {(r.tree, r.component): (r.sites, r.log_z) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, (n, z) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(z, abs=1e-9)


def test_unequal_pairs_keep_their_direction(spark):
    pair = [0.1, 0.7, -0.4, 1.3]
    edges = [(0, v, v + 1, pair) if v % 2 else (0, v + 1, v, pair) for v in range(5)]
    got = forests.forest_log_partition(rows(spark, [(0, v, [0.0, 0.2 * v]) for v in range(6)], "tree int, site long, field array<double>"), rows(spark, edges, "tree int, i long, j long, pair array<double>"), 2)
    z = sum(math.exp(sum(0.2 * v * s[v] for v in range(6)) + sum(p[s[i] * 2 + s[j]] for _, i, j, p in edges)) for s in itertools.product((0, 1), repeat=6))
    assert got.first().log_z == pytest.approx(math.log(z))


def test_a_long_path_and_a_star(spark):
    n = 300
    edges = [(0, v, v + 1) for v in range(n - 1)] + [(1, 0, v) for v in range(1, n)]
    e = rows(spark, edges, "tree int, i long, j long").withColumn("pair", forests.potts_pair(F.lit(0.8), 3))
    nodes = spark.range(n).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"), F.col("id").alias("site"), F.array(*[F.lit(0.0)] * 3).alias("field"))
    got = {r.tree: (r.component, r.sites, r.log_z) for r in forests.forest_log_partition(nodes, e, 3).collect()}
    want = math.log(3) + (n - 1) * math.log(math.exp(0.8) + 2)
    for tree in (0, 1):
        assert got[tree][:2] == (0, n) and got[tree][2] == pytest.approx(want)


def test_loops_raise(spark):
    nodes = rows(spark, [(0, v, [0.0, 0.0]) for v in range(4)], "tree int, site long, field array<double>")
    for pairs in ([(0, 1), (1, 2), (0, 2)], list(itertools.combinations(range(4), 2))):
        e = rows(spark, [(0, i, j) for i, j in pairs], "tree int, i long, j long").withColumn("pair", forests.potts_pair(F.lit(1.0), 2))
        with pytest.raises(Exception, match="loop"):
            forests.forest_log_partition(nodes, e, 2).collect()


def test_spanning_forest_is_the_least(spark):
    rng = random.Random(5)
    pairs = [(30 * k + i, 30 * k + j) for k in range(3) for i, j in itertools.combinations(range(30), 2) if rng.random() < (0.05, 0.1, 0.4)[k]]
    edges = [(i, j, rng.randrange(6)) for i, j in pairs]
    got = forests.spanning_forest(rows(spark, edges, "i long, j long, order int")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == kruskal(edges)


def test_forests_cover_every_edge(spark):
    pairs = list(itertools.combinations(range(5), 2)) + [(20, 21)]
    found, k = forests.covering_forests(rows(spark, pairs, "i long, j long"), 2)
    got = found.collect()
    assert {(r.i, r.j) for r in got} == set(pairs) and 3 <= k <= 5
    times = {(i, j): sum((r.i, r.j) == (i, j) for r in got) for i, j in pairs}
    assert all(times[r.i, r.j] == r.times for r in got)
    for tree in range(k):
        own = [(r.i, r.j, 0) for r in got if r.tree == tree]
        assert len(own) == 5 and kruskal(own) == {e[:2] for e in own}


def test_bounds_hold_the_log_partition(spark):
    rng, q = random.Random(2), 3
    pairs = [(v, v + 1) for v in (0, 1, 3, 4, 6, 7)] + [(v, v + 3) for v in range(6)] + [(10, 11), (11, 12)]
    edges = [(i, j, rng.choice([-0.7, 0.9]) if i < 10 else 1.1) for i, j in pairs] + [(1, 0, 0.5), (4, 4, 0.25)]
    sites = [*range(9), 10, 11, 12, 15]
    h = {v: [rng.uniform(-1, 1) for _ in range(q)] for v in sites}
    e, f = rows(spark, edges, "i long, j long, w double"), rows(spark, list(h.items()), "site long, h array<double>")
    found = forests.log_partition_bounds(e, f, q, 4).join(forests.spanning_tree_bound(e, f, q).drop("sites"), "component")
    got = {r.component: r for r in found.collect()}
    assert {c: r.sites for c, r in got.items()} == {0: 9, 10: 3, 15: 1}
    root = parts(sites, edges)
    for c, r in got.items():
        own = [x for x in edges if root[x[0]] == c]
        z = enumerated([v for v in sites if root[v] == c], own, h, q)
        assert r.mean_field <= z + 1e-9 and z - 1e-9 <= r.bound <= r.saturated + 1e-9
        assert (r.decoupled is None) == any(w < 0 for *_, w in own)
        assert r.decoupled is None or r.decoupled <= r.mean_field + 1e-6
        if c:
            assert r.bound == pytest.approx(z)


def test_no_edges_and_no_sites(spark):
    none = rows(spark, [], "i long, j long, w double")
    one = forests.log_partition_bounds(none, rows(spark, [(7, [0.0, 1.0])], "site long, h array<double>"), 2, 1).first()
    assert one.component == 7 and one.decoupled == one.mean_field == pytest.approx(math.log(1 + math.e))
    assert forests.spanning_tree_bound(none, rows(spark, [], "site long, h array<double>"), 2, 0).collect() == []


def test_rounds_send_no_table_through_the_driver(spark):
    from weftline.operators.graph import bond_components

    edges = rows(spark, [(v, v + 1, 1.0) for v in range(5)], "i long, j long, w double")
    table = forests.laid(edges)
    roots = bond_components(edges)
    for met in (table.join(rows(spark, [(1, 2)], "i long, x long"), "i"), rows(spark, [(1, 2)], "site long, x long").join(roots, "site"), forests.mean_field(edges, rows(spark, [(v, [0.0, 0.1]) for v in range(6)], "site long, h array<double>"), 2, 1).join(roots, "site")):
        assert met.count() and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
