"""Whitening and clustering against brute force: nulls, other lengths, ties, repeated rows, columns of clashing names."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from weftline.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string, cluster int"


def rows(dims: int, count: int = 300, seed: int = 3) -> list[tuple]:
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(5, dims))
    data = [(middle[i % 5] + draw.normal(scale=0.3, size=dims)).astype(np.float32).tolist() for i in range(count)]
    out = [(i, v, 1, "clash", 2) for i, v in enumerate(data)]
    bad = [None, [], [None] * dims, [math.nan] * dims, [math.inf] * dims, data[0][: dims - 1], [*data[0], 0.5]]
    out += [(1000 + i, v, None, None, None) for i, v in enumerate(bad)]
    return [*out, out[7], out[7], (2000, data[7], 1, "copy", 1), (None, data[8], 1, None, None)]


def integers(v, scale: int, shift: int, dims: int) -> tuple | None:
    if v is None or len(v) != dims or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(scale * float(np.float32(c))) + shift for c in v)


@pytest.mark.parametrize("dims", [1, 6, 24])
def test_whitening_against_exact_sums(spark, dims):
    table = rows(dims)
    got = whitening.whiten(spark.createDataFrame(table, SCHEMA), components=16).collect()
    x = [(r, integers(r[1], 64, 1_000_000, dims)) for r in table]
    x = [(r, v) for r, v in x if v]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(v[i] for v in fit) for i in range(dims)]
    v = np.array(fit, dtype=np.float64)
    v -= v.mean(axis=0)
    cov = v.T @ v / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert sorted((repr(r["vec_id"]), r["n_"], r["deviation"]) for r in got) == sorted((repr(r[0]), n, sum((n * a - s) ** 2 for a, s in zip(t, sums, strict=True))) for r, t in x)
    assert [r["x"] for r in got if r["vec_id"] == 2000] == ["copy"] and len([1 for r in got if r["vec_id"] == 7]) == 3
    k = min(16, dims)
    assert all(len(r["whitened"]) == k for r in got)
    np.testing.assert_allclose(got[0]["explained"], values[:k] / np.trace(cov), rtol=1e-9)
    whole = {r["vec_id"]: r["whitened"] for r in got}
    z = np.array([next(iter(whole[r[0]] for r, t in x if t == f and r[0] is not None)) for f in fit if any(t == f and r[0] is not None for r, t in x)])
    if len(z) == n:
        np.testing.assert_allclose(z.T @ z / n - np.outer(z.mean(axis=0), z.mean(axis=0)), np.eye(k), atol=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_of_nothing_and_of_one_vector(spark):
    none = whitening.whiten(spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA))
    assert none.count() == 0 and none.columns[-5:] == ["n_", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1, "x", 1)] * 3, SCHEMA)).collect()
    assert [(r["n_"], r["deviation"], r["whitened"]) for r in one] == [(1, 0, [])] * 3


def test_deviation_is_exact_beyond_doubles():
    model = whitening.Whitening(3_000_000, [3_000_000 * 1_000_000 + 1], 1.0, np.ones(1), np.ones((1, 1)))
    assert model.deviation(np.array([[1_000_700]])) == [(3_000_000 * 700 - 1) ** 2]


def lloyd(table: list[tuple], dims: int, k: int, rounds: int, scale: int) -> list[tuple]:
    kept = [(r[0], integers(r[1], scale, 0, dims)) for r in table if r[0] is not None]
    kept = [(i, v) for i, v in kept if v]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, b), j) for j, b in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return sorted((i, j, d, sum(e for _, e, o in last if o == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)


@pytest.mark.parametrize(("dims", "scale", "rounds"), [(3, 2, 3), (8, 64, 3), (2, 1, 6)])
def test_clusters_against_lloyd(spark, dims, scale, rounds):
    table = rows(dims)
    got = centroids.cluster(spark.createDataFrame(table, SCHEMA), k=7, rounds=rounds, scale=scale, dims=dims)
    assert sorted(map(tuple, got.collect())) == lloyd(table, dims, 7, rounds, scale)


def test_few_and_no_vectors(spark):
    few = [(i, [float(i), 1.0], 1, "", 1) for i in range(3)]
    got = centroids.cluster(spark.createDataFrame(few, SCHEMA), dims=2)
    assert sorted(map(tuple, got.collect())) == lloyd(few, 2, 16, 3, 64)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_save_distances_and_lose_no_tie():
    draw = np.random.default_rng(9)
    x = draw.integers(-4, 5, (4000, 2))  # many ties
    c = draw.integers(-4, 5, (9, 2))
    cluster, upper, lower = centroids.first_bounds(x, c)
    taken = 0
    for _ in range(6):
        new = c + draw.integers(-1, 2, c.shape)
        cluster, upper, lower, computed = centroids.reassigned(x, cluster, upper, lower, new, centroids.moved(c, new))
        c = new
        far = np.stack([((x - b) ** 2).sum(axis=1) for b in c], axis=1)
        assert (cluster == far.argmin(axis=1)).all()
        assert (upper**2 >= far.min(axis=1)).all() and (lower**2 <= far + 1e-9).all()
        taken += computed.sum()
    big = draw.normal(scale=100, size=(2000, 8)).astype(np.int64) + draw.integers(0, 5, (2000, 1)) * 1000
    c = big[:5]
    cluster, upper, lower = centroids.first_bounds(big, c)
    new = c + 1
    assert centroids.reassigned(big, cluster, upper, lower, new, centroids.moved(c, new))[3].mean() < 3
