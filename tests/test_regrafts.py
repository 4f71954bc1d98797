"""Subtree pruning and regrafting against cutting and joining plain adjacency lists."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import topology


def grown(rng: random.Random, n: int) -> set:
    """The edges of a random unrooted tree; leaves are names, inner nodes numbers."""
    edges, inner = {frozenset(("a", 0)), frozenset(("b", 0)), frozenset(("c", 0))}, 1
    for k in range(3, n):
        x, y = rng.choice(sorted(edges, key=lambda e: sorted(map(str, e))))
        edges -= {frozenset((x, y))}
        edges |= {frozenset((x, inner)), frozenset((inner, y)), frozenset((inner, chr(97 + k)))}
        inner += 1
    return edges


def side(edges: set, start, banned: frozenset) -> set:
    seen, left = {start}, [start]
    while left:
        x = left.pop()
        for e in edges:
            if x in e and e != banned:
                (y,) = e - {x}
                if y not in seen:
                    seen.add(y)
                    left.append(y)
    return seen


def key(edges: set) -> frozenset:
    return frozenset(frozenset(v for v in side(edges, x, e) if isinstance(v, str)) for e in edges for x in e)


def regrafts(edges: set, radius: int | None) -> set:
    out = set()
    for e in edges:
        for u, v in itertools.permutations(e):
            if isinstance(u, str):
                continue
            x, y = (next(iter(f - {u})) for f in edges if u in f and f != e)
            gone = side(edges, v, e)
            rest = {f for f in edges if u not in f and not f & gone} | {frozenset((x, y))}
            near, level = {x: 0, y: 0}, [x, y]
            while level:
                nxt = [(b, near[a] + 1) for a in level for f in rest if a in f for b in f - {a} if b not in near]
                near.update(nxt)
                level = [b for b, _ in nxt]
            for f in rest:
                a, b = f
                if radius is None or max(near[a], near[b]) <= radius:
                    whole = (rest - {f}) | {frozenset((a, u)), frozenset((b, u)), frozenset((u, v))} | {g for g in edges if g <= gone}
                    out.add(key(whole))
    return out - {key(edges)}


def text(edges: set, node, parent=None) -> str:
    kids = [next(iter(e - {node})) for e in edges if node in e and parent not in e]
    kids.sort(key=str)
    return node if not kids else "(" + ",".join(text(edges, k, node) for k in kids) + ")"


def read(steps) -> frozenset:
    stack, edges = [], set()
    for k, s in enumerate(steps):
        me = k if s.kids else s.name
        for _ in range(s.kids):
            edges.add(frozenset((stack.pop(), me)))
        stack.append(me)
    assert len(stack) == 1 and steps[-1].kids == 3 and all(s.kids in (0, 2) for s in steps[:-1])
    return key(edges)


@pytest.mark.parametrize("radius", [None, 1, 2])
def test_regrafts(spark, radius):
    rng = random.Random(4)
    drawn = {f"t{k}": grown(rng, n) for k, n in enumerate((3, 4, 5, 6, 7, 8))}
    rows = [(t, text(e, rng.choice(sorted(x for f in e for x in f if isinstance(x, int)))) + ";") for t, e in drawn.items()]
    trees = topology.programs(topology.parsed(spark.createDataFrame(rows, "tree string, newick string"), arity="unrooted"))
    got = {t: [] for t in drawn}
    for r in topology.spr_neighbours(trees, radius).collect():
        got[r.tree].append(read(r.steps))
    for k, (t, e) in enumerate(drawn.items()):
        n = k + 3
        assert len(set(got[t])) == len(got[t]) and set(got[t]) == regrafts(e, radius)
        assert radius is not None or len(got[t]) == 2 * (n - 3) * (2 * n - 7)


def test_a_radius_below_one_raises(spark):
    with pytest.raises(ValueError, match="radius"):
        topology.spr_neighbours(spark.range(1).select(F.col("id").alias("tree")), 0)
