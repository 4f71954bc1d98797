"""Trees as text, rows and programs against plain recursion: parsing, splits, neighbourhoods, scores, climbs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import topology


def drawn(rng: random.Random, names: list[str], most: int = 2, root: int = 2):
    """A random tree as (name, length, children)."""
    rng.shuffle(names)

    def grow(part: list[str], kids: int):
        if len(part) == 1:
            return (part[0], rng.choice([None, 0.5, 1.25, 3.0]), [])
        kids = min(kids, len(part))
        cuts = [0, *sorted(rng.sample(range(1, len(part)), kids - 1)), len(part)]
        return (rng.choice(["", "in", "a b"]), rng.choice([None, 2.0]), [grow(part[a:b], rng.randint(2, most)) for a, b in itertools.pairwise(cuts)])

    return grow(names, root)


def text(tree, comment="") -> str:
    name, length, kids = tree
    return ("(" + ",".join(text(k, comment) for k in kids) + ")" if kids else "") + name + comment + (f":{length}" if length is not None else "")


def leaves(tree) -> list[str]:
    return [tree[0]] if not tree[2] else [x for k in tree[2] for x in leaves(k)]


def sides(tree) -> set:
    whole, out = frozenset(leaves(tree)), set()

    def walk(t):
        own = frozenset(leaves(t))
        out.add(whole - own if min(whole) in own else own)
        for k in t[2]:
            walk(k)

    walk(tree)
    return out - {frozenset()}


def neighbours(tree) -> list:
    """All interchanges, by swapping subtrees in the nested form."""
    out = []

    def swap(t, a, b):
        return b if t is a else a if t is b else (t[0], t[1], [swap(k, a, b) for k in t[2]])

    def walk(u):
        for v in u[2]:
            if v[2]:
                sibling = next(k for k in u[2] if k is not v)
                out.extend(swap(tree, sibling, b) for b in v[2])
            walk(v)

    walk(tree)
    return out


def fitch(tree, rows: list[dict]) -> int:
    total = 0

    def walk(t, row):
        nonlocal total
        if not t[2]:
            return 7 if row[t[0]] is None else 1 << row[t[0]]
        got = None
        for m in (walk(k, row) for k in t[2]):
            if got is None:
                got = m
            elif got & m:
                got &= m
            else:
                got |= m
                total += row["weight"]
        return got

    for row in rows:
        walk(tree, row)
    return total


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(4)
    return [drawn(rng, [f"t{k}" for k in range(rng.randint(1, 12))], 4) for _ in range(40)]


def test_strings_come_back(spark, trees):
    rows = [(i, text(t) + ";") for i, t in enumerate(trees)] + [(100 + i, text(t, "[&x=(1,2);]") + ";") for i, t in enumerate(trees[:5])]
    strings = spark.createDataFrame(rows, "tree long, newick string")
    nodes = topology.parsed(strings)
    assert dict(topology.newick(topology.programs(nodes)).collect()) == dict(rows)
    assert topology.refused(strings).count() == 0
    held: dict = {}
    for r in nodes.collect():
        held.setdefault(r["tree"], {})[r["node"]] = r

    def flat(t):
        return [x for k in t[2] for x in flat(k)] + [t]

    for i, t in enumerate(trees):
        own, order = held[i], flat(t)
        at = {id(x): k for x, k in zip(order, sorted(own), strict=True)}
        for x in order:
            r = own[at[id(x)]]
            assert (r["name"], r["length"]) == (x[0], x[1])
            assert {own[at[id(k)]]["parent"] for k in x[2]} <= {at[id(x)]}
        assert [k for k, r in own.items() if r["parent"] is None] == [max(own)]


@pytest.mark.parametrize(
    ("bad", "place"),
    [("", 0), (None, 0), ("(a,b)", 5), ("(a,b", 4), ("(a,b;", 4), ("a,b;", 1), ("(a,b));", 5), ("(a,);", 3), ("(a,b)(c,d);", 5), ("x(a,b);", 0), ("(a,b:x);", 3), ("(a,b);c", 6), ("(a[x,b);", 2), ("(a:1:2,b);", 1), ("();", 1)],
)
def test_malformed_strings_are_refused_with_their_place(spark, bad, place):
    strings = spark.createDataFrame([(1, bad), (2, "(a,b);")], "tree long, newick string")
    got = topology.refused(strings).collect()
    assert [(r["tree"], r["place"]) for r in got] == [(1, place)]
    assert {r["tree"] for r in topology.parsed(strings).collect()} == {2}


def test_arity(spark):
    rows = [(1, "((a,b),(c,d));"), (2, "((a,b),c,d);"), (3, "((a,b,c),d,e);"), (4, "(a);"), (5, "a;"), (6, "((a,b),((c,d),e),f);")]
    strings = spark.createDataFrame(rows, "tree long, newick string")
    assert {r["tree"] for r in topology.parsed(strings, arity="binary").collect()} == {1, 5}
    assert {r["tree"] for r in topology.parsed(strings, arity="unrooted").collect()} == {2, 5, 6}
    assert topology.parsed(spark.createDataFrame([], "tree long, newick string")).count() == 0


def test_splits_are_those_of_the_leaf_sets(spark, trees):
    strings = spark.createDataFrame([(i, text(t) + ";") for i, t in enumerate(trees)], "tree long, newick string")
    got: dict = {}
    for r in topology.splits(topology.programs(topology.parsed(strings))).collect():
        got.setdefault(r["tree"], []).append((r["h0"], r["h1"], r["n"]))
    seen: dict = {}
    for i, t in enumerate(trees):
        want = sides(t)
        assert sorted(n for *_, n in got.get(i, [])) == sorted(map(len, want))
        for h in got.get(i, []):
            seen.setdefault(h[:2], set()).add(i)
    # the same split has the same hash in all trees
    common: dict = {}
    for i, t in enumerate(trees):
        for s in sides(t):
            common.setdefault(s, set()).add(i)
    assert sorted(map(sorted, seen.values())) == sorted(map(sorted, common.values()))


def unrooted(rng, n):
    return drawn(rng, [f"t{k:02d}" for k in range(n)], 2, 3)


def test_neighbours_are_all_interchanges(spark):
    rng = random.Random(8)
    some = [unrooted(rng, n) for n in (3, 4, 5, 7, 10)]
    strings = spark.createDataFrame([(i, text(t) + ";") for i, t in enumerate(some)], "tree long, newick string")
    near = topology.nni_neighbours(topology.programs(topology.parsed(strings, arity="unrooted")))
    made: dict = {}
    for r in topology.newick(near.withColumn("tree", F.struct("tree", "branch", "swap"))).collect():
        made.setdefault(r["tree"]["tree"], []).append(r["newick"])
    again = spark.createDataFrame([(f"{i}-{k}", s) for i, all_ in made.items() for k, s in enumerate(all_)], "tree string, newick string")
    assert topology.refused(again, arity="unrooted").count() == 0

    def parse(s):  # plain recursion on the strings
        def at(i):
            kids = []
            if s[i] == "(":
                while s[i] in "(,":
                    k, i = at(i + 1)
                    kids.append(k)
                i += 1
            j = i
            while s[j] not in "(),;":
                j += 1
            return (s[i:j].split(":")[0], None, kids), j

        return at(0)[0]

    for i, t in enumerate(some):
        n = len(leaves(t))
        assert len(made.get(i, [])) == 2 * max(n - 3, 0)
        assert {frozenset(sides(parse(s))) for s in made.get(i, [])} == {frozenset(sides(x)) for x in neighbours(t)}


def patterns(rng, n: int, count: int) -> list[dict]:
    return [{f"t{k:02d}": rng.choice([0, 1, 2, rng.randint(0, 2), None]) for k in range(n)} | {"weight": rng.randint(1, 5)} for _ in range(count)]


def test_scores_and_climbs_equal_plain_ones(spark):
    rng = random.Random(5)
    n = 7
    rows = patterns(rng, n, 60)
    taxa = [f"t{k:02d}" for k in range(n)]
    table = spark.createDataFrame([tuple(r[x] for x in [*taxa, "weight"]) for r in rows], ", ".join(f"{x} long" for x in [*taxa, "weight"]))
    columns = topology.columns_of(table, taxa, block=16)
    some = [unrooted(rng, n) for _ in range(5)]
    strings = spark.createDataFrame([(i, text(t) + ";") for i, t in enumerate(some)] + [(9, "(a,b,t00);")], "tree long, newick string")
    programs = topology.programs(topology.parsed(strings, arity="unrooted"))
    assert dict(topology.fitch_scores(programs, columns).collect()) == {i: fitch(t, rows) for i, t in enumerate(some)}

    def climb(t, rounds):
        score, seen = fitch(t, rows), {frozenset(sides(t))}
        for _ in range(rounds):
            near = [x for x in neighbours(t) if frozenset(sides(x)) not in seen]
            seen |= {frozenset(sides(x)) for x in near}
            if not near or min(fitch(x, rows) for x in near) >= score:
                return score, True
            t = min(near, key=lambda x: fitch(x, rows))
            score = fitch(t, rows)
        return score, False

    one = {r["tree"]: r["score"] for r in topology.climbed(programs, columns, 1).collect()}
    assert one == {i: climb(t, 1)[0] for i, t in enumerate(some)}
    far = {r["tree"]: (r["score"], r["settled"], r["steps"]) for r in topology.climbed(programs, columns, 12).collect()}
    least = min(fitch(t, rows) for t in some)
    for i, t in enumerate(some):
        assert far[i][1] and far[i][0] <= climb(t, 1)[0] <= fitch(t, rows)
    assert min(x[0] for x in far.values()) <= least


def test_a_state_that_no_mask_holds_raises(spark):
    table = spark.createDataFrame([(63, 1, 2)], "a long, b long, weight long")
    with pytest.raises(Exception, match="state of a"):
        topology.columns_of(table, ["a", "b"]).collect()
