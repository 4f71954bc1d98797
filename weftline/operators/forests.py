"""Spanning forests, log partitions of forests by contraction, and bounds on those of any Potts graph.

Graphs are ``edges`` (i, j, w) and ``field`` (site, h): h lists the log weight of each of the q labels, and an edge adds w
where its ends have one label. Sites without edges are components of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import bond_components
from weftline.sources.shared import laid

NEVER = float("-inf")


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x worked out once."""
    return F.transform(F.array(x), use)[0]


def _log_sum(xs: Column) -> Column:
    """The log of the sum of exp over an array, -inf where all its entries are."""
    sums = lambda x, top: top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return _bound(xs, lambda x: _bound(F.array_max(x), lambda top: F.when(top == NEVER, top).otherwise(sums(x, top))))


def _labels(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _turned(pair: Column, q: int) -> Column:
    return F.transform(_labels(q * q), lambda p: F.get(pair, (p % q) * q + F.floor(p / q).cast("int")))


def _both(rows: DataFrame, q: int) -> DataFrame:
    return rows.select("tree", "a", "b", "pair").union(rows.select("tree", F.col("b").alias("a"), F.col("a").alias("b"), _turned(F.col("pair"), q)))


def potts_pair(w: Column, q: int) -> Column:
    """The log weights of an edge for each pair of labels, row by row."""
    return F.array(*(w if s == t else F.lit(0.0) for s in range(q) for t in range(q)))


def forest_log_partition(nodes: DataFrame, edges: DataFrame, q: int) -> DataFrame:
    """tree, component, sites, log_z: the log partition of each component of each forest, named by its least site.

    ``nodes`` are (tree, site, field), ``edges`` (tree, i, j, pair) with q * q log weights. Nodes with one or two edges are
    summed out, those of least hash among such neighbours at once: one with one edge gives its neighbour a message, one with
    two becomes an edge between its neighbours. A constant share of the nodes goes in each round, whatever the shape, so that
    a path of n nodes takes log n rounds as a star does. All forests go side by side. A loop raises.
    """
    nodes = laid(nodes.select("tree", "site", F.col("site").alias("least"), F.lit(1).cast("long").alias("sites"), "field"))
    arcs = laid(_both(edges.select("tree", F.col("i").alias("a"), F.col("j").alias("b"), "pair"), q))
    turn = 0
    while not arcs.isEmpty():
        rank = lambda x, turn=turn: F.struct(F.xxhash64(F.lit(turn), "tree", x).alias("r"), F.col(x).alias("s"))
        degree = arcs.groupBy("tree", F.col("a").alias("b")).agg(F.count("*").alias("n"))
        seen = arcs.select("tree", "a", "b").join(degree, ["tree", "b"]).groupBy("tree", "a").agg(F.count("*").alias("n"), F.min(F.when(F.col("n") <= 2, rank("b"))).alias("rival"))
        gone = laid(seen.where((F.col("n") <= 2) & (F.col("rival").isNull() | (rank("a") < F.col("rival")))).select("tree", "a"))
        if gone.isEmpty():
            raise ValueError("the edges have a loop")
        # one or two edges each
        leaving = arcs.join(gone, ["tree", "a"]).groupBy("tree", "a").agg(F.array_sort(F.collect_list(F.struct("b", "pair"))).alias("to"))
        leaving = leaving.join(nodes.withColumnRenamed("site", "a"), ["tree", "a"])
        leaving = laid(leaving.withColumn("two", F.when(F.size("to") < 2, False).when(F.col("to")[0]["b"] == F.col("to")[1]["b"], F.raise_error(F.lit("the edges have a loop")).cast("boolean")).otherwise(True)))
        first, second = F.expr("to[0].pair"), F.expr("to[1].pair")
        message = F.transform(_labels(q), lambda t: _log_sum(F.transform(_labels(q), lambda r: F.get("field", r) + F.get(first, r * q + t))))
        given = leaving.select("tree", F.expr("to[0].b").alias("site"), "least", "sites", F.when(F.col("two"), F.array(*[F.lit(0.0)] * q)).otherwise(message).alias("m"))
        sums = given.groupBy("tree", "site").agg(F.min("least").alias("l"), F.sum("sites").alias("n"), F.array(*(F.sum(F.get("m", F.lit(t))) for t in range(q))).alias("m"))
        stay = nodes.join(gone.withColumnRenamed("a", "site"), ["tree", "site"], "left_anti").join(sums, ["tree", "site"], "left")
        added = F.when(F.col("m").isNull(), F.col("field")).otherwise(F.zip_with("field", "m", lambda x, y: x + y))
        nodes = laid(stay.select("tree", "site", F.least("least", "l").alias("least"), (F.col("sites") + F.coalesce("n", F.lit(0))).alias("sites"), added.alias("field")))
        through = F.transform(_labels(q * q), lambda p: _log_sum(F.transform(_labels(q), lambda r: F.get(first, r * q + F.floor(p / q).cast("int")) + F.get("field", r) + F.get(second, r * q + p % q))))
        new = leaving.where("two").select("tree", F.expr("to[0].b").alias("a"), F.expr("to[1].b").alias("b"), through.alias("pair"))
        rest = arcs.join(gone, ["tree", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["tree", "b"], "left_anti")
        arcs = laid(rest.select("tree", "a", "b", "pair").union(_both(new, q)))
        turn += 1
    return nodes.select("tree", F.col("least").alias("component"), "sites", _log_sum(F.col("field")).alias("log_z"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """i, j: the edges of the spanning forest of least ``order`` (ties by i and j). ``edges`` are (i, j, order), each pair once.

    Each round every component takes its least edge out; the trees of these choices become one component by pointer jumping,
    and of the edges between two components the least stays. Components at least halve, so that rounds are few.
    """
    left = laid(edges.where("i <> j").select("i", "j", F.col("i").alias("a"), F.col("j").alias("b"), F.struct("order", "i", "j").alias("o")))
    done: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("c"), F.col("b").alias("to"), "o").union(left.select("b", "a", "o"))
        pick = laid(ends.groupBy("c").agg(F.min(F.struct("o", "to")).alias("m")).select("c", "m.to", F.col("m.o.i").alias("i"), F.col("m.o.j").alias("j")))
        chosen = pick.select("i", "j").distinct()
        done = chosen if done is None else done.union(chosen)
        # two components that chose one edge point at each other: the smaller becomes the root
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("again"))
        hooks = laid(pick.join(back, "to").select("c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"), F.lit(True).alias("moved")))
        while not hooks.where("moved").isEmpty():
            jump = hooks.select(F.col("c").alias("to"), F.col("to").alias("next"))
            hooks = laid(hooks.join(jump, "to").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        root = lambda x: hooks.select(F.col("c").alias(x), F.col("to").alias(f"{x}2"))  # noqa: E731, B023
        met = left.join(root("a"), "a").join(root("b"), "b").where("a2 <> b2")
        left = met.groupBy(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min("o").alias("o"))
        left = laid(left.select(F.col("o.i").alias("i"), F.col("o.j").alias("j"), "a", "b", "o"))
    return done if done is not None else edges.select("i", "j").limit(0)


def covering_forests(edges: DataFrame, least: int = 1, priority: Callable[[int], Column] | None = None) -> tuple[DataFrame, int]:
    """(tree, i, j, times) and the number of forests: spanning forests that together hold every edge, ``least`` or more.

    ``edges`` are (i, j), each pair once. A forest prefers the edges that were in the fewest forests before (``times`` at the
    end), so that every forest takes as many new ones as can be without a loop; ``priority(k)`` orders equals in forest k.
    Their number grows with the density of the densest part, not with the number of edges.
    """
    order = priority or (lambda k: F.xxhash64(F.lit(k), "i", "j"))
    times, forests, k = laid(edges.where("i <> j").select("i", "j", F.lit(0).alias("times"))), None, 0
    while k < least or not times.where("times = 0").isEmpty():
        chosen = laid(spanning_forest(times.select("i", "j", F.struct("times", order(k).alias("p")).alias("order"))))
        own = chosen.select(F.lit(k).alias("tree"), "i", "j")
        forests = own if forests is None else forests.union(own)
        times = laid(times.join(chosen.withColumn("one", F.lit(1)), ["i", "j"], "left").select("i", "j", (F.col("times") + F.coalesce("one", F.lit(0))).alias("times")))
        k += 1
    if forests is None:
        return times.select(F.lit(0).alias("tree"), "i", "j", "times"), k
    return forests.join(times, ["i", "j"]).select("tree", "i", "j", "times"), k


def simple(edges: DataFrame, field: DataFrame, q: int) -> tuple[DataFrame, DataFrame]:
    """Edges and fields of the same model with each pair of sites once, i < j: the weights of parallel edges are added up, and
    an edge of a site with itself goes into the field."""
    pairs = edges.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    own = pairs.where("i = j").select(F.col("i").alias("site"), F.col("w").alias("own"))
    h = F.transform("h", lambda x: x + F.coalesce("own", F.lit(0.0)))
    checked = F.when(F.size("h") == q, h).otherwise(F.raise_error(F.lit(f"a field does not list {q} labels")).cast("array<double>"))
    return laid(pairs.where("i < j")), laid(field.join(own, "site", "left").select("site", checked.alias("h")))


def spanning_tree_bound(edges: DataFrame, field: DataFrame, q: int, least: int = 2, priority: Callable[[int], Column] | None = None) -> DataFrame:
    """component, sites, bound: an upper bound on the log partition of each component, exact where it is a tree.

    The log partition is convex in the weights, so that the mean over forests that cover all edges is above it, if an edge
    that is in a share r of them weighs w / r there. Forests are those of ``covering_forests``.
    """
    edges, field = simple(edges, field, q)
    forests, k = covering_forests(edges.select("i", "j"), least, priority)
    weighed = forests.join(edges, ["i", "j"]).select("tree", "i", "j", potts_pair(F.col("w") * k / F.col("times"), q).alias("pair"))
    nodes = field.select(F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1))).alias("tree"), "site", F.col("h").alias("field"))
    found = forest_log_partition(nodes, weighed, q)
    return found.groupBy("component").agg(F.first("sites").alias("sites"), F.avg("log_z").alias("bound"))


def mean_field(edges: DataFrame, field: DataFrame, q: int, sweeps: int, damping: float = 0.5) -> DataFrame:
    """site, p: the label shares of each site after ``sweeps`` damped sweeps over all sites at once, from its field alone."""
    names = range(q)
    near = laid(edges.select(F.col("i").alias("site"), F.col("j").alias("other"), "w").union(edges.select("j", "i", "w")))

    def shares(x: Column) -> Column:
        return _bound(x, lambda a: _bound(_log_sum(a), lambda z: F.transform(a, lambda v: F.exp(v - z))))

    now = laid(field.select("site", "h", shares(F.col("h")).alias("p")))
    for _ in range(sweeps):
        pull = near.join(now.select(F.col("site").alias("other"), "p"), "other").groupBy("site").agg(F.array(*(F.sum(F.col("w") * F.get("p", F.lit(s))) for s in names)).alias("m"))
        met = now.join(pull, "site", "left")
        new = shares(F.when(F.col("m").isNull(), F.col("h")).otherwise(F.zip_with("h", "m", lambda x, y: x + y)))
        now = laid(met.select("site", "h", F.zip_with("p", new, lambda x, y: damping * x + (1 - damping) * y).alias("p")))
    return now.select("site", "p")


def log_partition_bounds(edges: DataFrame, field: DataFrame, q: int, sweeps: int = 10) -> DataFrame:
    """component, sites, decoupled, mean_field, saturated: bounds on each component's log partition, from below by the first
    two, from above by the last; ``spanning_tree_bound`` is tighter and takes more rounds.

    ``decoupled`` drops all edges and is null where a component has a negative weight, under which it is no bound;
    ``mean_field`` is the value of the product of ``mean_field``'s shares, a bound after any number of sweeps; ``saturated``
    gives every labelling the weight that no labelling exceeds.
    """
    edges, field = simple(edges, field, q)
    met = field.join(mean_field(edges, field, q, sweeps), "site").join(bond_components(edges), "site", "left")
    site = laid(met.select("site", F.coalesce("root", "site").alias("component"), "h", "p"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    own = add(F.zip_with("p", "h", lambda p, h: F.when(p > 0, p * (h - F.log(p))).otherwise(0.0)))
    by_site = site.groupBy("component").agg(F.count("*").alias("sites"), F.sum(_log_sum(F.col("h"))).alias("free"), F.sum(own).alias("own"), F.sum(F.array_max("h")).alias("top"))
    a = site.select(F.col("site").alias("i"), "component", F.col("p").alias("pi"))
    b = site.select(F.col("site").alias("j"), F.col("p").alias("pj"))
    by_edge = edges.join(a, "i").join(b, "j").groupBy("component").agg(F.sum(F.col("w") * add(F.zip_with("pi", "pj", lambda x, y: x * y))).alias("met"), F.sum(F.greatest("w", F.lit(0.0))).alias("most"), F.min("w").alias("low"))
    both = by_site.join(by_edge, "component", "left").fillna(0.0, ["met", "most", "low"])
    saturated = F.col("sites") * math.log(q) + F.col("top") + F.col("most")
    return both.select("component", "sites", F.when(F.col("low") >= 0, F.col("free")).alias("decoupled"), (F.col("own") + F.col("met")).alias("mean_field"), saturated.alias("saturated"))
