"""Operators on trees and alignments: pattern compression, pruning, parsimony, distances, splits, spectra.

A tree is a model parameter: a list of (node, parent, length), the root's parent being None. Its leaves are columns of the
sites, which hold states from 0 to k - 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.columns import jc_distance
from weftline.sources.shared import cut

Tree = list[tuple[str, str | None, float]]
Matrix = list[list[float]]


def children_of(tree: Tree) -> dict[str, list[str]]:
    """The children of each inner node, nodes in postorder."""
    below: dict[str | None, list[str]] = {}
    for node, parent, _ in tree:
        below.setdefault(parent, []).append(node)
    if len(below.get(None, [])) != 1:
        raise ValueError("a tree has one root")
    order, stack = [], list(below[None])
    while stack:
        order.append(node := stack.pop())
        stack += below.get(node, [])
    if len(order) != len(tree):
        raise ValueError("every node hangs from the root")
    return {node: below[node] for node in reversed(order) if node in below}


def jc_matrix(t: float, k: int = 4) -> Matrix:
    """Jukes-Cantor transition probabilities after branch length ``t``."""
    e = math.exp(-t * k / (k - 1))
    return [[1 / k + (k - 1) / k * e if i == j else (1 - e) / k for j in range(k)] for i in range(k)]


def gtr_matrix(exchange: list[float], pi: list[float]) -> Callable[[float], Matrix]:
    """Transition probabilities of the reversible model with one change per unit of length on average.

    ``exchange`` holds the upper triangle by rows. The rates are symmetric in the square roots of ``pi``, so that one
    decomposition serves all lengths.
    """
    import numpy as np

    root = np.sqrt(np.array(pi))
    rates = np.zeros((len(pi), len(pi)))
    rates[np.triu_indices(len(pi), 1)] = exchange
    rates = (rates + rates.T) * np.array(pi)[None, :]
    np.fill_diagonal(rates, -rates.sum(axis=1))
    rates /= -(np.array(pi) * np.diag(rates)).sum()
    values, vectors = np.linalg.eigh(root[:, None] * rates / root[None, :])
    return lambda t: np.clip(vectors / root[:, None] @ np.diag(np.exp(values * t)) @ (vectors.T * root[None, :]), 0, None).tolist()


def site_patterns(rows: DataFrame, columns: list[str], first: Column) -> DataFrame:
    """The distinct patterns of ``columns`` with their weight and the least ``first`` that shows them."""
    return rows.groupBy(*columns).agg(F.count("*").alias("weight"), F.min(first).alias("first"))


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: how often two columns hold each pair of states."""
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


#: So many taxa have a column for each pair; more are paired by rows.
PAIRED = 32


def distance_matrix(rows: DataFrame, taxa: list[str], k: int = 4) -> DataFrame:
    """a < b, p, distance: the Jukes-Cantor distance of each pair of taxa (in the order of ``taxa``) from one scan.

    p is the share of sites that differ, out of all; a null state differs from nothing. Up to PAIRED taxa, each pair is one
    sum of a single aggregate; with more, the distinct patterns of sites are paired as rows and counted by pair. Fewer than
    two taxa have no pairs, and without sites p is null.
    """
    pairs = [(i, j) for i in range(len(taxa)) for j in range(i + 1, len(taxa))]
    slim = rows.select(*(F.col(f"`{x}`").alias(f"x{i}") for i, x in enumerate(taxa)))
    names = F.array(*(F.lit(x) for x in taxa))
    if len(taxa) <= PAIRED:
        apart = [F.avg(F.when(F.col(f"x{i}") != F.col(f"x{j}"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("p") for i, j in pairs]
        told = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x) for (i, j), x in zip(pairs, apart, strict=True))) if pairs else F.array().cast("array<struct<i:int,j:int,p:double>>")
        shares = (slim.agg(told.alias("e")) if pairs else slim.limit(0).select(told.alias("e"))).select(F.explode("e").alias("e")).select("e.*")
    else:
        counts = slim.groupBy(*slim.columns).agg(F.count("*").alias("n"))
        seen = F.array(*(F.col(f"x{i}") for i in range(len(taxa))))
        places = F.sequence(F.lit(0), F.lit(len(taxa) - 1))
        # one row a pattern and taxon, with the later taxa that differ
        each = counts.select("n", seen.alias("s"), F.explode(places).alias("i"))
        later = F.filter(places, lambda j: (j > F.col("i")) & (F.get("s", j) != F.get("s", F.col("i"))))
        apart = each.select("n", "i", F.explode(later).alias("j")).groupBy("i", "j").agg(F.sum("n").alias("d"))
        total = rows.count()
        every = rows.sparkSession.range(len(taxa)).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.filter(places, lambda j: j > F.col("i"))).alias("j"))
        shares = every.join(apart, ["i", "j"], "left").select("i", "j", (F.coalesce("d", F.lit(0)) / F.lit(total or None)).alias("p"))
    return shares.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "p", jc_distance(F.col("p"), k).alias("distance"))


def _state(x: str, k: int) -> Column:
    """A leaf's state as a place among ``k``; null stays null, another value raises."""
    return F.when(F.col(f"`{x}`").isNull(), F.lit(None).cast("int")).when(F.col(f"`{x}`").between(0, k - 1), F.col(f"`{x}`").cast("int")).otherwise(F.raise_error(F.lit(f"a state of {x} is not between 0 and {k - 1}")).cast("int"))


def pruning_log_likelihood(sites: DataFrame, tree: Tree, k: int = 4, matrix: Callable[[float], Matrix] | None = None, pi: list[float] | None = None, weight: str | None = "weight") -> DataFrame:
    """One row: n_patterns, n_sites and the log likelihood of any tree by pruning; ``matrix`` is Jukes-Cantor by default.

    A projection for each inner node holds its k partial likelihoods, the largest scaled to 1: one pass over the patterns,
    no join, one aggregate. A null state says nothing: any state may stand there; one that is not from 0 to k - 1 raises. Sites that are not compressed have no
    ``weight``. Without sites the sums are null.
    """
    matrix = matrix or (lambda t: jc_matrix(t, k))
    step, below = {node: matrix(t) for node, _, t in tree}, children_of(tree)
    rows = sites.select("*", F.lit(0.0).alias("_scale"))

    def from_child(child: str, s: int) -> Column:
        if child in below:
            return reduce(lambda a, b: a + b, (F.lit(step[child][s][r]) * F.col(f"_{child}_{r}") for r in range(k)))
        return F.coalesce(F.get(F.array(*map(F.lit, step[child][s])), _state(child, k)), F.lit(1.0))

    for node, kids in below.items():
        raw = [reduce(lambda a, b: a * b, (from_child(c, s) for c in kids)).alias(f"_{node}_{s}") for s in range(k)]
        rows = rows.select("*", *raw).withColumn("_top", F.greatest(*(f"_{node}_{s}" for s in range(k))))
        rows = rows.withColumns({f"_{node}_{s}": F.when(F.col("_top") > 0, F.col(f"_{node}_{s}") / F.col("_top")).otherwise(0.0) for s in range(k)} | {"_scale": F.when(F.col("_top") > 0, F.col("_scale") + F.log("_top")).otherwise(float("-inf"))})
    root = list(below)[-1]
    total = reduce(lambda a, b: a + b, (F.lit((pi or [1 / k] * k)[s]) * F.col(f"_{root}_{s}") for s in range(k)))
    n = F.col(weight) if weight else F.lit(1)
    rows = rows.select(n.alias("n"), F.when(total > 0, F.col("_scale") + F.log(total)).otherwise(float("-inf")).alias("ll"))
    return rows.agg(F.count("*").alias("n_patterns"), F.sum("n").cast("long").alias("n_sites"), F.sum(F.col("n") * F.col("ll")).alias("log_likelihood"))


def fitch_score(patterns: DataFrame, tree: Tree, weight: str = "weight") -> DataFrame:
    """One row: the parsimony score of a binary tree, by the intersections and unions of state sets as bit masks.

    A null state is any state; one that is not from 0 to 62 raises.
    """
    below = children_of(tree)
    leaf = lambda c: F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), _state(c, 63)), F.lit(-1).cast("long"))
    rows = patterns.select("*", F.lit(0).cast("long").alias("_cost"))
    for node, kids in below.items():
        if len(kids) != 2:
            raise ValueError(f"{node} does not have two children")
        x, y = (F.col(f"_{c}") if c in below else leaf(c) for c in kids)
        both = x.bitwiseAND(y)
        rows = rows.withColumns({f"_{node}": F.when(both != 0, both).otherwise(x.bitwiseOR(y)), "_cost": F.col("_cost") + F.when(both == 0, 1).otherwise(0)})
    return rows.agg(F.sum(F.col(weight) * F.col("_cost")).alias("score"))


def sankoff_score(patterns: DataFrame, tree: Tree, cost: Matrix, weight: str = "weight") -> DataFrame:
    """One row: the least total cost of changes on any tree, where a change from i to j costs ``cost[i][j]``.

    The min-plus form of pruning: a projection for each inner node holds the least cost below it for each of its states.
    A null state is any state; one that ``cost`` does not have raises.
    """
    k, below = len(cost), children_of(tree)
    rows = patterns

    def least(child: str, s: int) -> Column:
        if child in below:
            return F.least(*(F.lit(float(cost[s][r])) + F.col(f"_{child}_{r}") for r in range(k)))
        return F.coalesce(F.get(F.array(*(F.lit(float(x)) for x in cost[s])), _state(child, k)), F.lit(float(min(cost[s]))))

    for node, kids in below.items():
        rows = rows.select("*", *(reduce(lambda a, b: a + b, (least(c, s) for c in kids)).alias(f"_{node}_{s}") for s in range(k)))
    root = list(below)[-1]
    return rows.agg(F.sum(F.col(weight) * F.least(*(f"_{root}_{s}" for s in range(k)))).alias("score"))


def split_support(patterns: DataFrame, taxa: list[str], weight: str = "weight") -> DataFrame:
    """split, n: the sites that part the taxa in two sides of two or more, each of one state; any number of taxa.

    A split is spelled as the side of the first taxon, a bar and the other side, names one after the other, with commas
    between longer ones. Sites with nulls, or with more than two states, support none.
    """
    every = F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"`{x}`").alias("s")) for x in taxa))
    glue = "" if all(len(x) == 1 for x in taxa) else ","

    def told(seen: Column) -> Column:
        own = F.filter(seen, lambda e: e["s"] == seen[0]["s"])
        other = F.filter(seen, lambda e: e["s"] != seen[0]["s"])
        two = F.forall(seen, lambda e: e["s"].isNotNull()) & (F.size(F.array_distinct(F.transform(seen, lambda e: e["s"]))) == 2)
        names = lambda side: F.array_join(F.transform(side, lambda e: e["x"]), glue)
        return F.when(two & (F.size(own) > 1) & (F.size(other) > 1), F.concat(names(own), F.lit("|"), names(other)))

    rows = patterns.select(F.transform(F.array(every), told)[0].alias("split"), F.col(weight).alias("_n")).where("split is not null")
    return rows.groupBy("split").agg(F.sum("_n").alias("n"))


def pattern_ratio(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_patterns, n_sites and ratio, the sites that one pattern stands for on average."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sites"), F.avg("n").alias("ratio"))


def robinson_foulds(splits: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance, normalised: the splits that one tree of a pair has and the other lacks, and their share.

    ``splits`` are (tree, mask) and ``pairs`` (a, b). Only shared splits are joined: |A - B| + |B - A| = |A| + |B| - 2 |A and B|.
    Trees without splits have none; the share is null where neither has one.
    """
    splits = splits.select("tree", "mask").distinct()
    size = splits.groupBy("tree").agg(F.count("*").alias("n"))
    mine = pairs.select("a", "b").distinct().join(splits.select(F.col("tree").alias("a"), "mask"), "a")
    both = mine.join(splits.select(F.col("tree").alias("b"), "mask"), ["b", "mask"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("both"))
    met = pairs.join(both, ["a", "b"], "left").join(size.select(F.col("tree").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("tree").alias("b"), F.col("n").alias("nb")), "b", "left")
    n = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))
    distance = n - 2 * F.coalesce("both", F.lit(0))
    return met.select("a", "b", distance.alias("distance"), F.when(n > 0, distance / n).alias("normalised"))


def path_distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance: the length of the path between the nodes of each pair, null if they are in different trees.

    ``nodes`` are (node, parent, length). Steps are doubled: one table for each power of two, with a node's ancestor that
    far up and the way there. The deeper end of a pair is lifted to the other's depth, then both ends as long as they stay
    apart. Rows are as many as nodes, for each power, and pairs: no node meets all its ancestors, so that deep trees cost
    what flat ones do, a few rounds more. Nodes that name each other as parents raise.
    """
    hop = cut(nodes.where("parent is not null").select(F.col("node").alias("at"), F.col("parent").alias("to"), F.col("length").cast("double").alias("d")))
    steps, left = [], hop.count()
    while left:
        steps.append(hop)
        hop = cut(hop.alias("x").join(hop.alias("y"), F.col("x.to") == F.col("y.at")).select("x.at", "y.to", (F.col("x.d") + F.col("y.d")).alias("d")))
        # in a tree, some node is just so deep that it drops out
        before, left = left, hop.count()
        if left == before:
            raise ValueError("the nodes have a cycle")
    known = nodes.select("node").distinct()
    end = lambda x: pairs.select(x).distinct().join(known, F.col(x) == F.col("node"), "left_semi").select(F.col(x).alias("own"), F.col(x).alias("at"), F.lit(0).cast("long").alias("depth"))
    depths = end("a").union(end("b")).distinct()
    for k in reversed(range(len(steps))):
        up = steps[k].select("at", "to")
        depths = cut(depths.join(up, "at", "left").select("own", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.when(F.col("to").isNotNull(), 1 << k).otherwise(0)).alias("depth")))
    # what stands at the root tells trees apart
    of = lambda x: depths.select(F.col("own").alias(x), F.col("at").alias(f"root_{x}"), F.col("depth").alias(f"deep_{x}"))
    met = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").where("root_a = root_b")
    met = met.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), (F.col("deep_a") - F.col("deep_b")).alias("gap"), F.lit(0.0).alias("d"))

    def lifted(rows: DataFrame, k: int, which: str) -> DataFrame:
        return rows.join(steps[k].select(F.col("at").alias(which), F.col("to").alias(f"to_{which}"), F.col("d").alias(f"d_{which}")), which, "left")

    for k in reversed(range(len(steps))):
        far = F.abs("gap") >= 1 << k
        rows = lifted(lifted(met, k, "x"), k, "y")
        up_x, up_y = far & (F.col("gap") > 0), far & (F.col("gap") < 0)
        met = cut(rows.select("a", "b", F.when(up_x, F.col("to_x")).otherwise(F.col("x")).alias("x"), F.when(up_y, F.col("to_y")).otherwise(F.col("y")).alias("y"), F.when(far, F.col("gap") - F.signum("gap").cast("long") * (1 << k)).otherwise(F.col("gap")).alias("gap"), (F.col("d") + F.when(up_x, F.col("d_x")).when(up_y, F.col("d_y")).otherwise(0.0)).alias("d")))
    for k in reversed(range(len(steps))):
        rows = lifted(lifted(met, k, "x"), k, "y")
        apart = F.coalesce(F.col("to_x") != F.col("to_y"), F.lit(False))
        met = cut(rows.select("a", "b", F.when(apart, F.col("to_x")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("to_y")).otherwise(F.col("y")).alias("y"), "gap", (F.col("d") + F.when(apart, F.col("d_x") + F.col("d_y")).otherwise(0.0)).alias("d")))
    if steps:  # the ends are the same or children of the node where the path turns
        rows = lifted(lifted(met, 0, "x"), 0, "y")
        met = rows.select("a", "b", F.when(F.col("x") == F.col("y"), F.col("d")).otherwise(F.col("d") + F.col("d_x") + F.col("d_y")).alias("d"))
    return pairs.select("a", "b").join(met.select("a", "b", F.col("d").alias("distance")), ["a", "b"], "left")


def hadamard(spectrum: DataFrame, bits: int) -> DataFrame:
    """i, x: the Walsh-Hadamard transform of (i, x) over 2 ** bits places; absent places are 0.

    The butterfly of each bit sends every value to two places, so that rows stay linear in the spectrum.
    """
    rows = spectrum.select(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    for b in range(bits):
        bit = 1 << b
        high = F.col("i").bitwiseAND(F.lit(bit)) != 0
        low = F.when(high, F.col("i") - bit).otherwise(F.col("i"))
        both = F.array(F.struct(low.alias("i"), F.col("x").alias("x")), F.struct((low + bit).alias("i"), F.when(high, -F.col("x")).otherwise(F.col("x")).alias("x")))
        rows = rows.select(F.explode(both).alias("e")).groupBy("e.i").agg(F.sum("e.x").alias("x"))
    return rows
