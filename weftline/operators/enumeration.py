"""Small models by enumeration, chains by repeated squaring, lattices by belief propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import cut

#: More configurations are refused.
MOST = 1 << 24


def configurations(graphs: DataFrame, sites: int, q: int, edges: list[tuple[int, int, float]]) -> DataFrame:
    """graph, id, log_weight of every labelling of every graph: its equal edges' weights and the field of its labels.

    ``graphs`` are (graph, scale, field): a factor on the edges' weights and the weight of each of the q labels. Site s of
    labelling ``id`` has label (id div q ** s) mod q. Labellings are made from their upper and lower halves, so that no row
    holds them all.
    """
    if q**sites > MOST:
        raise ValueError(f"{q} ** {sites} labellings are too many to enumerate")
    low = q ** (sites // 2)
    rows = graphs.select("graph", "scale", "field", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q**sites // low - 1).cast("long"))).alias("high"))
    rows = rows.select("graph", "scale", "field", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(low - 1).cast("long"))).alias("low")).select("graph", "scale", "field", (F.col("high") * low + F.col("low")).alias("id"))
    label = [label_of(s, q) for s in range(sites)]
    equal, own = F.lit(0.0), F.lit(0.0)
    for i, j, w in edges:
        equal = equal + F.when(label[i] == label[j], F.lit(float(w))).otherwise(0.0)
    for s in range(sites):
        own = own + F.get("field", label[s].cast("int"))
    return rows.select("graph", "id", (F.col("scale") * equal + own).alias("log_weight"))


def label_of(site: int | Column, q: int) -> Column:
    """The label of a site in column ``id``."""
    power = F.lit(q**site) if isinstance(site, int) else F.pow(F.lit(q), site)
    return F.pmod(F.floor(F.col("id") / power), F.lit(q)).cast("long")


def log_partition(weights: DataFrame) -> DataFrame:
    """graph, states, log_z: the log of the summed weights of each graph, scaled by its largest so that none overflows."""
    top = weights.groupBy("graph").agg(F.max("log_weight").alias("top"))
    sums = weights.join(top, "graph").groupBy("graph", "top").agg(F.count("*").alias("states"), F.sum(F.exp(F.col("log_weight") - F.col("top"))).alias("z"))
    return sums.select("graph", "states", F.when(F.col("top") == float("-inf"), F.col("top")).otherwise(F.col("top") + F.log("z")).alias("log_z"))


def site_marginals(weights: DataFrame, sites: int, q: int) -> DataFrame:
    """graph, site, label, p: the share of a graph's weight in which a site has a label. Labels that none has are left out."""
    top = weights.groupBy("graph").agg(F.max("log_weight").alias("top"))
    each = F.array(*(F.struct(F.lit(s).cast("long").alias("site"), label_of(s, q).alias("label")) for s in range(sites)))
    sums = weights.join(top, "graph").select("graph", F.explode(each).alias("e"), F.exp(F.col("log_weight") - F.col("top")).alias("w")).groupBy("graph", "e.site", "e.label").agg(F.sum("w").alias("w"))
    total = sums.groupBy("graph", "site").agg(F.sum("w").alias("t"))
    return sums.join(total, ["graph", "site"]).select("graph", "site", "label", (F.col("w") / F.col("t")).alias("p"))


def marginal_decode(marginals: DataFrame) -> DataFrame:
    """graph, site, label: each site's most likely label, ties to the smallest."""
    best = marginals.groupBy("graph", "site").agg(F.max(F.struct("p", (-F.col("label")).alias("back"))).alias("best"))
    return best.select("graph", "site", (-F.col("best.back")).alias("label"))


def chain_log_partition(chains: DataFrame, coupling: float, field: list[float], bits: int = 40) -> DataFrame:
    """``chains`` with log_z of an open Potts chain of ``length`` sites, -inf for none.

    The transfer matrix is squared ``bits`` times on the driver, as it depends on the model alone; a row multiplies the
    squares that its length is made of. Everything is a projection.
    """
    import numpy as np

    q = len(field)
    m = np.exp(coupling * np.eye(q) + np.array(field)[None, :])
    x, scale = F.array(*(F.lit(math.exp(h)) for h in field)), F.lit(0.0)
    state = F.struct(x.alias("x"), scale.alias("scale"))
    squares, log = [], 0.0
    for _ in range(bits):
        top = float(m.max())
        m, log = m / top, log + math.log(top)
        squares.append(F.struct(F.array(*(F.lit(float(v)) for v in m.ravel())).alias("m"), F.lit(log).alias("scale")))
        m, log = m @ m, 2 * log

    def multiply(acc: Column, p: Column) -> Column:
        y = F.array(*(sum((acc["x"][i] * p["m"][i * q + j] for i in range(1, q)), acc["x"][0] * p["m"][j]) for j in range(q)))
        raw = F.struct(y.alias("x"), F.array_max(y).alias("top"), (acc["scale"] + p["scale"]).alias("scale"))
        return F.transform(F.array(raw), lambda r: F.struct(F.transform(r["x"], lambda v: v / r["top"]).alias("x"), (r["scale"] + F.log(r["top"])).alias("scale")))[0]

    steps = F.filter(F.array(*squares), lambda _, i: F.pmod(F.floor((F.col("length") - 1) / F.pow(F.lit(2.0), i)), F.lit(2)) == 1)
    done = F.aggregate(steps, state, multiply, lambda a: a["scale"] + F.log(F.aggregate(a["x"], F.lit(0.0), lambda s, v: s + v)))
    return chains.withColumn("log_z", F.when(F.col("length") > 0, done).otherwise(float("-inf")))


def propagate(edges: DataFrame, field: DataFrame, q: int, sweeps: int, damping: float = 0.5) -> DataFrame:
    """site, label, p: the beliefs after ``sweeps`` flooding sweeps; ``edges`` are (i, j, w), ``field`` (site, h0, h1, ...).

    A message is q logs on a directed edge. In a sweep, what reaches a site is one aggregate, and each edge takes off what
    came along it. New messages are ``damping`` parts of the old and the rest of the proposal, normalised. Parallel edges
    each have their own messages.
    """
    names = range(q)
    arcs = cut(edges.select(F.monotonically_increasing_id().alias("e"), "i", "j", "w"))
    ways = arcs.select("e", F.col("i").alias("site"), F.col("j").alias("other"), "w").union(arcs.select("e", F.col("j").alias("site"), F.col("i").alias("other"), "w"))
    messages = cut(ways.select("*", *(F.lit(-math.log(q)).alias(f"m{s}") for s in names)))  # from site to other
    lse = lambda xs: F.greatest(*xs) + F.log(sum((F.exp(x - F.greatest(*xs)) for x in xs[1:]), F.exp(xs[0] - F.greatest(*xs))))
    reached = lambda: messages.groupBy(F.col("other").alias("site")).agg(*(F.sum(f"m{s}").alias(f"r{s}") for s in names))
    for _ in range(sweeps):
        total = field.join(reached(), "site", "left").select("site", *((F.col(f"h{s}") + F.coalesce(f"r{s}", F.lit(0.0))).alias(f"t{s}") for s in names))
        back = messages.select("e", F.col("other").alias("site"), *(F.col(f"m{s}").alias(f"b{s}") for s in names))
        met = messages.join(total, "site").join(back, ["e", "site"])
        met = met.select("e", "site", "other", "w", *(F.col(f"m{s}") for s in names), *((F.col(f"t{s}") - F.col(f"b{s}")).alias(f"u{s}") for s in names))
        met = met.select("*", *(lse([F.col(f"u{s}") + (F.col("w") if s == t else F.lit(0.0)) for s in names]).alias(f"p{t}") for t in names))
        met = met.withColumn("z", lse([F.col(f"p{t}") for t in names]))
        met = met.select("e", "site", "other", "w", *((damping * F.col(f"m{t}") + (1 - damping) * (F.col(f"p{t}") - F.col("z"))).alias(f"n{t}") for t in names))
        met = met.withColumn("z", lse([F.col(f"n{t}") for t in names]))
        messages = cut(met.select("e", "site", "other", "w", *((F.col(f"n{t}") - F.col("z")).alias(f"m{t}") for t in names)))
    total = field.join(reached(), "site", "left").select("site", *((F.col(f"h{s}") + F.coalesce(f"r{s}", F.lit(0.0))).alias(f"t{s}") for s in names))
    total = total.withColumn("z", lse([F.col(f"t{s}") for s in names]))
    return total.select("site", F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("label"), F.exp(F.col(f"t{s}") - F.col("z")).alias("p")) for s in names))).alias("e")).select("site", "e.label", "e.p")
