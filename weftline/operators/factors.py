"""Factor graphs of any arity: sums and maxima over all labellings by messages between variables and factors.

``variables`` are (v, card): each takes the states 0 to card - 1. ``axes`` are (f, axis, v): the variables of a factor in
order. ``entries`` are (f, idx, logv): the log weight of the factor for each tuple of states ``idx``; a tuple that is not
listed has weight 1 (its log is 0), one of -inf is forbidden. Messages are rows (f, v, state, m) in each direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import bond_components
from weftline.sources.shared import cut, laid

NEVER = float("-inf")
#: So many states of a variable are summed in one row.
BLOCK = 16


def _added(x: Column, top: Column, best: bool) -> Column:
    """The log of the sum of exp(x), or the largest x, as an aggregate; ``top`` is the group's largest, null over no rows."""
    return F.first(top) if best else F.when(F.first(top) == NEVER, F.lit(NEVER)).otherwise(F.first(top) + F.log(F.sum(F.exp(x - top))))


def _folded(rows: DataFrame, by: list[str], x: str, best: bool) -> DataFrame:
    """``by`` and m: the log sum or the maximum of ``x``, in two partial aggregates."""
    top = rows.groupBy(*by).agg(F.max(x).alias("_top"))
    if best:
        return top.withColumnRenamed("_top", "m")
    met = rows.join(top, by)
    return met.groupBy(*by).agg(_added(F.col(x), F.col("_top"), best).alias("m"))


def states(variables: DataFrame) -> DataFrame:
    """v, state: a row for each state of each variable; one without states raises."""
    wrong = F.when(F.col("card") < 1, F.raise_error(F.lit("a variable has no states")).cast("long")).otherwise(F.col("card").cast("long"))
    return variables.select("v", F.explode(F.sequence(F.lit(0).cast("long"), wrong - 1)).alias("state"))


def tables(variables: DataFrame, axes: DataFrame, entries: DataFrame) -> DataFrame:
    """f, idx, logv: the whole table of each factor, with the entries that are not listed."""
    sized = axes.join(variables, "v").groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "card"))), lambda x: x["card"].cast("long")).alias("cards"))
    many = F.aggregate("cards", F.lit(1).cast("long"), lambda a, x: a * x)
    place = sized.select("f", "cards", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("at"))
    start = F.struct(F.col("at").alias("left"), F.array().cast("array<bigint>").alias("idx"))
    step = lambda acc, n: F.struct(F.floor(acc["left"] / n).alias("left"), F.concat(acc["idx"], F.array(F.pmod(acc["left"], n))).alias("idx"))
    place = place.select("f", F.aggregate("cards", start, step, lambda acc: acc["idx"]).alias("idx"))
    listed = entries.select("f", F.transform("idx", lambda x: x.cast("long")).alias("idx"), F.col("logv").cast("double").alias("logv"))
    return place.join(listed, ["f", "idx"], "left").select("f", "idx", F.coalesce("logv", F.lit(0.0)).alias("logv"))


def _long(whole: DataFrame, axes: DataFrame) -> DataFrame:
    """f, idx, logv, v, state: an entry for each of its axes."""
    of = F.expr("idx[cast(axis as int)]")
    return whole.join(axes.select("f", "axis", "v"), "f").select("f", "idx", "logv", "v", of.alias("state"))


def _to_variables(long: DataFrame, incoming: DataFrame, wanted: DataFrame, best: bool) -> DataFrame:
    """f, v, state, m for ``wanted`` (f, v): each entry adds what its other variables send, and entries fold by state."""
    met = long.join(incoming, ["f", "v", "state"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    # -inf is counted apart, so that what one variable sends can be taken off again
    none = F.when(F.col("m") == NEVER, 1).otherwise(0)
    sums = met.groupBy("f", "idx").agg(F.sum(F.when(F.col("m") > NEVER, F.col("m")).otherwise(0.0)).alias("all"), F.sum(none).alias("no"))
    mine = met.join(wanted, ["f", "v"], "left_semi").join(sums, ["f", "idx"])
    rest = F.when(F.col("no") - none > 0, F.lit(NEVER)).otherwise(F.col("all") - F.when(F.col("m") > NEVER, F.col("m")).otherwise(0.0))
    return _folded(mine.select("f", "v", "state", (F.col("logv") + rest).alias("x")), ["f", "v", "state"], "x", best)


def _to_factors(outgoing: DataFrame, axes: DataFrame, every: DataFrame, wanted: DataFrame) -> DataFrame:
    """f, v, state, m for ``wanted`` (f, v): the sum of what the variable's other factors send."""
    none = F.when(F.col("m") == NEVER, 1).otherwise(0)
    value = F.when(F.col("m") > NEVER, F.col("m")).otherwise(0.0)
    sums = outgoing.groupBy("v", "state").agg(F.sum(value).alias("all"), F.sum(none).alias("no"))
    met = wanted.join(every, "v").join(sums, ["v", "state"], "left").join(outgoing.select("f", "v", "state", "m"), ["f", "v", "state"], "left")
    no = F.coalesce("no", F.lit(0)) - F.when(F.col("m") == NEVER, 1).otherwise(0)
    rest = F.coalesce("all", F.lit(0.0)) - F.when(F.col("m") > NEVER, F.col("m")).otherwise(0.0)
    return met.select("f", "v", "state", F.when(no > 0, F.lit(NEVER)).otherwise(rest).alias("m"))


def _blocks(messages: DataFrame, most: int) -> DataFrame:
    """v, all, no: what the messages (v, m) of each variable add up to by state, and how many of them are -inf there.

    BLOCK states are summed in a row, in partial aggregates: a variable with many factors is no group of one task.
    """
    wide = min(most, BLOCK)
    m = F.col("m")
    dealt = messages.select("v", "m", F.lit(0).alias("block")) if most <= BLOCK else messages.select("v", "m", F.explode(F.sequence(F.lit(0), F.expr(f"(size(m) - 1) div {BLOCK}"))).alias("block"))
    at = lambda s: F.get(m, F.col("block") * BLOCK + s)
    sums = dealt.groupBy("v", "block").agg(
        F.max(F.size(m)).alias("card"),
        *(F.sum(F.when(at(s) > NEVER, at(s)).when(at(s).isNotNull(), 0.0)).alias(f"a{s}") for s in range(wide)),
        *(F.sum(F.when(at(s) == NEVER, 1).otherwise(0)).alias(f"n{s}") for s in range(wide)),
    )
    sums = sums.select("v", "block", "card", F.array(*(f"a{s}" for s in range(wide))).alias("all"), F.array(*(f"n{s}" for s in range(wide))).alias("no"))
    if most > BLOCK:
        sums = sums.groupBy("v").agg(F.max("card").alias("card"), F.array_sort(F.collect_list(F.struct("block", "all", "no"))).alias("parts"))
        sums = sums.select("v", "card", F.flatten("parts.all").alias("all"), F.flatten("parts.no").alias("no"))
    return sums.select("v", F.slice("all", F.lit(1), F.col("card")).alias("all"), F.slice("no", F.lit(1), F.col("card")).alias("no"))


def _total() -> Column:
    """The sums of ``_blocks`` as messages."""
    return F.zip_with("all", "no", lambda x, n: F.when(n > 0, F.lit(NEVER)).otherwise(x))


def _sent(rows: DataFrame, best: bool, down: bool) -> DataFrame:
    """f, v, m: what each factor (f, vs, cards, w, come, to, least) sends to its variable ``to`` (with ``least``) or, ``down``,
    to its others.

    ``come`` lists what each of its variables sent, null where that is 0 for every state, or null as a whole. Factors of one shape are worked
    out together.
    """
    fields = {x.name: x.dataType.simpleString() for x in rows.schema}
    names = ["f", "v", "m"] if down else ["f", "v", "m", "least"]
    kind = f"f {fields['f']}, v {fields['to']}, m array<double>" + ("" if down else f", least {fields['least']}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs, cards, target = (batch.column(k) for k in ("vs", "cards", "axis"))
            shapes: dict[tuple[int, ...], list[int]] = {}
            for k, shape in enumerate(zip(*(c.to_pylist() for c in (cards, target)), strict=True)):
                shapes.setdefault((*shape[0], shape[1]), []).append(k)
            for (*card, axis), own in shapes.items():
                take = pa.array(own)
                some = batch.take(take)
                shape = (len(own), *card)
                x = some.column("w").flatten().to_numpy(zero_copy_only=False).reshape(shape)
                sent = []
                for k, n in enumerate(card):
                    got = pc.list_element(some.column("come"), k)
                    got = pc.if_else(pc.is_valid(got), got, pa.scalar([0.0] * n, got.type))
                    sent.append(got.flatten().to_numpy(zero_copy_only=False).reshape(len(own), *(n if j == k else 1 for j in range(len(card)))))
                for k in range(len(card)) if down else [axis]:
                    if down and k == axis:
                        continue
                    y = x
                    for j, m in enumerate(sent):
                        y = y if j == k else y + m
                    y = np.moveaxis(y, k + 1, 1).reshape(len(own), card[k], -1)
                    m = y.max(axis=2)
                    if not best:
                        top = np.where(np.isfinite(m), m, 0.0)
                        with np.errstate(divide="ignore"):
                            m = top + np.log(np.exp(y - top[:, :, None]).sum(axis=2))
                    ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * card[k])
                    columns = [some.column("f"), pc.list_element(some.column("vs"), k), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns if down else [*columns, some.column("least")], names=names)

    axis = (F.array_position("vs", F.col("to")) - 1).cast("int").alias("axis")
    return rows.select("f", "vs", "cards", "w", "come", axis, *([] if down else ["least"])).mapInArrow(work, kind)


def _row_major(cards: Column) -> Column:
    """How far apart in a factor's table the states of each axis are."""
    return F.reverse(F.aggregate(F.reverse(cards), F.struct(F.lit(1).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out")), lambda a, c: F.struct((a["n"] * c).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"]))


def _whole(entries: DataFrame, shapes: DataFrame) -> DataFrame:
    """``shapes`` (f, cards and more) with ``w``: the factor's table in row-major order."""
    many = F.aggregate("cards", F.lit(1).cast("long"), lambda a, x: a * x)
    if "weights" in entries.columns:
        met = shapes.join(entries.select("f", "weights"), "f", "left")
        w = F.coalesce(F.transform("weights", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), many.cast("int")))
        wrong = F.raise_error(F.lit("a factor's weights do not fit its variables")).cast("array<double>")
        return met.withColumn("w", F.when(F.size(w) == many, w).otherwise(wrong)).drop("weights")
    listed = entries.groupBy("f").agg(F.collect_list(F.struct(F.transform("idx", lambda x: x.cast("long")).alias("idx"), F.col("logv").cast("double").alias("logv"))).alias("listed"))
    met = shapes.join(listed, "f", "left").withColumn("_strides", _row_major(F.col("cards")))
    sound = lambda x: (F.size(x["idx"]) == F.size("cards")) & F.forall(F.zip_with(x["idx"], "cards", lambda i, c: (i >= 0) & (i < c)), lambda y: y)
    place = lambda x: F.aggregate(F.zip_with(x["idx"], "_strides", lambda i, s: i * s), F.lit(0).cast("long"), lambda a, y: a + y)
    own = F.transform(F.filter(F.coalesce("listed", F.array()), sound), lambda x: F.struct(place(x).alias("at"), F.lit(0).alias("rest"), F.coalesce(x["logv"], F.lit(0.0)).alias("logv")))
    # every place once with weight 1, behind what is listed
    rest = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda k: F.struct(k.alias("at"), F.lit(1).alias("rest"), F.lit(0.0).alias("logv")))
    met = met.withColumn("_all", F.array_sort(F.concat(own, rest)))
    first = lambda x, k: (k == 0) | (F.get("_all", k - 1)["at"] != x["at"])
    return met.withColumn("w", F.transform(F.filter("_all", first), lambda x: x["logv"])).drop("listed", "_strides", "_all")


def _packed(variables: DataFrame, axes: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each factor (f, vs, cards, ns, w) with its variables in order and the numbers of their factors, and one for
    each variable (v, card, n)."""
    wrong = F.when(F.col("card") < 1, F.raise_error(F.lit("a variable has no states")).cast("int")).otherwise(F.col("card").cast("int"))
    degree = axes.groupBy("v").agg(F.count("*").alias("n"))
    known = laid(variables.select("v", wrong.alias("card")).join(degree, "v", "left"), "variables")
    shapes = axes.select("f", "axis", "v").join(known, "v").repartition("f").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("axis", "v", "card", "n"))).alias("x"))
    shapes = shapes.select("f", F.col("x.v").alias("vs"), F.col("x.card").alias("cards"), F.col("x.n").alias("ns"))
    parts = laid(_whole(entries, shapes), "factors")
    if not parts.where("size(array_distinct(vs)) < size(vs)").isEmpty():
        raise ValueError("a factor lists a variable twice")
    return parts, known


def layers(parts: DataFrame) -> Iterator[DataFrame]:
    """The turns of a schedule that peels leaves off a forest, from ``parts`` (f, vs, ns and more) of ``_packed``: rows (f, ups,
    to, rest), in the first turn with all columns of ``parts``.

    In each turn the variables with one factor left send to it and go (``ups``); then the factors with one variable left send
    to that and go (``to``; null where more are left). A factor whose last variables could all go keeps the least. What
    remains at the end is one variable a tree. Where a loop is left, this raises.
    """
    left = parts.withColumns({"_vs": F.col("vs"), "_ns": F.col("ns")})
    while True:
        of = lambda lone: F.transform(F.filter(F.arrays_zip("_vs", "_ns"), lambda x: (x["_ns"] == 1) == lone), lambda x: x["_vs"])
        left = left.withColumns({"ups": of(F.lit(True)), "rest": of(F.lit(False))})
        root = F.array_min("ups")
        to = F.when(F.size("rest") == 0, root).when(F.size("rest") == 1, F.get("rest", F.lit(0)))
        step = left.withColumn("to", to).withColumns({"ups": F.when(F.size("rest") == 0, F.filter("ups", lambda v: v != root)).otherwise(F.col("ups")), "rest": F.when(F.size("rest") > 1, F.col("rest"))}).drop("_vs", "_ns")
        step = laid(step, "turn")
        if step.isEmpty():
            return
        if step.where("to is not null or size(ups) > 0").isEmpty():
            raise ValueError("the factors have a loop; use loopy() for them")
        yield step
        pairs = step.select("f", F.explode("rest").alias("v"))
        met = pairs.join(pairs.groupBy("v").agg(F.count("*").alias("n")), "v")
        left = met.groupBy("f").agg(F.collect_list(F.struct("v", "n")).alias("x")).select("f", F.col("x.v").alias("_vs"), F.col("x.n").alias("_ns"))


def _piled(pile: list[tuple[int, DataFrame]], more: DataFrame) -> None:
    """Adds a turn's table to the pile; tables of equally many turns become one, so that long forests read few."""
    pile.append((1, more))
    while len(pile) > 1 and pile[-1][0] == pile[-2][0]:
        (n, x), (_, y) = pile.pop(-2), pile.pop()
        pile.append((2 * n, laid(x.unionByName(y), "messages")))


def _all(pile: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x for _, x in pile))


def _ascended(parts: DataFrame, most: int, best: bool) -> tuple[list[DataFrame], list[tuple[int, DataFrame]], list[tuple[int, DataFrame]]]:
    """The way up: of each turn the factors that send, with what has come to them; a pile of the messages (f, v, m, least) to
    variables, ``least`` of all variables behind them; a pile of those (f, v, m, least) that variables sent, but for those
    of variables to which nothing had come: 0 for all states."""
    turns, to_v, to_f = [], [], []
    for turn, step in enumerate(layers(parts)):
        if turn:
            sums = _blocks(_all(to_v).select("v", "m"), most).select("v", _total().alias("m"))
            least = _all(to_v).groupBy("v").agg(F.min("least").alias("least"))
            ups = step.select("f", F.explode("ups").alias("v"))
            _piled(to_f, laid(ups.join(sums.join(least, "v"), "v").select("f", "v", "m", F.least("v", "least").alias("least")), "messages"))
        go = step.where("to is not null")
        if turn:
            come = _all(to_f).join(go.select("f"), "f", "left_semi").groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("v", F.struct("m", "least")))).alias("got"))
            go = go.select("f", "to").join(parts, "f").join(come, "f", "left")
            got = lambda v: F.col("got")[v]
            go = go.select("f", "vs", "cards", "w", "to", F.transform("vs", lambda v: got(v)["m"]).alias("come"), F.transform("vs", lambda v: F.when(v != F.col("to"), F.coalesce(got(v)["least"], v))).alias("names"))
            go = go.withColumn("least", F.array_min("names")).drop("names")
        else:
            go = go.select("f", "vs", "cards", "w", "to", F.lit(None).cast("array<array<double>>").alias("come"), F.array_min(F.array_remove("vs", F.col("to"))).alias("least"))
        go = laid(go, "sending") if turn else go
        turns.append(go)
        _piled(to_v, laid(_sent(go, best, down=False), "messages"))
    return turns, to_v, to_f


def _most(known: DataFrame) -> int:
    return known.agg(F.max("card")).first()[0] or 1


def _beliefs(variables: DataFrame, axes: DataFrame, entries: DataFrame, best: bool) -> DataFrame:
    """v, m: ``solve`` with the states of a variable in one row."""
    parts, known = _packed(variables, axes, entries)
    most = _most(known)
    turns, to_v, _ = _ascended(parts, most, best)
    for go in reversed(turns):
        # what went up comes back: the factor hears from the variable that it sent to what all others say there
        sums = _blocks(_all(to_v).select("v", "m"), most)
        own = _all(to_v).join(go.select("f", F.col("to").alias("v")), ["f", "v"], "left_semi").join(sums, "v")
        less = F.zip_with("all", "m", lambda x, m: x - F.when(m > NEVER, m).otherwise(0.0))
        none = F.zip_with("no", "m", lambda n, m: n - F.when(m == NEVER, 1).otherwise(0))
        back = own.select("f", F.zip_with(less, none, lambda x, n: F.when(n > 0, F.lit(NEVER)).otherwise(x)).alias("back"))
        met = go.join(back, "f")
        met = met.withColumn("come", F.transform("vs", lambda v, k: F.when(v == F.col("to"), F.col("back")).otherwise(F.get("come", k))))
        _piled(to_v, laid(_sent(met, best, down=True).withColumn("least", F.lit(None).cast(variables.schema["v"].dataType)), "messages"))
    if not turns:
        return known.select("v", F.array_repeat(F.lit(0.0), F.col("card")).alias("m"))
    sums = _blocks(_all(to_v).select("v", "m"), most).select("v", _total().alias("m"))
    return known.join(sums, "v", "left").select("v", F.coalesce("m", F.array_repeat(F.lit(0.0), F.col("card"))).alias("m"))


def _by_state(beliefs: DataFrame, *more: Column) -> DataFrame:
    return beliefs.select("v", F.posexplode("m").alias("state", "m"), *more).withColumn("state", F.col("state").cast("long"))


def _log_sum(xs: str) -> Column:
    """The log of the sum of exp over an array."""
    top = F.array_max(xs)
    return F.when(top == NEVER, top).otherwise(top + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def solve(variables: DataFrame, axes: DataFrame, entries: DataFrame, best: bool = False) -> DataFrame:
    """v, state, m: for each state of each variable, the log of the sum (or the maximum, with ``best``) of the weights of all
    labellings of its component that give it this state. Exact on forests; loops raise.

    Leaves are peeled off: every node sends once, when one neighbour is left, and the same schedule is run back, so that
    each edge carries one message each way. A variable without factors has m = 0; factors without variables are not read,
    and a factor that lists a variable twice raises.

    A factor's table is one row, in row-major order. ``entries`` may hold it as that: (f, weights), an array as long as the
    product of the cards.
    """
    return _by_state(_beliefs(variables, axes, entries, best))


def components(variables: DataFrame, axes: DataFrame) -> DataFrame:
    """v, component: the least variable that factors connect v with."""
    first = axes.groupBy("f").agg(F.min("v").alias("i"))
    edges = axes.join(first, "f").select("i", F.col("v").alias("j")).where("i <> j").distinct().withColumn("w", F.lit(1.0))
    roots = bond_components(edges).withColumnRenamed("site", "v")
    return variables.select("v").join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("component"))


def log_partition(variables: DataFrame, axes: DataFrame, entries: DataFrame) -> DataFrame:
    """component, log_z: the log of the sum of the weights of all labellings, by component (named by its least variable)."""
    parts, known = _packed(variables, axes, entries)
    most = _most(known)
    _, to_v, to_f = _ascended(parts, most, False)
    alone = known.where("n is null").select(F.col("v").alias("component"), F.log(F.col("card").cast("double")).alias("log_z"))
    if not to_v:
        return alone
    # the variables that heard and sent nothing on are the roots
    heard = _all(to_v).select("v", "m", "least")
    heard = heard.join(_all(to_f).select("v"), "v", "left_anti") if to_f else heard
    least = heard.groupBy("v").agg(F.min("least").alias("least"))
    roots = _blocks(heard.select("v", "m"), most).join(least, "v").select(F.least("v", "least").alias("component"), _total().alias("m"))
    return roots.select("component", _log_sum("m").alias("log_z")).union(alone)


def marginals(variables: DataFrame, axes: DataFrame, entries: DataFrame) -> DataFrame:
    """v, state, p: how likely each variable has each state; null where no labelling has a weight."""
    sums = _beliefs(variables, axes, entries, False).withColumn("all", _log_sum("m"))
    return _by_state(sums, F.col("all")).select("v", "state", F.when(F.col("all") > NEVER, F.exp(F.col("m") - F.col("all"))).alias("p"))


def max_marginals(variables: DataFrame, axes: DataFrame, entries: DataFrame) -> DataFrame:
    """v, state, m, best: the weight of the best labelling with each state, and whether it is the variable's best (of equal
    ones the least state). Where no two labellings are the best, the best states together are the best labelling."""
    sums = _beliefs(variables, axes, entries, True)
    first = (F.array_position("m", F.array_max("m")) - 1).alias("first")
    return _by_state(sums, first).select("v", "state", "m", (F.col("state") == F.col("first")).alias("best"))


def loopy(variables: DataFrame, axes: DataFrame, entries: DataFrame, rounds: int, settle: float = 1e-9, damping: float = 0.0, best: bool = False) -> tuple[DataFrame, float, int]:
    """``solve`` by flooding, for factors with loops: v, state, m (scaled so that a variable's largest is 0), the last change
    of a message and the rounds taken. It stops where no message changes by more than ``settle``, or after ``rounds``.

    On loops the sums are approximate. ``damping`` is the share of the old message that stays; forbidden states stay so.
    """
    every = cut(states(variables))
    long = cut(_long(tables(variables, axes, entries), axes))
    pairs = cut(axes.select("f", "v").distinct())
    start = pairs.join(every, "v").select("f", "v", "state", F.lit(0.0).alias("m"))
    to_v, change, taken = cut(start), float("inf"), 0

    def scaled(m: DataFrame) -> DataFrame:
        top = m.groupBy("f", "v").agg(F.max("m").alias("top"))
        return m.join(top, ["f", "v"]).select("f", "v", "state", F.when(F.col("top") > NEVER, F.col("m") - F.col("top")).otherwise(F.col("m")).alias("m"))

    while taken < rounds and change > settle:
        new = scaled(_to_variables(long, _to_factors(to_v, axes, every, pairs), pairs, best)).withColumnRenamed("m", "new")
        met = to_v.join(new, ["f", "v", "state"])
        mix = F.when((F.col("m") > NEVER) & (F.col("new") > NEVER), F.lit(damping) * F.col("m") + F.lit(1 - damping) * F.col("new")).otherwise(F.col("new"))
        met = cut(met.select("f", "v", "state", mix.alias("now"), F.when(F.col("m") == F.col("new"), 0.0).otherwise(F.abs(F.col("new") - F.col("m"))).alias("d")))
        change, taken = met.agg(F.max("d")).first()[0] or 0.0, taken + 1
        to_v = met.select("f", "v", "state", F.col("now").alias("m"))
    none = F.when(F.col("m") == NEVER, 1).otherwise(0)
    sums = to_v.groupBy("v", "state").agg(F.sum(F.when(F.col("m") > NEVER, F.col("m")).otherwise(0.0)).alias("all"), F.sum(none).alias("no"))
    met = every.join(sums, ["v", "state"], "left").select("v", "state", F.when(F.coalesce("no", F.lit(0)) > 0, F.lit(NEVER)).otherwise(F.coalesce("all", F.lit(0.0))).alias("m"))
    top = met.groupBy("v").agg(F.max("m").alias("top"))
    return met.join(top, "v").select("v", "state", (F.col("m") - F.col("top")).alias("m")), change, taken
