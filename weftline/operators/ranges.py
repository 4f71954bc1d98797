"""Joins on ranges, draws by cumulative weights, and the merging of short segments: no nested loops, no task per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.segments import carried, numbered, placed
from weftline.sources.shared import cut


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, on: list[str] | None = None) -> DataFrame:
    """Each point with each span that holds it (low <= at <= high), and that agrees in the columns ``on``.

    A span goes to the two bins that can hold it at the power of two next to its length, a point to its bin at each power
    that some span has: at most some tens of rows a point whatever the spans' lengths, and an equality join that adaptive
    execution can split where one bin is hot. The columns of both sides follow each other, those of ``on`` once. Nulls,
    not-a-numbers and spans that end before they start meet nothing; infinite ends are as far as doubles go.
    """
    on = on or []
    far = 1.7e308
    held = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(far)), F.lit(-far))
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    good = spans.where(sound(low) & sound(high) & (F.col(low) <= F.col(high)))
    # spans of length 0 share the finest power that is of use
    size = held(high) / 2 - held(low) / 2
    power = F.when(size > 2.0**-40, F.ceil(F.log2(size)) + 1).otherwise(-40).cast("int")
    good = good.withColumns({"_power": power, "_low": held(low), "_high": held(high)})
    # at a power above their length, the ends lie in one bin or in neighbours; quotients that no long holds are whole anyway
    share = lambda x: F.col(x) / F.pow(F.lit(2.0), F.col("_power"))
    double = lambda x: F.when(F.abs(share(x)) < 2.0**53, F.floor(share(x)).cast("double")).otherwise(share(x))
    dealt = good.withColumn("_bin", F.explode(F.array_distinct(F.array(double("_low"), double("_high")))))
    powers = sorted(r["_power"] for r in good.select("_power").distinct().collect())  # one an octave
    mine = points.where(sound(at)).withColumn("_at", held(at)).withColumn("_power", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumn("_bin", double("_at"))
    met = mine.join(dealt, [*on, "_power", "_bin"]).where((F.col("_low") <= F.col("_at")) & (F.col("_at") <= F.col("_high")))
    return met.drop("_power", "_bin", "_low", "_high", "_at")


def range_totals(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, span: str, counted: str, on: list[str] | None = None) -> DataFrame:
    """``span``, n, first: of the points that lie in each span (low <= at <= high) and agree in the columns ``on``, the number
    and the least ``counted``. Spans that hold no point have no row, and spans of one name are added up.

    The pairs are never laid out. Places are numbered in order, and the ends of a span become a run of places. Runs of 1, 2,
    4, ... places that start at multiples of their length hold what their points add up to; a span is put together from at
    most two of each length. The work is that of points and spans times the logarithm of the places, whatever the spans
    hold. Nulls, not-a-numbers and spans that end before they start meet nothing; infinite ends are as far as doubles go.
    """
    on = on or []
    far = 1.7e308
    held = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(far)), F.lit(-far)) + 0.0
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    group = F.struct(*on) if on else F.lit(0)
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    live = points.where(sound(at) & whole).select(group.alias("segment"), held(at).alias("x"), F.col(counted).alias("first"))
    places = live.groupBy("segment", "x").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    places = cut(numbered(places, "segment", ["x"]).select("segment", "x", "k", "n", "first"))
    good = spans.where(sound(low) & sound(high) & (F.col(low) <= F.col(high)) & whole).withColumn("_id", F.monotonically_increasing_id())
    # of equal numbers a low end comes before the place and a high end after it
    ends = good.select(group.alias("segment"), F.col(span).alias("_span"), "_id", F.explode(F.array(F.struct(held(low).alias("x"), F.lit(0).alias("side")), F.struct(held(high).alias("x"), F.lit(2).alias("side")))).alias("e"))
    ends = cut(ends.select("segment", "e.x", "e.side", "_id", F.lit(None).cast("long").alias("k"), "_span"))
    kind = spans.schema[span].dataType
    both = places.select("segment", "x", F.lit(1).alias("side"), F.lit(-1).cast("long").alias("_id"), "k", F.lit(None).cast(kind).alias("_span")).union(ends)
    order = ["x", "side", "_id"]
    met = carried(placed(both, "segment", order), "segment", order, F.col("k"), "last", "before").where("side <> 1")
    stop = F.coalesce(F.col("before") + 1, F.lit(0))
    runs = met.groupBy("segment", "_id").agg(F.first("_span").alias("_span"), F.min(stop).alias("a"), F.max(stop).alias("b")).where("a < b")
    runs = cut(runs)
    top = runs.agg(F.max(F.col("b") - F.col("a"))).first()[0]
    levels = (top or 1).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    of = lambda c: F.expr(f"shiftright({c}, level)")
    blocks = places.select("segment", "k", "n", "first", level).groupBy("segment", "level", of("k").alias("block")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # at each level a run gives up a block at an odd start and one before an odd end, as long as anything is left
    up = F.expr("shiftright(a + shiftleft(1L, level) - 1, level)")
    laid = runs.select("segment", "_span", "a", "b", level).withColumns({"up": up, "down": of("b")}).where("up < down")
    given = F.filter(F.array(F.when(F.col("up") % 2 == 1, F.col("up")), F.when((F.col("down") % 2 == 1) & ((F.col("up") % 2 == 0) | (F.col("down") - 1 > F.col("up"))), F.col("down") - 1)), lambda x: x.isNotNull())
    parts = laid.select("segment", "_span", "level", F.explode(given).alias("block"))
    found = parts.join(blocks, ["segment", "level", "block"]).groupBy("_span").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return found.withColumnRenamed("_span", span)


def categorical_draws(entries: DataFrame, weights: DataFrame, entry: str, row: str, u: str, state: str, weight: str) -> DataFrame:
    """``entry``, ``row`` and ``state``: for each entry the state of its row at which the cumulative weight passes u times
    the row's total; u is from 0 to 1, and a u of 1 draws the last state.

    States in order lay their weights end to end, entries lie among them, and what lies last before an entry is carried
    to it, over range partitions: a row with most of the entries or of the states is dealt out like any other. States of
    no weight are never drawn, those below 0 raise; entries whose row has no weight, or without u, draw null.
    """
    sound = F.when(F.col(weight) < 0, F.raise_error(F.lit("a weight is below 0")).cast("double")).otherwise(F.col(weight).cast("double"))
    live = weights.select(F.col(row).alias("row"), F.col(state).alias("state"), sound.alias("w")).where("w > 0")
    laid = carried(placed(live, "row", ["state"]), "row", ["state"], F.col("w"), "sum", "stop")
    total = live.groupBy(F.col("row").alias("_row")).agg(F.sum("w").alias("_total"))
    kind = weights.schema[state].dataType.simpleString()
    of = entries.schema[entry].dataType.simpleString()
    asked = entries.join(total, F.col(row) == F.col("_row"), "left").select(F.col(row).alias("row"), (F.col(u).cast("double") * F.col("_total")).alias("x"), F.lit(1).alias("side"), F.col(entry).alias("entry"), F.lit(None).cast(kind).alias("state"))
    starts = laid.select("row", (F.col("stop") - F.col("w")).alias("x"), F.lit(0).alias("side"), F.lit(None).cast(of).alias("entry"), "state")
    # of starts that rounding makes equal, the later state is the one that has room
    order = ["x", "side", "state"]
    out = carried(placed(starts.union(asked), "row", order), "row", order, F.col("state"), "last", "drawn").where("side = 1")
    return out.select(F.col("entry").alias(entry), F.col("row").alias(row), F.when(F.col("x").isNotNull(), F.col("drawn")).alias(state))


def _first_reaching(laid: DataFrame, sums: str, own: str, least: float) -> DataFrame:
    """segment, k, to: the first place from k on at which the sum of ``own`` since k reaches ``least``; null where none does."""
    kind = "segment", "x", "side", "k", "from"
    data = laid.select("segment", F.col(sums).cast("double").alias("x"), F.lit(1).alias("side"), "k", F.lit(None).cast("long").alias("from"))
    asked = laid.select("segment", (F.col(sums) - F.col(own) + F.lit(least)).cast("double").alias("x"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("k"), F.col("k").alias("from"))
    order = ["x", "side", "k", "from"]
    met = carried(placed(data.union(asked).select(*kind), "segment", order), "segment", order, F.col("k"), "last", "to", reverse=True)
    # where the floor is met before k, k itself is the first
    return met.where("side = 0").select("segment", F.col("from").alias("k"), F.when(F.col("to").isNotNull(), F.greatest("to", "from")).alias("to"))


def floored(rows: DataFrame, group: str, order: list[str], length: str, min_length: float, weight: str | None = None, min_weight: float = 0.0) -> DataFrame:
    """``rows`` with ``merged``: the number, from 0 in each group, of the merged segment that a segment belongs to.

    Along a group, a merged segment opens at a segment and closes at the first at which its summed length reaches
    ``min_length`` and its summed weight ``min_weight``; what is left over at the end joins the one before, and stands alone
    only where it is all there is. Where a merged segment that opens at a place would close is found for all places by
    carrying sums; which places are opened follows by doubling those jumps, so that a group of any size takes
    logarithmically many rounds and no task holds it. Lengths and weights are 0 or more; nulls count as 0. Rows that tie in
    ``order`` may merge in either order.
    """
    kept = rows.withColumn("_key", F.struct(*order))
    at = F.coalesce(F.col(length).cast("double"), F.lit(0.0))
    heavy = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    laid = numbered(kept.select(F.col(group).alias("segment"), *order, at.alias("_len"), heavy.alias("_w")), "segment", order)
    laid = carried(laid, "segment", order, F.col("_len"), "sum", "_lens")
    laid = cut(carried(laid, "segment", order, F.col("_w"), "sum", "_ws"))
    ends = _first_reaching(laid, "_lens", "_len", min_length)
    if weight and min_weight > 0:
        other = _first_reaching(laid, "_ws", "_w", min_weight).select(F.col("segment").alias("_s"), F.col("k").alias("_k"), F.col("to").alias("other"))
        same = ends.join(other, F.col("segment").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")))
        ends = same.select("segment", "k", F.when(F.col("to").isNotNull() & F.col("other").isNotNull(), F.greatest("to", "other")).alias("to"))
    # a place opens if a chain of closings leads there; an open place that nothing closes is left over
    jump = cut(ends.where("to is not null").select("segment", F.col("k").alias("a"), (F.col("to") + 1).alias("b")))
    closing = jump
    opened = cut(laid.where("k = 0").select("segment", "k"))
    while not jump.isEmpty():
        more = opened.join(jump, (opened["segment"].eqNullSafe(jump["segment"])) & (F.col("k") == F.col("a"))).select(opened["segment"], F.col("b").alias("k"))
        opened = cut(opened.union(more).distinct())
        x, y = jump.alias("x"), jump.alias("y")
        jump = cut(x.join(y, F.col("x.segment").eqNullSafe(F.col("y.segment")) & (F.col("x.b") == F.col("y.a"))).select("x.segment", "x.a", "y.b"))
    closes = closing.select(F.col("segment").alias("_s"), F.col("a").alias("_a"))
    opened = opened.join(closes, F.col("segment").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_a")), "left").where("k = 0 or _a is not null").select(F.col("segment").alias("_s"), F.col("k").alias("_k"))
    met = laid.join(opened, F.col("segment").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")), "left")
    marked = carried(met.select("segment", *order, "k", "_part", F.when(F.col("_k").isNotNull(), 1).otherwise(0).cast("long").alias("open")), "segment", order, F.col("open"), "sum", "merged")
    own = marked.select(F.col("segment").alias("_s"), F.struct(*order).alias("_o"), (F.col("merged") - 1).alias("merged"))
    return kept.join(own, F.col(group).eqNullSafe(F.col("_s")) & F.col("_key").eqNullSafe(F.col("_o"))).drop("_s", "_o", "_key")
