"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-word blocks (operator 4)."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import staged, table, word_count
from weftline.operators.segments import numbered

#: The words of a block, the words that a shard of a source has about, and how often a source may be repeated.
BLOCK, SHARD, REPEATS = 32, 1 << 18, 3
SEED = 11


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; what is above ``repeats`` times a size is dealt to the others again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > repeats * sizes[i]]
        for i in over or free:
            out[i] = float(repeats * sizes[i]) if over else share[i]
        if not over:
            break
        free -= set(over)
        left = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients weight / (2 * seats so far + 1), ties to the first; none above ``most``.

    The whole part of each share is dealt first, less a margin that the rule is sure to grant; the rest goes one by one.
    """
    n, total = len(weights), sum(weights)
    most = most or [seats] * n
    out = [0] * n
    if total > 0:
        # with quotients above total / (2 * seats) * (1 + n / seats), fewer than seats seats can be dealt
        level = 2 * (seats + n) / total
        out = [max(0, min(most[i], math.floor((w * level / (1 + 2 * n / max(seats, 1)) - 1) / 2))) for i, w in enumerate(weights)]
        if sum(out) > seats:
            out = [0] * n
    left = seats - sum(out)
    heap = [(-w / (2 * out[i] + 1), i) for i, w in enumerate(weights) if w > 0 and out[i] < most[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        left -= 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


#: Prices tried in a pass, passes at most, and how many seats may be left to rank.
PRICES, PASSES, RANKED = 32, 8, 1_000


def shard_quotas(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, shard, words and ``quota``: each source's ``blocks`` dealt to its shards as ``sainte_lague`` does.

    ``counts`` are (source, shard, words, blocks); a shard takes no more than REPEATS times its words. A seat is granted if
    its quotient reaches a price, so the seats at many prices are sums over shards: a few passes close in on each source's
    price, one row a source, and only the seats with quotients between the last two prices are ranked, over range
    partitions. No task and no group holds a source's shards.
    """
    spark = counts.sparkSession
    most = F.ceil(REPEATS * F.col("words") / block).cast("long")
    seats = lambda price: F.when(F.col("words") > 0, F.least(most, F.floor((F.col("words") / price + 1) / 2))).otherwise(0).cast("long")
    kind = counts.schema["source"].dataType.simpleString()
    # below a quarter, any shard has all the seats that it may have
    ends = {r["source"]: (0.25, max(1.0, 2.0 * (r["w"] or 0)), r["blocks"]) for r in counts.groupBy("source").agg(F.max("words").alias("w"), F.first("blocks").alias("blocks")).collect()}

    def priced() -> DataFrame:
        return spark.createDataFrame([(s, *e) for s, e in ends.items()], f"_source {kind}, low double, high double, seats long")

    def with_prices() -> DataFrame:
        return counts.select("source", "shard", "words").join(F.broadcast(priced()), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    for _ in range(PASSES if ends else 0):
        at = [F.col("low") * F.pow(F.col("high") / F.col("low"), F.lit(j / (PRICES - 1))) for j in range(PRICES)]
        rows = with_prices().groupBy("source").agg(*(F.sum(seats(x)).alias(f"n{j}") for j, x in enumerate(at))).collect()
        gaps = []
        for r in rows:
            low, high, want = ends[r["source"]]
            prices, found = [low * (high / low) ** (j / (PRICES - 1)) for j in range(PRICES)], [r[f"n{j}"] for j in range(PRICES)]
            above = next((j for j, n in enumerate(found) if n <= want), PRICES - 1)
            ends[r["source"]] = (prices[max(above - 1, 0)], prices[above], want)
            gaps.append(found[max(above - 1, 0)] - found[above])
        if max(gaps) <= RANKED:
            break
    held = with_prices().select("source", "shard", "words", "seats", seats(F.col("high")).alias("sure"), seats(F.col("low")).alias("open"))
    held = staged(held, "shard-prices")
    left = held.groupBy("source").agg((F.first("seats") - F.sum("sure")).alias("left"))
    asked = held.where("open > sure").select("source", "shard", "words", F.explode(F.sequence(F.col("sure") + 1, F.col("open"))).alias("seat"))
    ranked = numbered(asked.select("source", (-F.col("words") / (2 * F.col("seat") - 1)).alias("back"), "shard", "seat"), "source", ["back", "shard", "seat"])
    same = lambda x: F.col("source").eqNullSafe(F.col(x))
    granted = ranked.join(F.broadcast(left.withColumnRenamed("source", "_source")), same("_source")).where("k < left").groupBy(F.col("source").alias("_s"), F.col("shard").alias("_h")).agg(F.count("*").alias("more"))
    met = held.join(granted, same("_s") & (F.col("shard") == F.col("_h")), "left")
    return met.select("source", "shard", "words", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def _plan(totals: list[tuple], weights: tuple[float, ...], block: int, shard: int) -> list[tuple]:
    """Rows (source, source_size, target, blocks, shards), sources by code point and null last."""
    totals = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    blocks = sainte_lague(goal, round(sum(goal) / block), [-(-REPEATS * n // block) for n in sizes])
    return [(s, n, g, b, max(1, -(-n // shard))) for (s, n), g, b in zip(totals, goal, blocks, strict=True)]


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = BLOCK, shard: int = SHARD, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken and ``ranges`` for every row.

    Sources in code-point order, null last, weigh ``weights`` in turn. Their targets share the words of all documents; a
    target stops at REPEATS times its source. The targets become integer quotas of ``block`` words by Sainte-Laguë, and a
    source's quota is apportioned to its shards in the same way. A shard lays its documents end to end in a seeded order;
    whole rounds of it are taken first, then a seeded selection of its blocks. ``taken`` counts a document's words, and
    ``ranges`` are the words (from, to) that the last round takes of it; ``taken - sum(to - from)`` is a multiple of size.

    A null or wordless text has size 0 and nothing is taken; an empty table gives no rows; equal rows may differ in what
    is taken of each, not in sum. The driver sees one row per source.
    """
    spark = docs.sparkSession
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw")), "sized")
    totals = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows = _plan(totals, weights, block, shard)
    schema = T.StructType([T.StructField("_source", docs.schema[source_col].dataType), *(T.StructField(c, t) for c, t in (("source_size", T.LongType()), ("target", T.DoubleType()), ("blocks", T.LongType()), ("shards", T.LongType())))])
    plan = spark.createDataFrame(rows, schema)
    known = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), "shards"))

    counts = staged(known.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks")), "shards")
    quota = shard_quotas(counts, block).select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "words", "quota")
    met = known.join(quota.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard"))).drop("_s", "_shard")
    order = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("stop", F.sum("size").over(order)).withColumn("begin", F.col("stop") - F.col("size"))
    # whole rounds, then rest words: k whole blocks of the shard's own n, and part of the block after the last of these
    # the last block of a shard that is taken REPEATS times may be short
    met = met.withColumn("want", F.least(F.col("quota") * block, REPEATS * F.col("words")))
    met = met.withColumn("rounds", F.when(F.col("words") > 0, F.expr("want div words")).otherwise(0)).withColumn("rest", F.col("want") - F.col("rounds") * F.col("words"))
    met = met.withColumn("k", F.expr(f"rest div {block}")).withColumn("n", F.greatest(F.expr(f"words div {block}"), F.lit(1)))
    # block b is chosen if (b * step + shift) mod n < k: a seeded walk over all blocks, as step has no factor of n
    met = met.withColumn("step", _coprime(F.col("n"))).withColumn("shift", F.pmod(F.xxhash64(F.lit(seed + 2), "shard"), "n"))
    first, last = F.expr(f"begin div {block}"), F.expr(f"greatest(stop - 1, begin) div {block}")

    def piece(b):  # noqa: ANN001, ANN202
        place = F.pmod(b * F.col("step") + F.col("shift"), F.col("n"))
        inside = b < F.expr(f"words div {block}")
        full = F.when(inside & (place < F.col("k")), F.lit(block)).when(inside & (place == F.col("k")), F.col("rest") - F.col("k") * block).when(~inside & (F.col("k") == F.expr(f"words div {block}")), F.col("rest") - F.col("k") * block).otherwise(0)
        start, end = F.greatest(b * block, F.col("begin")), F.least(b * block + full, F.col("stop"))
        return F.struct((start - F.col("begin")).alias("from"), (end - F.col("begin")).alias("to"))

    ranges = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.filter(F.transform(F.sequence(first, last), piece), lambda r: r["to"] > r["from"])).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))
    met = met.withColumn("ranges", ranges)
    extra = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return met.withColumn("taken", F.col("rounds") * F.col("size") + extra).select("doc_id", "size", "source_size", "target", "taken", "ranges", "draw", "source")


def _coprime(n):  # noqa: ANN001, ANN202
    """A step near the golden section of n that shares no factor with it: the first of a few primes that doesn't divide n."""
    primes = [2654435761, 2246822519, 3266489917]
    step = F.lit(1)
    for p in reversed(primes):
        step = F.when(F.pmod(n, F.lit(p)) != 0, F.pmod(F.lit(p), n)).otherwise(step)
    return F.greatest(step, F.lit(1)).cast("long")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix: a row for each whole round of a document, and one with the words of the last round.

    The columns are those of ``docs``, of any names; a last row's text keeps the white space before its words, and n_chars,
    where there is such a column, counts its characters. Texts without words and empty tables give no rows; of equal rows,
    which one is repeated is not fixed.
    """
    id_col, source_col, text_col = (str(options.get(k, d)) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    seed = options.get("seed", SEED)
    taken = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("id"), "draw", "source", "size", "taken", "ranges")
    # equal rows stand in equal numbers on both sides; numbering them keeps the join one to one
    own = lambda last: F.row_number().over(Window.partitionBy("id", "draw", "source").orderBy(last))
    taken = taken.withColumn("n", own(F.desc("taken"))).alias("b")
    # neutral names, as those of docs may be any
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in (id_col, source_col, text_col)}
    keyed = docs.toDF(*names).withColumns({"id": at[id_col], "draw": F.xxhash64(F.lit(seed), at[id_col], at[text_col]), "source": at[source_col]}).withColumn("n", own(F.lit(1))).alias("a")
    same = (F.col("a.draw") == F.col("b.draw")) & (F.col("a.n") == F.col("b.n")) & F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    met = keyed.join(taken, same).select(*(F.col(f"a.{c}") for c in names), "b.size", "b.taken", "b.ranges")
    part = F.aggregate("ranges", F.lit(0).cast("long"), lambda x, r: x + r["to"] - r["from"])
    chunks = F.regexp_extract_all(at[text_col], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    some = F.transform(F.array(chunks), lambda words: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(words, r["from"].cast("int") + 1, (r["to"] - r["from"]).cast("int")))), ""))[0]
    whole = F.array_repeat(at[text_col], ((F.col("taken") - part) / F.greatest("size", F.lit(1))).cast("int"))
    texts = F.concat(whole, F.when(part > 0, F.array(some)).otherwise(F.array().cast("array<string>")))
    out = met.select(*names, F.explode(texts).alias("new"))
    columns = {text_col: F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(columns.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
