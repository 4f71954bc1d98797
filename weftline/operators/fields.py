"""Linear algebra over GF(2) and Reed-Solomon codes over GF(2 ** m): arithmetic as columns, words as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import cut

#: A primitive polynomial of each degree.
PRIMITIVE = {2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10001001, 8: 0b100011101, 9: 0b1000010001, 10: 0b10000001001}


def _exclusive(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.union(y).groupBy("r", "c").agg((F.count("*") % 2).alias("n")).where("n = 1").select("r", "c")


def gf2_echelon(rows: DataFrame, row: str, column: str) -> DataFrame:
    """r, c, lead: places of ones of independent rows that span what ``rows`` do, no two of which lead by the same column.

    ``rows`` are the places of ones (row, column); a place that stands there twice is none. Elimination goes by rounds: in
    each, every column that leads some rows keeps one of them as its pivot (the shortest, then the least) and the others
    take its exclusive or, all columns side by side, as a join and a count of places. Rows stay rows of places; no task
    holds a matrix.
    """
    ones = rows.select(F.col(row).alias("r"), F.col(column).alias("c")).dropna().groupBy("r", "c").agg((F.count("*") % 2).alias("n")).where("n = 1").select("r", "c")
    left = cut(ones)
    while True:
        leads = left.groupBy("r").agg(F.min("c").alias("lead"), F.count("*").alias("size"))
        keep = leads.groupBy("lead").agg(F.min(F.struct("size", "r")).alias("p"), F.count("*").alias("n")).select("lead", F.col("p.r").alias("pivot"), "n")
        many = cut(leads.join(keep.where("n > 1"), "lead").where("r <> pivot").select("r", "pivot"))
        if many.isEmpty():
            return cut(left.join(leads.select("r", "lead"), "r"))
        left = cut(_exclusive(left, many.join(left.select(F.col("r").alias("pivot"), "c"), "pivot").select("r", "c")))


def gf2_basis(rows: DataFrame, row: str, column: str) -> DataFrame:
    """pivot and ``column``: the rows of the reduced echelon form over GF(2), each named by its pivot column.

    From ``gf2_echelon``, rows take the pivot rows of the columns that they hold besides their own, once those are clear
    of other pivots: from the last to the first, and side by side where they do not wait for each other.
    """
    done = cut(gf2_echelon(rows, row, column).select(F.col("lead").alias("r"), "c"))
    pivots = done.select(F.col("r").alias("c")).distinct()
    while True:
        own = cut(done.where("r <> c").join(pivots, "c", "left_semi").select("r", F.col("c").alias("p")))
        if own.isEmpty():
            return done.select(F.col("r").alias("pivot"), F.col("c").alias(column))
        now = own.join(own.select(F.col("r").alias("p")).distinct(), "p", "left_anti")
        done = cut(_exclusive(done, now.join(done.select(F.col("r").alias("p"), "c"), "p").select("r", "c")))


def gf2_rank(rows: DataFrame, row: str, column: str) -> DataFrame:
    """One row: rank, rows and columns (those with a one), and free, the columns less the rank: the null space's dimension."""
    rank = gf2_echelon(rows, row, column).select("lead").distinct().count()
    sizes = rows.dropna(subset=[row, column]).agg(F.countDistinct(row).alias("rows"), F.countDistinct(column).alias("columns"))
    return sizes.withColumn("rank", F.lit(rank).cast("long")).select("rank", "rows", "columns", (F.col("columns") - F.col("rank")).alias("free"))


def gf2_null_space(rows: DataFrame, row: str, column: str) -> DataFrame:
    """vector, ``column``: the ones of a basis of the null space, a vector for each column without a pivot (its name).

    The vector of a free column has a one there and at the pivots of the reduced rows that hold it.
    """
    basis = cut(gf2_basis(rows, row, column))
    free = rows.select(F.col(column).alias("vector")).dropna().distinct().join(basis.select(F.col("pivot").alias("vector")), "vector", "left_anti")
    at = basis.select(F.col(column).alias("vector"), F.col("pivot").alias(column)).join(free, "vector", "left_semi")
    return free.select("vector", F.col("vector").alias(column)).union(at)


class Field:
    """GF(2 ** m): sums are exclusive ors; products add logarithms to a primitive element a, by two tables of literals."""

    def __init__(self, m: int):
        self.m, self.n = m, (1 << m) - 1
        x, self.powers = 1, []
        for _ in range(self.n):
            self.powers.append(x)
            x <<= 1
            if x >> m:
                x ^= PRIMITIVE[m]
        self.logs = [0] * (self.n + 1)
        for k, v in enumerate(self.powers):
            self.logs[v] = k
        self._exp = F.array(*map(F.lit, self.powers))
        self._log = F.array(*map(F.lit, self.logs))

    def power(self, k: Column) -> Column:
        """a to the power k."""
        return F.get(self._exp, F.pmod(k, F.lit(self.n)).cast("int"))

    def log(self, x: Column) -> Column:
        """The logarithm of x; 0 has none."""
        return F.when(x != 0, F.get(self._log, x.cast("int")))

    def times(self, x: Column, y: Column) -> Column:
        return F.when((x == 0) | (y == 0), F.lit(0)).otherwise(self.power(self.log(x) + self.log(y)))

    def over(self, x: Column, y: Column) -> Column:
        """x / y; null for a y of 0."""
        return F.when(y != 0, F.when(x == 0, F.lit(0)).otherwise(self.power(self.log(x) - self.log(y) + self.n)))


def _once(x: Column, f) -> Column:  # noqa: ANN001
    return F.transform(F.array(x), f)[0]


def rs_syndromes(symbols: DataFrame, word: str, place: str, symbol: str, field: Field, checks: int) -> DataFrame:
    """``word`` and syndromes: the sums of symbol * a ** (j * place) for j from 1 to ``checks``, as one partial aggregate.

    Places are 0 to n - 1; places without a row hold 0. Symbols or places out of range raise.
    """
    bad = F.when((F.col(symbol) < 0) | (F.col(symbol) > field.n) | (F.col(place) < 0) | (F.col(place) >= field.n), F.raise_error(F.lit("a symbol or a place is out of the field")).cast("int"))
    x = F.coalesce(bad, F.col(symbol).cast("int"))
    each = [F.bit_xor(F.when(F.col("_x") == 0, F.lit(0)).otherwise(field.power(field.log(F.col("_x")) + j * F.col(place)))).alias(f"_s{j}") for j in range(1, checks + 1)]
    sums = symbols.withColumn("_x", x).groupBy(word).agg(*each)
    return sums.select(word, F.array(*(f"_s{j}" for j in range(1, checks + 1))).alias("syndromes"))


def _locator(field: Field, syndromes: Column, checks: int) -> Column:
    """The error locator's coefficients (constant first) and degree, by Berlekamp-Massey over the array of syndromes."""
    wide = checks + 1
    one = F.array(F.lit(1), *(F.lit(0) for _ in range(wide - 1)))
    start = F.struct(one.alias("c"), one.alias("b"), F.lit(0).alias("l"), F.lit(1).alias("m"), F.lit(1).alias("d"))

    def step(acc: Column, n: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(0), F.least(acc["l"], n)), lambda i: field.times(F.get(acc["c"], i), F.get(syndromes, n - i)))

        def told(delta: Column) -> Column:
            less = lambda factor: F.transform(acc["c"], lambda v, i: v.bitwiseXOR(F.when(i >= acc["m"], field.times(factor, F.coalesce(F.get(acc["b"], i - acc["m"]), F.lit(0)))).otherwise(0)))
            new = _once(field.over(delta, acc["d"]), less)
            same = F.struct(acc["c"].alias("c"), acc["b"].alias("b"), acc["l"].alias("l"), (acc["m"] + 1).alias("m"), acc["d"].alias("d"))
            longer = F.struct(new.alias("c"), acc["c"].alias("b"), (n + 1 - acc["l"]).alias("l"), F.lit(1).alias("m"), delta.alias("d"))
            kept = F.struct(new.alias("c"), acc["b"].alias("b"), acc["l"].alias("l"), (acc["m"] + 1).alias("m"), acc["d"].alias("d"))
            return F.when(delta == 0, same).when(2 * acc["l"] <= n, longer).otherwise(kept)

        return _once(F.aggregate(terms, F.lit(0), lambda s, x: s.bitwiseXOR(x)), told)

    return F.aggregate(F.sequence(F.lit(0), F.lit(checks - 1)), start, step, lambda acc: F.struct(acc["c"].alias("c"), acc["l"].alias("l")))


def rs_errors(syndromes: DataFrame, word: str, field: Field, checks: int, length: int) -> DataFrame:
    """``word``, errors and corrected: where (place) and by what (value) a word of ``length`` places is wrong.

    Up to ``checks`` / 2 errors are found: the locator by Berlekamp-Massey, its roots by trying all places, the values by
    Forney's formula, and what is found must explain every syndrome. ``corrected`` is null for a word without errors, true
    where they are found and false where there are more than that; then ``errors`` is empty.
    """
    value = lambda coefficients, log: F.aggregate(F.transform(coefficients, lambda v, i: F.when(v == 0, F.lit(0)).otherwise(field.power(field.log(v) + i * log))), F.lit(0), lambda s, x: s.bitwiseXOR(x))
    exclusive = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s.bitwiseXOR(x))
    none = F.array().cast("array<struct<place:bigint,value:int>>")

    # what a loop reads is bound to a variable first, so that it is computed once a word
    def judged(s: Column, f: Column, p: Column, e: Column) -> Column:
        explained = F.transform(F.sequence(F.lit(1), F.lit(checks)), lambda j: F.aggregate(e, F.lit(0), lambda acc, x: acc.bitwiseXOR(F.coalesce(field.power(field.log(x["value"]) + j * x["place"]), F.lit(0)))))
        good = (F.size(p) == f["l"]) & (f["l"] <= checks // 2) & F.coalesce(F.forall(e, lambda x: x["value"] > 0), F.lit(False)) & (explained == s)
        return F.struct(F.when(good, e).otherwise(none).alias("errors"), good.alias("corrected"))

    def valued(s: Column, f: Column, p: Column) -> Column:
        # omega = syndromes * locator up to the number of checks; the derivative keeps odd powers
        omega = F.transform(F.sequence(F.lit(0), F.lit(checks - 1)), lambda n: exclusive(F.transform(F.sequence(F.lit(0), n), lambda i: field.times(F.get(f["c"], i), F.get(s, n - i)))))
        slope = F.transform(F.slice(f["c"], 2, checks), lambda v, i: F.when(i % 2 == 0, v).otherwise(0))
        at = lambda o: F.transform(p, lambda x: F.struct(x.cast("long").alias("place"), field.over(value(o["o"], field.n - x), value(o["d"], field.n - x)).alias("value")))
        return _once(F.struct(omega.alias("o"), slope.alias("d")), lambda o: _once(at(o), lambda e: judged(s, f, p, e)))

    def found(s: Column) -> Column:
        roots = lambda f: F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda x: value(f["c"], field.n - x) == 0)
        told = _once(_locator(field, s, checks), lambda f: _once(roots(f), lambda p: valued(s, f, p)))
        clean = F.struct(none.alias("errors"), F.lit(None).cast("boolean").alias("corrected"))
        return F.when(F.forall(s, lambda x: x == 0), clean).otherwise(told)

    return syndromes.select(word, _once(F.col("syndromes"), found).alias("_r")).select(word, "_r.errors", "_r.corrected")


def rs_corrected(symbols: DataFrame, word: str, place: str, symbol: str, m: int, checks: int, length: int) -> DataFrame:
    """``word``, ``place``, ``symbol`` and corrected: the symbols of every word with the errors that ``rs_errors`` finds taken
    out. A place without a row that an error falls on gets one. Words with too many errors stay as they are."""
    field = Field(m)
    found = rs_errors(rs_syndromes(symbols, word, place, symbol, field, checks), word, field, checks, length)
    wrong = found.select(word, F.explode("errors").alias("e")).select(word, F.col("e.place").alias(place), F.col("e.value").alias("_v"))
    both = symbols.select(word, F.col(place).cast("long").alias(place), F.col(symbol).cast("int").alias("_v")).union(wrong)
    sums = both.groupBy(word, place).agg(F.bit_xor("_v").alias(symbol))
    return sums.join(found.select(word, "corrected"), word)


def rs_generator(m: int, checks: int) -> list[int]:
    """The coefficients, constant first, of the product of x - a ** j for j from 1 to ``checks``."""
    field = Field.__new__(Field)
    field.m, field.n = m, (1 << m) - 1
    x, powers = 1, []
    for _ in range(field.n):
        powers.append(x)
        x <<= 1
        if x >> m:
            x ^= PRIMITIVE[m]
    logs = {v: k for k, v in enumerate(powers)}
    times = lambda a, b: powers[(logs[a] + logs[b]) % field.n] if a and b else 0
    return reduce(lambda g, j: [(g[i - 1] if i else 0) ^ (times(g[i], powers[j % field.n]) if i < len(g) else 0) for i in range(len(g) + 1)], range(1, checks + 1), [1])
