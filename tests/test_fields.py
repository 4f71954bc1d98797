"""Elimination over GF(2) and Reed-Solomon correction against plain arithmetic."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import fields


def plain_rank(rows: list[int]) -> int:
    rows, rank = list(rows), 0
    while rows:
        top = rows.pop()
        if top:
            rank += 1
            low = top & -top
            rows = [r ^ top if r & low else r for r in rows]
    return rank


@pytest.mark.parametrize(("n", "m", "share", "seed"), [(12, 9, 0.4, 1), (8, 20, 0.2, 2), (15, 15, 0.5, 3)])
def test_rank_and_null_space(spark, n, m, share, seed):
    rng = random.Random(seed)
    rows = [sum(1 << c for c in range(m) if rng.random() < share) for _ in range(n)]
    rows += [rows[0] ^ rows[1], rows[2]]
    places = [(i, c) for i, r in enumerate(rows) for c in range(m) if r >> c & 1]
    table = spark.createDataFrame([*places, (0, 3), (0, 3), (None, 1)], "row long, col long")
    got = fields.gf2_rank(table, "row", "col").first()
    used = {c for _, c in places}
    rank = plain_rank(rows)
    assert (got["rank"], got["columns"], got["free"]) == (rank, len(used | {3}), len(used | {3}) - rank)
    vectors: dict = {}
    for r in fields.gf2_null_space(table, "row", "col").collect():
        vectors.setdefault(r["vector"], set()).add(r["col"])
    assert len(vectors) == got["free"]
    for own in vectors.values():
        mask = sum(1 << c for c in own)
        assert own and all(bin(mask & r).count("1") % 2 == 0 for r in rows)
    assert plain_rank([sum(1 << c for c in v) for v in vectors.values()]) == len(vectors)
    assert fields.gf2_rank(table.limit(0), "row", "col").first()["rank"] == 0


def test_words_are_corrected_up_to_half_the_checks(spark):
    rng = random.Random(4)
    m, checks, n = 4, 6, 15
    field = fields.Field(m)
    times = lambda a, b: field.powers[(field.logs[a] + field.logs[b]) % field.n] if a and b else 0
    g = fields.rs_generator(m, checks)
    assert len(g) == checks + 1 and g[-1] == 1
    sent, received = {}, []
    for w in range(60):
        message = [rng.randrange(16) for _ in range(n - checks)]
        word = [0] * n
        for i, a in enumerate(message):
            for j, b in enumerate(g):
                word[i + j] ^= times(a, b)
        sent[w] = word
        got = list(word)
        for p in rng.sample(range(n), w % 6):
            got[p] ^= rng.randrange(1, 16)
        received += [(w, p, x, "c") for p, x in enumerate(got) if x or p % 2]
    table = spark.createDataFrame(received, "word long, place long, symbol int, more string")
    out: dict = {}
    for r in fields.rs_corrected(table, "word", "place", "symbol", m, checks, n).collect():
        out.setdefault(r["word"], [[0] * n, r["corrected"]])[0][r["place"]] = r["symbol"]
    for w, word in sent.items():
        symbols, corrected = out.get(w, [[0] * n, None])
        if w % 6 <= 3:
            assert symbols == word and corrected is (None if w % 6 == 0 else True)
        elif corrected:  # more errors may look like another word
            assert sum(a != b for a, b in zip(symbols, word, strict=True)) >= checks + 1 - 3
    assert any(v[1] is False for v in out.values())
    bad = spark.createDataFrame([(1, 0, 16)], "word long, place long, symbol int")
    with pytest.raises(Exception, match="out of the field"):
        fields.rs_corrected(bad, "word", "place", "symbol", m, checks, n).collect()


def test_arithmetic_is_that_of_the_polynomials(spark):
    for m in (2, 3, 8):
        field = fields.Field(m)
        assert sorted(field.powers) == list(range(1, 1 << m))  # the polynomial is primitive

        def product(a, b, m=m):
            out = 0
            while b:
                if b & 1:
                    out ^= a
                a <<= 1
                if a >> m:
                    a ^= fields.PRIMITIVE[m]
                b >>= 1
            return out

        pairs = [(a, b) for a in range(min(1 << m, 40)) for b in range(min(1 << m, 12))]
        rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", field.times(F.col("a"), F.col("b")).alias("t"), field.over(F.col("a"), F.col("b")).alias("d")).collect()
        for r in rows:
            assert r["t"] == product(r["a"], r["b"])
            assert r["d"] is None if r["b"] == 0 else product(r["d"], r["b"]) == r["a"]
