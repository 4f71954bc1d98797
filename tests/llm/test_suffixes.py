"""Removal of repeated passages against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from weftline.llm import suffixes

SCHEMA = "doc_id long, text string, kept string, c1 long"


def brute(texts: list[str | None], length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(int)))
        out.append((list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(b for b, g in zip(d, gone, strict=False) if not g)))
    return out


def corpus(length: int, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    letters = lambda n, of="abcdefgh ": "".join(draw.choice(list(of), n))
    passage, other = letters(3 * length), letters(length + 3)
    texts = [None, "", "short", letters(4 * length), "é" * length, "ab" * length, "a" * (length - 1), "z" * length, "z" * length]
    for _ in range(25):  # parts of a passage in other surroundings, at every cut
        a, b = sorted(draw.integers(0, len(passage), 2))
        texts.append(letters(draw.integers(0, 2 * length)) + passage[a:b] + letters(draw.integers(0, length)) + other[draw.integers(0, 4) :] + letters(draw.integers(0, 9)))
    near = list(passage + letters(length))
    for _ in range(12):  # near copies
        one = list(near)
        for k in draw.integers(0, len(one), 3):
            one[k] = "X"
        texts.append("".join(one))
    texts += [texts[12], texts[12] + texts[12], passage + "tail", "head" + passage, letters(3) * length]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, texts[10], None, None), (5, "twice the id " * length, "x", None)]


@pytest.mark.parametrize(("length", "seed", "wide"), [(20, 1, 65_536), (20, 2, 1), (64, 3, 65_536), (64, 4, 2), (200, 5, 65_536), (33, 6, 65_536)])
def test_spans_against_all_strings(spark, length, seed, wide):
    rows = corpus(length, seed)
    got = suffixes.without_repeats(spark.createDataFrame(rows, SCHEMA), length, bucket=20, wide=wide)
    assert got.columns == ["doc_id", "text", "kept", "c1", "removed", "kept_"]
    key = lambda r: repr((r[0], r[1]))
    got = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["removed"]], bytes(r["kept_"])) for r in got.collect()), key=key)
    want = sorted(((r[0], r[1], *b) for r, b in zip(rows, brute([r[1] for r in rows], length), strict=True)), key=key)
    assert got == want


def test_no_rows(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_sort_orders_and_compares():
    draw = np.random.default_rng(2)
    rows = [bytes(draw.integers(0, 2, 24, dtype=np.uint8)) for _ in range(60)] * 2 + [b"\0" * 24]
    order, same = suffixes.multikey_sort(suffixes._words(rows, 24))
    ordered = [rows[k] for k in order]
    assert ordered == sorted(rows)
    for a, b, n in zip(ordered, ordered[1:], same[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])


def test_every_string_has_its_anchor_at_the_same_place():
    draw = np.random.default_rng(4)
    text = bytes(draw.integers(97, 100, 900, dtype=np.uint8))
    found = suffixes.anchors([text, b"xx" + text[100:700], b""], 50)
    offset = {}
    for p, a, b in zip(found.at.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
        for s in range(a, b + 1):
            assert 0 <= p - s < suffixes.window_of(50)
            assert offset.setdefault(found.data[s : s + 50], p - s) == p - s
    assert sum(b - a + 1 for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True)) == 851 + 553
