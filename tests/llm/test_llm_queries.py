"""The registered queries of this subpackage on the driver's tables: against their SQL, or against brute force without one."""

from __future__ import annotations

import itertools
import re

import duckdb
import numpy as np
import pytest

from weftline.llm import queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "labels", "benchmark", "pages", "conversations")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize(("name", "sf"), [("op1_licenses", SMALL), ("op5_rules", MORE), ("op10_topk", SMALL), ("op11_suffix_dedup", SMALL), ("op13_clusters", SMALL)])
def test_query_equals_its_sql(spark, name, sf):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = duck(sf).execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert got == sorted(want, key=repr)


def test_near_duplicates_of_all_documents(spark):
    rows = duck(SMALL).execute("select doc_id, text from documents").fetchall()
    sets = {}
    for d, text in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[d] = set(itertools.pairwise(words)) if len(words) > 1 else {tuple(words)} if words else set()
    least = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {d: low if m == high else m for d, m in least.items()}
    got = queries.queries()["op6_near_dups"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, len(s), least[d], least[d] == d) for d, s in sets.items())


def test_quality_scores_of_all_documents(spark):
    got = queries.queries()["op3_quality"](spark, MORE).collect()
    labels = dict(duck(MORE).execute("select doc_id, quality from labels where quality is not null").fetchall())
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85  # the area under the curve


def test_whitening_of_all_vectors(spark):
    got = queries.queries()["op12_whitening"](spark, MORE).collect()
    rows = duck(MORE).execute("select vec_id, embedding from embeddings").fetchall()
    x = {v: tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in e) for v, e in rows}
    fit = np.array(sorted(set(x.values())), dtype=np.float64)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(v, sum((n * a - s) ** 2 for a, s in zip(t, sums, strict=True))) for v, t in x.items()}
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    share = {r["component"]: r["explained"] for r in got}
    np.testing.assert_allclose([share[k + 1] for k in range(16)], values[:16] / np.trace(cov), rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
