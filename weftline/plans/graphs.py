"""Queries on the labelled lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.common import LATTICE_SQL, STATES, WIDTH, labelled_lattice
from weftline.sources.generated import triangular


def _energy(spark, sf):  # noqa: ANN001, ANN202
    return graph.potts_energy(*labelled_lattice(spark, sf))


def _sweep_sql() -> str:
    out, labels = [], "v"
    for colour in (0, 1):
        out.append(f"""
f{colour} AS (SELECT n.site, label, sum(w) AS field FROM n JOIN {labels} l ON l.site = other GROUP BY ALL),
b{colour} AS (SELECT site, label AS top, field AS best FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY field DESC, label) AS k FROM f{colour}) WHERE k = 1),
s{colour} AS (SELECT l.site, CASE WHEN (l.site // {WIDTH} + l.site % {WIDTH}) % 2 = {colour} AND best > coalesce(field, 0) THEN top ELSE l.label END AS label
  FROM {labels} l LEFT JOIN b{colour} b ON b.site = l.site LEFT JOIN f{colour} f ON f.site = l.site AND f.label = l.label)""")
        labels = f"s{colour}"
    return ",".join(out)


def _components(spark, sf):  # noqa: ANN001, ANN202
    edges, labels = labelled_lattice(spark, sf)
    bonds = graph.with_labels(edges, labels).where("li = lj").select("i", "j", "w")
    return graph.bond_components(bonds)


W = f"WITH RECURSIVE {LATTICE_SQL}"
QUERIES = {
    "potts_energy": (_energy, f"{W} SELECT count(*) AS n_edges, count(*) FILTER (li = lj) AS n_equal, CAST(coalesce(sum(CASE WHEN li = lj THEN -w ELSE 0 END), 0) AS DOUBLE) AS energy FROM x"),
    "cut_value": (lambda s, d: graph.cut_value(*labelled_lattice(s, d)), f"{W} SELECT CAST(sum(CASE WHEN li <> lj THEN w ELSE 0 END) AS DOUBLE) AS cut FROM x"),
    "local_fields": (lambda s, d: graph.local_fields(*labelled_lattice(s, d)), f"{W} SELECT n.site, label, sum(w) AS field FROM n JOIN v ON v.site = other GROUP BY ALL"),
    "merge_deltas": (lambda s, d: graph.merge_deltas(*labelled_lattice(s, d)), f"{W} SELECT least(li, lj) AS a, greatest(li, lj) AS b, -sum(w) AS delta FROM x WHERE li <> lj GROUP BY ALL"),
    "icm_sweep": (lambda s, d: graph.icm_sweep(*labelled_lattice(s, d), WIDTH), f"{W}, {_sweep_sql()} SELECT site, label FROM s1"),
    "degree_csr": (lambda s, d: graph.degrees(labelled_lattice(s, d)[0]), f"{W} SELECT site, count(*) AS degree, CAST(sum(count(*)) OVER (ORDER BY site) - count(*) AS BIGINT) AS start FROM n GROUP BY site"),
    "lattice_edges": (lambda s, d: labelled_lattice(s, d)[0].select("eid", "i", "j"), f"{W} SELECT eid, i, j FROM e"),
    "triangular_edges": (lambda s, d: triangular(labelled_lattice(s, d)[1].select("site"), WIDTH), f"{W} SELECT i, j FROM e UNION ALL SELECT site, site + {WIDTH + 1} FROM v WHERE site % {WIDTH} < {WIDTH - 1} AND site + {WIDTH + 1} IN (SELECT site FROM v)"),
    "connected_components": (
        _components,
        f"{W}, r AS (SELECT site, site AS root FROM (SELECT i AS site FROM x WHERE li = lj UNION SELECT j FROM x WHERE li = lj) UNION SELECT y.b, r.root FROM r JOIN (SELECT i AS a, j AS b FROM x WHERE li = lj UNION SELECT j, i FROM x WHERE li = lj) y ON y.a = r.site) SELECT site, min(root) AS root FROM r GROUP BY site",
    ),
    "label_histogram": (lambda s, d: labelled_lattice(s, d)[1].groupBy("label").agg(F.count("*").alias("n")), f"{W} SELECT label, count(*) AS n FROM v GROUP BY label"),
}
assert STATES > 1
