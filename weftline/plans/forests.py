"""Bounds on the log partitions of the lattice's bonds between equal labels, with a field from the customers' keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import forests, graph
from weftline.plans.common import LATTICE_SQL, STATES, labelled_lattice

#: Forests and sweeps of the queries; the SQL writes each out. The lattice's bonds need no more forests.
FORESTS, SWEEPS = 4, 2
#: The order of edges of one count in forest k.
_PRIME = 1000003


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges, labels = labelled_lattice(spark, sf)
    bonds = graph.with_labels(edges, labels.hint("merge")).where("li = lj").select("i", "j", "w")
    return bonds, labels.select("site", F.array(*(F.pmod(F.col("site") * (s + 1), F.lit(5)) * 0.2 for s in range(STATES))).alias("h"))


def _priority(k: int):  # noqa: ANN202
    return F.pmod((2 * F.col("i") + (F.col("j") - F.col("i") > 1).cast("long")) * (7919 + 104 * k), F.lit(_PRIME))


def _spanning(spark: SparkSession, sf: str) -> DataFrame:
    return forests.spanning_tree_bound(*_graph(spark, sf), STATES, FORESTS, _priority).withColumn("bound", F.round("bound", 6))


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = forests.log_partition_bounds(*_graph(spark, sf), STATES, SWEEPS)
    return out.select("component", "sites", *(F.round(x, 6).alias(x) for x in ("decoupled", "mean_field", "saturated")))


_S = range(STATES)
_H = ", ".join(f"((site * {s + 1}) % 5) * 0.2::DOUBLE AS h{s}" for s in _S)
_BASE = f"""{LATTICE_SQL}, b AS (SELECT i, j, w FROM x WHERE li = lj), y AS (SELECT i AS a, j AS b, w FROM b UNION ALL SELECT j, i, w FROM b),
rr AS (SELECT site, site AS root FROM v UNION SELECT y.b, rr.root FROM rr JOIN y ON y.a = rr.site), root AS (SELECT site, min(root) AS root FROM rr GROUP BY site),
h AS (SELECT site, root, {_H} FROM v JOIN root USING (site))"""


def _forests_sql() -> str:
    out = ["k0 AS (SELECT i, j, 0::BIGINT AS times FROM b)"]
    for k in range(FORESTS):
        out.append(f"""q{k} AS (SELECT i, j, [times, ((2 * i + CAST(j - i > 1 AS BIGINT)) * {7919 + 104 * k}) % {_PRIME}, i, j] AS key FROM k{k}),
a{k} AS (SELECT i AS a, j AS b, key FROM q{k} UNION ALL SELECT j, i, key FROM q{k}),
g{k} AS (SELECT i, j, key, i AS site FROM q{k} UNION SELECT g.i, g.j, g.key, a.b FROM g{k} g JOIN a{k} a ON a.a = g.site AND a.key < g.key),
f{k} AS (SELECT i, j FROM q{k} EXCEPT SELECT i, j FROM g{k} WHERE site = j),
k{k + 1} AS (SELECT k.i, k.j, times + CAST(f.i IS NOT NULL AS BIGINT) AS times FROM k{k} k LEFT JOIN f{k} f ON f.i = k.i AND f.j = k.j)""")
    every = " UNION ALL ".join(f"SELECT {k} AS tree, i, j FROM f{k}" for k in range(FORESTS))
    out.append(f"t AS (SELECT tree, i, j, w * {FORESTS} / times AS w FROM ({every}) JOIN k{FORESTS} USING (i, j) JOIN b USING (i, j))")
    return ", ".join(out)


def _lse(xs: list[str]) -> str:
    return f"ln({' + '.join(f'exp({x})' for x in xs)})"


def _spanning_sql() -> str:
    message = ", ".join(f"sum({_lse([f't{r}' + (' + w' if r == s else '') for r in _S])}) AS m{s}" for s in _S)
    up = ", ".join(f"h{s} + coalesce(m{s}, 0) AS t{s}" for s in _S)
    return f"""WITH RECURSIVE {_BASE}, {_forests_sql()}, tt AS (SELECT tree, i AS a, j AS b, w FROM t UNION ALL SELECT tree, j, i, w FROM t),
d AS (SELECT tree, root AS top, site, NULL::BIGINT AS parent, 0 AS depth, 0::DOUBLE AS w FROM root CROSS JOIN (SELECT unnest(range(0, {FORESTS})) AS tree) WHERE site = root
 UNION ALL SELECT d.tree, d.top, tt.b, d.site, d.depth + 1, tt.w FROM d JOIN tt ON tt.tree = d.tree AND tt.a = d.site AND tt.b IS DISTINCT FROM d.parent),
dh AS (SELECT d.*, {", ".join(f"h{s}" for s in _S)} FROM d JOIN h USING (site)),
up AS (SELECT tree, top, site, parent, depth, w, {", ".join(f"h{s} AS t{s}" for s in _S)} FROM dh WHERE depth = (SELECT max(depth) FROM d)
 UNION ALL SELECT n.tree, n.top, n.site, n.parent, n.depth, n.w, {up} FROM dh n JOIN (SELECT max(depth) AS now FROM up) z ON n.depth = z.now - 1
  LEFT JOIN (SELECT tree, parent, {message} FROM up GROUP BY tree, parent) c ON c.tree = n.tree AND c.parent = n.site)
SELECT top AS component, sites, round(avg({_lse([f"t{s}" for s in _S])}), 6) AS bound FROM up JOIN (SELECT root AS top, count(*) AS sites FROM root GROUP BY root) USING (top) WHERE depth = 0 GROUP BY top, sites"""


def _bounds_sql() -> str:
    e = [f"exp(h{s})" for s in _S]
    p = [f"p0 AS (SELECT *, {', '.join(f'{x} / ({" + ".join(e)}) AS p{s}' for s, x in enumerate(e))} FROM h)"]
    for k in range(SWEEPS):
        pull = ", ".join(f"sum(y.w * o.p{s}) AS m{s}" for s in _S)
        x = [f"exp(h{s} + coalesce(m{s}, 0))" for s in _S]
        p.append(f"""p{k + 1} AS (SELECT p.site, root, {", ".join(f"h{s}" for s in _S)}, {", ".join(f"0.5::DOUBLE * p{s} + 0.5::DOUBLE * {x[s]} / ({' + '.join(x)}) AS p{s}" for s in _S)}
 FROM p{k} p LEFT JOIN (SELECT y.a AS site, {pull} FROM y JOIN p{k} o ON o.site = y.b GROUP BY y.a) m ON m.site = p.site)""")
    own = " + ".join(f"p{s} * (h{s} - ln(p{s}))" for s in _S)
    met = " + ".join(f"a.p{s} * c.p{s}" for s in _S)
    return f"""WITH RECURSIVE {_BASE}, {", ".join(p)},
s AS (SELECT root, count(*) AS sites, sum({_lse([f"h{s}" for s in _S])}) AS free, sum({own}) AS own, sum(greatest({", ".join(f"h{s}" for s in _S)})) AS top FROM p{SWEEPS} GROUP BY root),
z AS (SELECT root, sum(w * ({met})) AS met, sum(w) AS most FROM b JOIN p{SWEEPS} a ON a.site = i JOIN (SELECT site, {", ".join(f"p{s}" for s in _S)} FROM p{SWEEPS}) c ON c.site = j GROUP BY root)
SELECT root AS component, sites, round(free, 6) AS decoupled, round(own + coalesce(met, 0), 6) AS mean_field, round(sites * {math.log(STATES)!r}::DOUBLE + top + coalesce(most, 0), 6) AS saturated FROM s LEFT JOIN z USING (root)"""


QUERIES = {"spanning_tree_bound": (_spanning, _spanning_sql()), "log_partition_bounds": (_bounds, _bounds_sql())}
