"""Centroid clustering with Elkan's bounds (operator 13).

Each vector carries its centroid, an upper bound of its distance to it and a lower bound of its distance to every
centroid. After the centroids move, the bounds are widened by how far; a distance is computed only where the bounds and
the distances between centroids leave open whether another centroid is nearer or as near. Bounds are rounded away from
the truth and compared strictly, so that ties are always decided by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import staged, table
from weftline.llm.vectors import lists, matrix, quantized, usable

CENTROIDS, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
STATE = "id long, x array<long>, cluster int, upper double, lower array<double>, computed int"
#: Squared distances up to this are exact in int64, whatever their sums pass through.
WIDE = 2.0**62


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python's integers where an int64 may not hold them."""
    top = 0.0 if not x.size else float(np.abs(x.astype(np.float64)).max()) + float(np.abs(c.astype(np.float64)).max())
    if top * top * x.shape[-1] < WIDE:
        d = x - c
        return (d * d).sum(axis=-1)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=-1)


def above(square: np.ndarray) -> np.ndarray:
    """An upper bound of the square root."""
    return np.nextafter(np.nextafter(np.sqrt(square.astype(np.float64)), np.inf), np.inf)


def below(square: np.ndarray) -> np.ndarray:
    """A lower bound of the square root."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(square.astype(np.float64)), -np.inf), -np.inf), 0.0)


def between(centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of half the distances between centroids."""
    k = len(centroids)
    return below(np.array([squared(centroids, centroids[j][None, :]) for j in range(k)]).reshape(k, k)) / 2


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds of how far each centroid has moved."""
    return above(squared(old, new))


def first_bounds(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower of vectors that have no bounds yet: every distance is computed."""
    far = np.stack([squared(x, c[None, :]) for c in centroids], axis=1)
    cluster = far.argmin(axis=1)  # the first of equal ones
    return cluster, above(far[np.arange(len(x)), cluster]), below(far)


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper, lower and the number of computed distances of each vector after the centroids moved by ``shift``.

    A centroid is left out only where a bound shows that it is farther than the vector's own: the upper bound lies below
    its lower bound, or below half the distance between the two centroids.
    """
    half, rows = between(centroids), np.arange(len(x))
    cluster = cluster.copy()
    upper = np.nextafter(upper + shift[cluster], np.inf)
    lower = np.maximum(np.nextafter(lower - shift[None, :], -np.inf), 0.0)
    computed = np.zeros(len(x), dtype=np.int32)
    exact = np.full(len(x), -1, dtype=object if len(x) and squared(x[:1], centroids[:1]).dtype == object else np.int64)
    known = np.zeros(len(x), dtype=bool)
    for j in range(len(centroids)):
        open_ = (cluster != j) & (upper >= lower[:, j]) & (upper >= half[cluster, j])
        at = rows[open_ & ~known]
        if len(at):  # the distance to the own centroid makes the upper bound tight
            exact[at] = squared(x[at], centroids[cluster[at]])
            upper[at] = above(exact[at])
            lower[at, cluster[at]] = below(exact[at])
            known[at] = True
            computed[at] += 1
        at = rows[open_ & (upper >= lower[:, j]) & (upper >= half[cluster, j])]
        if len(at):
            d = squared(x[at], centroids[j][None, :])
            lower[at, j] = below(d)
            computed[at] += 1
            won = (d < exact[at]) | ((d == exact[at]) & (j < cluster[at]))
            to = at[won]
            cluster[to], exact[to], upper[to] = j, d[won], above(d[won])
    return cluster, upper, lower, computed


def _assigned(state: DataFrame, centroids: np.ndarray, shift: np.ndarray | None) -> DataFrame:
    """The state after one assignment; without bounds (``shift`` None) ``state`` needs id and x alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), centroids.shape[1])
            if shift is None:
                cluster, upper, lower = first_bounds(x, centroids)
                computed = np.full(len(x), len(centroids))
            else:
                held = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(centroids))
                cluster, upper, lower, computed = reassigned(x, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), held, centroids, shift)
            columns = [batch.column("id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), lists(lower, pa.float64()), pa.array(computed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "upper", "lower", "computed"])

    return state.mapInArrow(work, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids, each replaced by the floor of its vectors' mean where it has any: one row a centroid is gathered."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])))
    new = centroids.copy()
    for r in sums.collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return new


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """The last state of ``vectors`` (id, x: ``dims`` longs) as STATE, and the ``k`` centroids.

    They start as the vectors of the k smallest sha256 of ``1:<id>`` (rows that share an id by their components), move for
    ``rounds`` rounds, and the vectors are assigned once more. ``computed`` counts the distances that the last assignment
    took. With fewer than k vectors there are as many centroids; without vectors none. Sums and distances that a long
    can't hold raise.
    """
    spark = vectors.sparkSession
    vectors = staged(vectors.select("id", "x"), "clustered")
    first = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), dims)
    if not first:
        return spark.createDataFrame([], STATE), centroids
    state = staged(_assigned(vectors, centroids, None), "clusters")
    for _ in range(rounds):
        new = _means(state, centroids)
        shift, centroids = moved(centroids, new), new
        state = staged(_assigned(state, centroids, shift), "clusters")
    return state, centroids


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared, exact), cluster_inertia, inertia and centroid_sha256 of each vector.

    Vectors are quantised to floor(scale * c). Vectors that are null, hold null, NaN or infinite components or have not
    exactly ``dims`` components take no part and give no row, nor do rows without an id. Repeated rows each get the same
    result, ties go to the smaller number, an empty table gives no rows, and other columns are not read.
    """
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    clean = clean.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == dims))
    state, centroids = fit(clean.select("id", quantized(F.col("v"), scale).alias("x")), k, rounds, dims)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cluster").to_numpy()
            d = squared(matrix(batch.column("x"), dims), centroids[own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d.tolist(), pa.int64()), pa.array([names[c] for c in own], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    out = state.mapInArrow(work, "vec_id long, cluster int, distance long, centroid_sha256 string")
    # one row a centroid
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    held = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}
    of = F.array(*(F.lit(held.get(c)).cast("long") for c in range(max(len(centroids), 1))))
    return out.select("vec_id", "cluster", "distance", F.get(of, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(held.values())).cast("long").alias("inertia"), "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle_sql() -> str:
    def assign(t: int) -> str:
        d = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        return f"a{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := {d}, c := c.c)) AS b FROM v CROSS JOIN c{t} c GROUP BY r)"

    def move(t: int) -> str:
        return f"""s{t} AS (SELECT b.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY 1, 2),
m{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (c))"""

    steps = ",\n".join(f"{assign(t)},\n{move(t)}" for t in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = {DIMS}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM v QUALIFY c < {CENTROIDS}),
{steps},
{assign(ROUNDS)},
o AS (SELECT vec_id, b.c AS c, b.d AS d FROM a{ROUNDS} JOIN v USING (r))
SELECT vec_id, CAST(o.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM o JOIN c{ROUNDS} k ON k.c = o.c
"""


ORACLE_SQL = _oracle_sql()
