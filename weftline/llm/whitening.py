"""Whitening of vectors (operator 12): all sums of products of dimensions in one aggregation of generated columns.

The distinct vectors are centred at the whole numbers next to their means before they are multiplied, so that the
products are small and exact; what is left of the means is taken off with exact fractions when the covariance is put
together. LAPACK decomposes it, and each row is projected in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import free_name, staged, table
from weftline.llm.vectors import lists, matrix, quantized, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Eigenvalues below this share of their sum are noise: there is nothing to whiten along such a component.
LEAST = 1e-13
#: Sums of squares below this are exact in int64.
WIDE = 2.0**62


class Whitening(NamedTuple):
    """``n`` fitted vectors with ``sums`` a dimension, eigenvalues and unit eigenvectors (rows) by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """The vectors less their mean along each component, over its deviation."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole).astype(np.float64) - rest) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum) ** 2, exact."""
        d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        top = float(np.abs(d.astype(np.float64)).max()) if d.size else 0.0
        if top * top * x.shape[1] < WIDE:
            d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()


def products(vectors: DataFrame, centre: list[int]) -> list[list[float]]:
    """The sums of (x_i - centre_i) (x_j - centre_j) for all i <= j, as one aggregation of generated SQL; one row comes back."""
    dims = len(centre)
    centred = vectors.selectExpr(*(f"cast(x[{i}] - {c}L as double) as d{i}" for i, c in enumerate(centre)))
    row = centred.selectExpr(*(f"sum(d{i} * d{j}) as p{i}_{j}" for i in range(dims) for j in range(i, dims))).first()
    return [[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(dims)] for i in range(dims)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (x: lists of longs, all as long); None without any.

    There are as many components as asked for, or as the vectors span. The driver sees one row of sums and one of products.
    """
    distinct = staged(vectors.select("x").distinct(), "distinct-vectors")
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    row = distinct.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims))).first()
    n, sums = row["n"], [int(row[f"s{i}"]) for i in range(dims)]
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    p = products(distinct, centre)
    # whole doubles turn into fractions without loss, so that taking off the rest of the means loses nothing
    v = np.array([[float((Fraction(p[i][j]) - Fraction(rest[i] * rest[j], n)) / n) for j in range(dims)] for i in range(dims)])
    values, vectors_ = np.linalg.eigh(v)
    trace = float(np.trace(v))
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > LEAST * trace][:components]
    return Whitening(n, sums, trace, values[order], vectors_[:, order].T.copy())


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened distinct vectors minus the identity, as measured.

    Each task adds up its batches; a row a task and pair of components is summed by Spark.
    """
    k = len(model.values)
    if not k:
        return 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                z = model.project(matrix(batch.column("x"), len(model.sums)))
                own += z.T @ z
                first += z.sum(axis=0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.hstack([own, first[:, None]]).reshape(-1))], names=["i", "j", "s"])

    sums = np.zeros((k, k + 1))
    for r in vectors.select("x").distinct().mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = r["s"]
    mean = sums[:, k] / model.n
    return float(np.abs(sums[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def integers(rows: DataFrame, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``rows``, which have no column x, with the quantised vector as x; without vectors that can't take part."""
    clean = rows.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).withColumn("x", quantized(F.col(vector_col), scale, shift))
    common = clean.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return clean.where(F.size("x") == common["size"]) if common else clean


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``rows`` with n, deviation, whitened and explained (lists, one entry a component) and identity_error.

    Each component c of a vector counts as floor(scale * c) + shift. Rows whose vector is null, empty or holds null, NaN or
    infinite components take no part and go; so do, where vectors differ in length, those that have not the commonest
    length (the longer of two as common). Repeated vectors are fitted once and each row gets its result. Vectors that are
    all equal span nothing and get empty lists; an empty table gives no rows. Numbers that a long can't hold raise. Where
    ``rows`` has columns of the new names, the new ones' get an underscore more.
    """
    columns = rows.columns
    names = [free_name(x, columns) for x in ("n", "deviation", "whitened", "explained", "identity_error")]
    vectors = staged(integers(rows.toDF(*(f"c{k}" for k in range(len(columns)))), f"c{columns.index(vector_col)}", scale, shift), "whitened-vectors")
    doubles = T.ArrayType(T.DoubleType())
    kinds = [("n", T.LongType()), ("deviation", T.LongType()), ("whitened", doubles), ("explained", doubles), ("identity_error", T.DoubleType())]
    model = fit(vectors, components)
    if model is None:
        return rows.limit(0).select("*", *(F.lit(None).cast(t).alias(name) for name, (_, t) in zip(names, kinds, strict=True)))
    error, shares = identity_error(vectors, model), model.values / model.trace if model.trace else model.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = matrix(batch.column("x"), len(model.sums)), batch.num_rows
            kept = [batch.column(k) for k in range(len(columns))]
            new = [pa.array([model.n] * m, pa.int64()), pa.array(model.deviation(x), pa.int64()), lists(model.project(x), pa.float64()), lists(np.tile(shares, (m, 1)), pa.float64()), pa.array([error] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(kept + new, names=[f"c{k}" for k in range(len(columns))] + [k for k, _ in kinds])

    schema = T.StructType([*vectors.drop("x").schema, *(T.StructField(name, kind) for name, kind in kinds)])
    return vectors.mapInArrow(work, schema).toDF(*columns, *names)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of ``whiten`` as rows, numbered from 1."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "e"))
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")
