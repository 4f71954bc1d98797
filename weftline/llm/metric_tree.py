"""Exact top-k search by inner product with an M-tree (operator 10).

An extra component makes all stored vectors equally long, so that the largest inner product is the smallest Euclidean
distance. Vectors go to the tree of their nearest pivot (salted where a pivot has many); a tree is a set of pages:
routing nodes and leaves with a centre, a covering radius and the distance to their parent's centre. A tree's
queries walk its nodes together; each leaves out, by the triangle inequality, what the stored distances show to be too far
for it, and a leaf's vectors meet the queries that are left in one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import staged, table

#: Pivots (a bounded sample), about how many vectors a tree has, a node's children, a leaf's vectors, a block's queries.
PIVOTS, TREE, FANOUT, PAGE, QUERIES = 32, 4096, 12, 64, 8192
#: The queries that go through a tree together.
BLOCK = 1024
#: How many pivots' trees a query goes to before all others that its bound leaves.
CLOSE = 4
SCALE = 1024
#: Bounds are computed in doubles, whose errors grow with the vectors' lengths; what is this near to a bound is looked at.
SLACK = 4e-12
#: Scores below this in absolute value fit a long, whatever their sums pass through.
WIDE = 2.0**62
#: Sorts below -vec_id of every vec_id, so that a vector with the same score goes before it.
NONE = -(1 << 63)

NODE = "pivot int, salt int, node int, parent int, leaf boolean, centre binary, radius double, parent_dist double, ids binary, vectors binary, dists binary"


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and the components floor(scale * x) as int64 bytes; without vectors that are null or hold null or non-finite
    components. A component that a long can't hold raises."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, data = [], []
            for i, v in enumerate(batch.column(1)):
                x = np.array([np.nan if y is None else y for y in v.as_py()] if v.is_valid and v.values.null_count else v.values.to_numpy(zero_copy_only=False) if v.is_valid else [np.nan], dtype=np.float64)
                if np.isfinite(x).all():
                    if (np.abs(x) >= 2.0**63 / scale).any():
                        raise OverflowError(f"a component of vector {batch.column(0)[i]} is too large")
                    keep.append(i)
                    data.append(np.floor(x * scale).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(data, pa.binary())], names=["vec_id", "data"])

    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(work, "vec_id long, data binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as int64 rows; shorter ones are filled up with zeros."""
    return np.frombuffer(b"".join(x.ljust(8 * dims, b"\0") for x in column.to_pylist()), dtype="<i8").reshape(-1, dims)


def _lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))[:, None]])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def reach(base: float, score: float) -> float:
    """How far from the query a vector with at least this score can be. ``base`` is the sum of both squared lengths."""
    return np.sqrt(max(base - 2.0 * score, 0.0) + SLACK * base) + SLACK * np.sqrt(base)


def products(vectors: np.ndarray, query: np.ndarray, base: float) -> np.ndarray:
    """Exact inner products; as Python's integers where they may not fit a long."""
    return vectors @ query if base < WIDE else vectors.astype(object) @ query.astype(object)


def pages(points: np.ndarray, ids: np.ndarray, ints: np.ndarray, centre: np.ndarray) -> list[tuple]:
    """The nodes of one tree, bulk loaded: (node, parent, leaf, centre, radius, parent_dist, ids, vectors, dists)."""
    out: list[tuple] = []
    stack = [(np.arange(len(points)), centre, -1, 0.0)]
    while stack:
        own, middle, parent, to_parent = stack.pop()
        dist = _far(points[own], middle)
        node, leaf = len(out), len(own) <= PAGE
        if leaf:
            order = np.argsort(dist, kind="stable")
            own, dist = own[order], dist[order]
        out.append((node, parent, leaf, middle.tobytes(), float(dist.max(initial=0.0)), to_parent, ids[own].tobytes() if leaf else None, ints[own].tobytes() if leaf else None, dist.tobytes() if leaf else None))
        if leaf:
            continue
        seeds, near = [own[int(dist.argmax())]], None
        for _ in range(FANOUT):  # farthest first
            d = _far(points[own], points[seeds[-1]])
            if near is None:
                near, best = d, np.zeros(len(own), dtype=int)
            else:
                best = np.where(d < near, len(seeds) - 1, best)
                near = np.minimum(near, d)
            if len(seeds) == FANOUT or near.max() == 0:
                break
            seeds.append(own[int(near.argmax())])
        if len(seeds) == 1:  # equal vectors: in pages as they come
            groups = [(own[i : i + PAGE], points[seeds[0]]) for i in range(0, len(own), PAGE)]
        else:
            groups = [(own[best == j], points[s]) for j, s in enumerate(seeds)]
        stack += [(g, c, node, float(_far(c, middle))) for g, c in groups if len(g)]
    return out


class Tree:
    """The nodes of one tree: those of each depth with their parents, and the leaves' vectors."""

    def __init__(self, nodes: dict):
        self.nodes = nodes
        depth: dict[int, int] = {}
        for n in sorted(nodes):  # parents come before their children
            depth[n] = depth[nodes[n]["parent"]] + 1 if nodes[n]["parent"] >= 0 else 0
        self.levels = [[n for n in sorted(nodes) if depth[n] == k] for k in range(max(depth.values()) + 1)]

    def bounds(self, queries: np.ndarray, limits: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The leaves, and for each query and leaf the least distance of a vector there; infinite where a node above or the
        leaf itself is out of the query's limit. A child's centre is looked at only by queries that come to its parent and
        that the stored distance between both centres does not rule out."""
        out: list[np.ndarray] = []
        leaves: list[int] = []
        n = len(queries)
        apart = {-1: np.zeros(n)}
        alive = {-1: np.arange(n)}
        for level in self.levels:
            below, far = {}, {}
            for node in level:
                x = self.nodes[node]
                own = alive[x["parent"]]
                if x["parent"] >= 0:
                    own = own[np.abs(apart[x["parent"]][own] - x["parent_dist"]) - x["radius"] <= limits[own]]
                d = np.full(n, np.inf)
                if len(own):
                    d[own] = _far(queries[own], x["centre"])
                    own = own[d[own] - x["radius"] <= limits[own]]
                if x["leaf"]:
                    least = np.full(n, np.inf)
                    least[own] = d[own] - x["radius"]
                    leaves.append(node)
                    out.append(least)
                else:
                    below[node], far[node] = own, d
            alive, apart = below, far
        return leaves, np.array(out).reshape(len(leaves), n)


#: Sums of products below this are exact in doubles, in any order.
EXACT = 2.0**52


def walk(tree: Tree, queries: np.ndarray, own: list[int], k: int, norm2: float, known: list[int | None]) -> list[list[tuple[int, int]]]:
    """The best k (score, -vec_id) of the tree's vectors for each query, best first; NONE stands for vectors found before.

    ``known`` has the k-th score that a query has from other trees, if it has k. All queries of a block go through the
    tree together: each first to the leaf that is nearest, then, leaf by leaf in ascending order of the least bound, those
    whose own limit does not rule the leaf out, in one product of matrices.
    """
    points = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
    bases = (points * points).sum(axis=1) + norm2
    found: list[list[tuple[int, int]]] = [[(s, NONE)] * k if s is not None else [] for s in known]
    reached = lambda i: reach(bases[i], found[i][-1][0]) if len(found[i]) >= k else np.inf
    limits = np.array([reached(i) for i in range(len(queries))])
    leaves, least = tree.bounds(points, limits)
    if not leaves:
        return found
    exact = bool((bases < EXACT).all())
    floats = queries.astype(np.float64) if exact else queries

    def visit(leaf: int, who: np.ndarray) -> None:
        x = tree.nodes[leaf]
        if exact:
            scores = floats[who] @ x["floats"].T
        else:
            scores = np.array([products(x["vectors"], queries[i], bases[i]) for i in who], dtype=object).reshape(len(who), len(x["ids"]))
        for row, i in zip(scores, who.tolist(), strict=True):
            good = x["ids"] != own[i]
            if len(found[i]) >= k:
                good &= row >= found[i][-1][0]
            some = np.flatnonzero(good)
            if len(some) > k:  # with all that equal the k-th
                some = some[row[some] >= np.sort(row[some])[-k]]
            new = [(int(row[j]), -int(x["ids"][j])) for j in some.tolist()]
            if new:
                found[i] = sorted([*found[i], *new], reverse=True)[:k]
                limits[i] = reached(i)

    first = least.argmin(axis=0)
    open_ = np.isfinite(least[first, np.arange(len(queries))])
    for j in np.unique(first[open_]).tolist():
        visit(leaves[j], np.flatnonzero(open_ & (first == j)))
    for j in np.argsort(least.min(axis=1), kind="stable").tolist():
        if len(who := np.flatnonzero((least[j] <= limits) & np.isfinite(least[j]) & (first != j))):
            visit(leaves[j], who)
    return found


def dealt(index: DataFrame, routed: DataFrame, size: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Both with ``block``: a tree's queries in blocks of about ``size``, and its pages as often as it has blocks.

    Pages of a tree that no query is routed to are left out.
    """
    wanted = routed.groupBy("pivot", "salt").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    asked = routed.join(wanted, ["pivot", "salt"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    paged = index.join(wanted, ["pivot", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return paged, asked


def _searched(index: DataFrame, routed: DataFrame, k: int, dims: int, norm2: float) -> DataFrame:
    """query_id, vec_id, score: the best of each tree for the queries routed to it (pivot, salt)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            nodes: dict = {}
            for r in left.to_pylist():
                r["centre"] = np.frombuffer(r["centre"])
                if r["leaf"]:
                    r |= {"ids": np.frombuffer(r["ids"], dtype="<i8"), "vectors": np.frombuffer(r["vectors"], dtype="<i8").reshape(-1, dims)}
                    r["floats"] = r["vectors"].astype(np.float64)
                nodes[r["node"]] = r
            tree = Tree(nodes)
            names = right["query_id"].to_pylist()
            for at in range(0, len(names), BLOCK):
                part = right.slice(at, BLOCK)
                own = names[at : at + BLOCK]
                for query, best in zip(own, walk(tree, _matrix(part["data"], dims), own, k, norm2, part["least"].to_pylist()), strict=True):
                    for score, minus in best:
                        if minus != NONE:
                            if not -(1 << 63) <= score < 1 << 63:
                                raise OverflowError(f"the score of vectors {query} and {-minus} does not fit a long")
                            rows.append((query, -minus, score))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    keys = ["pivot", "salt", "block"]
    paged, asked = dealt(index, routed)
    return paged.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")


def build(vectors: DataFrame, pivots: np.ndarray, dims: int, norm2: float, tree: int = TREE) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """The written pages of all trees, the number of salted trees of each pivot, and the covering radius of each pivot."""
    lifted = _lifted(pivots, norm2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _lifted(_matrix(batch.column(1), dims), norm2)
                best = (-2 * x @ lifted.T + (lifted * lifted).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32))], names=["vec_id", "data", "pivot"])

    assigned = staged(vectors.mapInArrow(assign, "vec_id long, data binary, pivot int"), "assigned")
    salts = {r["pivot"]: -(-r["n"] // tree) for r in assigned.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    many = F.coalesce(*(F.when(F.col("pivot") == p, F.lit(n)) for p, n in sorted(salts.items())), F.lit(1))

    def grow(group: pa.Table) -> pa.Table:
        pivot, salt = group["pivot"][0].as_py(), group["salt"][0].as_py()
        ints = _matrix(group["data"], dims)
        nodes = pages(_lifted(ints, norm2), group["vec_id"].to_numpy(), ints, lifted[pivot])
        cols = list(zip(*nodes, strict=True))
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["node", "parent", "leaf", "centre", "radius", "parent_dist", "ids", "vectors", "dists"]
        return pa.table({"pivot": pa.array([pivot] * len(nodes), pa.int32()), "salt": pa.array([salt] * len(nodes), pa.int32())} | {n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    salted = assigned.withColumn("salt", F.pmod(F.xxhash64("vec_id", "data"), many).cast("int"))
    index = staged(salted.groupBy("pivot", "salt").applyInArrow(grow, NODE), "pages")
    radii = {r["pivot"]: r["r"] for r in index.where("node = 0").groupBy("pivot").agg(F.max("radius").alias("r")).collect()}
    return index, salts, radii


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query's vector with the vectors of ``rows``.

    Ties go to the smaller id; rows with a query's own id are no candidates for it; a query with fewer candidates gets all.
    Rows that repeat are candidates as often; queries that repeat an id count once. Null ids and vectors that
    ``quantized`` leaves out take no part; shorter vectors are filled up with zeros; empty tables give no rows; other
    columns are not read. A score among the k largest that does not fit a long raises.
    """
    spark = rows.sparkSession
    vectors = staged(quantized(rows, id_col, vector_col), "vectors")
    asked = quantized(queries, id_col, vector_col).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("data").alias("data"))
    asked = staged(asked, "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if vectors.isEmpty() or asked.isEmpty():
        return empty
    dims = max(df.agg(F.max(F.length("data")).alias("n")).first()["n"] for df in (vectors, asked)) // 8

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((_matrix(batch.column(0), dims).astype(np.float64) ** 2).sum(axis=1).max())])], names=["n"])

    norm2 = vectors.select("data").mapInArrow(norms, "n double").agg(F.max("n").alias("n")).first()["n"]
    drawn = vectors.select("data").orderBy(F.xxhash64("vec_id"), "data").limit(PIVOTS).collect()
    pivots = np.unique(np.array([np.frombuffer(bytes(r["data"]).ljust(8 * dims, b"\0"), dtype="<i8") for r in drawn]), axis=0)
    index, salts, radii = build(vectors, pivots, dims, norm2, tree)
    centres = {p: _lifted(pivots[p : p + 1], norm2)[0] for p in salts}

    def route(turn: int):  # noqa: ANN202
        """The trees of each query: one of its nearest pivot, then those of the CLOSE nearest, then all others; in each turn
        without those that its k-th score so far rules out."""
        names = sorted(salts)
        middle = np.array([centres[p] for p in names])
        wide = np.array([radii[p] for p in names])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for r in batch.to_pylist():
                    q = np.append(np.frombuffer(r["data"].ljust(8 * dims, b"\0"), dtype="<i8").astype(np.float64), 0.0)
                    d = _far(middle, q)
                    near = np.argsort(d, kind="stable")
                    limit = np.inf if r["least"] is None else reach(float(q @ q) + norm2, r["least"])
                    part = near[:1] if turn == 0 else near[:CLOSE] if turn == 1 else near[CLOSE:]
                    trees = [(int(j), s) for j in part if turn == 0 or d[j] - wide[j] <= limit for s in range(1 if turn == 0 else salts[names[j]])]
                    out += [(r["query_id"], r["data"], r["least"], names[j], s) for j, s in trees if turn != 1 or (j, s) != (near[0], 0)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "data", "least", "pivot", "salt"])

        return work

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for turn in range(3):
        least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        routed = asked.join(least, "query_id", "left").mapInArrow(route(turn), "query_id long, data binary, least long, pivot int, salt int")
        found = best.union(_searched(index, routed, k, dims, norm2))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = staged(best.select("query_id", "vec_id", "score"), "best") if turn < 2 else best
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
