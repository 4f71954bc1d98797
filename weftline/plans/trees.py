"""Queries on alignments whose sites are the lines of orders, and on trees of the tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from weftline.functions.columns import jc_other, jc_same
from weftline.operators import tree
from weftline.plans.common import table

K = 4
BRANCHES = "abcd"


#: Eight taxa whose states are those of a line's part, changed in some orders.
TAXA = "abcdefgh"
STATES = {x: f"(l_partkey + CASE WHEN l_orderkey % {3 + i} = 0 THEN l_suppkey % 3 ELSE 0 END) % {K}" for i, x in enumerate(TAXA)}
TREE: tree.Tree = [("root", None, 0.0), ("ab", "abc", 0.1), ("a", "ab", 0.1), ("b", "ab", 0.2), ("abc", "left", 0.05), ("c", "abc", 0.3), ("de", "left", 0.2), ("d", "de", 0.25), ("e", "de", 0.15), ("left", "root", 0.1), ("right", "root", 0.15), ("fg", "right", 0.1), ("f", "fg", 0.05), ("g", "fg", 0.2), ("h", "right", 0.3)]
FOUR: tree.Tree = [("root", None, 0.0), ("x", "root", 0.15), ("a", "x", 0.1), ("b", "x", 0.2), ("y", "root", 0.05), ("c", "y", 0.3), ("d", "y", 0.25)]
EXCHANGE, PI = [1.0, 2.5, 0.8, 1.2, 3.0, 0.9], [0.3, 0.2, 0.25, 0.25]
#: A change between neighbours in the circle of states costs 1, across it 2.5.
COST = [[0.0 if i == j else 2.5 if (i - j) % 4 == 2 else 1.0 for j in range(K)] for i in range(K)]
BITS = 6


def _lines(spark, sf, taxa=TAXA):  # noqa: ANN001, ANN202
    return table(spark, sf, "lineitem").select(*(F.expr(STATES[x]).cast("long").alias(x) for x in taxa))


def patterns(spark, sf, taxa=TAXA):  # noqa: ANN001, ANN202
    return tree.site_patterns(_lines(spark, sf, taxa), list(taxa), F.lit(0)).drop("first")


def lines_sql(taxa=TAXA) -> str:  # noqa: ANN001
    return f"al AS (SELECT {', '.join(f'CAST({STATES[x]} AS BIGINT) AS {x}' for x in taxa)} FROM lineitem), pt AS (SELECT {', '.join(taxa)}, count(*) AS weight FROM al GROUP BY ALL)"


def _levels_sql(shape, start: str, leaf, inner, join) -> tuple[str, str]:  # noqa: ANN001
    """A query for each inner node, in postorder, with a column for each state; the last one's name."""
    out, last, below = [], start, tree.children_of(shape)
    for node, kids in below.items():
        columns = [f"{join.join('(' + (inner(c, s) if c in below else leaf(c, s)) + ')' for c in kids)} AS {node}_{s}" for s in range(K)]
        out.append(f"n_{node} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = f"n_{node}"
    return ", ".join(out), last


def _pruned_sql(shape, start: str, weight: str, matrix=tree.jc_matrix, pi=None) -> str:  # noqa: ANN001
    step = {n: matrix(t) for n, _, t in shape}
    leaf = lambda c, s: f"CASE {c} " + " ".join(f"WHEN {r} THEN {step[c][s][r]!r}::DOUBLE" for r in range(K)) + " END"
    inner = lambda c, s: " + ".join(f"{step[c][s][r]!r}::DOUBLE * {c}_{r}" for r in range(K))
    levels, last = _levels_sql(shape, start, leaf, inner, " * ")
    total = " + ".join(f"{(pi or [1 / K] * K)[s]!r}::DOUBLE * root_{s}" for s in range(K))
    return f"{levels} SELECT count(*) AS n_patterns, CAST(sum({weight}) AS BIGINT) AS n_sites, round(sum({weight} * ln({total})), 4) AS log_likelihood FROM {last}"


def _pruned(sites, shape, **options):  # noqa: ANN001, ANN003, ANN202
    return tree.pruning_log_likelihood(sites, shape, K, **options).withColumn("log_likelihood", F.round("log_likelihood", 4))


def _sankoff_sql() -> str:
    leaf = lambda c, s: f"CASE {c} " + " ".join(f"WHEN {r} THEN {COST[s][r]}::DOUBLE" for r in range(K)) + " END"
    inner = lambda c, s: "least(" + ", ".join(f"{COST[s][r]}::DOUBLE + {c}_{r}" for r in range(K)) + ")"
    levels, last = _levels_sql(TREE, "pt", leaf, inner, " + ")
    return f"WITH {lines_sql()}, {levels} SELECT sum(weight * least({', '.join(f'root_{s}' for s in range(K))})) AS score FROM {last}"


def _fitch_sql() -> str:
    out, last, below = [], "pt0", tree.children_of(TREE)
    for node, kids in below.items():
        x, y = (f"m_{c}" if c in below else f"(1::BIGINT << {c})" for c in kids)
        out.append(f"n_{node} AS (SELECT * EXCLUDE cost, CASE WHEN {x} & {y} <> 0 THEN {x} & {y} ELSE {x} | {y} END AS m_{node}, cost + CAST({x} & {y} = 0 AS BIGINT) AS cost FROM {last})")
        last = f"n_{node}"
    return f"WITH {lines_sql()}, pt0 AS (SELECT *, 0::BIGINT AS cost FROM pt), {', '.join(out)} SELECT CAST(sum(weight * cost) AS BIGINT) AS score FROM {last}"


def _paths(spark, sf):  # noqa: ANN001, ANN202
    customers = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), (1 + F.col("c_nationkey") * 0.25).cast("double").alias("length"))
    nodes = customers.withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))
    pairs = customers.select(F.col("node").alias("a"), (F.pmod(F.col("node") * 37, F.lit(500)) + 1).alias("b"))
    return tree.path_distances(nodes, pairs)


_PAIRS = list(product(range(4), repeat=2))
_PAIRS = [(TAXA[i], TAXA[j]) for i, j in _PAIRS if i < j]
QUERIES = {
    "site_patterns": (
        lambda s, d: tree.site_patterns(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_orderkey").cast("long")),
        "SELECT l_returnflag, l_linestatus, count(*) AS weight, min(CAST(l_orderkey AS BIGINT)) AS first FROM lineitem GROUP BY ALL",
    ),
    "pattern_ratio": (
        lambda s, d: tree.pattern_ratio(_lines(s, d), list(TAXA)).withColumn("ratio", F.round("ratio", 9)),
        f"WITH {lines_sql()} SELECT count(*) AS n_patterns, CAST(sum(weight) AS BIGINT) AS n_sites, round(avg(CAST(weight AS DOUBLE)), 9) AS ratio FROM pt",
    ),
    "pair_counts": (lambda s, d: tree.pair_counts(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"), "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL"),
    "alignment_patterns": (
        lambda s, d: tree.site_patterns(table(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("site"), *(F.expr(STATES[x]).cast("long").alias(x) for x in BRANCHES)), list(BRANCHES), F.col("site")),
        f"WITH al AS (SELECT CAST(l_orderkey AS BIGINT) AS site, {', '.join(f'CAST({STATES[x]} AS BIGINT) AS {x}' for x in BRANCHES)} FROM lineitem) SELECT {', '.join(BRANCHES)}, count(*) AS weight, min(site) AS first FROM al GROUP BY ALL",
    ),
    "jc_transition_table": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), (F.abs(F.col("c_acctbal").cast("double")) / 2000).alias("t")).select("id", F.round(jc_same(F.col("t")), 9).alias("same"), F.round(jc_other(F.col("t")), 9).alias("other")),
        f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, abs(CAST(c_acctbal AS DOUBLE)) / 2000 AS t FROM customer) SELECT id, round({1 / K} + {(K - 1) / K} * exp(-t * {K / (K - 1.0)!r}::DOUBLE), 9) AS same, round({1 / K} - {1 / K} * exp(-t * {K / (K - 1.0)!r}::DOUBLE), 9) AS other FROM c",
    ),
    "jc_distance_matrix": (
        lambda s, d: tree.distance_matrix(_lines(s, d), list("abcd")).select("a", "b", F.round("p", 9).alias("p"), F.round("distance", 9).alias("distance")),
        f"WITH {lines_sql()}, s AS ({' UNION ALL '.join(f"""SELECT '{x}' AS a, '{y}' AS b, avg(CASE WHEN {x} <> {y} THEN 1::DOUBLE ELSE 0::DOUBLE END) AS p FROM al""" for x, y in _PAIRS)}) SELECT a, b, round(p, 9) AS p, round(-0.75::DOUBLE * ln(1 - p / 0.75::DOUBLE), 9) AS distance FROM s",
    ),
    "pruning_4taxa": (lambda s, d: _pruned(_lines(s, d, "abcd"), FOUR, weight=None), f"WITH {lines_sql('abcd')}, {_pruned_sql(FOUR, 'al', '1')}"),
    "pruning_weighted": (lambda s, d: _pruned(patterns(s, d), TREE), f"WITH {lines_sql()}, {_pruned_sql(TREE, 'pt', 'weight')}"),
    "pruning_gtr": (lambda s, d: _pruned(patterns(s, d), TREE, matrix=tree.gtr_matrix(EXCHANGE, PI), pi=PI), f"WITH {lines_sql()}, {_pruned_sql(TREE, 'pt', 'weight', tree.gtr_matrix(EXCHANGE, PI), PI)}"),
    "fitch_score": (lambda s, d: tree.fitch_score(patterns(s, d), TREE), _fitch_sql()),
    "sankoff_score": (lambda s, d: tree.sankoff_score(patterns(s, d), TREE, COST), _sankoff_sql()),
    "split_pattern_support": (
        lambda s, d: tree.split_support(patterns(s, d, "abcd"), list("abcd")),
        f"WITH {lines_sql('abcd')}, s AS (SELECT weight, CASE WHEN a = b AND c = d AND a <> c THEN 'ab|cd' WHEN a = c AND b = d AND a <> b THEN 'ac|bd' WHEN a = d AND b = c AND a <> b THEN 'ad|bc' END AS split FROM pt) SELECT split, CAST(sum(weight) AS BIGINT) AS n FROM s WHERE split IS NOT NULL GROUP BY split",
    ),
    "split_pattern_support_8": (
        lambda s, d: tree.split_support(patterns(s, d), list(TAXA)),
        f"WITH {lines_sql()}, l AS (SELECT weight, [{', '.join(TAXA)}] AS s FROM pt), t AS (SELECT weight, s, list_filter(range(1, {len(TAXA) + 1}), lambda i: s[i] = s[1]) AS own, list_filter(range(1, {len(TAXA) + 1}), lambda i: s[i] <> s[1]) AS other FROM l WHERE len(list_distinct(s)) = 2) "
        f"SELECT array_to_string(list_transform(own, lambda i: substr('{TAXA}', i, 1)), '') || '|' || array_to_string(list_transform(other, lambda i: substr('{TAXA}', i, 1)), '') AS split, CAST(sum(weight) AS BIGINT) AS n FROM t WHERE len(own) > 1 AND len(other) > 1 GROUP BY 1",
    ),
    "tree_path_distances": (
        _paths,
        "WITH RECURSIVE n AS (SELECT CAST(c_custkey AS BIGINT) AS node, CASE WHEN c_custkey > 1 THEN CAST(c_custkey // 2 AS BIGINT) END AS parent, 1 + c_nationkey * 0.25::DOUBLE AS length FROM customer), "
        "p AS (SELECT node AS a, node * 37 % 500 + 1 AS b FROM n), q AS (SELECT a AS node FROM p UNION SELECT b FROM p), u AS (SELECT node, node AS anc, 0::DOUBLE AS d FROM q UNION ALL SELECT u.node, n.parent, u.d + n.length FROM u JOIN n ON n.node = u.anc WHERE n.parent IS NOT NULL), "
        "m AS (SELECT a, b, min(x.d + y.d) AS distance FROM p JOIN u x ON x.node = a JOIN u y ON y.node = b AND y.anc = x.anc GROUP BY a, b) SELECT p.a, p.b, distance FROM p LEFT JOIN m USING (a, b)",
    ),
    "hadamard_transform": (
        lambda s, d: tree.hadamard(table(s, d, "lineitem").groupBy(F.pmod(F.col("l_partkey"), F.lit(1 << BITS)).cast("long").alias("i")).agg(F.count("*").alias("x")), BITS),
        f"WITH c AS (SELECT CAST(l_partkey % {1 << BITS} AS BIGINT) AS i, count(*) AS x FROM lineitem GROUP BY ALL) SELECT range AS i, CAST(sum(CASE WHEN bit_count(range & i) % 2 = 0 THEN x ELSE -x END) AS DOUBLE) AS x FROM c CROSS JOIN range({1 << BITS}) GROUP BY range",
    ),
}
