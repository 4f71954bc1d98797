"""Queries on trees that the tables spell as text, and on the neighbourhoods of trees over the lines' patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import topology, tree
from weftline.plans.common import table
from weftline.plans.trees import TAXA, lines_sql, patterns

TREES, PARTS = 40, 16


def spelled(spark: SparkSession, sf: str) -> DataFrame:
    """tree, newick: for each class of suppliers, the parts' classes in two levels of groups by the quantities sold."""
    s = F.sum(F.col("l_quantity").cast("long"))
    sold = table(spark, sf, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(TREES)).cast("long").alias("tree"), F.pmod("l_partkey", F.lit(PARTS)).cast("long").alias("part")).agg(s.alias("s"))
    sold = sold.selectExpr("tree", "part as at", "s % 3 as g", "(s div 3) % 3 as h", "concat('p', part, ':', cast((s % 8) * 0.25D as string)) as piece")
    joined = F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), ","), F.lit(")"))
    inner = sold.groupBy("tree", "g", "h").agg(joined.alias("kids"), F.count("*").alias("n")).selectExpr("tree", "g", "h as at", "concat(kids, 'g', g, '_', h, ':', cast(n * 0.5D as string)) as piece")
    outer = inner.groupBy("tree", "g").agg(joined.alias("kids"), F.count("*").alias("n")).selectExpr("tree", "g as at", "concat(kids, 'g', g, ':', cast(n * 0.5D as string)) as piece")
    return outer.groupBy("tree").agg(F.concat(joined, F.lit(";")).alias("newick"))


_SOLD = f"""z AS (SELECT CAST(l_suppkey % {TREES} AS BIGINT) AS tree, CAST(l_partkey % {PARTS} AS BIGINT) AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY ALL),
sold AS (SELECT tree, part, s % 3 AS g, (s // 3) % 3 AS h, (s % 8) * 0.25::DOUBLE AS len FROM z)"""
_SPELLED = f"""{_SOLD},
i AS (SELECT tree, g, h, '(' || string_agg('p' || part || ':' || len, ',' ORDER BY part) || ')g' || g || '_' || h || ':' || (count(*) * 0.5::DOUBLE) AS piece FROM sold GROUP BY tree, g, h),
o AS (SELECT tree, g, '(' || string_agg(piece, ',' ORDER BY h) || ')g' || g || ':' || (count(*) * 0.5::DOUBLE) AS piece FROM i GROUP BY tree, g)
SELECT tree, '(' || string_agg(piece, ',' ORDER BY g) || ');' AS newick FROM o GROUP BY tree"""
_NODES = f"""WITH {_SOLD},
i AS (SELECT tree, g, h, count(*) * 0.5::DOUBLE AS len FROM sold GROUP BY ALL), o AS (SELECT tree, g, count(*) * 0.5::DOUBLE AS len FROM i GROUP BY ALL)
SELECT tree, 'p' || part AS name, len AS length, 'g' || g || '_' || h AS parent FROM sold UNION ALL SELECT tree, 'g' || g || '_' || h, len, 'g' || g FROM i
UNION ALL SELECT tree, 'g' || g, len, '' FROM o UNION ALL SELECT DISTINCT tree, '', NULL::DOUBLE, NULL FROM o"""
_SPLITS = f"""{_SOLD},
l AS (SELECT tree, 'p' || part AS name, g, h FROM sold), a AS (SELECT tree, list(name ORDER BY name) AS every FROM l GROUP BY tree),
n AS (SELECT tree, [name] AS own FROM l UNION ALL SELECT tree, list(name ORDER BY name) FROM l GROUP BY tree, g, h UNION ALL SELECT tree, list(name ORDER BY name) FROM l GROUP BY tree, g),
sp AS (SELECT DISTINCT tree, CASE WHEN own[1] = every[1] THEN list_filter(every, lambda x: NOT list_contains(own, x)) ELSE own END AS side FROM n JOIN a USING (tree)),
s AS (SELECT * FROM sp WHERE len(side) > 0)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = topology.parsed(spelled(spark, sf))
    above = nodes.select("tree", F.col("node").alias("parent"), F.col("name").alias("of"))
    return nodes.join(above, ["tree", "parent"], "left").select("tree", "name", "length", F.col("of").alias("parent"))


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    return topology.programs(topology.parsed(spelled(spark, sf)))


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    splits = topology.splits(_programs(spark, sf)).select("tree", F.struct("h0", "h1").alias("mask"))
    pairs = table(spark, sf, "supplier").select(F.pmod("s_suppkey", F.lit(TREES)).cast("long").alias("a")).distinct().withColumn("b", F.pmod(F.col("a") * 3 + 1, F.lit(TREES)))
    return tree.robinson_foulds(splits, pairs).withColumn("normalised", F.round("normalised", 9))


#: The eight taxa of the lines in an order of each nation, as a tree whose branches hang from one long path.
_ORDER = f"(n_nationkey * 7 + k * 5 + n_nationkey * k * 3) % {len(TAXA) + 3}"


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """tree, newick: an unrooted tree for each nation."""
    taxa = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(TAXA)))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), F.explode(taxa).alias("e")).select("n_nationkey", "e.k", "e.x").withColumn("o", F.expr(_ORDER))
    names = F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "x"))), lambda e: e["x"])
    inner = len(TAXA) - 3
    rows = rows.groupBy(F.col("n_nationkey").alias("tree")).agg(names.alias("x"))
    return rows.select("tree", F.concat(F.lit("("), F.array_join(F.slice("x", 1, 2), ","), F.lit(",("), F.array_join(F.slice("x", 3, inner), ",("), F.lit(","), F.col("x")[len(TAXA) - 1], F.lit(")" * (inner + 1) + ";")).alias("newick"))


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return topology.columns_of(patterns(spark, sf), list(TAXA))


def _path_programs(spark: SparkSession, sf: str) -> DataFrame:
    return topology.programs(topology.parsed(paths(spark, sf), arity="unrooted"))


def _neighbour_scores(spark: SparkSession, sf: str) -> DataFrame:
    near = topology.nni_neighbours(_path_programs(spark, sf)).select(F.struct("tree", "branch", "swap").alias("tree"), "steps")
    scores = topology.fitch_scores(near, _columns(spark, sf))
    return scores.groupBy(F.col("tree.tree").alias("tree"), "score").agg(F.count("*").alias("n"))


def _regraft_scores(spark: SparkSession, sf: str) -> DataFrame:
    near = topology.spr_neighbours(_path_programs(spark, sf), 1).select(F.struct("tree", "node", "onto", "upper").alias("tree"), "steps")
    scores = topology.fitch_scores(near, _columns(spark, sf))
    return scores.groupBy(F.col("tree.tree").alias("tree"), "score").agg(F.count("*").alias("n"))


def _regrafts(spark: SparkSession, sf: str) -> DataFrame:
    return topology.spr_neighbours(_path_programs(spark, sf)).groupBy("tree").agg(F.count("*").alias("trees"), F.sum(F.size("steps").cast("long")).alias("nodes"))


def _climb(spark: SparkSession, sf: str) -> DataFrame:
    return topology.climbed(_path_programs(spark, sf), _columns(spark, sf), 1).select("tree", "score", F.col("settled"))


_N = len(TAXA)
#: A program puts leaves (1 to N) on a stack and takes off two or three values for -2 and -3.
_RUNS = f"""t AS (SELECT unnest(range(0, {_N})) AS k), q AS (SELECT CAST(n_nationkey AS BIGINT) AS tree, list(CAST(k + 1 AS BIGINT) ORDER BY {_ORDER}, k) AS o FROM nation CROSS JOIN t GROUP BY 1),
own AS (SELECT tree, 0 AS j, 0 AS swap, o || list_transform(range(0, {_N - 3}), lambda i: CAST(-2 AS BIGINT)) || [CAST(-3 AS BIGINT)] AS p FROM q),
near AS (SELECT tree, j, 0 AS swap, o[1:j - 2] || [o[j], o[j - 1]] || o[j + 1:{_N}] || list_transform(range(0, {_N - 3}), lambda i: CAST(-2 AS BIGINT)) || [CAST(-3 AS BIGINT)] AS p FROM q CROSS JOIN (SELECT unnest(range(3, {_N})) AS j)
 UNION ALL SELECT tree, j, 1, o[1:j - 2] || o[j + 1:{_N}] || list_transform(range(0, {_N - 1} - j), lambda i: CAST(-2 AS BIGINT)) || [o[j], o[j - 1], CAST(-2 AS BIGINT)] || list_transform(range(0, j - 3), lambda i: CAST(-2 AS BIGINT)) || [CAST(-3 AS BIGINT)] FROM q CROSS JOIN (SELECT unnest(range(3, {_N})) AS j)),
every AS (SELECT * FROM own UNION ALL SELECT * FROM near),
m AS (SELECT [{", ".join(f"1::BIGINT << {x}" for x in TAXA)}] AS states, weight FROM pt),
run AS (SELECT tree, j, swap, p, states, weight, 0 AS i, []::BIGINT[] AS stack, 0::BIGINT AS cost FROM every CROSS JOIN m
 UNION ALL SELECT tree, j, swap, p, states, weight, i + 1,
  CASE WHEN p[i + 1] > 0 THEN stack || [states[p[i + 1]]] WHEN p[i + 1] = -2 THEN stack[1:len(stack) - 2] || [CASE WHEN stack[-2] & stack[-1] = 0 THEN stack[-2] | stack[-1] ELSE stack[-2] & stack[-1] END] ELSE
   [CASE WHEN stack[1] & stack[2] = 0 THEN stack[1] | stack[2] ELSE stack[1] & stack[2] END, stack[3]] END,
  cost + CASE WHEN p[i + 1] > 0 THEN 0 WHEN p[i + 1] = -2 THEN CAST(stack[-2] & stack[-1] = 0 AS BIGINT) ELSE CAST(stack[1] & stack[2] = 0 AS BIGINT) + CAST((CASE WHEN stack[1] & stack[2] = 0 THEN stack[1] | stack[2] ELSE stack[1] & stack[2] END) & stack[3] = 0 AS BIGINT) END
 FROM run WHERE i < len(p)),
scores AS (SELECT tree, j, swap, CAST(sum(cost * weight) AS BIGINT) AS score FROM run WHERE i = len(p) GROUP BY ALL)"""
_PATTERNS = lines_sql()

QUERIES = {
    "newick_nodes": (_nodes, _NODES),
    "newick_round_trip": (lambda s, d: topology.newick(_programs(s, d)), f"WITH {_SPELLED}"),
    "tree_splits": (
        lambda s, d: topology.splits(_programs(s, d)).groupBy("tree", "n").agg(F.count("*").alias("splits")),
        f"WITH {_SPLITS} SELECT tree, CAST(len(side) AS BIGINT) AS n, count(*) AS splits FROM s GROUP BY ALL",
    ),
    "robinson_foulds": (
        _distances,
        f"WITH {_SPLITS}, p AS (SELECT DISTINCT CAST(s_suppkey % {TREES} AS BIGINT) AS a FROM supplier), q AS (SELECT a, (a * 3 + 1) % {TREES} AS b FROM p), "
        "x AS (SELECT a, b, side, 1 AS l, 0 AS r FROM q JOIN s ON s.tree = a UNION ALL SELECT a, b, side, 0, 1 FROM q JOIN s ON s.tree = b), m AS (SELECT a, b, side, sum(l) AS l, sum(r) AS r FROM x GROUP BY ALL) "
        "SELECT a, b, CAST(count(*) FILTER (l + r = 1) AS BIGINT) AS distance, round(count(*) FILTER (l + r = 1) / CAST(sum(l + r) AS DOUBLE), 9) AS normalised FROM m GROUP BY a, b",
    ),
    "nni_fitch_scores": (_neighbour_scores, f"WITH RECURSIVE {_PATTERNS}, {_RUNS} SELECT tree, score, count(*) AS n FROM scores WHERE j > 0 GROUP BY ALL"),
    # one node away, regrafts are the interchanges
    "spr_fitch_scores": (_regraft_scores, f"WITH RECURSIVE {_PATTERNS}, {_RUNS} SELECT tree, score, count(*) AS n FROM scores WHERE j > 0 GROUP BY ALL"),
    "spr_neighbourhoods": (_regrafts, f"WITH RECURSIVE {_PATTERNS}, {_RUNS} SELECT tree, 2 * (len(o) - 3) * (2 * len(o) - 7) AS trees, 2 * (len(o) - 3) * (2 * len(o) - 7) * (2 * len(o) - 2) AS nodes FROM q"),
    "parsimony_round": (
        _climb,
        f"WITH RECURSIVE {_PATTERNS}, {_RUNS}, b AS (SELECT tree, min(score) FILTER (j = 0) AS own, min(score) FILTER (j > 0) AS least FROM scores GROUP BY tree) SELECT tree, least(own, least) AS score, least >= own AS settled FROM b",
    ),
}
