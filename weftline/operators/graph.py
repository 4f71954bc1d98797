"""Operators on labelled graphs: energies, fields, cuts, conditional modes, components, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.segments import offsets
from weftline.sources.shared import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: site, other, w. Parallel edges stay: they are doubled bonds."""
    return edges.select(F.col("i").alias("site"), F.col("j").alias("other"), "w").unionByName(edges.select(F.col("j").alias("site"), F.col("i").alias("other"), "w"))


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (i, j, w) with the labels ``li`` and ``lj`` of their ends."""
    a = labels.select(F.col("site").alias("i"), F.col("label").alias("li"))
    b = labels.select(F.col("site").alias("j"), F.col("label").alias("lj"))
    return edges.join(a, "i").join(b, "j")


def potts_energy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n_edges, n_equal and energy = minus the sum of the weights of edges whose ends have one label."""
    equal = F.col("li") == F.col("lj")
    return with_labels(edges, labels).agg(F.count("*").alias("n_edges"), F.count(F.when(equal, 1)).alias("n_equal"), F.coalesce(F.sum(F.when(equal, -F.col("w")).otherwise(0.0)), F.lit(0.0)).alias("energy"))


def cut_value(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the weight of the edges between different labels."""
    return with_labels(edges, labels).agg(F.coalesce(F.sum(F.when(F.col("li") != F.col("lj"), F.col("w")).otherwise(0.0)), F.lit(0.0)).alias("cut"))


def local_fields(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """site, label, field: the weight that a site's neighbours of each label give; labels without neighbours have no row."""
    near = both_ways(edges).join(labels.select(F.col("site").alias("other"), "label"), "other")
    return near.groupBy("site", "label").agg(F.sum("w").alias("field"))


def merge_deltas(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a < b, delta: the change of energy if two labels that touch became one."""
    met = with_labels(edges, labels).where("li != lj")
    return met.groupBy(F.least("li", "lj").alias("a"), F.greatest("li", "lj").alias("b")).agg((-F.sum("w")).alias("delta"))


def icm_sweep(edges: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """One sweep of iterated conditional modes, the even colour of the checkerboard first, then the odd.

    A site takes the label with the largest field, ties to the smallest label, and stays where its own label's field is as
    large. Sites of one colour have no edges with each other, so that all of them can move at once.
    """
    near = both_ways(edges)
    for colour in (0, 1):
        turn = F.pmod(F.floor(F.col("site") / width) + F.pmod(F.col("site"), F.lit(width)), F.lit(2)) == colour
        # only the sites whose turn it is, and one aggregate over their fields
        fields = near.where(turn).join(labels.select(F.col("site").alias("other"), "label"), "other").groupBy("site", "label").agg(F.sum("w").alias("field"))
        own = labels.select("site", F.col("label").alias("old"))
        best = fields.join(own, "site").groupBy("site").agg(F.max(F.struct("field", (-F.col("label")).alias("back"))).alias("top"), F.max(F.when(F.col("label") == F.col("old"), F.col("field"))).alias("own"))
        better = F.col("top").isNotNull() & (F.col("top.field") > F.coalesce("own", F.lit(0.0)))
        labels = labels.join(best, "site", "left").select("site", F.when(better, -F.col("top.back")).otherwise(F.col("label")).alias("label"))
    return labels


def degrees(edges: DataFrame) -> DataFrame:
    """site, degree and start: the offset of the site's row in a compressed adjacency.

    Degrees are summed per site first; their running sum goes by range partitions, so that no task orders all sites.
    """
    count = both_ways(edges.withColumn("w", F.lit(1.0)) if "w" not in edges.columns else edges).groupBy("site").agg(F.count("*").alias("degree"))
    return offsets(count, "site", "degree").select("site", "degree", "start")


def bond_components(edges: DataFrame) -> DataFrame:
    """site, root: the smallest site of each component; sites without bonds have no row.

    Each round takes the least label of the neighbours and then that label's own label, until nothing changes; rounds are
    checkpointed, so that plans stay small and a lost executor costs one round at most. Joins are by sorting, so that no
    round sends a table through the driver.
    """
    near = cut(both_ways(edges).select("site", "other").distinct()).hint("merge")
    roots = near.groupBy("site").agg(F.least(F.first("site"), F.min("other")).alias("root"))
    while True:
        roots = cut(roots).hint("merge")
        least = near.join(roots.select(F.col("site").alias("other"), F.col("root").alias("r")), "other").groupBy("site").agg(F.min("r").alias("r"))
        met = cut(roots.join(least, "site").select("site", F.col("root").alias("old"), F.least("root", "r").alias("root"))).hint("merge")
        jump = met.select(F.col("site").alias("root"), F.col("root").alias("next"))
        moved = cut(met.join(jump, "root").select("site", "old", F.least("root", "next").alias("root"))).hint("merge")
        roots = moved.select("site", "root")
        if moved.where("old != root").isEmpty():
            return roots
