"""Lattices over the keys of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lattice(sites: DataFrame, width: int, site: str = "site") -> DataFrame:
    """The open square lattice over sites 0, 1, ... in rows of ``width``: eid, i, j. Edges to absent sites are left out."""
    right = sites.where(F.pmod(F.col(site), F.lit(width)) < width - 1).select((2 * F.col(site)).alias("eid"), F.col(site).alias("i"), (F.col(site) + 1).alias("j"))
    down = sites.select((2 * F.col(site) + 1).alias("eid"), F.col(site).alias("i"), (F.col(site) + width).alias("j"))
    edges = right.unionByName(down)
    return edges.join(sites.select(F.col(site).alias("j")), "j", "left_semi").select("eid", "i", "j")


def triangular(sites: DataFrame, width: int, site: str = "site") -> DataFrame:
    """The square lattice with one diagonal: i, j."""
    diagonal = sites.where(F.pmod(F.col(site), F.lit(width)) < width - 1).select(F.col(site).alias("i"), (F.col(site) + width + 1).alias("j"))
    diagonal = diagonal.join(sites.select(F.col(site).alias("j")), "j", "left_semi").select("i", "j")
    return lattice(sites, width, site).select("i", "j").unionByName(diagonal)
