"""Connected components of a link table, by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _followed(labels: DataFrame) -> DataFrame:
    """Follow (node, root) pointers, which never rise, to their ends; each round doubles the steps."""
    total = None
    while True:
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        ahead = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        labels = written(labels.join(ahead, labels["root"] == ahead["_n"]).select("node", F.col("_r").alias("root")), "labels")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the least node that can be reached.

    Each round points every node to the least of itself and its neighbours (an aggregation, combined before the
    shuffle, so a node with very many links is no hot group), follows the pointers to their ends, and
    replaces the links by links between the ends: each link is joined once on either side, and what is left
    shrinks quickly.  The rounds' tables are then read backwards.  All tables are in the shared folder: lineage stays
    short and a lost executor costs one step.
    """
    u, v = F.col(a), F.col(b)
    left = written(edges.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "links")
    levels = []
    while True:
        ends = left.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            left.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        labels = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
        labels = _followed(labels)
        levels.append(labels)
        of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        moved = left.join(of("u"), "u").join(of("v"), "v").where("ru <> rv")
        left = written(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        if not left.limit(1).count():
            break
    roots = levels.pop()
    while levels:
        known = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        lower = levels.pop()
        roots = written(
            lower.join(known, lower["root"] == known["_n"], "left").select("node", F.coalesce("_r", "root").alias("root")),
            "labels",
        )
    return roots
