"""Trees: walks from roots, nearest mapped ancestors, lineages, indentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


def walk(nodes: DataFrame, node: str, parent: str, order: str, most: int = 100) -> DataFrame:
    """nodes with depth, root and path (the orders from the root down); orderBy("path") is pre-order.

    Level by level: a join of the last level's nodes with their children for each, so the rounds are as many as the
    tree is deep, not as it is large. Orders are numbers.
    """
    step = nodes.select(node, parent, F.col(order).cast("bigint").alias("_o"))
    level = step.where(F.col(parent).isNull()).select(node, parent, F.lit(0).alias("depth"), F.col(node).alias("root"), F.array("_o").alias("path"))
    out = level
    for depth in range(1, most + 1):
        up = level.select(F.col(node).alias("_up"), F.col("root").alias("_root"), F.col("path").alias("_path"))
        level = cut(step.join(up, step[parent] == up["_up"]).select(node, parent, F.lit(depth).alias("depth"), F.col("_root").alias("root"), F.concat("_path", F.array("_o")).alias("path")))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most} levels, or a cycle")


def nearest_mapped(nodes: DataFrame, mapped: DataFrame, node: str, parent: str, most: int = 100) -> DataFrame:
    """(node, ancestor): the nearest ancestor (or the node itself) that is in `mapped`; null if none is."""
    known = mapped.select(F.col(node).alias("_at")).distinct().withColumn("_hit", F.lit(1))
    at = nodes.select(node, F.col(node).alias("_at"))
    up = nodes.select(F.col(node).alias("_at"), F.col(parent).alias("_up"))
    out = None
    for _ in range(most):
        tried = at.join(known, "_at", "left")
        found = tried.where("_hit = 1").select(node, F.col("_at").alias("ancestor"))
        moved = tried.where("_hit is null").join(up, "_at", "left").select(node, F.col("_up").alias("_at"))
        found = found.unionByName(moved.where("_at is null").select(node, F.col("_at").alias("ancestor")))
        out = found if out is None else out.unionByName(found)
        at = cut(moved.where("_at is not null"))
        if not at.limit(1).count():
            return out
    raise ValueError(f"deeper than {most} levels, or a cycle")


def subtree_sizes(walked: DataFrame, node: str) -> DataFrame:
    """(node, pages): nodes of each subtree, itself included, from walk(): a path counts for each of its prefixes."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n)))
    counts = walked.select("root", prefix.alias("path")).groupBy("root", "path").agg(F.count("*").alias("pages"))
    return walked.join(counts, ["root", "path"]).select(node, "pages")


def indent_parents(indents: Column) -> Column:
    """For an array of indents, the index (from 0) of each line's parent: the last earlier line with a smaller indent."""
    def parent(x: Column, i: Column) -> Column:
        earlier = F.filter(F.transform(F.slice(indents, F.lit(1), i), lambda y, j: F.when(y < x, j)), lambda j: j.isNotNull())
        return F.try_element_at(earlier, F.lit(-1))

    return F.transform(indents, parent)
