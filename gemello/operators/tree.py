"""Directory trees and node tables.

Node tables are adjacency lists with a pre-order interval: (file, side, id, parent_id, ord, pre, last), where last is the greatest pre of a
node's subtree, so that being below a node is a range predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_directories(path: Column) -> Column:
    """All proper prefixes of a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def directory_rollup(counts: DataFrame) -> DataFrame:
    """(node, depth, is_dir, files, added, removed) of every file and directory of counts (path, added, removed)."""
    parts = F.split("path", "/")
    each = counts.withColumn("parts", parts).select("added", "removed", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    return (
        each.groupBy(F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("node"), F.col("k").cast("long").alias("depth"), (F.col("k") < F.size("parts")).alias("is_dir"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    )


def visible_paths(files: DataFrame, closed: DataFrame) -> DataFrame:
    """files (path) that lie below no closed directory (dir)."""
    below = files.select("path", F.explode(parent_directories(F.col("path"))).alias("dir")).join(closed, "dir", "left_semi")
    return files.join(below.select("path"), "path", "left_anti")


def sibling_links(nodes: DataFrame) -> DataFrame:
    """nodes with prev_sibling and next_sibling, and prev in pre-order."""
    s = Window.partitionBy("file", "side", "parent_id").orderBy("ord")
    p = Window.partitionBy("file", "side").orderBy("pre")
    return nodes.withColumns({"prev_sibling": F.lag("id").over(s), "next_sibling": F.lead("id").over(s), "prev": F.lag("id").over(p)})


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """(file, side, id, num_descendants, num_ancestors) from the intervals: a running count of those open along the pre-order, no self-join."""
    n = nodes.select("file", "side", "id", "pre", "last")
    opens = n.withColumns({"_at": F.col("pre"), "_step": F.lit(1)})
    closes = n.withColumns({"_at": F.col("last") + 1, "_step": F.lit(-1)})
    w = Window.partitionBy("file", "side").orderBy("_at", "_step").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("_step").over(w), F.lit(0)).cast("long")
    run = opens.unionByName(closes).withColumn("num_ancestors", above).filter("_step = 1")
    return run.select("file", "side", "id", (F.col("last") - F.col("pre")).alias("num_descendants"), "num_ancestors")


def hidden(nodes: DataFrame) -> DataFrame:
    """nodes with hidden: whether it or any node above it is collapsed. A running maximum of collapsed intervals, no self-join."""
    w = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("hidden", F.coalesce(F.max(F.when(F.col("collapsed"), F.col("last"))).over(w) >= F.col("pre"), F.lit(False)))


def unique_content(nodes: DataFrame) -> DataFrame:
    """nodes with unique_on_side: whether its content id stands once on its side of the file."""
    w = Window.partitionBy("file", "side", "content_id")
    return nodes.withColumn("unique_on_side", F.count(F.lit(1)).over(w) == 1)


def common_unique(nodes: DataFrame) -> DataFrame:
    """(file, content_id) of subtrees that stand once on either side and not below another such."""
    u = unique_content(nodes).filter("unique_on_side").select("file", "side", "content_id", "pre", "last")
    both = u.join(u.filter("side = 'rhs'").select("file", "content_id"), ["file", "content_id"], "left_semi").join(u.filter("side = 'lhs'").select("file", "content_id"), ["file", "content_id"], "left_semi")
    w = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    top = both.filter("side = 'lhs'").withColumn("covered", F.max("last").over(w)).filter("covered IS NULL OR covered < pre")
    return top.select("file", "content_id")


def partners(changes: DataFrame) -> DataFrame:
    """(file, lhs_id, rhs_id) of nodes that name each other: changes (file, side, id, kind, opposite_id)."""
    c = changes.filter(F.col("opposite_id").isNotNull())
    a = c.filter("side = 'lhs'").select("file", F.col("id").alias("lhs_id"), F.col("opposite_id").alias("rhs_id"))
    b = c.filter("side = 'rhs'").select("file", F.col("id").alias("rhs_id"), F.col("opposite_id").alias("lhs_id"))
    return a.join(b, ["file", "lhs_id", "rhs_id"])
