"""What a pair of equal subtrees says of all nodes below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.operators.parse import with_nearest
from gemello.operators.tree import unique_content


def deep_changes(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, side, id, kind, opposite_id) of nodes (file, side, id, pre, last, level, kind): below anchors (file, side, id, anchor), which have one
    number for each pair of equal subtrees, every node is unchanged and names the node at its offset in the other subtree; all others are novel.

    Equal subtrees may differ in nodes of kind can_ignore that end lists. Offsets count without these; one that stands alone is
    ignored_punctuation. An anchor on one side only makes its nodes novel. Both sides of a subtree meet in a window by (anchor, offset), no node is joined
    with nodes; the anchor above a node comes from the one that opened last.
    """
    ignorable = F.col("kind") == "can_ignore"
    marked = anchors.select("file", "side", "id", "anchor")
    n = nodes.select("file", "side", "id", "pre", "last", "level", "kind").join(marked, ["file", "side", "id"], "left")
    order = Window.partitionBy("file", "side").orderBy("pre")
    n = n.withColumn("core", F.sum(F.when(ignorable, 0).otherwise(1)).over(order))
    at = F.struct(F.col("anchor").alias("anchor"), F.col("core").alias("core"), F.col("level").alias("level"))
    n = with_nearest(n, ["file", "side"], F.col("anchor").isNotNull(), at, "above")
    n = n.withColumn("of", F.when(F.col("anchor").isNotNull(), at).otherwise(F.col("above")))
    place = [F.col("of.anchor"), F.col("core") - F.col("of.core"), F.col("level") - F.col("of.level"), ignorable]
    both = Window.partitionBy("file", *place)
    there = F.when(F.col("side") == "lhs", F.min(F.when(F.col("side") == "rhs", F.col("id"))).over(both)).otherwise(F.min(F.when(F.col("side") == "lhs", F.col("id"))).over(both))
    pair = Window.partitionBy("file", "of.anchor")
    inside = F.col("of").isNotNull() & (F.min("side").over(pair) != F.max("side").over(pair))
    n = n.withColumns({"opposite_id": F.when(inside, there), "inside": inside})
    kind = F.when(~F.col("inside"), "novel").when(F.col("opposite_id").isNotNull(), "unchanged").when(ignorable, "ignored_punctuation").otherwise("novel")
    return n.select("file", "side", "id", kind.alias("kind"), "opposite_id")


def equal_subtrees(nodes: DataFrame) -> DataFrame:
    """(file, side, id, anchor): the greatest subtrees of nodes (file, side, id, pre, last, content_id) whose content stands once on either side; both
    of a pair have one anchor."""
    u = unique_content(nodes).filter("unique_on_side")
    content = Window.partitionBy("file", "content_id")
    both = u.withColumn("paired", F.count(F.lit(1)).over(content) == 2).filter("paired")
    above = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    top = both.withColumn("covered", F.coalesce(F.max("last").over(above) >= F.col("pre"), F.lit(False))).filter("NOT covered")
    # what holds a subtree on one side holds its only copy on the other, so that both sides leave out the same
    return top.select("file", "side", "id", F.xxhash64("content_id").alias("anchor"))
