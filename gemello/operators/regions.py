"""Region tables: visibility, linking, coverage and the built-in shape rules, as set operations over whole files.

A region table is an adjacency list with the interval encoding of operators.tree; leaves carry alignment ids, folds share fold states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.operators.intervals import coalesce_ranges


def visible_items(nodes: DataFrame) -> DataFrame:
    """(file, id, kind): what shows when collapsed regions are one row each; nothing below a collapsed region does."""
    w = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.max(F.when(F.col("collapsed"), F.col("last"))).over(w) >= F.col("pre"), F.lit(False))
    return nodes.withColumn("below", below).filter("NOT below").select("file", "id", F.when(F.col("collapsed"), "fold").otherwise("line").alias("kind"))


def link_states(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions of one key get its least fold state, collapsed if any of them was."""
    w = Window.partitionBy(*keys)
    return regions.withColumns({"collapsed": F.bool_or("collapsed").over(w), "fold_state_id": F.min("fold_state_id").over(w)})


def set_collapsed(regions: DataFrame, states: DataFrame) -> DataFrame:
    """regions with collapsed and label of (fold_state_id, new_collapsed, new_label), where given."""
    j = regions.join(states, "fold_state_id", "left")
    return j.withColumns({"collapsed": F.coalesce("new_collapsed", "collapsed"), "label": F.coalesce("new_label", "label")}).drop("new_collapsed", "new_label")


def open_folds(regions: DataFrame, wanted: DataFrame) -> DataFrame:
    """regions with the wanted fold states (fold_state_id) open; an unknown state is an error."""
    unknown = wanted.join(regions.select("fold_state_id"), "fold_state_id", "left_anti").first()
    if unknown:
        raise KeyError(f"no fold state {unknown.fold_state_id}")
    j = regions.join(wanted.withColumn("_open", F.lit(True)), "fold_state_id", "left")
    return j.withColumn("collapsed", F.col("collapsed") & F.col("_open").isNull()).drop("_open")


def shared_states(links: DataFrame) -> DataFrame:
    """(node, state): linked regions' least state, over links (a, b), by minimum propagation to a fixpoint; states of a file are few."""
    from gemello.session import written

    e = links.filter("a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    state = both.select(F.col("a").alias("node")).distinct().withColumn("state", F.col("node"))
    while True:
        near = both.join(state, both.b == state.node).groupBy(F.col("a").alias("node")).agg(F.min("state").alias("near"))
        new = written(state.join(near, "node").select("node", F.least("state", "near").alias("state"), (F.col("near") < F.col("state")).alias("moved")), "states")
        state = new.select("node", "state")
        if new.filter("moved").isEmpty():
            return state


def one_sided(nodes: DataFrame) -> DataFrame:
    """nodes (with paired leaves marked) with one_sided: no paired node in the subtree. Counts along the pre-order, no self-join on ranges."""
    w = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    run = nodes.withColumn("upto", F.sum(F.col("paired").cast("int")).over(w))
    at = run.select("file", "side", F.col("pre").alias("last"), F.col("upto").alias("upto_last"))
    return run.join(at, ["file", "side", "last"]).withColumn("one_sided", (F.col("upto_last") - F.col("upto") + F.col("paired").cast("int")) == 0)


def has_changes(nodes: DataFrame) -> DataFrame:
    """nodes (with changed marked) with has_changes: whether any node of the subtree is changed."""
    w = Window.partitionBy("file", "side").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    run = nodes.withColumn("upto", F.sum(F.col("changed").cast("int")).over(w))
    at = run.select("file", "side", F.col("pre").alias("last"), F.col("upto").alias("upto_last"))
    return run.join(at, ["file", "side", "last"]).withColumn("has_changes", (F.col("upto_last") - F.col("upto") + F.col("changed").cast("int")) > 0)


def in_window(leaves: DataFrame, start: int, end: int) -> DataFrame:
    """Leaves that share a line with [start, end)."""
    return leaves.filter((F.col("start") < end) & (F.col("end") > start))


def coverage(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, visible): lines that changed, all and without hidden leaves.

    A paired leaf covers the lines of its changed spans, an unpaired one all its lines.
    """
    own = F.when(F.col("paired"), F.transform("changed", lambda c: F.struct(c["line"].alias("start"), (c["line"] + 1).alias("end")))).otherwise(F.array(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    each = leaves.select(*keys, "hidden", F.explode(own).alias("r")).select(*keys, "hidden", "r.start", "r.end")
    size = lambda df, name: coalesce_ranges(df.drop("hidden"), keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    return size(each, "total").join(size(each.filter("NOT hidden"), "visible"), keys, "left").fillna(0, ["visible"])


def deleted_bodies(folds: DataFrame, least: int = 12) -> DataFrame:
    """Left folds tagged function that have no counterpart and enough lines, collapsed."""
    n = F.col("end") - F.col("start")
    hit = (F.col("side") == "lhs") & F.array_contains("tags", "function") & F.col("one_sided") & (n >= least)
    return folds.filter(hit).withColumn("label", F.concat(n.cast("string"), F.lit(" lines removed")))


def removed_runs(leaves: DataFrame, least: int = 5) -> DataFrame:
    """Left leaves without counterpart in a body without one: all but their first and last line, collapsed."""
    n = F.col("end") - F.col("start")
    hit = (F.col("side") == "lhs") & F.col("one_sided") & F.col("holder_one_sided") & (n >= max(least, 3))
    return leaves.filter(hit).withColumn("label", F.concat((n - 2).cast("string"), F.lit(" lines removed"))).withColumns({"start": F.col("start") + 1, "end": F.col("end") - 1})


def test_bodies(folds: DataFrame, least: int = 3) -> DataFrame:
    """Folds of tests with enough lines, collapsed, but in integration and end-to-end files and integration folds."""
    kinds = F.array(F.lit("integration"), F.lit("e2e"))
    hit = F.arrays_overlap("tags", F.array(F.lit("test"), F.lit("module"))) & (F.col("end") - F.col("start") >= least)
    return folds.filter(hit & ~F.arrays_overlap("file_tags", kinds) & ~F.array_contains("tags", "integration"))
