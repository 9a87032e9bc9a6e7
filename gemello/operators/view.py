"""What a viewer derives from regions and rows: order, windows, states, headers, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOVEL_KINDS = ("novel", "novel_word", "unchanged_part")
# What a fallback cause is called on the wire.
FALLBACK_CODES = {"generated": "generated", "hidden": "hidden", "byte_limit": "too_large", "graph_limit": "too_complex", "parse_errors": "parse_error"}


def is_novel(kind: Column) -> Column:
    return kind.isin(*NOVEL_KINDS)


def fallback_code(cause: Column) -> Column:
    """The wire code of a cause; null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FALLBACK_CODES.items() for x in kv]), F.coalesce(cause, F.lit("")))


def parse_error_cause(errors: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """(keys, errors, first_line) of files whose parse errors (keys, side, line) on both sides are over the limit; the right side's first comes first."""
    first = lambda s: F.min(F.when(F.col("side") == s, F.col("line")))
    return errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("errors"), F.coalesce(first("rhs"), first("lhs")).alias("first_line")).filter(F.col("errors") > limit)


def pairing(lhs: Column, rhs: Column) -> Column:
    """both, left or right; a pair of nothing is an error."""
    return F.when(lhs.isNotNull() & rhs.isNotNull(), "both").when(lhs.isNotNull(), "left").when(rhs.isNotNull(), "right").otherwise(F.raise_error(F.lit("a pairing has at least one side")).cast("string"))


def item_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items (keys, start, end, is_fold, byte_start, byte_end) with ord: by start, the longer first, folds before leaves, then by bytes."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("is_fold"), "byte_start", F.desc("byte_end"))
    return items.withColumn("ord", F.row_number().over(w))


def fold_on_line(folds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, id): of the folds (id, start, end, is_scope) that open on a line, a scope if there is one, then the longest."""
    best = F.min_by("id", F.struct((~F.col("is_scope")).cast("int"), -(F.col("end") - F.col("start")), F.col("id")))
    return folds.groupBy(*keys, F.col("start").alias("line")).agg(best.alias("id"))


def fold_partners(folds: DataFrame, partners: DataFrame) -> DataFrame:
    """(file, lhs_fold, rhs_fold): folds (file, side, id, node_id, start, end) of nodes that are partners, both of them not empty."""
    own = folds.filter("start < end")
    side = lambda s: own.filter(F.col("side") == s).select("file", F.col("node_id").alias(f"{s}_id"), F.col("id").alias(f"{s}_fold"))
    return partners.join(side("lhs"), ["file", "lhs_id"]).join(side("rhs"), ["file", "rhs_id"]).select("file", "lhs_fold", "rhs_fold")


def aligned_folds(folds: DataFrame, runs: DataFrame) -> DataFrame:
    """(file, lhs_fold, rhs_fold): folds without a partner that lie in one unchanged run (file, run, lhs_start, rhs_start, size) over the same lines of it."""
    def inside(s):
        j = folds.filter(F.col("side") == s).join(runs, "file").filter((F.col("start") >= F.col(f"{s}_start")) & (F.col("end") <= F.col(f"{s}_start") + F.col("size")))
        return j.select("file", "run", (F.col("start") - F.col(f"{s}_start")).alias("a"), (F.col("end") - F.col(f"{s}_start")).alias("b"), F.col("id").alias(f"{s}_fold"))

    return inside("lhs").join(inside("rhs"), ["file", "run", "a", "b"]).select("file", "lhs_fold", "rhs_fold")


def unmatched_folds(folds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Folds (file, side, id) that no pair (file, lhs_fold, rhs_fold) names."""
    named = pairs.select("file", F.explode(F.array(F.struct(F.lit("lhs").alias("side"), F.col("lhs_fold").alias("id")), F.struct(F.lit("rhs").alias("side"), F.col("rhs_fold").alias("id")))).alias("n")).select("file", "n.*")
    return folds.join(named, ["file", "side", "id"], "left_anti")


def split_lines(folds: DataFrame, runs: DataFrame) -> DataFrame:
    """(file, side, line): all starts and ends of folds, and their mirrors across paired runs."""
    own = folds.select("file", "side", F.explode(F.array("start", "end")).alias("line"))
    def mirror(s, o):
        j = own.filter(F.col("side") == s).join(runs, "file").filter((F.col("line") >= F.col(f"{s}_start")) & (F.col("line") <= F.col(f"{s}_start") + F.col("size")))
        return j.select("file", F.lit(o).alias("side"), (F.col("line") - F.col(f"{s}_start") + F.col(f"{o}_start")).alias("line"))

    return own.unionByName(mirror("lhs", "rhs")).unionByName(mirror("rhs", "lhs")).distinct()


def hidden_lines(folds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line) below collapsed folds (start, end, collapsed), each once."""
    return folds.filter("collapsed AND start < end").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("line")).distinct()


def kept_on_both(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file, leaf, line): a leaf's own kept lines and those of its partner, shifted: kept (file, leaf, line), pairs (file, leaf, peer, shift)."""
    peer = pairs.join(kept.select("file", F.col("leaf").alias("peer"), "line"), ["file", "peer"]).select("file", "leaf", (F.col("line") + F.col("shift")).alias("line"))
    return kept.select("file", "leaf", "line").unionByName(peer).distinct()


def root_region(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, end): the root over a side's regions; an empty side ends at 0."""
    return regions.groupBy(*keys).agg(F.coalesce(F.max("end"), F.lit(0)).alias("end"))


def hull(captures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): from the least start to the greatest end of captures."""
    return captures.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def conflicts(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (keys) that queries gave more than one range (start, end)."""
    return ranges.groupBy(*keys).agg(F.count_distinct("start", "end").alias("n")).filter("n > 1").select(*keys)


def row_window(rows: DataFrame, keys: list[str], top: int, bottom: int) -> DataFrame:
    """Rows (keys, row, height) that meet [top, bottom) of the view; rows without height belong to the one after."""
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    y = rows.withColumn("bottom_", F.sum("height").over(w)).withColumn("top_", F.col("bottom_") - F.col("height"))
    meets = (F.col("top_") < bottom) & ((F.col("bottom_") > top) | ((F.col("height") == 0) & (F.col("top_") >= top)))
    return y.filter(meets).drop("top_", "bottom_")


def selection(rows: DataFrame, side: str, first: int, last: int) -> DataFrame:
    """(file, line): a side's lines on rows first to last, each once."""
    return rows.filter(F.col("row").between(first, last) & F.col(side).isNotNull()).select("file", F.col(side).alias("line")).distinct()


def header_tint(regions: DataFrame) -> DataFrame:
    """regions (one_sided, side, collapsed, has_changes) with tint: inserted, removed, modified if it hides a change, else neutral."""
    return regions.withColumn(
        "tint", F.when(F.col("one_sided") & (F.col("side") == "rhs"), "inserted").when(F.col("one_sided"), "removed").when(F.col("collapsed") & F.col("has_changes"), "modified").otherwise("neutral")
    )


def gutter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digits): places that the largest line number needs."""
    return rows.groupBy(*keys).agg(F.length(F.max(F.greatest("lhs", "rhs") + 1).cast("string")).alias("digits"))


def restore_view(saved: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, row): where a saved place (file, key, fold, line) is now: its row, else its fold's, else the next source line's, else the header's row 0."""
    of = lambda c, name: rows.filter(F.col(c).isNotNull()).groupBy("file", c).agg(F.min("row").alias(name))
    after = saved.select("file", "line").join(rows.select("file", F.col("line").alias("l"), F.col("row").alias("r")), "file").filter("l >= line").groupBy("file").agg(F.min_by("r", "l").alias("by_line"))
    j = saved.join(of("key", "by_key"), ["file", "key"], "left").join(of("fold", "by_fold"), ["file", "fold"], "left").join(after, "file", "left")
    return j.select("file", F.coalesce("by_key", "by_fold", "by_line", F.lit(0)).alias("row"))
