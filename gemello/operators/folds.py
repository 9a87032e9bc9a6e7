"""Folds and what a viewer derives from them: ranges, order, strict nesting, sets of fold states, coloured segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemello.operators.scan import scan


def fold_range(override: Column, opens: Column, closes: Column, pieces: Column) -> Column:
    """The range of a fold as struct (start_line, start_col, end_line, end_col); null if it holds nothing.

    override is such a struct or null. opens and closes are a list's delimiter spans, arrays of structs (line, start, end): its range lies
    between them. An atom has pieces, such spans too, and its range is from its first to its last.
    """
    first = F.coalesce(F.try_element_at(opens, F.lit(-1))["line"], F.try_element_at(pieces, F.lit(1))["line"])
    column = F.coalesce(F.try_element_at(opens, F.lit(-1))["end"], F.try_element_at(pieces, F.lit(1))["start"])
    last = F.coalesce(F.try_element_at(closes, F.lit(1))["line"], F.try_element_at(pieces, F.lit(-1))["line"])
    stop = F.coalesce(F.try_element_at(closes, F.lit(1))["start"], F.try_element_at(pieces, F.lit(-1))["end"])
    own = F.struct(first.alias("start_line"), column.alias("start_col"), last.alias("end_line"), stop.alias("end_col"))
    r = F.coalesce(override, own)
    return F.when(F.struct(r["start_line"], r["start_col"]) < F.struct(r["end_line"], r["end_col"]), r)


def fold_order(folds: DataFrame, keys: list[str]) -> DataFrame:
    """folds (keys, start, end, depth, id) with ord from 1: by start, the longer first, then the less deep, then by id."""
    return folds.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start", F.desc("end"), "depth", "id")))


class _Clip:
    """A stack over one file's folds by start."""

    def __init__(self) -> None:
        self.open: list[list] = []  # rows that may still be clipped, with start and end last

    def add(self, row: tuple) -> list[tuple]:
        *_, start, end = row
        done = []
        while self.open and (self.open[-1][-1] <= start or self.open[-1][-2] < start and self.open[-1][-1] < end):
            top = self.open.pop()  # closed before this one, or crossed by it
            done.append((*top[:-1], min(top[-1], start)))
        self.open.append(list(row))
        return [r for r in done if r[-2] < r[-1]]

    def end(self) -> list[tuple]:
        return [tuple(r) for r in self.open if r[-2] < r[-1]]


def strict_nesting(folds: DataFrame, keys: list[str]) -> DataFrame:
    """folds (keys, id, start, end) nested or apart: where two cross, the earlier ends at the later's start. Empty ones go.

    One pass with a stack over a file's folds by start; columns beyond those four are dropped.
    """
    own = folds.select(*keys, "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return scan(own, keys, ["start", F.desc("end"), "id"], _Clip, own.schema)


def fold_sets(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold_state_id, foldable, start_collapsed): fold states of regions (keys, is_leaf, foldable_leaf, collapsed, fold_state_id).

    Every fold can be folded and those leaves that say so; a state starts collapsed if any region of it does.
    """
    can = ~F.col("is_leaf") | F.col("foldable_leaf")
    return regions.groupBy(*keys, "fold_state_id").agg(F.bool_or(can).alias("foldable"), F.bool_or("collapsed").alias("start_collapsed"))


def gap_states(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold_state_id) of context gaps among regions (keys, side, pre, last, is_leaf, collapsed, tagged, paired, changed, alignment_id, fold_state_id).

    A gap starts collapsed, has no tags, is paired, and all leaves under it are paired and unchanged on both sides. Counts run along
    the pre-order, so that no region meets all its descendants.
    """
    touched = regions.filter("is_leaf AND changed").select(*keys, "alignment_id").distinct().withColumn("_touched", F.lit(True))
    own = regions.join(touched, [*keys, "alignment_id"], "left")
    bad = F.when(F.col("is_leaf") & (~F.col("paired") | F.coalesce("_touched", F.lit(False))), 1).otherwise(0)
    w = Window.partitionBy(*keys, "side").orderBy("pre")
    upto = own.withColumn("_bad", bad).withColumn("_upto", F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = upto.select(*keys, "side", F.col("pre").alias("last"), F.col("_upto").alias("_at"))
    can = upto.filter("collapsed AND NOT tagged AND paired").join(at, [*keys, "side", "last"])
    return can.filter("_at = _upto - _bad").select(*keys, "fold_state_id").distinct()


def nested_states(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold_state_id, nested): the fold states inside folds of each state, over regions (keys, side, pre, last, parent_pre, is_leaf, fold_state_id).

    Ancestors are met a level at a time by equal keys, as many rounds as the regions are deep; each round is written.
    """
    from gemello.session import written

    up = regions.select(*keys, "side", F.col("pre").alias("at"), "parent_pre", F.col("fold_state_id").alias("state"), "is_leaf")
    found, level = None, regions.filter("parent_pre IS NOT NULL AND NOT is_leaf").select(*keys, "side", F.col("parent_pre").alias("at"), F.col("fold_state_id").alias("nested"))
    while True:
        met = written(level.join(up, [*keys, "side", "at"]), "nested")
        own = met.filter("NOT is_leaf AND state <> nested").select(*keys, F.col("state").alias("fold_state_id"), "nested")
        found = own if found is None else found.unionByName(own)
        level = met.filter("parent_pre IS NOT NULL").select(*keys, "side", F.col("parent_pre").alias("at"), "nested")
        if level.isEmpty():
            return found.distinct()


def placeholder_rows(files: DataFrame) -> DataFrame:
    """(file_index, key, label, load): the two rows that stand for each hidden file of files (file_index, label)."""
    # What the rows say.
    why = F.when(F.coalesce("label", F.lit("")) == "", "Hidden by default").otherwise(F.col("label"))
    row = lambda suffix, label, load: F.struct(F.concat(F.col("file_index").cast("string"), F.lit(suffix)).alias("key"), label.alias("label"), F.lit(load).alias("load"))
    rows = F.array(row(":load", F.lit("Load diff"), True), row(":why", why, False))
    return files.select("file_index", F.explode(rows).alias("r")).select("file_index", "r.*")


def line_segments(size: Column, syntax: Column, changed: Column) -> Column:
    """A line of size bytes cut at the bounds of all its spans: array of (start, end, capture, emphasized).

    syntax is an array of structs (start, end, capture), of which the narrowest over a segment counts, the first of equals; changed one
    of structs (start, end). All of a line is in its row, so nothing is shuffled.
    """
    ends = lambda spans: F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), size), ends(syntax), ends(changed))))
    numbered = F.transform(syntax, lambda s, i: F.struct((s["end"] - s["start"]).alias("width"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end"), s["capture"].alias("capture")))
    pairs = F.arrays_zip(F.slice(bounds, 1, F.size(bounds) - 1).alias("start"), F.slice(bounds, 2, F.size(bounds) - 1).alias("end"))

    def segment(p):
        over = lambda s: (s["start"] <= p["start"]) & (s["end"] >= p["end"])
        best = F.array_min(F.filter(numbered, over))
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), best["capture"].alias("capture"), F.exists(changed, over).alias("emphasized"))

    return F.transform(pairs, segment)


def edge_spans(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): spans (line, start, end) of a subtree's first and last tokens, of tokens (keys, ord, line, start, end)."""
    span = F.struct("line", "start", "end")
    return tokens.groupBy(*keys).agg(F.min_by(span, "ord").alias("first"), F.max_by(span, "ord").alias("last"))


def node_gap(last: Column, first: Column) -> Column:
    """(lines, columns) between a node's last span and the next one's first: columns only on one line, zeros if either is null."""
    same = last["line"] == first["line"]
    lines = F.when(last.isNull() | first.isNull() | same, 0).otherwise(first["line"] - last["line"])
    return F.struct(lines.cast("long").alias("lines"), F.when(same, first["start"] - last["end"]).otherwise(0).cast("long").alias("columns"))


def common_words(parts: Column) -> Column:
    """Whether words have enough in common to be shown one by one: parts is an array of structs (kind: both or else, word)."""
    both = F.size(F.filter(parts, lambda p: (p["kind"] == "both") & (p["word"] != " ")))
    return (both > 2) & (2 * both >= F.size(F.filter(parts, lambda p: p["kind"] != "both")))


class _Increasing:
    """The last pair that was taken."""

    def __init__(self) -> None:
        self.high = (-1, -1)

    def add(self, row: tuple) -> list[tuple]:
        *key, _, lhs, rhs = row
        if lhs > self.high[0] and rhs > self.high[1]:
            self.high = (lhs, rhs)
            return [(*key, lhs, rhs)]
        return []

    def end(self) -> list[tuple]:
        return []


def increasing_pairs(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lhs, rhs): of positions (keys, seq, lhs, rhs) in their order, those beyond the last one taken on both sides."""
    own = positions.filter("rhs IS NOT NULL").select(*keys, "seq", "lhs", "rhs")
    return scan(own, keys, ["seq"], _Increasing, own.drop("seq").schema)


def blank_pairs(pairs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lhs, rhs): pairs and the equal blank lines right before each, after the pair before it; lines are (keys, side, line, text).

    How many blank lines end above a line is a running maximum of those that aren't blank; the least of both sides' counts is paired.
    """
    before = Window.partitionBy(*keys, "side").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    blanks = F.col("line") - 1 - F.coalesce(F.max(F.when(F.col("text") != "", F.col("line"))).over(before), F.lit(-1))
    run = lines.withColumn("_n", blanks)
    side = lambda s: run.filter(F.col("side") == s).select(*keys, F.col("line").alias(s), F.col("_n").alias(f"_{s}"))
    order = Window.partitionBy(*keys).orderBy("lhs")
    free = lambda s: F.col(s) - F.coalesce(F.lag(s).over(order), F.lit(-1)) - 1
    own = pairs.withColumns({"_fl": free("lhs"), "_fr": free("rhs")}).join(side("lhs"), [*keys, "lhs"]).join(side("rhs"), [*keys, "rhs"])
    n = F.least("_fl", "_fr", "_lhs", "_rhs")
    return own.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n))).select(*keys, (F.col("lhs") - F.col("_k")).alias("lhs"), (F.col("rhs") - F.col("_k")).alias("rhs"))


def with_opposite_lines(pairs: DataFrame, novel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, lhs, rhs): pairs in order, with the right side's novel lines (keys, rhs) that no pair has alone before the next pair."""
    lone = novel.join(pairs.select(*keys, "rhs"), [*keys, "rhs"], "left_anti").distinct().withColumn("lhs", F.lit(None).cast("long"))
    both = pairs.select(*keys, "lhs", "rhs").unionByName(lone)
    return both.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("rhs")).cast("long"))
