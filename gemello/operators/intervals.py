"""Intervals, runs and rankings over lines: window forms that sort once inside a file's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open ranges (keys, start, end) merged where they overlap or touch; empty ones go."""
    r = ranges.filter("start < end")
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def range_total(ranges: Column) -> Column:
    """Lines covered by an array of ranges (start, end)."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned rows (keys, row, kind, lhs, rhs) as runs: consecutive rows of a kind whose lines follow each other on every present side."""
    w = Window.partitionBy(*keys).orderBy("row")
    follows = lambda c: (F.col(c).isNull() & F.lag(c).over(w).isNull()) | (F.col(c) == F.lag(c).over(w) + 1)
    same = (F.lag("kind").over(w) == F.col("kind")) & F.coalesce(follows("lhs"), F.lit(False)) & F.coalesce(follows("rhs"), F.lit(False))
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return (
        rows.withColumn("new", new)
        .withColumn("run", F.sum("new").over(w))
        .groupBy(*keys, "run", "kind")
        .agg(F.min("lhs").alias("lhs_start"), (F.max("lhs") + 1).alias("lhs_end"), F.min("rhs").alias("rhs_start"), (F.max("rhs") + 1).alias("rhs_end"))
    )


def hunk_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, row, changed) that change after one that doesn't."""
    w = Window.partitionBy(*keys).orderBy("row")
    return rows.filter("changed IS NOT NULL").withColumn("start", F.col("changed") & ~F.coalesce(F.lag("changed").over(w), F.lit(False))).filter("start").drop("start")


def merge_hunks(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, seq, side, text): consecutive ones other than both-sided ones as one hunk with each side's text in order."""
    w = Window.partitionBy(*keys).orderBy("seq")
    marked = pieces.withColumn("island", F.sum(F.when(F.col("side") == "both", 1).otherwise(0)).over(w)).filter("side <> 'both'")
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("seq", "text")))), lambda x: x["text"]), "")
    return marked.groupBy(*keys, "island").agg(text("left").alias("lhs"), text("right").alias("rhs"))


def context_lines(lines: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """lines (keys, line, changed) with kept: whether a changed line is at most n lines away. A range frame, no join."""
    w = Window.partitionBy(*keys).orderBy("line").rangeBetween(-n, n)
    return lines.withColumn("kept", F.max(F.col("changed").cast("int")).over(w) == 1)


def hidden_runs(lines: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, start, end, label) of runs of at least so many lines that aren't kept."""
    w = Window.partitionBy(*keys).orderBy("line")
    gap = lines.filter("NOT kept").withColumn("island", F.col("line") - F.row_number().over(w))
    out = gap.groupBy(*keys, "island").agg(F.min("line").alias("start"), (F.max("line") + 1).alias("end")).drop("island")
    return out.filter(F.col("end") - F.col("start") >= least).withColumn("label", F.concat((F.col("end") - F.col("start")).cast("string"), F.lit(" unchanged lines")))


def outermost(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, start, last) that no earlier one covers the start of."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("covered", F.max("last").over(w)).filter("covered IS NULL OR start > covered").drop("covered")


def fill_gaps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Matched line pairs (keys, lhs, rhs) with the lines skipped between two of them, one-sided, left before right: adds seq."""
    w = Window.partitionBy(*keys).orderBy("lhs")
    p = pairs.withColumns({"pl": F.lag("lhs").over(w), "pr": F.lag("rhs").over(w)})
    gap = lambda a, b: F.when(b > a + 1, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(None).cast("long")
    left = F.transform(gap(F.col("pl"), F.col("lhs")), lambda x: F.struct(F.lit(0).alias("o"), x.alias("lhs"), none.alias("rhs")))
    right = F.transform(gap(F.col("pr"), F.col("rhs")), lambda x: F.struct(F.lit(1).alias("o"), none.alias("lhs"), x.alias("rhs")))
    own = F.array(F.struct(F.lit(2).alias("o"), F.col("lhs").cast("long").alias("lhs"), F.col("rhs").cast("long").alias("rhs")))
    return p.select(*keys, F.col("lhs").alias("at"), F.explode(F.concat(F.coalesce(left, F.array().cast("array<struct<o:int,lhs:bigint,rhs:bigint>>")), F.coalesce(right, F.array().cast("array<struct<o:int,lhs:bigint,rhs:bigint>>")), own)).alias("r")).select(*keys, "at", "r.*")


def compact_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One-sided rows (keys, at, o, lhs, rhs) of one gap paired in order: the k-th left line of a gap with its k-th right line."""
    k = F.row_number().over(Window.partitionBy(*keys, "at", "o").orderBy(F.coalesce("lhs", "rhs")))
    return rows.withColumn("k", F.when(F.col("o") < 2, k).otherwise(1 << 30)).groupBy(*keys, "at", "k").agg(F.max("lhs").alias("lhs"), F.max("rhs").alias("rhs"))


def split_runs(runs_: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, run, lhs_start, rhs_start, size) cut at lines (keys, side, line), on both sides at once: (keys, run, piece, offset, size)."""
    inside = lambda side: runs_.join(cuts.filter(F.col("side") == side), keys).filter((F.col("line") > F.col(f"{side}_start")) & (F.col("line") < F.col(f"{side}_start") + F.col("size"))).select(*keys, "run", (F.col("line") - F.col(f"{side}_start")).alias("offset"))
    starts = runs_.select(*keys, "run", F.lit(0).cast("long").alias("offset")).unionByName(inside("lhs")).unionByName(inside("rhs")).distinct()
    w = Window.partitionBy(*keys, "run").orderBy("offset")
    pieces = starts.join(runs_.select(*keys, "run", "size"), [*keys, "run"])
    return pieces.withColumns({"piece": F.row_number().over(w) - 1, "stop": F.coalesce(F.lead("offset").over(w), F.col("size"))}).select(*keys, "run", "piece", "offset", (F.col("stop") - F.col("offset")).alias("size"))


def region_ids(items: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, side, pre, pair_key) with id, dense from 1 over the left side and then the right, and alignment_id, which a pair shares."""
    w = Window.partitionBy(*keys).orderBy("side", "pre")
    out = items.withColumn("id", F.row_number().over(w))
    first = F.min("id").over(Window.partitionBy(*keys, "pair_key"))
    out = out.withColumn("first", F.when(F.col("pair_key").isNotNull(), first).otherwise(F.col("id")))
    return out.withColumn("alignment_id", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first")) - 1).drop("first")


def nest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, id, start, end) with parent_id, the smallest other span that holds it; equal spans nest by id.

    Spans don't cross. Each opens and closes along its file: closes of those that end at a place come first, then opens, the longer ones before,
    then what is empty there. The number open at a span is its depth, and its parent the one that opened the depth above last.
    """
    empty = F.col("start") == F.col("end")
    at = lambda c, phase, size: F.struct(F.col(c).alias("_at"), phase.alias("_phase"), size.alias("_size"))
    opens = at("start", F.when(empty, 2).otherwise(1), -F.col("end").cast("double"))
    closes = at("end", F.when(empty, 3).otherwise(0), F.lit(0.0))
    rows = spans.withColumn("_e", F.explode(F.array(F.struct(F.lit(1).alias("_step"), opens.alias("_o")), F.struct(F.lit(-1).alias("_step"), closes.alias("_o")))))
    rows = rows.select(*spans.columns, "_e._step", "_e._o.*")
    before = Window.partitionBy(*keys).orderBy("_at", "_phase", "_size", "id").rowsBetween(Window.unboundedPreceding, -1)
    deep = rows.withColumn("_deep", F.coalesce(F.sum("_step").over(before), F.lit(0))).filter("_step = 1")
    # a span stands among the children of its depth and opens the depth below
    both = deep.withColumn("_r", F.explode(F.array(F.struct(F.col("_deep").alias("_level"), F.lit(False).alias("_opens")), F.struct((F.col("_deep") + 1).alias("_level"), F.lit(True).alias("_opens")))))
    both = both.select("*", "_r.*")
    level = Window.partitionBy(*keys, "_level").orderBy("_at", "_phase", "_size", "id").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("parent_id", F.last(F.when(F.col("_opens"), F.col("id")), ignorenulls=True).over(level)).filter("NOT _opens")
    return found.select(*spans.columns, "parent_id")


def merge_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Folds (keys, id, depth, start, end, tags) of one line span as one: the innermost, with all their tags."""
    return folds.groupBy(*keys, "start", "end").agg(F.max_by("id", F.struct("depth", "id")).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def whole_line_span(start_line: Column, start_col: Column, end_line: Column, end_col: Column, lines: Column) -> tuple[Column, Column]:
    """The whole lines of a range: from the next one if code stands before it on its first, and with the last only if nothing but white space follows."""
    before = F.substring(F.get(lines, start_line), F.lit(1), start_col)
    after = F.substring(F.get(lines, end_line), end_col + 1, F.lit(1 << 30))
    start = start_line + F.when(before.rlike(r"\S"), 1).otherwise(0)
    end = end_line + F.when(after.rlike(r"\S"), 0).otherwise(1)
    return start, F.greatest(start, F.least(end, F.size(lines)))


def paint(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, end, capture) as disjoint segments, each with the narrowest capture over it, equal neighbours merged."""
    points = spans.select(*keys, F.explode(F.array("start", "end")).alias("p")).distinct()
    seg = points.withColumn("q", F.lead("p").over(Window.partitionBy(*keys).orderBy("p"))).filter("q IS NOT NULL")
    over = seg.join(spans, keys).filter("start <= p AND end >= q")
    best = over.groupBy(*keys, "p", "q").agg(F.min_by("capture", F.struct(F.col("end") - F.col("start"), F.col("capture"))).alias("capture"))
    w = Window.partitionBy(*keys).orderBy("p")
    new = F.when((F.lag("q").over(w) == F.col("p")) & (F.lag("capture").over(w) == F.col("capture")), 0).otherwise(1)
    return best.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(*keys, "run", "capture").agg(F.min("p").alias("start"), F.max("q").alias("end")).drop("run")


def changed_spans(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens (keys, line, start, end, novel) of a leaf as changed spans: a whole line if all of it is novel, else neighbours merged."""
    n = tokens.filter("novel")
    full = tokens.groupBy(*keys, "line").agg(F.bool_and("novel").alias("all_novel"), F.min("start").alias("s"), F.max("end").alias("e"))
    whole = full.filter("all_novel AND e > s").select(*keys, "line", F.lit(0).cast("long").alias("start"), F.col("e").cast("long").alias("end"))
    part = coalesce_ranges(n.join(full.filter("NOT all_novel").select(*keys, "line"), [*keys, "line"], "left_semi").select(*keys, "line", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), [*keys, "line"])
    return whole.unionByName(part)


def ranked_groups(rows: DataFrame) -> DataFrame:
    """rows (text, grp, score) with best, their group's highest score, by which groups go first."""
    return rows.withColumn("best", F.max("score").over(Window.partitionBy("grp"))).select("text", "grp", "score", "best")


def longest_scope(captures: DataFrame, theme: DataFrame) -> DataFrame:
    """(capture, scope): the longest dotted prefix of a capture that a theme has."""
    parts = F.split("capture", "\\.")
    each = captures.select("capture", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("scope"))
    best = each.join(theme, "scope").groupBy("capture").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    return captures.join(best, "capture", "left")


def adjacent_groups(rows: DataFrame) -> DataFrame:
    """Consecutive rows (ord, language) of one language as one: (first_ord, language, n)."""
    w = Window.orderBy("ord")  # a handful of settings
    new = F.when(F.lag("language").over(w).eqNullSafe(F.col("language")), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("g", F.sum("new").over(w)).groupBy("g", "language").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")).drop("g")


def line_set(start_line: Column, end_line: Column, end_col: Column) -> Column:
    """Lines that a range touches; an end at column 0 touches none."""
    last = F.when(end_col == 0, end_line - 1).otherwise(end_line)
    return F.when(last >= start_line, F.sequence(start_line, last)).otherwise(F.array().cast("array<bigint>"))


def row_zip(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items (keys, side, pos, key) of both sides in display order: pairs by key on one row, one-sided ones before the next pair.

    Keys that both sides have stand in the same order on each. Adds row.
    """
    left = items.filter("side = 'lhs'").select(*keys, "key", F.col("pos").alias("lhs"))
    right = items.filter("side = 'rhs'").select(*keys, "key", F.col("pos").alias("rhs"))
    j = left.join(right, [*keys, "key"], "full_outer")
    both = F.col("lhs").isNotNull() & F.col("rhs").isNotNull()
    ahead = lambda c: F.min(F.when(both, F.col(c))).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(c)).rowsBetween(0, Window.unboundedFollowing))
    nxt = F.min(F.when(both, F.col("lhs"))).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("rhs")).rowsBetween(0, Window.unboundedFollowing))
    full = j.withColumn("block", F.when(F.col("lhs").isNotNull(), ahead("lhs")).otherwise(nxt))
    order = [F.coalesce("block", F.lit(1 << 60)), F.when(both, 2).when(F.col("lhs").isNotNull(), 0).otherwise(1), F.coalesce("lhs", "rhs")]
    return full.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).select(*keys, "row", "key", "lhs", "rhs")
