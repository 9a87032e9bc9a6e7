"""A whole comparison: manifest, tags, texts, the diff of each file, counts and records.

The shell is relational; the one opaque stage takes rows with both texts of a file and gives back its rows and counts. Texts join the
manifest last and by content id, so that neither the manifest nor its renames carry them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.functions.classify import hidden_reason, with_tags
from gemello.functions.languages import guess, static_fallback
from gemello.operators import alignment, sliders, syntax, treematch
from gemello.operators.manifest import exact_renames, manifest
from gemello.operators.ranking import global_row_number
from gemello.sinks import envelope, record_lines


@dataclass(frozen=True)
class Options:
    """Limits and choices of a comparison."""

    byte_limit: int = 1_000_000
    graph_limit: int = treematch.GRAPH_LIMIT
    ignore_comments: bool = False
    renames: bool = True
    hide: tuple[str, ...] = ("generated", "vendored")
    hide_deleted: bool = False
    overrides: tuple[tuple[str, str], ...] = ()
    context: int = 3

    def __post_init__(self):
        if min(self.byte_limit, self.graph_limit, self.context) < 0:
            raise ValueError("limits are not negative")


def file_pairs(base: DataFrame, head: DataFrame, options: Options = Options()) -> DataFrame:
    """Changed files with both texts, tags, language, whether they are hidden, and why they are compared by lines."""
    changes = manifest(base, head)
    if options.renames:
        changes = exact_renames(changes)
    blob = lambda df, s: df.select(F.col("path").alias(f"{s}_path"), F.col("text").alias(s))
    pairs = changes.join(blob(base, "lhs"), "lhs_path", "left").join(blob(head, "rhs"), "rhs_path", "left")
    keyed = pairs.select(F.coalesce("rhs_path", "lhs_path").alias("file_key"), "status", "lhs_path", "rhs_path", "lhs", "rhs", F.coalesce("rhs", "lhs").alias("_text"))
    out = with_tags(keyed, "file_key", "_text").withColumn("language", guess(F.col("file_key"), F.col("_text"), list(options.overrides))).drop("_text")
    out = out.withColumn("hidden", hidden_reason(F.col("status"), F.col("tags"), list(options.hide), options.hide_deleted))
    providers = [k for k in syntax.PROVIDERS]
    known = F.when(F.col("language").isin(*providers), F.col("language"))
    cause = static_fallback(F.col("hidden").isNotNull(), F.array_contains("tags", "generated"), known, F.coalesce("lhs", F.lit("")), F.coalesce("rhs", F.lit("")), options.byte_limit)
    return out.withColumn("cause", cause)


DIFF = "file_key string, cause string, added long, removed long, rows array<struct<kind:string,lhs:bigint,rhs:bigint>>"


def _without_comments(positions: list[tuple], nodes: Iterable[syntax.Node]) -> list[tuple]:
    """Positions with those inside comments ignored, whole ones and their words."""
    by_line: dict[int, list[tuple[int, int]]] = {}
    for n in nodes:
        for line, start, end in n.spans if n.kind == "comment" else ():
            by_line.setdefault(line, []).append((start, end))
    inside = lambda p: any(start <= p[1] and p[2] <= end for start, end in by_line.get(p[0], ()))
    return [(*p[:3], "ignored", None) if inside(p) else p for p in positions]


def diff_text(lhs: str, rhs: str, language: str | None, cause: str, options: Options) -> tuple[str, int, int, list]:
    """(cause, added, removed, rows) of two texts: by structure if that can be done, else by lines, and why."""
    by_line = alignment.line_positions(lhs, rhs) if lhs != rhs else ([], [])
    added, removed = len(alignment.novel_lines(by_line[1])), len(alignment.novel_lines(by_line[0]))
    own = by_line
    if cause == "structural" and lhs != rhs:
        try:
            a, b, changes = treematch.structural(lhs, rhs, language, options.graph_limit)
            sliders.correct(a, b, changes, language)
            left, right = ({n.id: n for n in syntax.preorder(t)} for t in (a, b))
            own = tuple(treematch.tree_positions(t, s, changes, o, words=True) for t, s, o in ((a, "lhs", right), (b, "rhs", left)))
            if options.ignore_comments:
                own = tuple(_without_comments(ps, ns.values()) for ps, ns in zip(own, (left, right), strict=True))
        except syntax.ParseError:
            cause = "parse_error"
        except treematch.TooComplex:
            cause = "too_complex"
    nl, nr = alignment.novel_lines(own[0]), alignment.novel_lines(own[1])
    rows = alignment.rows(lhs, rhs, own) if lhs != rhs else alignment.rows(lhs, rhs)
    kinds = [("unchanged" if i is not None and j is not None and i not in nl and j not in nr else "novel", i, j) for i, j in rows]
    return cause, added, removed, kinds


def diffs(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """The diff of each pair of file_pairs(): no shuffle, a row in and a row out."""

    def run(batches):
        for b in batches:
            out = []
            for key, lhs, rhs, language, cause in zip(*(c.to_pylist() for c in b.columns), strict=True):
                why, added, removed, rows = diff_text(lhs or "", rhs or "", language, cause, options)
                out.append((key, why, added, removed, [{"kind": k, "lhs": i, "rhs": j} for k, i, j in rows]))
            if out:
                key, why, added, removed, rows = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("lhs", pa.int64()), ("rhs", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(why), pa.array(added, pa.int64()), pa.array(removed, pa.int64()), pa.array(rows, kind)], ["file_key", "cause", "added", "removed", "rows"])

    return pairs.select("file_key", "lhs", "rhs", "language", "cause").mapInArrow(run, DIFF)


def records(base: DataFrame, head: DataFrame, options: Options = Options()) -> DataFrame:
    """(seq, line): the record stream of a comparison, files in order of their keys."""
    pairs = file_pairs(base, head, options)
    done = pairs.select("file_key", "status", "tags", "hidden").join(diffs(pairs, options), "file_key")
    own = done.select("file_key", "status", "tags", "hidden", "cause", "added", "removed", "rows", F.lit("file").alias("type"))
    lines = record_lines(own, ["type", "file_key", "status", "tags", "hidden", "cause", "added", "removed", "rows"])
    ranked = global_row_number(lines.select("file_key", "line", F.lit(False).alias("failed")), "file_key", "ord").withColumn("ord", F.col("ord") - 1)
    return envelope(pairs.select("file_key"), ranked)


@dataclass
class Pipeline:
    """Shape steps in order: each takes and gives a region table. A step that fails ends the run under its name."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def run(self, regions: DataFrame) -> DataFrame:
        for name, step in self.steps:
            try:
                regions = step(regions)
            except Exception as e:
                raise RuntimeError(f"shape step {name} failed: {e}") from e
        return regions


def render(diff: DataFrame, pairs: DataFrame, context: int = 3) -> DataFrame:
    """(file_key, row, line): numbered rows side by side; runs of unchanged rows far from a change are one row each."""
    from pyspark.sql import Window

    rows = diff.select("file_key", F.posexplode("rows").alias("row", "r")).select("file_key", F.col("row").cast("long").alias("row"), "r.*")
    near = Window.partitionBy("file_key").orderBy("row").rangeBetween(-context, context)
    kept = rows.withColumn("kept", F.max((F.col("kind") != "unchanged").cast("int")).over(near) == 1)
    island = kept.withColumn("island", F.when(~F.col("kept"), F.col("row") - F.row_number().over(Window.partitionBy("file_key", "kept").orderBy("row"))))
    side = lambda s: pairs.select("file_key", F.posexplode(F.split(F.coalesce(s, F.lit("")), "\n")).alias("n", "t")).select("file_key", F.col("n").cast("long").alias(s), F.col("t").alias(f"{s}_text"))
    shown = island.filter("kept").join(side("lhs"), ["file_key", "lhs"], "left").join(side("rhs"), ["file_key", "rhs"], "left")
    cell = lambda s: F.concat(F.lpad(F.coalesce((F.col(s) + 1).cast("string"), F.lit("")), 5, " "), F.lit(" "), F.coalesce(f"{s}_text", F.lit("")))
    mark = F.when(F.col("kind") == "unchanged", " ").otherwise("*")
    lines = shown.select("file_key", "row", F.concat(mark, cell("lhs"), F.lit(" │ "), cell("rhs")).alias("line"))
    folds = island.filter("NOT kept").groupBy("file_key", "island").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    return lines.unionByName(folds.select("file_key", "row", F.concat(F.lit("  ··· "), F.col("n").cast("string"), F.lit(" unchanged lines")).alias("line")))
