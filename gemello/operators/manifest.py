"""The manifest: what changed between two snapshots, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemello.operators.ranking import global_row_number


def manifest(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rows (path, status, lhs_path, rhs_path, lhs_oid, rhs_oid, lhs_mode, rhs_mode) of files that differ; texts stay behind.

    A full outer join on path over the narrow columns alone: Catalyst prunes the texts from both scans.
    """
    side = lambda df, s: df.select("path", *(F.col(c).alias(f"{s}_{c}") for c in ("oid", "mode")), F.lit(True).alias(f"{s}_has"))
    j = side(base, "lhs").join(side(head, "rhs"), "path", "full_outer")
    kind = lambda m: F.substring(m, 1, F.length(m) - 4)  # noqa: E731  the object type without the permission digits
    status = (
        F.when(F.col("lhs_has").isNull(), "added")
        .when(F.col("rhs_has").isNull(), "deleted")
        .when(kind(F.col("lhs_mode")) != kind(F.col("rhs_mode")), "type_changed")
        .otherwise("modified")
    )
    same = F.col("lhs_has").isNotNull() & F.col("rhs_has").isNotNull() & F.col("lhs_oid").eqNullSafe(F.col("rhs_oid")) & F.col("lhs_mode").eqNullSafe(F.col("rhs_mode"))
    return j.filter(~same).select(
        "path", status.alias("status"), F.when(F.col("lhs_has"), F.col("path")).alias("lhs_path"), F.when(F.col("rhs_has"), F.col("path")).alias("rhs_path"), "lhs_oid", "rhs_oid", "lhs_mode", "rhs_mode"
    )


def exact_renames(changes: DataFrame) -> DataFrame:
    """Deleted and added files of one content id as renames, one to one in path order; all other rows as they are."""
    w = Window.partitionBy("status", F.coalesce("lhs_oid", "rhs_oid")).orderBy("path")
    ranked = changes.filter(F.col("status").isin("added", "deleted")).withColumn("n", F.row_number().over(w))
    gone = ranked.filter("status = 'deleted'").select("lhs_path", "lhs_oid", "lhs_mode", "n")
    came = ranked.filter("status = 'added'").select("rhs_path", "rhs_oid", "rhs_mode", F.col("n").alias("m"))
    pairs = gone.join(came, (gone.lhs_oid == came.rhs_oid) & (gone.n == came.m))
    renamed = pairs.select(F.col("rhs_path").alias("path"), F.lit("renamed").alias("status"), "lhs_path", "rhs_path", "lhs_oid", "rhs_oid", "lhs_mode", "rhs_mode")
    used = pairs.select(F.explode(F.array(F.struct(F.lit("deleted").alias("status"), F.col("lhs_path").alias("path")), F.struct(F.lit("added").alias("status"), F.col("rhs_path").alias("path")))).alias("u")).select("u.*")
    return changes.join(used, ["status", "path"], "left_anti").select(renamed.columns).unionByName(renamed)


def similar_pairs(gone: DataFrame, came: DataFrame, least: float = 0.5) -> DataFrame:
    """(lhs_path, rhs_path, shared, score) of texts (path, text) whose lines overlap by at least ``least`` of the longer one's.

    An exact prefix filter keeps common lines out of the join: if two bags of lines share the wanted part, they share one among
    each one's rarest n - ceil(least n) + 1 lines (repeats numbered).
    """
    lines = lambda df: df.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("path", F.xxhash64("line").alias("h"))
    numbered = lambda df: lines(df).withColumn("k", F.row_number().over(Window.partitionBy("path", "h").orderBy("h"))).select("path", F.xxhash64("h", "k").alias("t"))
    left, right = numbered(gone), numbered(came)
    df = left.unionByName(right).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("path")
        r = side.join(df, "t").withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("df", "t"))})
        return r.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("t", F.col("path").alias(name))

    candidates = prefix(left, "lhs_path").join(prefix(right, "rhs_path"), "t").select("lhs_path", "rhs_path").distinct()
    count = lambda side, name, n: side.groupBy(F.col("path").alias(name)).agg(F.count(F.lit(1)).alias(n))
    shared = (
        candidates.join(left.withColumnRenamed("path", "lhs_path"), "lhs_path")
        .join(right.withColumnRenamed("path", "rhs_path"), ["rhs_path", "t"])
        .groupBy("lhs_path", "rhs_path")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    sized = shared.join(count(left, "lhs_path", "nl"), "lhs_path").join(count(right, "rhs_path", "nr"), "rhs_path")
    score = F.col("shared") / F.greatest("nl", "nr")
    return sized.withColumn("score", score).filter(F.col("score") >= least).select("lhs_path", "rhs_path", "shared", "score")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best by score, ties by path."""
    a = Window.partitionBy("lhs_path").orderBy(F.desc("score"), "rhs_path")
    b = Window.partitionBy("rhs_path").orderBy(F.desc("score"), "lhs_path")
    return pairs.withColumns({"a": F.row_number().over(a), "b": F.row_number().over(b)}).filter("a = 1 AND b = 1").drop("a", "b")


def split_conflicts(base: DataFrame, head: DataFrame, unmerged: DataFrame) -> DataFrame:
    """The manifest without unmerged paths, and each of these once as conflicted."""
    clean = manifest(base.join(unmerged, "path", "left_anti"), head.join(unmerged, "path", "left_anti")).select("path", "status")
    return clean.unionByName(unmerged.distinct().select("path", F.lit("conflicted").alias("status")))


def select_paths(changes: DataFrame, patterns: list[str]) -> DataFrame:
    """Changes whose path is one of the patterns, lies below one, or matches one with wildcards; ":" magic is refused."""
    keep = F.lit(not patterns)
    for p in patterns:
        if p.startswith(":"):
            raise ValueError(f"pathspec magic is not supported: {p}")
        if any(c in p for c in "*?["):
            regex = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" else "\\" + c if not c.isalnum() and c not in "/_" else c for c in p)
            keep = keep | F.col("path").rlike(f"(?s)^(?:{regex})$")
        else:
            keep = keep | (F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/")
    return changes.filter(keep)


def ordered(changes: DataFrame) -> DataFrame:
    """The manifest with ord, the place of a row by its new path, else its old one."""
    return global_row_number(changes.withColumn("_key", F.coalesce("rhs_path", "lhs_path")), "_key", "ord").drop("_key")


# The letter of each status in reports.
LETTERS = {"added": "A", "deleted": "D", "renamed": "R", "type_changed": "T", "conflicted": "U", "modified": "M"}


def letter(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), status)


def name_status(changes: DataFrame) -> DataFrame:
    """One line for each change: its letter and path, both paths of a rename."""
    names = F.when(F.col("status") == "renamed", F.concat_ws("\t", "lhs_path", "rhs_path")).otherwise(F.coalesce("rhs_path", "lhs_path"))
    return changes.select(F.concat_ws("\t", letter(F.col("status")), names).alias("line"))


def line_counts(changes: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, added, removed) over bags of lines: how many more of each line the one side has than the other.

    Lines go with weight one and minus one to a single aggregation by (path, line), combined before its shuffle.
    """
    signed = lambda df, key, w: (
        changes.filter(F.col(key).isNotNull()).select("path", F.col(key).alias("file")).join(df.select(F.col("path").alias("file"), "text"), "file")
        .filter(F.octet_length("text") > 0)
        .select("path", F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"), F.lit(w).alias("w"))
    )
    net = signed(base, "lhs_path", -1).unionByName(signed(head, "rhs_path", 1)).groupBy("path", F.xxhash64("line").alias("h")).agg(F.sum("w").alias("w"))
    per = net.groupBy("path").agg(F.sum(F.greatest("w", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("w"), F.lit(0))).alias("removed"))
    return changes.select("path", "status").join(per, "path", "left").select("path", "status", F.coalesce("added", F.lit(0)).cast("long").alias("added"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))


def shortstat(counts: DataFrame) -> DataFrame:
    """The one-line summary; a part that is zero is left out unless both are."""
    t = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("added"), F.lit(0)).alias("a"), F.coalesce(F.sum("removed"), F.lit(0)).alias("r"))
    plural = lambda n, one, many: F.when(F.col(n) == 1, one).otherwise(many)
    head = F.concat(F.lit(" "), F.col("n"), plural("n", " file changed", " files changed"))
    a = F.concat(F.lit(", "), F.col("a"), plural("a", " insertion(+)", " insertions(+)"))
    r = F.concat(F.lit(", "), F.col("r"), plural("r", " deletion(-)", " deletions(-)"))
    none = (F.col("a") == 0) & (F.col("r") == 0)
    return t.select(F.when(F.col("n") == 0, "").otherwise(F.concat(head, F.when((F.col("a") > 0) | none, a).otherwise(""), F.when((F.col("r") > 0) | none, r).otherwise(""))).alias("line"))


def stat_table(counts: DataFrame, width: int = 80) -> DataFrame:
    """(name, line): aligned names and totals with bars of + and -, scaled to the width as a whole."""
    top = counts.agg(F.max(F.length("path")).alias("nw"), F.max(F.col("added") + F.col("removed")).alias("most")).first()
    names, most = top.nw or 0, top.most or 0
    digits = len(str(most))
    scale = max(7, width - (names + digits + 5) if width > names + digits + 5 else width)
    scaled = F.lit(scale <= most)
    j = counts.withColumn("total", F.col("added") + F.col("removed"))
    j = j.withColumn("bars", F.expr(f"(total * {scale} + {most} div 2) div {max(most, 1)}"))
    j = j.withColumn("plus", F.expr("bars * added div greatest(total, 1)"))
    p = F.when(scaled & (F.col("total") > 0), F.greatest(F.col("plus"), F.lit(1))).otherwise(F.col("added"))
    m = F.when(scaled & (F.col("total") > 0), F.greatest(F.col("bars") - F.col("plus"), F.lit(1))).otherwise(F.col("removed"))
    line = F.concat(F.lit(" "), F.rpad("path", names, " "), F.lit(" | "), F.lpad(F.col("total").cast("string"), digits, " "), F.when(F.col("total") > 0, " ").otherwise(""), F.repeat(F.lit("+"), p.cast("int")), F.repeat(F.lit("-"), m.cast("int")))
    return j.select(F.col("path").alias("name"), line.alias("line"))
