"""Snapshots: tables of (path, mode, oid, text), one row for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_OID = "0" * 40
BLOB, EXECUTABLE, LINK, SUBMODULE = "100644", "100755", "120000", "160000"


def blob_oid(text: Column) -> Column:
    """The content id of a text: SHA-1 over "blob", the length in bytes, a zero byte and the bytes."""
    body = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "UTF-8"), F.lit(b"\x00"), body))


def snapshot(files: DataFrame) -> DataFrame:
    """files (path, text[, mode]) with their content ids."""
    mode = F.coalesce("mode", F.lit(BLOB)) if "mode" in files.columns else F.lit(BLOB)
    return files.select("path", mode.alias("mode"), blob_oid(F.col("text")).alias("oid"), "text")


def empty(spark: SparkSession) -> DataFrame:
    """The empty tree."""
    return spark.createDataFrame([], "path string, mode string, oid string, text string")


def resolve(snapshots: dict[str, DataFrame], name: str | None, spark: SparkSession) -> DataFrame:
    """A named snapshot; no name is the empty tree, an unknown one an error."""
    if name is None:
        return empty(spark)
    if name not in snapshots:
        raise KeyError(f"unknown snapshot {name!r}")
    return snapshots[name]


def overlay(index: DataFrame, deltas: DataFrame) -> DataFrame:
    """Apply working-tree deltas (path, change, mode, text) to an index: removed files go; content and mode changes take their new value.

    Files that the index doesn't have (untracked ones) are left out. Changed content gets a new content id; one join.
    """
    d = deltas.select("path", "change", F.col("mode").alias("new_mode"), F.col("text").alias("new_text"))
    joined = index.join(d, "path", "left").filter(~F.coalesce(F.col("change") == "removed", F.lit(False)))
    text = F.when(F.col("change") == "content", F.col("new_text")).otherwise(F.col("text"))
    mode = F.when(F.col("change").isin("mode", "type"), F.col("new_mode")).otherwise(F.col("mode"))
    oid = F.when(F.col("change") == "content", blob_oid(F.col("new_text"))).otherwise(F.col("oid"))
    return joined.select("path", mode.alias("mode"), oid.alias("oid"), text.alias("text"))


def clean_lines(text: Column) -> Column:
    """A working file's text as it would be stored: line ends of one kind."""
    return F.regexp_replace(text, "\r\n", "\n")


def pair_of_files(spark: SparkSession, before: str | None, after: str | None, path: str) -> DataFrame:
    """The one-row comparison of two texts outside any snapshot; None is an absent side."""
    return spark.createDataFrame([(path, before, after)], "path string, lhs string, rhs string")


def is_binary(content: Column) -> Column:
    """Whether bytes hold a zero byte."""
    return F.position(F.lit(b"\x00"), content) > 0


def content_kind(lhs: Column, rhs: Column) -> Column:
    """binary if either side has a zero byte, else not_utf8 if either isn't valid UTF-8, else text; absent sides don't count."""
    any_of = lambda f: F.coalesce(f(lhs), F.lit(False)) | F.coalesce(f(rhs), F.lit(False))
    bad = any_of(lambda c: F.try_validate_utf8(c.cast("string")).isNull() & c.isNotNull())
    return F.when(any_of(is_binary), "binary").when(bad, "not_utf8").otherwise("text")


def attribute_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path) with the value of the last rule (ord, pattern, value) whose pattern matches, null if none does."""
    hit = files.join(F.broadcast(rules), F.expr("path rlike pattern"), "left")
    return hit.groupBy("path").agg(F.max_by("value", "ord").alias("value"))


def ancestors(commits: DataFrame, start: str) -> DataFrame:
    """(id, distance) of all ancestors of a commit, itself at 0, from (id, parent) rows by breadth-first rounds."""
    from gemello.session import written

    out = commits.sparkSession.createDataFrame([(start, 0)], "id string, distance int")
    frontier, k = out, 0
    while True:
        k += 1
        step = frontier.join(commits, "id").select(F.col("parent").alias("id")).filter("id is not null").distinct()
        frontier = written(step.join(out, "id", "left_anti").select("id", F.lit(k).alias("distance")), "ancestors")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def merge_base(commits: DataFrame, a: str, b: str) -> DataFrame:
    """The common ancestor (id) nearest to both commits; of several equally near the least id."""
    left, right = ancestors(commits, a), ancestors(commits, b)
    both = left.join(right.withColumnRenamed("distance", "other"), "id")
    return both.orderBy(F.col("distance") + F.col("other"), "id").select("id").limit(1)
