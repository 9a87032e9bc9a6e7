"""Saved record streams: decoding and the checks of the protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
MAX_RECORD = 128 << 20
SCHEMA = "type string, version int, files bigint, file_key string, status string, tags array<string>, hidden string, cause string, added bigint, removed bigint, succeeded bigint, failed bigint"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a stream saved as text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def decode(lines: DataFrame) -> DataFrame:
    """Records of lines; fields that aren't known are let go, a line that is no JSON or too long has type invalid."""
    r = F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"})
    bad = (F.octet_length("line") > MAX_RECORD) | r["type"].isNull()
    return lines.withColumn("r", r).select(*[c for c in lines.columns if c != "line"], F.when(bad, "invalid").otherwise(F.col("r.type")).alias("type"), *[F.col(f"r.{f.split()[0]}") for f in SCHEMA.split(", ")[1:]])


def problems(records: DataFrame) -> DataFrame:
    """(problem) of a stream of records (seq, type, ...): starts once and first, known version, complete last with right counts, no bad or repeated file."""
    t = records.agg(
        F.count_if(F.col("type") == "start").alias("starts"), F.min_by("type", "seq").alias("first"), F.max_by("type", "seq").alias("last"),
        F.max(F.when(F.col("type") == "start", F.col("version"))).alias("version"), F.max(F.when(F.col("type") == "start", F.col("files"))).alias("listed"),
        F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "complete").alias("completes"), F.count_distinct(F.when(F.col("type") == "file", F.col("file_key"))).alias("keys"),
        F.count_if(F.col("type") == "invalid").alias("invalid"), F.max(F.when(F.col("type") == "complete", F.col("succeeded") + F.col("failed"))).alias("done"),
    )
    checks = {
        "no start": F.col("starts") == 0,
        "more than one start": F.col("starts") > 1,
        "start is not first": (F.col("starts") > 0) & (F.col("first") != "start"),
        "unknown version": F.col("version") != VERSION,
        "incomplete": F.col("completes") == 0,
        "record after complete": (F.col("completes") > 1) | (F.col("completes") == 1) & (F.col("last") != "complete"),
        "wrong counts": (F.col("done") != F.col("files")) | (F.col("listed") != F.col("files")),
        "repeated file": F.col("keys") != F.col("files"),
        "invalid record": F.col("invalid") > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return t.select(F.explode(found).alias("problem"))
