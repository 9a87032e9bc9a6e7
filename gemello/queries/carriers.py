"""Tables that the queries run over, made alike in Spark and in SQL from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.sources.snapshots import snapshot

#: SQL of the two snapshots, to be put after WITH.
SNAPSHOTS = """
src AS (
  SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT path, '100644' AS mode, text, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS oid
  FROM src WHERE doc_id % 10 <> 0
), edited AS (
  SELECT CASE WHEN doc_id % 10 = 4 THEN 'moved/' || path ELSE path END AS path,
    CASE WHEN doc_id % 10 = 5 THEN '100755' WHEN doc_id % 10 = 6 THEN '120000' ELSE '100644' END AS mode,
    CASE WHEN doc_id % 10 = 2 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i <> 2), chr(10))
      WHEN doc_id % 10 = 3 THEN text || chr(10) || 'an appended line' ELSE text END AS text
  FROM src WHERE doc_id % 10 <> 1
), head AS (
  SELECT path, mode, text, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS oid FROM edited
)"""

#: SQL of the manifest of those, to be put after SNAPSHOTS.
MANIFEST = (
    SNAPSHOTS
    + """, manifest AS (
  SELECT coalesce(b.path, h.path) AS path,
    CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted'
      WHEN left(b.mode, 2) <> left(h.mode, 2) THEN 'type_changed' ELSE 'modified' END AS status,
    b.path AS lhs_path, h.path AS rhs_path, b.oid AS lhs_oid, h.oid AS rhs_oid, b.mode AS lhs_mode, h.mode AS rhs_mode
  FROM base b FULL OUTER JOIN head h ON b.path = h.path
  WHERE b.path IS NULL OR h.path IS NULL OR b.oid <> h.oid OR b.mode <> h.mode
)"""
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all tasks of a shuffle, for work that takes long per row: a table may be one file that one task reads."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, head): files dropped, added, edited, moved, made executable and made links by doc_id."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    src = documents(spark, sf_dir).select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 10
    base = snapshot(src.filter(k != 0).select("path", "text"))
    cut = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i != 1), "\n")
    head = src.filter(k != 1).select(
        F.when(k == 4, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(k == 5, "100755").when(k == 6, "120000").otherwise("100644").alias("mode"),
        F.when(k == 2, cut).when(k == 3, F.concat("text", F.lit("\nan appended line"))).otherwise(F.col("text")).alias("text"),
    )
    return base, snapshot(head)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text) of all documents' lines, from 0."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))


#: SQL of the same, to be put after WITH.
LINES = """
lines AS (
  SELECT doc_id, i - 1 AS line, l[i] AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(generate_series(1, len(l))) AS u(i)
)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    """The same rows as a SQL VALUES list."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        parts = str(v).replace("'", "''").split("\n")
        return " || chr(10) || ".join(f"'{p}'" for p in parts) if len(parts) == 1 else "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
