"""Records, renderings and results that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a failure is called on the wire.
ERROR_CODES = {"not_utf8": "not_utf8", "conflict": "conflicted", "missing": "missing_blob", "unsupported": "unsupported_mode", "io": "io"}


def error_code(cause: Column) -> Column:
    """The wire code of a cause, internal for any other."""
    known = F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(cause, F.lit(""))), F.lit("internal"))


def exit_code(changes: DataFrame, failed: bool = False) -> DataFrame:
    """One row: 2 after a failure, else 1 if anything changed, else 0."""
    return changes.agg((F.lit(2) if failed else F.when(F.count(F.lit(1)) > 0, 1).otherwise(0)).alias("code"))


def escape_separators(text: Column) -> Column:
    """JSON text with the three line separators beyond ASCII written as escapes, so that a record is one line everywhere."""
    for c in ("\u0085", "\u2028", "\u2029"):
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return text


def record_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with a column line: the columns as compact JSON, defaults (null, false, empty) left out."""
    slim = []
    for c in columns:
        kind = rows.schema[c].dataType.typeName()
        empty = F.size(c) == 0 if kind in ("array", "map") else ~F.col(c) if kind == "boolean" else F.lit(False)
        slim.append(F.when(~F.coalesce(empty, F.lit(True)), F.col(c)).alias(c))
    return rows.withColumn("line", escape_separators(F.to_json(F.struct(*slim))))


def envelope(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(seq, line) of a stream: start with the number of files, one record for each file in completion order, complete with counts.

    files: (ord, line, failed). Start and footer are one row each.
    """
    start = manifest.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("start").alias("type"), F.lit(3).alias("version"), F.col("n").alias("files"))).alias("line"))
    body = files.select((F.col("ord") + 1).cast("long").alias("seq"), "line")
    done = files.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad")).select((F.col("n") + 1).alias("seq"), F.to_json(F.struct(F.lit("complete").alias("type"), (F.col("n") - F.col("bad")).alias("succeeded"), F.col("bad").alias("failed"))).alias("line"))
    return start.unionByName(body).unionByName(done)


def write_records(records: DataFrame, path: str) -> None:
    """Write (seq, line) as text files whose order of names and lines is that of seq."""
    records.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.text(path)
