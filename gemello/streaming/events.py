"""Comparisons over streams: file pairs that arrive, their records, and the state of a manifest's slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gemello.operators.alignment import textual_counts
from gemello.sinks import record_lines


def stream_pairs(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """File pairs (file_key, lhs, rhs) as they are put into a folder of Parquet files; the number for each trigger bounds the work at once."""
    return spark.readStream.schema("file_key string, lhs string, rhs string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counted(pairs: DataFrame) -> DataFrame:
    """Textual counts of each pair: a map over the stream, without state."""
    return textual_counts(pairs)


def write_records(counts: DataFrame, path: str, checkpoint: str):
    """Append records to text files, one batch at a time; a batch that is repeated after a failure writes its own folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        lines = record_lines(batch.withColumn("type", F.lit("file")), ["type", *batch.columns])
        lines.select("line").write.mode("overwrite").text(f"{path}/batch={number:08d}")

    return counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slot_updates(records: DataFrame) -> DataFrame:
    """(comparison, listed, loaded, duplicates, unknown) after each batch of records (comparison, type, file_key), kept as state by comparison.

    A start record lists a file key of its own row each; the state holds the keys of one comparison.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        listed, seen, twice, unknown = (set(x) if k < 2 else x for k, x in enumerate(state.get)) if state.exists else (set(), set(), 0, 0)
        for b in batches:
            rows = b.sort_values("type", ascending=False, key=lambda c: c == "start")
            for kind, name in zip(rows["type"], rows["file_key"], strict=True):
                if kind == "start":
                    listed.add(name)
                elif name in seen:
                    twice += 1
                elif name in listed:
                    seen.add(name)
                else:
                    unknown += 1
        state.update((sorted(listed), sorted(seen), twice, unknown))
        yield pd.DataFrame({"comparison": [key[0]], "listed": [len(listed)], "loaded": [len(seen)], "duplicates": [twice], "unknown": [unknown]})

    return records.groupBy("comparison").applyInPandasWithState(
        step, "comparison string, listed long, loaded long, duplicates long, unknown long", "listed array<string>, seen array<string>, twice long, unknown long", "update", GroupStateTimeout.NoTimeout
    )


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type of a stream of events (ts, event_type) with a watermark for late ones."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_to_memory(stream: DataFrame, name: str, mode: str = "append"):
    """Run a stream over what is there, into a memory table of that name."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
