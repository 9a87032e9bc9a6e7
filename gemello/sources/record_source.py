"""Record streams as a data source of Spark: files of lines that tasks write, and byte ranges of them that tasks read.

A written stream is a folder with a file of each task, one for the start record and one for the complete record, which the commit writes with
the counts of all tasks, and a list of these files in order, which the commit writes last. A folder without that list was never committed. A task
that fails leaves a file that no list names, and an aborted write leaves none.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gemello.sources.records import VERSION

NAME = "gemello_records"
LIST = "_files.json"
#: Bytes of a range, those of the ranges that a task reads at least, and bytes that are read at once, at most and at least.
SPLIT = 64 << 20
TASK = 8 << 20
BLOCK = 1 << 20
LEAST = 4 << 10
ROWS = 1024


@dataclass
class Span:
    """Ranges of one file that follow each other: of split bytes each, from start to end."""

    file: int
    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: the lines that begin in each range of its spans. Short ranges make neither more tasks nor larger ones to plan."""

    split: int
    of: list[Span]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file, and the records and failures in it."""

    part: int
    name: str
    records: int
    failed: int


class RecordStream(DataSource):
    """Options: path, a URI of a folder; split, the bytes of a range. A read has (file, offset, line), a write takes (line, failed)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file int, offset long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["path"], overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        system, folder = fs.FileSystem.from_uri(self.path)
        most = -(-TASK // self.split) * self.split
        out, held = [], most
        for k, name in enumerate(listed(system, folder)):
            size, at = system.get_file_info(f"{folder}/{name}").size, 0
            while at < size:
                if held >= most:
                    out.append(Ranges(self.split, []))
                    held = 0
                # whole ranges, but for a file's last
                end = min(size, at + max(self.split, (most - held) // self.split * self.split))
                out[-1].of.append(Span(k, name, at, end))
                held, at = held + end - at, end
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for span in partition.of:
            with system.open_input_file(f"{folder}/{span.path}") as f:
                for start in range(span.start, span.end, partition.split):
                    for offset, line in lines(f, start, min(start + partition.split, span.end)):
                        rows.append((span.file, offset, line.decode("utf-8", "replace")))
                        held += len(line)
                        if len(rows) == ROWS or held > BLOCK:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    file, offset, line = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), pa.array(offset, pa.int64()), pa.array(line, pa.string())], ["file", "offset", "line"])


def listed(system: fs.FileSystem, folder: str) -> list[str]:
    """The files of a stream in order: those that its commit lists, or else all in the folder by name."""
    at = f"{folder}/{LIST}"
    if system.get_file_info(at).type == fs.FileType.File:
        with system.open_input_file(at) as f:
            return json.loads(f.read())
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines of an open file that begin in [start, end), without blank ones. The last may end beyond.

    Of a line of the range before, no more is read than this range, however long the line is.
    """
    f.seek(max(0, start - 1))
    at, rest, first = max(0, start - 1), [], start > 0
    read, size = at, min(BLOCK, max(end - start, LEAST))
    while True:
        block = f.read(size)
        read += len(block)
        pieces = block.split(b"\n")
        for k, piece in enumerate(pieces):
            rest.append(piece)
            if k < len(pieces) - 1 or not block:
                line = b"".join(rest)
                rest = []
                if first:
                    first = False  # the end of a line of the range before
                elif at >= end:
                    return
                elif line.strip():
                    yield at, line
                at += len(line) + 1
        if not block or (read if first else at) >= end:
            return


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        part, records, failed = TaskContext.get().partitionId(), 0, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.ndjson"
        with system.open_output_stream(f"{folder}/{name}") as f:
            for b in iterator:
                columns = b.to_pydict()
                f.write("".join(f"{x}\n" for x in columns["line"]).encode())
                records += b.num_rows
                failed += sum(map(bool, columns["failed"]))
        return Written(part, name, records, failed)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        if not self.overwrite and system.get_file_info(f"{folder}/{LIST}").type == fs.FileType.File:
            self.abort(messages)
            raise FileExistsError(f"{self.path} has a stream; overwrite it or take another folder")
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        records, failed = sum(m.records for m in done), sum(m.failed for m in done)
        mark = uuid.uuid4().hex[:12]
        ends = {f"start-{mark}.ndjson": {"type": "start", "version": VERSION, "files": records}, f"complete-{mark}.ndjson": {"type": "complete", "succeeded": records - failed, "failed": failed}}
        system.create_dir(folder, recursive=True)
        for name, record in ends.items():
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write((json.dumps(record, separators=(",", ":")) + "\n").encode())
        start, complete = ends
        with system.open_output_stream(f"{folder}/_{mark}.json") as f:
            f.write(json.dumps([start, *[m.name for m in done if m.records], complete]).encode())
        system.move(f"{folder}/_{mark}.json", f"{folder}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{folder}/{m.name}").type == fs.FileType.File:
                system.delete_file(f"{folder}/{m.name}")


def register(spark: SparkSession) -> None:
    """Make the source known to a session; what plans it, beside the executors, need not have this package on its path."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(RecordStream)


def write_stream(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write records (line, failed) as a stream: a start record, the lines of each task, a complete record with the counts."""
    register(records.sparkSession)
    records.select("line", "failed").write.format(NAME).option("path", path).mode("overwrite" if overwrite else "append").save()


def read_stream(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, offset, line) of a stream's records; their order is that of file and offset."""
    register(spark)
    return spark.read.format(NAME).option("path", path).option("split", str(split)).load()
