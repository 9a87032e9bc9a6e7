"""Record files by byte ranges, streams in chunks, JSON members, against what is done on one machine."""

import io
import json
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from gemello.operators.variants import flatten
from gemello.session import shared_dir
from gemello.sources import record_source as rs
from gemello.sources.records import decode, problems
from gemello.streaming import chunks


def test_every_line_belongs_to_one_range(monkeypatch):
    rng = random.Random(3)
    for block in (1, 3, 1 << 20):
        monkeypatch.setattr(rs, "BLOCK", block)
        for _ in range(60):
            data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", b"\n\n", "é".encode()]) for _ in range(rng.randrange(30)))
            want, at = [], 0
            for line in data.split(b"\n"):
                if line.strip():
                    want.append((at, line))
                at += len(line) + 1
            size = rng.randrange(1, 9)
            got = [x for a in range(0, len(data), size) for x in rs.lines(io.BytesIO(data), a, min(a + size, len(data)))]
            assert got == want


def records(spark, n, failed=()):
    rows = [(json.dumps({"type": "file", "file_key": f"k{i}", "text": "é\n" * (i % 40)}, separators=(",", ":"), ensure_ascii=False), i in failed) for i in range(n)]
    return spark.createDataFrame(rows, "line string, failed boolean")


def test_a_written_stream_reads_back_whole(spark):
    path = shared_dir(spark, "stream")
    rs.write_stream(records(spark, 500, {3, 4}).repartition(6), path)
    for split in (100, 5000, rs.SPLIT):
        back = decode(rs.read_stream(spark, path, split)).withColumn("seq", F.struct("file", "offset"))
        assert problems(back).count() == 0
        rows = back.orderBy("seq").collect()
        assert [rows[0].type, rows[-1].type] == ["start", "complete"] and (rows[0].files, rows[-1].succeeded, rows[-1].failed) == (500, 498, 2)
        assert {r.file_key for r in rows[1:-1]} == {f"k{i}" for i in range(500)}
    with pytest.raises(Exception, match="has a stream"):
        rs.write_stream(records(spark, 3), path)
    rs.write_stream(records(spark, 3), path, overwrite=True)
    assert rs.read_stream(spark, path).count() == 5
    empty = shared_dir(spark, "stream")
    rs.write_stream(records(spark, 0), empty)
    assert problems(decode(rs.read_stream(spark, empty)).withColumn("seq", F.struct("file", "offset"))).count() == 0


def test_short_ranges_make_no_more_tasks(spark):
    path = shared_dir(spark, "stream")
    rs.write_stream(records(spark, 500).repartition(6), path)
    df = rs.read_stream(spark, path, 100)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 502


def test_many_ranges_are_little_to_plan(tmp_path):
    with open(tmp_path / "part-0", "wb") as f:
        f.truncate(1 << 32)
    (tmp_path / "part-1").write_bytes(b"x" * 70)
    tasks = rs.RecordReader(f"file://{tmp_path}", 20_000).partitions()
    assert len(tasks) <= 600 and len(pickle.dumps(tasks)) < 200_000
    spans = [s for t in tasks for s in t.of]
    assert [(s.file, s.start) for s in spans] == [(0, 0), *((s.file, s.end) for s in spans[:-2]), (1, 0)] and (spans[-2].end, spans[-1].end) == (1 << 32, 70)


def test_a_range_within_a_line_reads_no_further():
    data = io.BytesIO(b"a" * 3_000_000 + b"\nb\n")
    assert list(rs.lines(data, 10_000, 30_000)) == [] and data.tell() < 60_000
    assert list(rs.lines(data, 2_990_000, 3_000_002)) == [(3_000_001, b"b")]


def test_an_aborted_stream_leaves_no_list(spark):
    path = shared_dir(spark, "stream")
    bad = records(spark, 50).repartition(2).withColumn("line", F.when(F.col("line").contains("k7"), F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        rs.write_stream(bad, path)
    folder = path.removeprefix("file://")
    assert not os.path.exists(f"{folder}/{rs.LIST}")


def found(spark, lines):
    rows = [(k, line) for k, line in enumerate(lines)]
    return {r.problem for r in problems(decode(spark.createDataFrame(rows, "seq long, line string"))).collect()}


def test_problems_of_a_stream(spark):
    start, file, done = '{"type":"start","version":3,"files":1}', '{"type":"file","file_key":"a"}', '{"type":"complete","succeeded":1,"failed":0}'
    assert found(spark, [start, file, done]) == set()
    assert found(spark, [start, file]) == {"incomplete"}
    assert found(spark, [start, done, file]) == {"record after complete"}
    assert found(spark, [start, file, done, done]) == {"record after complete"}
    assert found(spark, [file, start, done]) == {"start is not first"}


def run_chunks(spark, rows, files, most=1 << 20):
    folder, out = shared_dir(spark, "chunks"), shared_dir(spark, "out")
    for part in range(files):
        own = [(s, n, b, 1_700_000_000 + t) for k, (s, n, b, t) in enumerate(rows) if k * files // len(rows) == part]
        spark.createDataFrame(own, "stream string, n long, bytes binary, at long").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("stream string, n long, bytes binary, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        chunks.run_to_files(chunks.records(stream, "1 hour", most), out, shared_dir(spark, "state"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {}
    for r in spark.read.schema(chunks.OUT).parquet(out).orderBy("stream", "seq").collect():
        got.setdefault(r.stream, []).append((r.seq, r.line, r.problem))
    return got


def test_chunks_become_records(spark):
    rng = random.Random(5)
    done = '{"type":"complete"}'
    lines = {s: [json.dumps({"type": "file", "text": "é€" * rng.randrange(30)}, ensure_ascii=False) for _ in range(8)] + [done] for s in "abcd"}
    rows = []
    for s, own in lines.items():
        data = "\n\n".join(own).encode() + b"\n" * (s == "a")
        cut = [data[k : k + 7] for k in range(0, len(data), 7)]
        cut = cut[: len(cut) // 2] if s == "c" else cut
        own_rows = [(s, n, b, 1) for n, b in enumerate(cut)] + [(s, len(cut), None, 1)]
        rows += own_rows[:-1] if s == "d" else own_rows
    rows += [rows[5], rows[90]]  # once more
    rng.shuffle(rows)
    # others: no JSON, a line beyond the bound, bytes that are no UTF-8, nothing for more than the patience
    rows += [("bad", 0, b'{"a":1}\noops\n{}\n', 2), ("long", 0, b"{}\n" + b"x" * 3000, 2), ("bytes", 0, b'"\xff"\n', 2), ("quiet", 0, b"{}\n{", 2), ("later", 0, b"{}\n", 90_000)]
    got = run_chunks(spark, rows, 4, 2000)
    whole = lambda s: [(k, x, None) for k, x in enumerate(lines[s])]
    assert got["a"] == whole("a") and got["b"] == whole("b")
    assert got["c"][-1][1:] == (None, "incomplete") or got["c"][-1][2] == "invalid record"
    assert [x for _, x, p in got["c"] if p is None] == lines["c"][: len(got["c"]) - 1]
    assert got["d"][:8] == whole("d")[:8]  # the end never came, so that its last line may go on
    assert got["bad"] == [(0, '{"a":1}', None), (1, None, "invalid record")]
    assert got["long"] == [(0, "{}", None), (1, None, "record too long")] and got["bytes"] == [(0, None, "invalid record")]
    assert got["quiet"] == [(0, "{}", None), (1, None, "incomplete")]


def walk(value, key=""):
    if isinstance(value, dict):
        if key:
            yield key, value
        for k, v in value.items():
            yield from walk(v, f"{key}.{k}" if key else k)
    else:
        yield key, value


def test_members_of_json(spark):
    docs = ['{"a": {"b": 1, "c": {"d": null, "e": []}}, "f": "x", "g": {}, "é": [1, {"h": 2}]}', "{}", "[1]", "3", "null", '"s"', "oops", None, '{"a.b": true, "deep": ' + '{"x": ' * 30 + "1.5" + "}" * 30 + "}"]
    got = {}
    for r in flatten(spark.createDataFrame(list(enumerate(docs)), "id int, json string"), ["id"]).collect():
        got.setdefault(r.id, {})[r.key] = (r.type, json.loads(r.value), r.is_leaf)
    names = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
    for i, d in enumerate(docs):
        if d is None or d == "oops":
            assert i not in got
        else:
            assert got.get(i, {}) == {k: (names[type(v)], v, not isinstance(v, dict)) for k, v in walk(json.loads(d))}
    assert flatten(spark.createDataFrame([], "id int, json string"), ["id"]).count() == 0
