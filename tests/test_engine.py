"""Snapshots, options, records and streams."""

import pytest
from pyspark.sql import functions as F

from gemello.functions.languages import parse_override
from gemello.operators import manifest as m
from gemello.operators import regions
from gemello.plans import compare
from gemello.session import shared_dir
from gemello.sinks import envelope, write_records
from gemello.sources import records, snapshots
from gemello.streaming import events


def files(spark, rows):
    return snapshots.snapshot(spark.createDataFrame(rows, "path string, text string, mode string"))


def test_content_id_is_gits(spark):
    got = files(spark, [("a", "hello\n", None), ("b", "", None)]).collect()
    assert {r.path: r.oid for r in got} == {"a": "ce013625030ba8dba906f756967f9e9ca394464a", "b": "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"}


def test_statuses_and_renames(spark):
    base = files(spark, [("same", "1", None), ("gone", "2", None), ("old", "3", None), ("edit", "4", None), ("kind", "5", None), ("mode", "6", None)])
    head = files(spark, [("same", "1", None), ("new", "7", None), ("moved", "3", None), ("edit", "44", None), ("kind", "5", "120000"), ("mode", "6", "100755")])
    got = {r.path: r.status for r in m.exact_renames(m.manifest(base, head)).collect()}
    assert got == {"gone": "deleted", "new": "added", "moved": "renamed", "edit": "modified", "kind": "type_changed", "mode": "modified"}
    assert {r.line for r in m.name_status(m.exact_renames(m.manifest(base, head))).collect()} >= {"R\told\tmoved", "T\tkind"}
    assert m.manifest(base, base).count() == 0 and m.shortstat(m.line_counts(m.manifest(base, base), base, base)).first().line == ""


def test_manifest_doesnt_read_texts(spark):
    path = shared_dir(spark, "snap")
    files(spark, [("a", "x", None)]).write.parquet(path)
    df = spark.read.parquet(path)
    plan = m.manifest(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan


def test_empty_snapshot_and_names(spark):
    head = files(spark, [("a", "x\ny\n", None)])
    assert [r.status for r in m.manifest(snapshots.resolve({"h": head}, None, spark), snapshots.resolve({"h": head}, "h", spark)).collect()] == ["added"]
    with pytest.raises(KeyError):
        snapshots.resolve({}, "h", spark)
    with pytest.raises(ValueError):
        m.select_paths(head, [":(top)a"])


def test_overrides_and_options():
    assert parse_override("*.x:y:RUST") == ("*.x:y", "Rust")
    for bad in ("nothing", "*.x:klingon"):
        with pytest.raises(ValueError):
            parse_override(bad)
    with pytest.raises(ValueError):
        compare.Options(byte_limit=-1)


def test_records_round_trip_and_replay(spark):
    base = files(spark, [("a.json", '{"x": 1}', None), ("b.txt", "one\ntwo\n", None)])
    head = files(spark, [("a.json", '{"x": 2}', None), ("b.txt", "one\n2\n", None), ("c.rs", "fn f() {}", None)])
    path = shared_dir(spark, "records")
    out = compare.records(base, head)
    write_records(out, path)
    lines = [r.line for r in records.read_lines(spark, path).collect()]
    assert lines == [r.line for r in out.orderBy("seq").collect()] and '"type":"start"' in lines[0] and '"type":"complete"' in lines[-1]
    decoded = records.decode(out)
    assert records.problems(decoded).count() == 0
    assert {(r.file_key, r.cause, r.added, r.removed) for r in decoded.filter("type = 'file'").collect()} == {("a.json", "structural", 1, 1), ("b.txt", "unsupported_language", 1, 1), ("c.rs", "structural", 1, 0)}
    assert [r.problem for r in records.problems(decoded.filter("type <> 'complete'")).collect()] == ["incomplete"]


def test_hidden_files_and_rendering(spark):
    base = files(spark, [("Cargo.lock", "a\n", None), ("x.txt", "".join(f"{k}\n" for k in range(30)), None)])
    head = files(spark, [("Cargo.lock", "b\n", None), ("x.txt", "".join(f"{k}\n" for k in range(30)).replace("15\n", "xv\n"), None)])
    pairs = compare.file_pairs(base, head)
    got = {r.file_key: (r.hidden, r.cause) for r in pairs.collect()}
    assert got["Cargo.lock"] == ("Generated file · hidden by default", "hidden") and got["x.txt"][0] is None
    lines = [r.line for r in compare.render(compare.diffs(pairs), pairs).filter("file_key = 'x.txt'").orderBy("row").collect()]
    assert sum("unchanged lines" in x for x in lines) == 2 and sum(x.startswith("*") for x in lines) == 1 and len(lines) == 9


def test_prefix_ends_with_a_whole_character(spark):
    from gemello.functions.classify import prefix_of

    rows = spark.createDataFrame([("é" * 5000,), ("a" + "é" * 5000,), ("x",), ("",)], "text string")
    prefix, whole = prefix_of(F.col("text"))
    assert [(len(r[0]), r[1]) for r in rows.select(prefix, whole).collect()] == [(4096, False), (4096, False), (1, True), (0, True)]


def test_pipeline_names_the_step_that_fails(spark):
    nodes = spark.createDataFrame([(1, True)], "fold_state_id long, collapsed boolean")
    opened = compare.Pipeline([("open", lambda r: regions.open_folds(r, spark.createDataFrame([(1,)], "fold_state_id long")))]).run(nodes)
    assert [r.collapsed for r in opened.collect()] == [False]
    with pytest.raises(RuntimeError, match="shape step bad"):
        compare.Pipeline([("bad", lambda r: regions.open_folds(r, spark.createDataFrame([(9,)], "fold_state_id long")))]).run(nodes)


def test_envelope_of_nothing(spark):
    none = spark.createDataFrame([], "file_key string")
    got = envelope(none, spark.createDataFrame([], "ord long, line string, failed boolean")).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1] and '"files":0' in got[0].line


def test_stream_of_pairs_writes_records(spark):
    arrivals, out, check = (shared_dir(spark, n) for n in ("arrivals", "out", "check"))
    spark.createDataFrame([(str(k), "a\nb\n", f"a\n{k}\n") for k in range(6)], "file_key string, lhs string, rhs string").repartition(3).write.parquet(arrivals)
    events.write_records(events.counted(events.stream_pairs(spark, arrivals)), out, check).awaitTermination()
    got = records.decode(spark.read.text(out).select(F.col("value").alias("line"))).collect()
    assert sorted(r.file_key for r in got) == [str(k) for k in range(6)] and all((r.added, r.removed) == (1, 1) for r in got)


def test_slot_state_over_batches(spark):
    folder = shared_dir(spark, "slots")
    spark.createDataFrame([("c", "start", "a"), ("c", "start", "b"), ("c", "file", "a"), ("c", "file", "a"), ("c", "file", "z")], "comparison string, type string, file_key string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("comparison string, type string, file_key string").parquet(folder)
    events.run_to_memory(events.slot_updates(stream), "slots_test", "update")
    assert [tuple(r) for r in spark.table("slots_test").collect()] == [("c", 2, 1, 1, 1)]
