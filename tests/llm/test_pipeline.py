"""The pipeline and the registered queries on the smallest tables."""

import glob
import os
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from gemello.llm import registry, simhash
from gemello.session import written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the driver's tables")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "pack" else before  # noqa: F821
        last = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        if name == "pack":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = len(after)
        assert after.items() <= before.items()
        if name == "quality":
            good = [k for k in before if labels.get(k) == 1]
            bad = [k for k in before if labels.get(k) == 0]
            assert sum(k in after for k in good) >= 0.97 * len(good) and sum(k in after for k in bad) <= 0.1 * len(bad)
        elif name == "exact":
            groups = defaultdict(list)
            for k, t in before.items():
                groups[lower(t)].append(k)
            assert set(after) == {max(g) for g in groups.values()}
        elif name == "near":
            fps = {k: simhash.fingerprint(t) for k, t in before.items()}
            ids = sorted(fps)
            assert all(any((fps[k] ^ fps[j]).bit_count() <= 4 for j in ids if j != k) for k in set(before) - set(after))
            assert not any((fps[a] ^ fps[b]).bit_count() <= 4 for a in after for b in after if a < b)
        else:
            held = {k for k, t in before.items() if any(f" {' '.join(i)} " in f" {' '.join(re.findall(r'\w+', t.lower()))} " for i in items)}
            assert set(after) == set(before) - held
        before = after
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in last.select("doc_id").collect()}
    size = defaultdict(int)
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 4096 and len(size) <= -(-sum(size.values()) // 4096) + 1


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cursor = con.execute(registry.ORACLES[name])
        names = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(repr([r[c] for c in names]) for r in rows) == sorted(repr(list(r)) for r in cursor.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "pack"]
