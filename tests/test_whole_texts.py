"""Queries of text functions over whole texts, against brute force where there is no SQL."""

import glob
import os
from collections import defaultdict

import pytest

from gemello import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the driver's tables")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_of_whole_turns(spark):
    turns, want = defaultdict(list), {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id, r.role].append((r.turn, r.text))
    for (conv, role), own in turns.items():
        for (turn, a), (_, b) in zip(own, own[1:], strict=False):
            if a is not None and b is not None:
                n = max(len(a), len(b))
                want[f"{conv}:{turn}:{role}"] = int(100 * (1 - distance(a, b) / n) + 0.5) if n else 100
    got = {r.file_key: r.value for r in registry.QUERIES["x6_similarity_turns"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name, extra", [("x13_separators_whole", (18, 6)), ("x18_terminal_safe_whole", (4, 3))])
def test_no_text_is_cut(spark, name, extra):
    """Every character of a document is in the result, and what stands for line feeds and at the end besides."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    of_line, end = extra
    got = {r.doc_id: r.value for r in registry.QUERIES[name](spark, SF).collect()}
    keeps_feed = name == "x18_terminal_safe_whole"
    assert {k: len(v) for k, v in got.items()} == {k: len(t) + t.count("\n") * (of_line - (not keeps_feed)) + end for k, t in texts.items()}
