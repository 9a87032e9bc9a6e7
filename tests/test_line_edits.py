"""Line edits of all edited files, removed lines too."""

import glob
import os

import pytest

from gemello import registry
from gemello.queries.diffs import edit_pairs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the driver's tables")
def test_no_edited_file_is_left_out(spark):
    rows = registry.QUERIES["t26_line_edits_all"](spark, SF).collect()
    want = {r.file_key for r in edit_pairs(spark, SF).filter("lhs <> '' OR rhs <> ''").collect()}
    assert {r.file_key for r in rows} == want and len(rows) == len(want)
    assert {int(r.file_key.rsplit("/", 1)[1][:-4]) % 10 for r in rows} == {2, 3}
    assert any(r.removed for r in rows) and any(r.appended for r in rows)
