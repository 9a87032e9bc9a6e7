"""Terminal columns and summaries."""

import duckdb
from pyspark.sql import functions as F

from gemello.functions import display, strings
from gemello.plans import summarize


def test_columns():
    assert [display.column_at("a\tb日c", k) for k in (0, 1, 2, 3, 6, 7)] == [0, 1, 4, 5, 7, 8]
    assert display.column_at("é́x", 2) == 1 and display.column_at("日", 1) == 0
    assert display.fit("日本", 3) == "日 " and display.fit("a", 3) == "a  "


def test_columns_of_a_table(spark):
    rows = spark.createDataFrame([("a\tb", 2), (None, 3)], "t string, o int")
    assert [r[0] for r in rows.select(display.terminal_column(F.col("t"), F.col("o"))).collect()] == [4, 0]


def test_summaries_that_are_short_enough(spark):
    rows = [("f", 1, "rhs", ["function"], True, 0, 30, "x" * 90), ("f", 2, "rhs", ["test"], True, 0, 2, "yy"), ("f", 3, "lhs", ["function"], True, 0, 30, "x" * 90), ("f", 4, "rhs", ["function"], False, 0, 30, "x" * 90)]
    folds = spark.createDataFrame(rows, "file string, id long, side string, tags array<string>, one_sided boolean, start long, end long, text string")
    assert [(r.id, r.label) for r in summarize.summarized(folds, lambda t: "short").collect()] == [(1, "short")]
    assert summarize.summarized(folds, lambda t: (_ for _ in ()).throw(OSError())).count() == 0


def test_capitals_are_those_of_sql(spark):
    """Letters whose full mapping has several characters, and those with a lower case of their own at a word's end."""
    several = [chr(c) for c in range(0xDF, 0x1E000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
    texts = [*several, *(c + "x" for c in several), "ΑΣ ΟΔΟΣ", "İXİ", "ßachzu", "", "éA", "ǆ", "𐐨𐐀", "1A"]
    want = duckdb.connect().execute("SELECT t, upper(left(lower(t), 1)) || substr(lower(t), 2) FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(df.select("t", strings.capitalized(strings.simple_lower(F.col("t")))).collect()) == dict(want)
