"""Text wrapped to a number of terminal columns, by jump pointers over running widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemello.functions.strings import without_controls
from gemello.session import written

# Characters of two columns (East Asian wide and full-width ones, by ranges), and blanks beyond ASCII.
WIDE = "[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏ꥠ-꥿가-힣豈-﫿︐-︙︰-﹯＀-｠￠-￦\\x{1f300}-\\x{1f64f}\\x{1f900}-\\x{1f9ff}\\x{20000}-\\x{3fffd}]"
NONE = r"[\p{Mn}\p{Me}\p{Cf}\p{Cc}]"
BLANK = "[\\s   -     　﻿]+"


def columns_of(text: Column) -> Column:
    """Columns of a text without tabs: one for each character, two for wide ones, none for marks and controls."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(NONE))


def wrap(texts: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """(keys, line, text) of texts (keys, text; keys tell rows apart): words filled into lines of at most so many columns, from line 0.

    Blanks between words become one, controls go. A word that is wider than a line begins one and is cut into lines of its own; if not even a
    character fits, its rest is one line. A text without words, or null, is one empty line, and so is any if columns is below 1.

    Each word, or character of a wide word, is a unit that knows where the line would go on that begins with it: counting the units that end within so many columns
    of its start. From the first unit, lines are found by jumps of 1, 2, 4 ... lines.
    """
    t = texts.select(*keys, F.trim(F.regexp_replace(without_controls(F.coalesce("text", F.lit(""))), BLANK, " ")).alias("text"))
    if columns < 1:
        return t.select(*keys, F.lit(0).cast("long").alias("line"), F.lit("").alias("text"))
    words = t.filter("text <> ''").select(*keys, F.posexplode(F.split("text", " ")).alias("word", "w")).withColumn("long", columns_of(F.col("w")) > columns)
    chars = F.filter(F.split("w", ""), lambda c: c != "")
    units = words.select(*keys, "word", "long", F.posexplode(F.when(F.col("long"), chars).otherwise(F.array("w"))).alias("char", "u")).withColumn("size", columns_of(F.col("u")))
    order = Window.partitionBy(*keys).orderBy("word", "char")
    gap = F.when((F.col("char") == 0) & (F.col("word") > 0), 1).otherwise(0)
    units = units.withColumns({"i": F.row_number().over(order) - 1, "end": F.sum(F.col("size") + gap).over(order)})
    # a line ends before and after a wide word
    cut = (F.col("char") == 0) & (F.col("long") | F.coalesce(F.lag("long").over(order), F.lit(False)))
    units = units.withColumn("cut", F.when(cut, F.col("i")))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    units = units.withColumn("stop", F.coalesce(F.min("cut").over(after), total))
    marks = F.explode(F.array(F.struct((F.col("end") - F.col("size")).alias("at"), F.lit(0).alias("ends")), F.struct(F.col("end").alias("at"), F.lit(1).alias("ends"))))
    near = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, columns)
    fit = units.select("*", marks.alias("m")).select("*", "m.*").withColumn("fits", F.sum("ends").over(near)).filter("ends = 0")
    go = F.when(F.col("fits") > F.col("i"), F.least("fits", "stop")).otherwise(F.col("stop"))
    units = written(fit.select(*keys, "i", "char", "u", F.when(go < total, go).alias("next")), "wrap-units")
    jumps = units.select(*keys, "i", "next").filter("next IS NOT NULL")
    starts = units.filter("i = 0").select(*keys, "i")
    while True:
        new = written(starts.join(jumps, [*keys, "i"]).select(*keys, F.col("next").alias("i")), "wrap-lines")
        if new.isEmpty():
            break
        starts = written(starts.unionByName(new), "wrap-starts")
        there = jumps.select(*keys, F.col("i").alias("next"), F.col("next").alias("then"))
        jumps = written(jumps.join(there, [*keys, "next"]).select(*keys, "i", F.col("then").alias("next")), "wrap-jumps")
    lined = units.join(starts.withColumn("starts", F.lit(1)), [*keys, "i"], "left").withColumn("line", F.sum("starts").over(Window.partitionBy(*keys).orderBy("i")) - 1)
    piece = F.struct("i", F.concat(F.when((F.col("char") == 0) & F.col("starts").isNull(), " ").otherwise(""), "u").alias("piece"))
    full = lined.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "").alias("text"))
    return full.unionByName(t.filter("text = ''").select(*keys, F.lit(0).cast("long").alias("line"), "text"))
