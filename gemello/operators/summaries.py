"""Row summaries of all regions of a file at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.operators.parse import _rows, with_nearest


def row_summaries(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, collapsed_rows, leading, trailing, longest_gap) of regions (keys, id, pre, last, level, is_leaf, lines, collapsed): what
    each shows if it is opened alone. Rows below it that are collapsed count as one each; between them stand runs of open lines: the one before the first, the
    one after the last, and the longest. A collapsed region is one collapsed row, an open leaf a run of its lines.

    A region's rows are those with the same nearest collapsed region above them, a stretch of that one's rows in order: running sums at the
    stretch's ends give counts and outer runs. The longest run inside is the greatest of two overlapping blocks of 2^j runs, made by doubling.
    """
    n = with_nearest(regions.select(*keys, "id", "pre", "last", "level", "is_leaf", "lines", "collapsed"), keys, F.col("collapsed"), F.col("id"), "context")
    rows = _rows(n, F.struct(F.col("pre").alias("_at"), F.lit(0).alias("_role")), F.struct(F.col("last").alias("_at"), F.lit(1).alias("_role")))
    order = Window.partitionBy(*keys, "context").orderBy("_at", "_role")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("_role") == 0
    rows = rows.withColumns(
        {
            "_lines": F.sum(F.when(opens & F.col("is_leaf") & ~F.col("collapsed"), F.col("lines")).otherwise(0)).over(upto),
            "_shut": F.sum(F.when(opens & F.col("collapsed"), 1).otherwise(0)).over(upto),
        }
    )
    # a region's end follows its start among those of its level
    level = Window.partitionBy(*keys, "context", "level").orderBy("_at", "_role")
    own = F.when(F.col("is_leaf") & ~F.col("collapsed"), F.col("lines")).otherwise(0)
    ends = rows.withColumns({"b": F.lead("_lines").over(level), "cb": F.lead("_shut").over(level)}).filter("_role = 0")
    ends = ends.withColumns({"a": F.col("_lines") - own, "ca": F.col("_shut") - F.col("collapsed").cast("int")})
    # the collapsed rows of a context, numbered from 1, with the lines before them and the longest of 2^j runs that begin at them
    shut = ends.filter("collapsed").select(*keys, "context", F.col("_shut").alias("k"), F.col("a").alias("p"))
    by = Window.partitionBy(*keys, "context").orderBy("k")
    shut = shut.withColumn("_m0", F.lead("p").over(by) - F.col("p"))
    most = ends.agg(F.max(F.col("cb") - F.col("ca"))).first()[0] or 0
    j = 0
    while 2 ** (j + 1) < most:
        shut = shut.withColumn(f"_m{j + 1}", F.greatest(f"_m{j}", F.lead(f"_m{j}", 2**j).over(by)))
        j += 1
    shut = shut.select(*keys, "context", "k", "p", F.array(*[f"_m{x}" for x in range(j + 1)]).alias("m"))
    size = F.col("cb") - F.col("ca") - 1
    step = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    step = F.when(F.pow(F.lit(2.0), step) > size, step - 1).when(F.pow(F.lit(2.0), step + 1) <= size, step + 1).otherwise(step)
    q = ends.withColumn("step", F.when(size > 0, step)).withColumns({"first": F.col("ca") + 1, "block": F.when(size > 0, (F.col("cb") - F.pow(F.lit(2.0), F.col("step"))).cast("long"))})

    def at(df: DataFrame, column: str, value: str, name: str) -> DataFrame:
        s = shut.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "context")], F.col("k").alias("_k"), F.col(value).alias(name))
        same = F.lit(True)
        for c in (*keys, "context"):
            same = same & df[c].eqNullSafe(s[f"_{c}"])
        return df.join(s, same & (df[column] == s["_k"]), "left").drop(*[f"_{c}" for c in (*keys, "context")], "_k")

    q = at(at(at(at(q, "first", "p", "p_first"), "cb", "p", "p_last"), "first", "m", "m_first"), "block", "m", "m_block")
    some = F.col("cb") > F.col("ca")
    lead = F.when(some, F.col("p_first") - F.col("a")).otherwise(F.col("b") - F.col("a"))
    trail = F.when(some, F.col("b") - F.col("p_last")).otherwise(F.col("b") - F.col("a"))
    gap = F.greatest(lead, trail, F.get("m_first", "step"), F.get("m_block", "step"))
    zero = F.lit(0)
    return q.select(
        *keys, "id", F.when(F.col("collapsed"), 1).otherwise(F.col("cb") - F.col("ca")).cast("long").alias("collapsed_rows"),
        *[F.when(F.col("collapsed"), zero).otherwise(c).cast("long").alias(name) for c, name in ((lead, "leading"), (trail, "trailing"), (gap, "longest_gap"))],
    )
