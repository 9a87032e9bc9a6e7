"""Abbreviated content ids: the shortest prefix that names one, and what a prefix names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemello.session import written

#: Characters that an abbreviation has at least.
LEAST = 4


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two ids have in common at their beginning; 0 if either is null."""
    same = F.filter(F.sequence(F.lit(1), F.length(a)), lambda k: F.left(a, k) == F.left(b, k))
    return F.coalesce(F.size(same), F.lit(0))


def shortest(ids: DataFrame) -> DataFrame:
    """(oid, short) of the different ids of ids (oid): the shortest prefix, of LEAST characters or more, that no other begins with.

    An id has most in common with its neighbours in order. Ids are dealt by ranges and written; what stands beside a range are the outermost ids of the
    next ranges that have any, one small row for each.
    """
    dealt = written(ids.select("oid").filter("oid IS NOT NULL").distinct().repartitionByRange("oid").withColumn("_range", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("_range").agg(F.min("oid").alias("_low"), F.max("oid").alias("_high"))
    by = Window.orderBy("_range")  # a row for each range
    beside = ends.select("_range", F.lag("_high").over(by).alias("_before"), F.lead("_low").over(by).alias("_after"))
    own = Window.partitionBy("_range").orderBy("oid")
    both = dealt.join(F.broadcast(beside), "_range").select("oid", F.coalesce(F.lag("oid").over(own), "_before").alias("a"), F.coalesce(F.lead("oid").over(own), "_after").alias("b"))
    n = F.greatest(common_prefix(F.col("oid"), F.col("a")), common_prefix(F.col("oid"), F.col("b"))) + 1
    return both.select("oid", F.left("oid", F.greatest(n, F.lit(LEAST))).alias("short"))


def resolve(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(prefix, outcome, oid) of the different prefixes of prefixes (prefix): found with its id, ambiguous, unknown, or too_short.

    Ids and prefixes meet by their first LEAST characters, which spread ids evenly, and an id counts once.
    """
    asked = prefixes.select(F.lower("prefix").alias("prefix")).distinct().withColumn("head", F.left("prefix", F.lit(LEAST)))
    known = ids.select("oid").distinct().withColumn("head", F.left("oid", F.lit(LEAST)))
    met = asked.filter(F.length("prefix") >= LEAST).join(known, "head").filter(F.startswith("oid", F.col("prefix")))
    found = met.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("oid").alias("oid"))
    outcome = F.when(F.coalesce(F.length("prefix"), F.lit(0)) < LEAST, "too_short").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return asked.drop("head").join(found, "prefix", "left").select("prefix", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("oid")).alias("oid"))
