"""Cuts and joins of regions in bulk: those that don't touch each other's regions, chosen by rounds of priorities, both sides of each or neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.session import written

#: Why a request is refused, by the order in which it is asked.
REASONS = ("unknown_region", "not_a_leaf", "out_of_range", "uneven_sides", "too_few", "repeated", "one_sided", "root", "not_siblings", "overlap")


def judged(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (file, request, kind, ids, offset) with reason, null for those that are right by themselves.

    A cut names a leaf and a line in it, counted from its start; the leaf it is aligned with must have as many lines. A join names two or more different
    regions: consecutive siblings below a fold, on each side on which it names any.
    """
    own = regions.select("file", "id", "side", "parent_id", "ord", "is_leaf", "alignment_id", (F.col("end") - F.col("start")).alias("size"))
    named = requests.select("file", "request", "kind", "offset", F.posexplode_outer("ids").alias("k", "id")).join(own, ["file", "id"], "left")
    pair = own.filter("is_leaf").select("file", "alignment_id", F.col("side").alias("pair_side"), F.col("size").alias("pair_size"))
    first = named.filter("kind = 'cut' AND k = 0")
    met = first.join(pair, ["file", "alignment_id"], "left").groupBy("file", "request").agg(F.bool_or((F.col("pair_side") != F.col("side")) & (F.col("pair_size") != F.col("size"))).alias("uneven"))
    cut = first.join(met, ["file", "request"]).select(
        "file", "request",
        F.when(F.col("side").isNull(), "unknown_region").when(~F.col("is_leaf"), "not_a_leaf").when(~F.coalesce((F.col("offset") > 0) & (F.col("offset") < F.col("size")), F.lit(False)), "out_of_range").when(F.coalesce("uneven", F.lit(False)), "uneven_sides").alias("reason"),
    )
    sides = named.filter("kind = 'join'").groupBy("file", "request", "side").agg(
        F.count("id").alias("n"), F.count_distinct("id").alias("different"), F.count_distinct("parent_id").alias("parents"), F.count("parent_id").alias("held"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    known = F.col("side").isNotNull()
    join = sides.groupBy("file", "request").agg(
        F.sum("n").alias("n"), F.sum("different").alias("different"), F.bool_or(~known & (F.col("n") > 0)).alias("lost"), F.bool_or(known & (F.col("n") == 1)).alias("alone"), F.bool_or(known & (F.col("held") == 0)).alias("top"),
        F.bool_or(known & ((F.col("parents") > 1) | (F.col("held") < F.col("n")) | (F.col("high") - F.col("low") + 1 != F.col("n")))).alias("apart"),
    ).select("file", "request", F.when(F.col("n") < 2, "too_few").when(F.col("different") < F.col("n"), "repeated").when(F.col("lost"), "unknown_region").when(F.col("alone"), "one_sided").when(F.col("top"), "root").when(F.col("apart"), "not_siblings").alias("reason"))
    return requests.join(cut.unionByName(join), ["file", "request"], "left").withColumn("reason", F.when((F.col("kind") == "cut") & (F.coalesce(F.size("ids"), F.lit(0)) < 1), "unknown_region").otherwise(F.col("reason")))


def touched(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, request, id): the regions that requests change, a cut's aligned leaf among them."""
    named = requests.select("file", "request", "kind", F.explode(F.when(F.col("kind") == "cut", F.slice("ids", 1, 1)).otherwise(F.col("ids"))).alias("id"))
    leaf = regions.filter("is_leaf").select("file", "id", "alignment_id")
    cut = named.filter("kind = 'cut'").join(leaf, ["file", "id"]).select("file", "request", "alignment_id").join(leaf, ["file", "alignment_id"]).select("file", "request", "id")
    return cut.unionByName(named.filter("kind = 'join'").select("file", "request", "id"))


def chosen(touches: DataFrame) -> DataFrame:
    """(file, request) of a greatest set of requests no two of which touch one region, over touches (file, request, id).

    In each round every request draws a priority; those that have the least at all their regions are taken, and whatever shares a region with them
    goes. Each round settles a good part of what is left, so that there are some log(n) rounds.
    """
    alive, taken, n = written(touches.distinct(), "touches"), None, 0
    while not alive.isEmpty():
        drawn = alive.withColumn("priority", F.struct(F.xxhash64(F.lit(n), "file", "request").alias("p"), F.col("request").alias("r")))
        least = drawn.groupBy("file", "id").agg(F.min("priority").alias("least"))
        won = drawn.join(least, ["file", "id"]).groupBy("file", "request").agg(F.bool_and(F.col("priority") == F.col("least")).alias("won")).filter("won").select("file", "request")
        won = written(won, "won")
        taken = won if taken is None else taken.unionByName(won)
        gone = alive.join(alive.join(won, ["file", "request"]).select("file", "id").distinct(), ["file", "id"]).select("file", "request").distinct()
        alive = written(alive.join(gone, ["file", "request"], "left_anti"), "touches")
        n += 1
    return touches.select("file", "request").limit(0) if taken is None else taken


def edited(regions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, outcomes) after requests (file, request, kind, ids, offset), which are numbered within a file: outcomes (file, request, reason), null for
    what was done.

    regions are (file, side, id, parent_id, ord, start, end, is_leaf, alignment_id, fold_state_id), with ids of their own on both sides of a file. A cut
    leaf keeps its first lines; the rest is a new leaf after it, aligned with the rest of the other side's. A join puts a new fold around its
    regions. New ids follow the greatest of the file, new pieces of one request share alignment and fold state, and siblings are numbered anew.
    """
    columns = ["file", "side", "id", "parent_id", "ord", "start", "end", "is_leaf", "alignment_id", "fold_state_id"]
    regions = regions.select(*columns)
    all_ = written(judged(regions, requests.select("file", "request", "kind", "ids", F.col("offset").cast("long").alias("offset"))), "requests")
    good = all_.filter("reason IS NULL").drop("reason")
    touches = written(touched(regions, good), "touched")
    done = written(chosen(touches), "done")
    outcomes = all_.join(done.withColumn("done", F.lit(True)), ["file", "request"], "left").select("file", "request", F.when(F.col("done").isNull(), F.coalesce("reason", F.lit("overlap"))).alias("reason"))
    acts = touches.join(done, ["file", "request"]).join(good.select("file", "request", "kind", "offset"), ["file", "request"])
    marked = regions.join(acts, ["file", "id"], "left")
    # a new region for each request and side
    top = regions.groupBy("file").agg(F.max("id").alias("top"), F.coalesce(F.max("alignment_id"), F.lit(-1)).alias("top_alignment"))
    new = marked.filter("request IS NOT NULL").groupBy("file", "request", "kind", "side").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("offset").alias("offset"), F.first("parent_id").alias("parent_id"), F.min("ord").alias("ord"))
    order = Window.partitionBy("file").orderBy("request", "side")
    new = new.join(top, "file").withColumn("new_id", F.col("top") + F.row_number().over(order))
    cut = F.col("kind") == "cut"
    new = new.withColumns({"state": F.min("new_id").over(Window.partitionBy("file", "request")), "new_alignment": F.when(cut, F.col("top_alignment") + F.dense_rank().over(Window.partitionBy("file", "kind").orderBy("request")))})
    ids = new.filter("kind = 'join'").select("file", "request", "side", "new_id")
    kept = marked.join(ids, ["file", "request", "side"], "left").select(
        "file", "side", "id", F.coalesce("new_id", "parent_id").alias("parent_id"), "ord", F.lit(0).alias("piece"), "start",
        F.when(cut, F.col("start") + F.col("offset")).otherwise(F.col("end")).alias("end"), "is_leaf", "alignment_id", "fold_state_id",
    )
    added = new.select(
        "file", "side", F.col("new_id").alias("id"), "parent_id", "ord", F.when(cut, 1).otherwise(0).alias("piece"), F.when(cut, F.col("start") + F.col("offset")).otherwise(F.col("start")).alias("start"), "end",
        cut.alias("is_leaf"), F.col("new_alignment").alias("alignment_id"), F.col("state").alias("fold_state_id"),
    )
    among = Window.partitionBy("file", "side", "parent_id").orderBy("ord", "piece")
    out = kept.unionByName(added).withColumn("ord", F.row_number().over(among) - 1)
    return out.select(*columns), outcomes
