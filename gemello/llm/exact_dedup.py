"""Exact deduplication over an extendible-hash index on shared files, in DataFrame operations only.

1. Every row's text is normalised (A-Z lower-cased, null as empty), hashed and digested once; the narrow rows go to a shared file.
2. An entry for each distinct key carries its number of rows (pre-aggregated before the shuffle, so a hot text is one row per task).
3. The directory starts with one bucket; while a bucket holds more than ``CAPACITY`` entries it is split in two by the next leading bit
   of the key, which doubles the directory where that bucket was at full depth. Counts are taken at a width of leading bits that
   the number of entries asks for; prefixes that are overfull even there are counted again at a greater width, up to all 64 bits, at
   which a prefix is one entry. The directory is a table on shared files and never collected.
4. Texts of keys with more than one row are combined by their bytes in each task and go, once each, to the owner task of their
   bucket, a range of keys. It chains the different texts of a key by comparing their bytes, and writes the bucket: of each
   link of a chain the number of rows and the row that stays.
5. Rows look their key up in the index. A key without a chain is one text; rows of a chained key compare their bytes with its links.

Null texts count as empty. Repeated rows each count; all rows of a group that carry its largest doc_id are kept, as they are one
document. A null doc_id sorts below all others: it stays only in a group without an id. An empty table gives no rows. Very long texts are
shuffled once for each task that holds a copy, and only if their key repeats. Other columns, whatever their names, pass through drop_exact
and are not read elsewhere.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemello.llm.prefilter import with_maybe
from gemello.session import remove_table, shared_dir, written

#: Entries a bucket may hold before it is split.
CAPACITY = 4096
#: Leading bits counted beyond those that evenly spread keys would need.
SLACK = 3
#: Least bits by which a directory is wider than the one that leads to it: keys that crowd there aren't evenly spread.
STEP = 20
#: Doublings in one job; those after the last one needed change nothing.
ROUNDS = 8


def normalized(text: Column) -> Column:
    """Lower-case A-Z only. Where all characters are ASCII the built-in lower() is that, and faster."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def prefix_of(key: Column, width: int) -> Column:
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - width)


def directory(entries: DataFrame, capacity: int = CAPACITY, width: int = SLACK) -> DataFrame:
    """(prefix, n, depth, bucket, held): for each prefix of width bits that occurs, the bucket that it points to and what that holds.

    A bucket's name is its leading bits. Every round splits all buckets over capacity whose depth is below width.
    """

    split = (F.col("held") > capacity) & (F.col("depth") < width)
    bit = F.expr(f"shiftrightunsigned(prefix, {width} - depth - 1) & 1").cast("string")
    load = F.sum("n").over(Window.partitionBy("bucket"))
    fine = entries.groupBy(prefix_of(F.col("key"), width).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    out, before = fine.withColumns({"depth": F.lit(0), "bucket": F.lit("")}).withColumn("held", load), None
    while True:
        for _ in range(ROUNDS):
            out = out.select("prefix", "n", (F.col("depth") + split.cast("int")).alias("depth"), F.when(split, F.concat("bucket", bit)).otherwise(F.col("bucket")).alias("bucket")).withColumn("held", load)
        out = written(out, "directory")
        if before is not None:
            remove_table(before)
        if out.filter(split).isEmpty():
            return out
        before = out


def directories(entries: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, DataFrame]]:
    """Directories of growing width: what is overfull at the width of one is in the next, to which its prefixes lead."""
    out, width = [], 0
    while True:
        n = entries.count()
        more = SLACK + max(0, math.ceil(math.log2(max(1, n) / capacity)))
        width = min(64, width + max(more, STEP) if out else more)
        table = directory(entries, capacity, width)
        out.append((width, table))
        over = table.filter(F.col("held") > capacity).select("prefix")
        if width == 64 or over.isEmpty():
            return out
        entries = written(entries.withColumn("prefix", prefix_of(F.col("key"), width)).join(over, "prefix", "left_semi").select("key"), "overfull")


def with_bucket(rows: DataFrame, tables: list[tuple[int, DataFrame]], capacity: int = CAPACITY) -> DataFrame:
    """rows (key, ...) with the bucket and depth that the directories lead their key to."""
    out, columns = None, rows.columns
    for k, (width, table) in enumerate(tables):
        found = rows.withColumn("prefix", prefix_of(F.col("key"), width)).join(table.select("prefix", "bucket", "depth", "held"), "prefix")
        last = k == len(tables) - 1
        here = (found if last else found.filter(F.col("held") <= capacity)).select("bucket", "depth", *columns)
        rows = found.filter(F.col("held") > capacity).select(*columns)
        out = here if out is None else out.unionByName(here)
    return out


def build_index(docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY, key=None) -> DataFrame:
    """The index on shared files: (bucket, depth, key, chain, chained, n, keep_id, norm), norm only where a key has a chain.

    docs (doc_id, text) are the rows and keys (doc_id, key) their keys. A task of the write owns whole buckets.
    """
    key = key or xx_key
    entries = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")), "entries")
    tables = directories(entries.select("key"), capacity)
    # texts of keys that surely are one row's alone stay where they are
    norm = docs.select("doc_id", normalized(F.col("text")).alias("norm")).withColumn("key", key(F.col("norm")))
    members = with_maybe(norm, F.col("key"), entries.filter("n > 1").select("key")).filter("maybe")
    texts = members.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    both = entries.select("key", F.lit(None).cast("string").alias("norm"), "n", "keep_id").unionByName(texts)
    # the entry of a key stands before its texts, in the order of their bytes; it alone stays of a key with one row
    own = Window.partitionBy("bucket", "key")
    links = (
        with_bucket(both, tables, capacity)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key", F.col("norm").asc_nulls_first())
        .withColumns({"chain": F.row_number().over(own.orderBy(F.col("norm").asc_nulls_first())) - 2, "texts": F.count("norm").over(own), "rows": F.max(F.when(F.col("norm").isNull(), F.col("n"))).over(own)})
        .filter((F.col("rows") > 1) == F.col("norm").isNotNull())
    )
    chained = (F.col("rows") > 1) & (F.col("texts") > 1)
    path = shared_dir(docs.sparkSession, "index")
    index = links.select("bucket", "depth", "key", F.greatest("chain", F.lit(0)).alias("chain"), chained.alias("chained"), "n", "keep_id", F.when(chained, F.col("norm")).alias("norm"))
    index.write.parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def xx_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def sha_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key=xx_key) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    key makes the 64-bit key of a normalised text; with a weak one the result stays the same.
    """
    docs = docs.select("doc_id", "text")
    norm = normalized(F.col("text"))
    rows = written(docs.select("doc_id", key(norm).alias("key"), sha_digest(norm).alias("digest")), "rows")
    index = build_index(docs, rows.select("doc_id", "key"), capacity, key)
    # only keys of several rows are looked up: any other row is its own group
    groups = written(index.filter("n > 1 AND NOT chained").select("key", "n", "keep_id"), "groups")
    chains = written(index.filter("chained").select("key", "norm", "n", "keep_id"), "chains")
    if not chains.isEmpty():
        chained = chains.select("key").distinct()
        of = docs.select("doc_id", norm.alias("norm")).withColumn("key", key(F.col("norm"))).join(chained, "key", "left_semi")
        linked = of.join(chains, ["key", "norm"]).select("doc_id", "keep_id", F.col("n").alias("group_size"), sha_digest(F.col("norm")).alias("digest"))
        rows = rows.join(chained, "key", "left_anti")
    else:
        linked = None
    found = rows.join(groups, "key", "left")
    out = found.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "digest")
    out = out if linked is None else out.unionByName(linked)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows that don't stay; all columns of docs, whatever their names. Texts that surely have no copy aren't shuffled."""
    groups = exact_groups(docs, capacity).filter(~F.col("kept"))
    gone = written(groups.select("doc_id", F.unhex("text_sha256").alias("digest")).distinct(), "gone")
    digest = sha_digest(normalized(F.col("row.text")))
    rows = docs.select(F.struct("*").alias("row"))
    marked = with_maybe(rows.withColumn("digest", digest), F.xxhash64("digest"), gone.select(F.xxhash64("digest").alias("key")))
    copies = marked.filter("maybe").join(gone, F.col("row.doc_id").eqNullSafe(gone.doc_id) & (marked.digest == gone.digest), "left_anti")
    return marked.filter("NOT maybe").select("row.*").unionByName(copies.select("row.*"))
