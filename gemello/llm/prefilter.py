"""A fixed-size bitmap of hashed keys: rows that surely match nothing skip the shuffle of an exact join that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap as a power of two: 4 MiB at most are broadcast, whatever the number of keys. With more keys more rows pass.
BITS = 25


def with_maybe(df: DataFrame, key: Column, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """df with a boolean column: false only if key is surely not among keys.key (both 64-bit hashes); a null key gives false."""
    at = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    bitmap = (
        keys.select(at(F.col("key")).alias("at"))
        .groupBy(F.call_function("bitmap_bucket_number", F.col("at")).alias("_slot"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("_bitmap"))
    )
    place = F.call_function("bitmap_bit_position", at(key)).cast("int")
    octet = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(F.col("_place"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumns({"_slot": F.call_function("bitmap_bucket_number", at(key)), "_place": place})
        .join(F.broadcast(bitmap), "_slot", "left")
        .withColumn(name, F.coalesce(F.call_function("getbit", octet, F.col("_place").bitwiseAND(7)) == 1, F.lit(False)))
        .drop("_slot", "_place", "_bitmap")
    )
