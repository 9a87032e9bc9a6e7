"""JSON as VARIANT, flattened in rounds of a lateral table function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.session import written


def flatten(docs: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """(keys, key, type, value, is_leaf) of docs (keys, a JSON text): every member of every object, by its dotted key, value as JSON
    text with an object's members in alphabetical order.

    A leaf is whatever is no object; an array is one. type is that of the JSON value: object, array, string, number, boolean or null. A text that isn't
    JSON, or null, has no rows. The root, if a leaf, has the empty key. Members of one name in an object: the last counts, as in most readers. As many
    rounds as objects are deep; each round's nodes are written.
    """
    root = docs.select(*keys, F.lit("").alias("key"), F.try_parse_json(column).alias("v")).filter("v IS NOT NULL")
    level, found = _level(root, keys), None
    while True:
        here = level.filter("NOT (key = '' AND type = 'object')")
        rows = here.select(*keys, "key", "type", F.to_json("v").alias("value"), (F.col("type") != "object").alias("is_leaf"))
        found = rows if found is None else found.unionByName(rows)
        inner = level.filter("type = 'object'")
        if inner.isEmpty():
            return found
        # a table function beside each row
        view = docs.sparkSession.sql("SELECT o.*, m.key AS member, m.value AS w FROM {objects} o, LATERAL variant_explode(o.v) AS m", objects=inner)
        child = view.select(*keys, F.when(F.col("key") == "", F.col("member")).otherwise(F.concat_ws(".", "key", "member")).alias("key"), F.col("w").alias("v"))
        level = _level(child, keys)


def _level(nodes: DataFrame, keys: list[str]) -> DataFrame:
    text = F.to_json("v")
    first = F.substring(text, 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return written(nodes.withColumn("type", kind), "members")

