"""Sources put together with what they import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemello.operators.ranking import global_row_number
from gemello.session import written

#: Stands after a source's own path, so that it follows what it imports.
AFTER = (1 << 31) - 1


def import_paths(text: Column) -> Column:
    """What the first line of a query file imports: `; inherits: a, b` gives [a, b]; null for any other."""
    first = F.trim(F.regexp_extract(text, r"\A[^\n]*", 0))
    found = F.regexp_extract(first, r"^;\s*inherits:(.*)$", 1)
    return F.when(found != "", F.filter(F.transform(F.split(found, ","), lambda p: F.trim(p)), lambda p: p != ""))


def import_tree(roots: DataFrame, imports: DataFrame, levels: int = 100) -> DataFrame:
    """(language, path, sources, cyclic): every way from a root to a source, as places among the imports and as the sources on it.

    roots (language, ord, source) begin; imports (source, ord, target). A way ends at a source that is already on it (cyclic). There are as many rows
    as ways, bounded by Spark's limit on recursion, so that a graph with ever more of them fails and isn't cut.
    """
    return roots.sparkSession.sql(
        f"""
        WITH RECURSIVE way(language, path, sources, cyclic) MAX RECURSION LEVEL {levels} AS (
          SELECT language, array(ord), array(source), false FROM {{roots}}
          UNION ALL
          SELECT w.language, concat(w.path, array(i.ord)), concat(w.sources, array(i.target)), array_contains(w.sources, i.target)
          FROM way w JOIN {{imports}} i ON i.source = element_at(w.sources, -1) WHERE NOT w.cyclic
        )
        SELECT * FROM way""",
        roots=roots.select("language", F.col("ord").cast("int").alias("ord"), "source"),
        imports=imports.select("source", F.col("ord").cast("int").alias("ord"), "target"),
    )


def first_ways(roots: DataFrame, imports: DataFrame) -> DataFrame:
    """(language, path, sources, cyclic): of the ways of import_tree() that are no cycles, the first to each source of a language.

    A source's first way goes on from the first way of what imports it there, so that rounds of joins keep one way for each source and go on with those
    that a round has found or bettered, until there are none. Rows grow with languages and sources, not with ways.
    """
    imports = imports.select("source", F.col("ord").cast("int").alias("ord"), "target")
    new = roots.select("language", "source", F.array(F.col("ord").cast("int")).alias("path"), F.array("source").alias("sources"))
    found = new = written(_first(new), "ways")
    while not new.isEmpty():
        step = new.join(imports, "source").filter(~F.array_contains("sources", F.col("target")))
        step = step.select("language", F.col("target").alias("source"), F.concat("path", F.array("ord")).alias("path"), F.concat("sources", F.array("target")).alias("sources"))
        step = written(_first(step), "ways")
        # what a round reaches may be little against all that is known
        known = found.join(step.select("language", "source"), ["language", "source"]).groupBy("language", "source").agg(F.min("path").alias("known"))
        new = written(step.join(known, ["language", "source"], "left").filter("known IS NULL OR path < known").drop("known"), "ways")
        found = found.unionByName(new)
    return _first(found).withColumn("cyclic", F.lit(False))


def _first(ways: DataFrame) -> DataFrame:
    """The first way to each source of a language."""
    return ways.groupBy("language", "source").agg(F.min(F.struct("path", "sources")).alias("w")).select("language", "source", "w.*")


def cycles(ways: DataFrame) -> DataFrame:
    """(language, cycle): the sources of each cycle that a way ends in, the first one again at its end."""
    last = F.element_at("sources", -1)
    found = ways.filter("cyclic").select("language", F.slice("sources", F.array_position("sources", last).cast("int"), F.size("sources")).alias("cycle"))
    return found.distinct()


def assembled(ways: DataFrame) -> DataFrame:
    """(language, place, source): each language's sources, once each, imports before their first importer, numbered from 1.

    A source stands where the first way in order reaches it, after whatever its imports lead to. Ways of cycles don't count beyond their end.
    """
    first = ways.filter("NOT cyclic").groupBy("language", F.element_at("sources", -1).alias("source")).agg(F.min("path").alias("path"))
    keyed = first.select("language", "source", F.struct("language", F.concat("path", F.array(F.lit(AFTER))).alias("path")).alias("key"))
    numbered = global_row_number(keyed, "key", "n")
    before = numbered.groupBy("language").agg((F.min("n") - 1).alias("before"))
    return numbered.join(before, "language").select("language", (F.col("n") - F.col("before")).cast("long").alias("place"), "source")
