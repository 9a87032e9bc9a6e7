"""Tree patterns with captures over node tables, by window functions along the pre-order.

A twig is a test of a node with twigs below it, each among the children or anywhere below. Matching goes up once, marking nodes whose twigs below are
there (running counts between a node's first and last place), and down once, from each match of the root to what it captures. Nodes
are never joined with nodes, and nested matches make no pairs: a captured node belongs to the nearest match above it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemello.operators.parse import with_children, with_descendants, with_nearest, with_parent


@dataclass(frozen=True)
class Twig:
    """A node of this name (any, if empty) and kind whose opening token or content has a match of a pattern, with all of its twigs below.

    capture names the node in the result; deep says that the twig may stand anywhere below, not among the children only. absent twigs must not match.
    """

    name: str = ""
    below: tuple[Twig, ...] = ()
    capture: str = ""
    kind: str = ""
    pattern: str = ""
    deep: bool = False
    absent: bool = False

    def test(self) -> Column:
        out = F.lit(True)
        if self.name:
            out = out & (F.col("name") == self.name)
        if self.kind:
            out = out & (F.col("kind") == self.kind)
        if self.pattern:
            out = out & F.coalesce("open", "content").rlike(self.pattern)
        return F.coalesce(out, F.lit(False))


def _flat(twig: Twig, above: int | None = None, out: list | None = None) -> list[tuple[Twig, int | None]]:
    """All twigs with the place of the one above them, each after that."""
    out = [] if out is None else out
    out.append((twig, above))
    own = len(out) - 1
    for t in twig.below:
        _flat(t, own, out)
    return out


def matches(nodes: DataFrame, keys: list[str], twig: Twig) -> DataFrame:
    """(keys, root, capture, id) of nodes (keys, id, pre, last, level, name, kind, open, content): for each match of the twig, by its root's id, the
    captured nodes. A node that several of a twig's branches capture stands once for each name."""
    flat = _flat(twig)
    if any(t.absent and _captures(t) for t, _ in flat) or not _captures(twig):
        raise ValueError("a twig captures something, and nothing that must not be there")
    # the nodes that some twig may stand for, and of them places and tests alone
    n = nodes.select(*keys, "id", "pre", "last", "level", *[t.test().alias(f"t_{i}") for i, (t, _) in enumerate(flat)])
    n = n.filter(reduce(or_, [F.col(f"t_{i}") for i in range(len(flat))]))
    # up: m_i says that twig i matches at a node
    for i in reversed(range(len(flat))):
        own = [(j, t) for j, (t, above) in enumerate(flat) if above == i]
        for deep, count in ((False, with_children), (True, with_descendants)):
            if some := {f"c_{j}": F.col(f"m_{j}") for j, t in own if t.deep == deep}:
                n = count(n, keys, some, F.col(f"t_{i}"))
        ok = F.col(f"t_{i}")
        for j, t in own:
            ok = ok & ((F.col(f"c_{j}") == 0) if t.absent else (F.col(f"c_{j}") > 0))
        n = n.withColumn(f"m_{i}", ok).drop(*[f"c_{j}" for j, _ in own])
    # down: r_i is the root of the match that twig i of a node belongs to
    n = n.filter(reduce(or_, [F.col(f"m_{i}") for i in range(len(flat))])).drop(*[f"t_{i}" for i in range(len(flat))]).withColumn("r_0", F.when(F.col("m_0"), F.col("id")))
    for i, (t, above) in enumerate(flat):
        if above is not None and not t.absent and _captures(t):
            held = F.col(f"r_{above}")
            if t.deep:
                n = with_nearest(n, keys, held.isNotNull(), held, "_root")
            else:
                # parents may be left out: what opened the level last need not hold the node
                n = with_parent(n, keys, F.struct("last", held.alias("root")), "_above", held.isNotNull())
                n = n.withColumn("_root", F.when(F.col("_above.last") >= F.col("pre"), F.col("_above.root"))).drop("_above")
            n = n.withColumn(f"r_{i}", F.when(F.col(f"m_{i}"), F.col("_root"))).drop("_root")
    found = [F.struct(F.col(f"r_{i}").alias("root"), F.lit(t.capture).alias("capture")) for i, (t, _) in enumerate(flat) if t.capture]
    return n.select(*keys, "id", F.explode(F.array(*found)).alias("_f")).filter("_f.root IS NOT NULL").select(*keys, "_f.root", "_f.capture", "id").distinct()


def _captures(twig: Twig) -> bool:
    return bool(twig.capture) or any(map(_captures, twig.below))


def tagged(nodes: DataFrame, keys: list[str], tags: dict[str, Twig]) -> DataFrame:
    """(keys, id, tags): the sorted names of the twigs whose root matches at a node, over nodes that have any."""
    out = None
    for tag, twig in tags.items():
        found = matches(nodes, keys, twig).filter("root = id").select(*keys, "id", F.lit(tag).alias("tag"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(*keys, "id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
