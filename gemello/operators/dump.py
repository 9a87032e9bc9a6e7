"""Syntax trees as text: an indented listing and a graph for Graphviz; the languages there are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from gemello.functions.languages import GLOBS
from gemello.operators.syntax import PROVIDERS, Node, number


def listing(root: Node) -> str:
    """A line for each node below the root in pre-order: two spaces a level, then what it is and where it begins."""
    out = []
    for n in number(root)[1:]:
        spans = n.open_span if n.is_list else n.spans
        place = f" {spans[0][0] + 1}:{spans[0][1]}" if spans else ""
        what = f"list {json.dumps(n.open, ensure_ascii=False)} {json.dumps(n.close, ensure_ascii=False)}" if n.is_list else f"{n.kind} {json.dumps(n.content, ensure_ascii=False)}"
        out.append("  " * (n.depth - 1) + what + place)
    return "\n".join(out)


def graph(root: Node) -> str:
    """The tree in the DOT language, a node for each and an edge to each child."""
    nodes = number(root)[1:]
    label = lambda n: json.dumps(f"{n.open} {n.close}".strip() if n.is_list else n.content, ensure_ascii=False)
    lines = [f"  id{n.id}[label={label(n)}];" for n in nodes]
    lines += [f"  id{n.id} -> id{c.id};" for n in nodes for c in n.children]
    return "\n".join(["digraph {", *lines, "}"])


def languages(spark: SparkSession) -> DataFrame:
    """(language, globs, structural): every language known, its name patterns, and whether it has a syntax provider."""
    rows = [(name, globs.split(), name in PROVIDERS) for name, globs in GLOBS.items()]
    return spark.createDataFrame(rows, "language string, globs array<string>, structural boolean")
