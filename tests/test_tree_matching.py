"""Runs of siblings, spread changes and imports against their definitions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gemello.operators import assembly, parse, propagate, siblings
from gemello.queries.trees import lists_and_twos
from test_trees import random_tree

RUNS = "file int, side string, id long, n long"
NODES = "file int, side string, parent_id long, ord long, id long, pre long, key string, extra int"


def sibling_rows(rng, file, side, n, keys):
    tree = random_tree(rng, file, n)
    count, out = {}, []
    for _, i, parent, pre, _, _, *_ in tree:
        k = count.get(parent, 0)
        count[parent] = k + 1
        out.append((file, side, parent, k, i, pre, rng.choice(keys), 1))
    return out


def found(nodes, file, side, first, n):
    own = [x for x in nodes if x[0] == file and x[1] == side]
    there = [x for x in nodes if x[0] == file and x[1] != side]
    start = next(x for x in own if x[4] == first)
    run = [x[6] for x in own if x[2] == start[2] and start[3] <= x[3] < start[3] + n]
    if len(run) < n:
        return None
    if not any(x[6] in run for x in there):
        return []
    for parent in [None, *[x[4] for x in sorted(there, key=lambda x: x[5])]]:
        kids = sorted((x for x in there if x[2] == parent), key=lambda x: x[3])
        for k in range(len(kids) - n + 1):
            if [x[6] for x in kids[k : k + n]] == run:
                return [x[4] for x in kids[k : k + n]]
    return None


@pytest.mark.parametrize("keys", ["ab", "abcdefgh", "a"])
def test_matching_siblings(spark, keys):
    rng = random.Random(len(keys))
    nodes = [r for f in range(12) for s in ("lhs", "rhs") for r in sibling_rows(rng, f, s, rng.randrange(1, 25), keys if s == "lhs" or f % 3 else keys.upper())]
    asked = {(x[0], x[1], x[4], rng.choice((1, 1, 2, 3, 4, 5, 8))) for x in nodes}
    got = siblings.matching_siblings(spark.createDataFrame(nodes, NODES), spark.createDataFrame([*asked, *list(asked)[:3]], RUNS)).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.ids == found(nodes, r.file, r.side, r.id, r.n), r
    kinds = {None if r.ids is None else bool(r.ids) for r in got}
    assert len(kinds) >= 2


def test_no_runs_and_a_side_without_file(spark):
    nodes = spark.createDataFrame([(1, "lhs", None, 0, 0, 0, "k", 1)], NODES)
    assert siblings.matching_siblings(nodes, spark.createDataFrame([], RUNS)).count() == 0
    assert [r.ids for r in siblings.matching_siblings(nodes, spark.createDataFrame([(1, "lhs", 0, 1)], RUNS)).collect()] == [[]]


def test_long_lists_are_dealt_once(spark):
    """Runs that come from nodes, in a list of 700: one shuffle of each, whatever the length of the list."""
    keys = {"lhs": [k * k % 11 for k in range(700)], "rhs": [k * k % 11 for k in range(1, 701)]}
    rows = [(1, side, None, k, k, k, str(key), 1) for side, own in keys.items() for k, key in enumerate(own)]
    nodes = spark.createDataFrame(rows, NODES)
    runs = nodes.filter("ord IN (0, 1, 690)").select("file", "side", "id", F.explode(F.array(*(F.lit(n).cast("long") for n in (2, 300, 699, 700)))).alias("n"))
    got = siblings.matching_siblings(nodes, runs)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    for r in got.collect():
        own, there = keys[r.side], keys["rhs" if r.side == "lhs" else "lhs"]
        run = own[r.id : r.id + r.n]
        first = next((k for k in range(701 - r.n) if there[k : k + r.n] == run), None) if len(run) == r.n else None
        assert r.ids == (None if first is None else [*range(first, first + r.n)]), r


def test_in_place_without_a_shuffle(spark):
    rng = random.Random(3)
    rows = [r for f in range(30) for s in ("lhs", "rhs") for r in sibling_rows(rng, f, s, rng.randrange(1, 25), "abc")]
    nodes = spark.createDataFrame(rows, NODES).coalesce(1)
    got = siblings.matching_siblings_in_place(nodes, lists_and_twos)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    asked = {(x[0], x[1], x[4], 2) for x in rows for y in rows if (y[0], y[1], y[2], y[3]) == (*x[:3], x[3] + 1)}
    lists = [[x for x in rows if (x[0], x[1], x[2]) == key] for key in {(x[0], x[1], x[2]) for x in rows if x[2] is not None}]
    asked |= {(*min(own, key=lambda x: x[3])[:2], min(x[4] for x in own), len(own)) for own in lists}
    got = got.collect()
    assert sorted((r.file, r.side, r.id, r.n) for r in got) == sorted(asked)
    for r in got:
        assert r.ids == found(rows, r.file, r.side, r.id, r.n), r


def test_tables_end_where_files_do(monkeypatch):
    monkeypatch.setattr(siblings, "NODES", 5)
    files = [1] * 3 + [2] * 4 + [None] * 2 + [3] * 17 + [4]
    batches = [pa.RecordBatch.from_pydict({"file": pa.array(files[at : at + 2], pa.int32())}) for at in range(0, len(files), 2)]
    tables = [t["file"].to_pylist() for t in siblings._whole_files(iter(batches))]
    assert sum(tables, []) == files and len(tables) > 2
    assert not any(set(a) & set(b) for k, a in enumerate(tables) for b in tables[k + 1 :])


def changes(spark, left, right):
    texts = spark.createDataFrame([(1, "lhs", left), (1, "rhs", right)], "file int, side string, text string")
    nodes = parse.with_content_id(parse.tree(texts, parse.GRAMMARS["c"], ["file", "side"]), ["file", "side"])
    rows = {(r.side, r.id): r for r in nodes.collect()}
    out = {}
    for r in propagate.deep_changes(nodes, propagate.equal_subtrees(nodes)).collect():
        out[r.side, r.id] = (rows[r.side, r.id].open or rows[r.side, r.id].content, r.kind, r.opposite_id)
    return out


def test_equal_subtrees_spread_to_all_below(spark):
    got = changes(spark, "f(a, [b, {c, d,},], e) x", "y f(a, [b, {c, d}], e,) z")
    left = {k: v for (s, k), v in got.items() if s == "lhs"}
    right = {k: v for (s, k), v in got.items() if s == "rhs"}
    # f and the list after it are there once on either side; a comma at the end of a list may be on one side only
    assert left[0] == ("f", "unchanged", 1) and left[1] == ("(", "unchanged", 2)
    assert [v for v in left.values() if v[1] == "ignored_punctuation"] == [(",", "ignored_punctuation", None)] * 2
    assert [v for v in right.values() if v[1] == "ignored_punctuation"] == [(",", "ignored_punctuation", None)]
    assert [v[0] for v in left.values() if v[1] == "novel"] == ["x"] and [v[0] for v in right.values() if v[1] == "novel"] == ["y", "z"]
    for k, (token, kind, there) in left.items():
        if kind == "unchanged":
            assert right[there] == (token, "unchanged", k)


def test_random_texts_pair_equal_nodes(spark):
    rng = random.Random(3)

    def text(deep):
        return "".join(rng.choice(["a ", "b ", "c ", f"w{rng.randrange(40)} ", ", "]) if deep > 3 or rng.random() < 0.7 else "[" + text(deep + 1) + "] " for _ in range(rng.randrange(1, 6)))

    texts = []
    for f in range(40):
        t = text(0)
        texts += [(f, "lhs", t), (f, "rhs", t.replace(rng.choice(["a ", "w1"]), rng.choice(["", "new "])))]
    nodes = parse.with_content_id(parse.tree(spark.createDataFrame(texts, "file int, side string, text string"), parse.GRAMMARS["c"], ["file", "side"]), ["file", "side"])
    of = {(r.file, r.side, r.id): r for r in nodes.collect()}
    got = {(r.file, r.side, r.id): r for r in propagate.deep_changes(nodes, propagate.equal_subtrees(nodes)).collect()}
    assert set(got) == set(of)
    for (f, s, i), r in got.items():
        if r.opposite_id is not None:
            there = "rhs" if s == "lhs" else "lhs"
            assert got[f, there, r.opposite_id].opposite_id == i and of[f, there, r.opposite_id].content_id == of[f, s, i].content_id
    same = {}
    for (f, s, _), r in of.items():
        same.setdefault((f, r.content_id, s), []).append(r.id)
    for (f, c, s), ids in same.items():  # whatever is there once on either side is unchanged
        there = same.get((f, c, "rhs" if s == "lhs" else "lhs"), [])
        if len(ids) == len(there) == 1:
            assert got[f, s, ids[0]].opposite_id == there[0]


def ways(spark, roots, edges):
    return assembly.import_tree(spark.createDataFrame(roots, "language string, ord int, source string"), spark.createDataFrame(edges, "source string, ord int, target string"))


def test_imports_come_before_their_first_importer(spark):
    edges = [("a", 1, "c"), ("a", 2, "b"), ("b", 1, "d"), ("c", 1, "d"), ("c", 2, "e"), ("x", 1, "missing")]
    w = ways(spark, [("l", 1, "a"), ("l", 2, "b"), ("l", 3, "x"), ("m", 1, "b")], edges)
    got = [tuple(r) for r in assembly.assembled(w).orderBy("language", "place").collect()]
    assert got == [("l", i, s) for i, s in enumerate("d e c b a missing x".split(), 1)] + [("m", 1, "d"), ("m", 2, "b")]
    assert assembly.cycles(w).count() == 0


def test_cycles_are_reported(spark):
    w = ways(spark, [("l", 1, "a"), ("m", 1, "self")], [("a", 1, "b"), ("b", 1, "c"), ("c", 1, "b"), ("b", 2, "a"), ("self", 1, "self")])
    assert {(r.language, tuple(r.cycle)) for r in assembly.cycles(w).collect()} == {("l", ("b", "c", "b")), ("l", ("a", "b", "a")), ("m", ("self", "self"))}


def test_random_imports_against_a_walk(spark):
    rng = random.Random(6)
    edges = sorted({(f"n{a}", f"n{rng.randrange(a)}") for a in range(1, 14) for _ in range(2)})
    edges = [(s, k, t) for k, (s, t) in enumerate(edges)]
    roots = [("l", k, f"n{i}") for k, i in enumerate(rng.sample(range(14), 5))]
    out = []

    def include(source):
        if source not in out:
            for s, _, t in edges:
                if s == source:
                    include(t)
            out.append(source)

    for _, _, r in roots:
        include(r)
    assert [r.source for r in assembly.assembled(ways(spark, roots, edges)).orderBy("place").collect()] == out


def test_first_ways_are_those_of_all_ways(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(7)}", k, f"n{rng.randrange(7)}") for k in range(12)]
    roots = [(lang, k, f"n{n}") for lang in "lm" for k, n in enumerate(rng.sample(range(7), 3))]
    first = assembly.first_ways(spark.createDataFrame(roots, "language string, ord int, source string"), spark.createDataFrame(edges, "source string, ord int, target string"))
    want = {}
    for r in ways(spark, roots, edges).filter("NOT cyclic").collect():
        key = (r.language, r.sources[-1])
        want[key] = min(want.get(key, (r.path, r.sources)), (r.path, r.sources))
    assert {(r.language, r.source): (r.path, r.sources) for r in first.collect()} == want


def test_more_ways_than_a_recursion_may_have(spark):
    """Each of three steps can be gone in 101 ways: more than 1,000,000 ways, 4 sources."""
    edges = [(f"n{k}", i, f"n{k + 1}") for k in range(3) for i in range(101)]
    first = assembly.first_ways(spark.createDataFrame([("l", 1, "n0")], "language string, ord int, source string"), spark.createDataFrame(edges, "source string, ord int, target string"))
    assert [r.source for r in assembly.assembled(first).orderBy("place").collect()] == ["n3", "n2", "n1", "n0"]


@pytest.mark.parametrize(("text", "want"), [("; inherits: a, b,, c \n(x)", ["a", "b", "c"]), (" ;inherits:x", ["x"]), ("(x)\n; inherits: a", None), ("; inherits a", None), ("", None), (None, None)])
def test_import_lines(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(assembly.import_paths(F.col("t")).alias("p")).first().p == want
