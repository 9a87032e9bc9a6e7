"""Nesting by windows and passes over sorted groups against stacks."""

import random

from gemello.operators import folds, intervals
from gemello.operators.scan import ROWS


def spans_of(rng, start, end, deep, out):
    """Spans that nest, some of them equal."""
    for _ in range(rng.randrange(1, 3)):
        out.append((start, end))
        if rng.random() < 0.3:
            out.append((start, end))
    at = start
    while deep and at < end - 1:
        a = rng.randrange(at, end)
        b = rng.randrange(a + 1, end + 1)
        spans_of(rng, a, b, deep - 1, out)
        at = b


def test_nest_takes_the_smallest_holder(spark):
    rng = random.Random(5)
    rows = []
    for f in range(60):
        own = []
        spans_of(rng, 0, rng.randrange(2, 40), 3, own)
        ids = rng.sample(range(1000), len(own))
        rows += [(f, i, a, b) for i, (a, b) in zip(ids, own, strict=True)]
    got = {(r.file, r.id): r.parent_id for r in intervals.nest(spark.createDataFrame(rows, "file int, id long, start long, end long"), ["file"]).collect()}
    for f, i, a, b in rows:
        holds = [(d - c, -j, j) for g, j, c, d in rows if g == f and j != i and c <= a and d >= b and (c < a or d > b or j < i)]
        assert got[f, i] == (min(holds)[2] if holds else None)


def test_empty_spans_have_a_holder(spark):
    rows = [(1, 1, 0, 10), (1, 2, 5, 5), (1, 3, 5, 8), (1, 4, 5, 5), (1, 5, 8, 8)]
    got = {r.id: r.parent_id for r in intervals.nest(spark.createDataFrame(rows, "file int, id long, start long, end long"), ["file"]).collect()}
    assert got == {1: None, 3: 1, 2: 3, 4: 2, 5: 1}


def test_passes_over_many_and_over_large_groups(spark):
    rng = random.Random(2)
    rows = [("big", k, rng.randrange(10**6), rng.randrange(10**6)) for k in range(3 * ROWS)] + [(f"g{i}", k, rng.randrange(50), rng.randrange(50)) for i in range(500) for k in range(10)]
    got = sorted(map(tuple, folds.increasing_pairs(spark.createDataFrame(rows, "file string, seq long, lhs long, rhs long"), ["file"]).collect()))
    want, high = [], {}
    for f, _, a, b in rows:
        x, y = high.get(f, (-1, -1))
        if a > x and b > y:
            high[f] = a, b
            want.append((f, a, b))
    assert got == sorted(want)
