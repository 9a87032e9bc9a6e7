"""Wrapping, abbreviated ids and row summaries against their definitions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gemello.functions.display import width
from gemello.operators import summaries, wrap
from gemello.sources import short_ids
from test_trees import random_tree


def wrapped(text, columns):
    if columns < 1:
        return [""]
    size = lambda s: sum(width(c, 0) for c in s)
    out, line = [], ""
    for word in (text or "").split():
        if size(word) > columns:
            if line:
                out.append(line)
            line, piece = "", ""
            for k, c in enumerate(word):
                if size(c) > columns and not piece:
                    piece = word[k:]
                    break
                if size(piece + c) > columns:
                    out.append(piece)
                    piece = ""
                    if size(c) > columns:
                        piece = word[k:]
                        break
                piece += c
            out.append(piece)
        elif not line:
            line = word
        elif size(line) + 1 + size(word) <= columns:
            line += " " + word
        else:
            out.append(line)
            line = word
    if line:
        out.append(line)
    return out or [""]


@pytest.mark.parametrize("columns", [0, 1, 2, 7, 20])
def test_wrap(spark, columns):
    rng = random.Random(columns)
    words = ["a", "bb", "ccc", "é", "éé", "日本語", "日", "x" * 9, "y" * 31, "日本" * 8, "mid-word", "́"]
    texts = ["  ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(60)] + ["", " ", None, "\t a \n b ", "w " * 3000, "z" * 500]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, line string")
    got = {}
    for r in wrap.wrap(df, ["id"], columns).orderBy("id", "line").collect():
        own = got.setdefault(r.id, [])
        assert r.line == len(own)
        own.append(r.text)
    for i, t in enumerate(texts):
        if "́" not in words or columns >= 7 or "́" not in (t or ""):
            assert got[i] == wrapped(t, columns), (t, columns)
        assert "".join(got[i]).replace(" ", "") == "".join((t or "").split()) or columns < 1


def test_shortest_ids(spark):
    rng = random.Random(2)
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3000)] + ["ab" * 20, "ab" * 19 + "ac", "ab" * 10 + "0" * 20]
    df = spark.createDataFrame([(i,) for i in [*ids, *ids[:50]]] + [(None,)], "oid string").repartition(7)
    got = {r.oid: r.short for r in short_ids.shortest(df).collect()}
    assert set(got) == set(ids)
    for oid in [*rng.sample(ids, 300), *ids[-3:]]:
        want = next(k for k in range(4, 41) if sum(x.startswith(oid[:k]) for x in ids) == 1)
        assert got[oid] == oid[:want]
    assert short_ids.shortest(df.limit(0)).count() == 0 and short_ids.shortest(spark.createDataFrame([("ab" * 20,)], "oid string")).first().short == "abab"
    asked = [(x[:k],) for x in rng.sample(ids, 100) for k in (3, 4, 5, 40)] + [("ABABAB",), ("ffff" * 10,), ("",)]
    for r in short_ids.resolve(spark.createDataFrame(asked, "prefix string"), df).collect():
        hits = [x for x in ids if x.startswith(r.prefix)]
        want = ("too_short", None) if len(r.prefix) < 4 else ("unknown", None) if not hits else ("found", hits[0]) if len(hits) == 1 else ("ambiguous", None)
        assert (r.outcome, r.oid) == want


def summary(nodes, x):
    """(collapsed, leading, trailing, longest) by folding children from left to right."""
    if x[6]:
        return 1, 0, 0, 0
    if x[4]:
        return 0, x[5], x[5], x[5]
    shut = lead = trail = gap = 0
    for c in sorted((n for n in nodes if n[7] == x[1]), key=lambda n: n[2]):
        s, a, b, g = summary(nodes, c)
        gap = max(gap, g, trail + a)
        lead += a if shut == 0 else 0
        trail = trail + b if s == 0 else b
        shut += s
    return shut, lead, trail, gap


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_row_summaries(spark, share):
    rng = random.Random(4)
    rows = []
    for f in range(25):
        tree = random_tree(rng, f, rng.randrange(1, 60))
        for _, i, parent, pre, last, level, *_ in tree:
            rows.append((f, i, pre, last, pre == last, rng.randrange(4), rng.random() < share, parent, level))
    df = spark.createDataFrame(rows, "file int, id long, pre long, last long, is_leaf boolean, lines int, collapsed boolean, parent long, level long")
    got = {(r.file, r.id): (r.collapsed_rows, r.leading, r.trailing, r.longest_gap) for r in summaries.row_summaries(df, ["file"]).collect()}
    assert len(got) == len(rows)
    for x in rows:
        assert got[x[0], x[1]] == summary([n for n in rows if n[0] == x[0]], x), x
    assert summaries.row_summaries(df.filter(F.lit(False)), ["file"]).count() == 0
