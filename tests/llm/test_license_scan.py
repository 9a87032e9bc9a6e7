"""The licence scan against a brute-force search, its SQL and the odd cases."""

import random
import re

import duckdb
import pytest

from gemello.llm import license_scan as ls
from gemello.llm import queries

SCHEMA = "doc_id long, text string, label string, words int"


def words(t):
    return re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def places(t):
    w = words(t)
    return sorted((i, b.label) for b in ls.BASE for i in range(len(w)) if w[i : i + len(b.words)] == b.words)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_places_against_brute_force(spark):
    rng = random.Random(5)
    pieces = "gnu general public license apache license cc by mit license GNU General mit Public cc-by MIT,License é license by".split()
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(60))) + rng.choice(["", "!", " CC BY", "Mit License"]), "x", 1) for i in range(150)]
    for i, r in by_id(ls.scan(spark.createDataFrame(docs, SCHEMA))).items():
        want = places(docs[i][1])
        assert (r.n_words, r.n_base) == (len(words(docs[i][1])), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and (r.score == 1.0 if want else 0 <= r.score <= 1)


def test_odd_rows(spark):
    docs = [(1, None, "a", 1), (2, "", "a", 1), (3, "one", "a", 1), (None, "MIT License", "a", 1), (None, "MIT License", "a", 1), (4, "x\ty " * 60_000 + "apache license", "a", 1), (5, "...", "a", 1)]
    got = ls.scan(spark.createDataFrame(docs, SCHEMA)).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and [tuple(r)[1:] for r in got if r.doc_id is None] == [(2, 1, 0, 0, "mit", "mit", 1.0)] * 2
    assert all(tuple(rows[i])[1:] == (n, 0, None, None, "", "", 0.0) for i, n in ((1, 0), (2, 0), (3, 1), (5, 0)))
    assert (rows[4].n_words, rows[4].n_base, rows[4].first_word) == (120_002, 1, 120_000)
    assert ls.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        ls.scan(spark.createDataFrame(docs, SCHEMA), [ls.Template("x", "one")]).count()


def test_notices_with_changed_added_and_missing_words(spark):
    mit = next(t for t in ls.NOTICES if t.label == "mit" and len(t.words) > 20).words
    changed, added, missing, two_added = list(mit), list(mit), list(mit), list(mit)
    changed[10] = "zzz"
    added.insert(10, "zzz")
    del missing[10]
    two_added[8:8] = ["zzz", "yyy"]
    two_added[20:20] = ["qqq"]
    spoiled = [w if i % 4 else "zzz" for i, w in enumerate(mit)]
    half = mit[: len(mit) // 2]
    shuffled = sorted(mit)
    twice = [*mit, "and", "again", *mit]
    texts = {1: mit, 2: changed, 3: added, 4: missing, 5: two_added, 6: spoiled, 7: half, 8: shuffled, 9: twice, 10: "gnu general public license version 2".split(), 11: "cc by nc".split() * 50}
    docs = spark.createDataFrame([(i, " ".join(["pre", "fix", *w, "end"]), "x", 1) for i, w in texts.items()], SCHEMA)
    got = {i: r.labels for i, r in by_id(ls.scan(docs)).items()}
    assert all(got[i] == "mit" for i in (1, 2, 3, 4, 5, 9)) and not any(got[i] for i in (6, 7, 8))
    assert got[10] == "gpl,gpl-2.0" and got[11] == "cc-by,cc-by-nc"
    found = [(r.doc_id, r.first, r.last) for r in ls.labelled_spans(docs).collect() if r.label == "mit"]
    assert (1, 2, 2 + len(mit)) in found and (3, 2, 3 + len(mit)) in found and sorted(x for x in found if x[0] == 9) == [(9, 2, 2 + len(mit)), (9, 4 + len(mit), 4 + 2 * len(mit))]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = queries.QUERIES["op13_license_scan"](spark, sf)
    want = db.execute(queries.ORACLES["op13_license_scan"] + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want and any(r[2] for r in want)
