"""MaxScore over shards against scores of all documents, its SQL and the odd cases."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gemello.llm import maxscore as ms
from gemello.llm import queries

DOCS, ITEMS = "doc_id long, text string, term string, shard int", "item_id long, text string, n int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in set(items):
        q = Counter(terms(text))
        found = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(r * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in q.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard", [50, 4_000_000])
def test_against_all_scores(spark, shard):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "x-Y", "a_b"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((3, 20, 64))]) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(400)] + [(None, "w1 w2 w59"), (None, "w1 w2 w59"), (7, "w59 w59"), (7, "w59 w59"), (900, None), (901, ""), (902, "..."), (903, "w5 " * 50_000)]
    docs += [(1000 + i, "w58 tie") for i in range(30)]
    rng.shuffle(docs)
    items = [(i, text(rng.randrange(12))) for i in range(40)] + [(50, "tie"), (51, None), (52, ""), (53, "nowhere"), (54, "W59 w59 w1"), (54, "W59 w59 w1"), (55, "w0 w1 w2")]
    index = ms.build(spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS).repartition(3), shard)
    assert got(ms.search(index, spark.createDataFrame([(*i, 1) for i in items], ITEMS))) == brute(docs, items)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "t", 1)], DOCS), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert ms.search(ms.build(none), items).count() == 0
    assert ms.search(ms.build(docs), items.limit(0)).count() == 0
    # two texts under one id are two queries
    two = ms.search(ms.build(docs), spark.createDataFrame([(1, "a", 1), (1, "b a", 1)], ITEMS))
    assert sorted((r.item_id, r.rank, r.doc_id) for r in two.collect()) == [(1, 1, 1)] * 2


def test_blocks_prune_and_stay_exact(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(["rare"] * (i < 20) + ["common"] * rng.randrange(1, 4) + ["mid"] * (i % 3 == 0))) for i in range(3000)]
    table = ms.build(spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS).coalesce(1)).toArrow()
    lists = ms.Lists(table, 3000, sum(len(t.split()) for _, t in docs))
    df = defaultdict(int, Counter(w for _, t in docs for w in set(t.split())))
    query = {w: math.floor(1000 * math.log(6002 / (2 * df[w] + 1))) for w in ("rare", "common", "mid")}
    small, large = ms.best(lists, query, block=16), ms.best(lists, query, block=10**6)
    assert small == large == [(p, s) for _, _, p, s in sorted(brute(docs, [(0, "rare common mid")]), key=lambda r: r[1])]


def test_saturation_is_exact_beyond_64_bits():
    lengths = np.array([10**7, 3], np.int64)
    assert ms.saturation(lengths, 10**11, 10**13).tolist() == [8 * (25 + 75 * x * 10**11 // 10**13) for x in (10**7, 3)]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.execute(queries.ORACLES["op11_lexical_search"]).fetchall()
    assert got(queries.QUERIES["op11_lexical_search"](spark, sf)) == sorted(want, key=str) and want
