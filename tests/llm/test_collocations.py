"""Collocations against counts of all phrases, their SQL and the odd cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gemello.llm import collocations as c
from gemello.llm import queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def brute(docs, top=2000):
    f = {}
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        found = {p: v for p, v in counts.items() if len(p) > 1 and v >= 30}
        inner = Counter()
        for q, v in found.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inner[q[i : i + m]] = max(inner[q[i : i + m]], v)
        rows = []
        for p, a in found.items():
            if 100 * inner[p] < 80 * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, lo, hi, n, -s) for r, (s, a, p, lo, hi) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def some(seed, n=400):
    rng = random.Random(seed)
    words = "the of Of a red blue house é É-x new york city in on #1   x y".split(" ")
    marks = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "! ", "\x0b", " "]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(["new york city", "in the red house", *words]) + rng.choice(marks) for _ in range(rng.randrange(40)))
        docs.append((text, rng.choice(["en", "en", "en", "de", None])))
    return docs + [(None, "en"), ("", "fr"), ("...", "fr"), ("few words", "it"), ("la la " * 20_000, "long"), ("same text here " * 2, "en")] + [("b a tie", "tie")] * 40 + [("c a tie", "tie")] * 40


def frame(spark, docs):
    return spark.createDataFrame([(1, *d, "p", 1) for d in docs], SCHEMA)


@pytest.mark.parametrize(("bits", "chunk"), [(None, None), (6, 500), (15, 3000)])
def test_against_all_counts(spark, monkeypatch, bits, chunk):
    if chunk:
        monkeypatch.setattr(c, "CHUNK", chunk)
    docs = some(bits or 1)
    got = sorted(map(tuple, c.collocations(frame(spark, docs).repartition(3), bits=bits).collect()))
    assert got == brute(docs) and len({r[0] for r in got}) >= 4


def test_top_and_empty(spark):
    docs = some(4)
    assert sorted(map(tuple, c.collocations(frame(spark, docs), top=3).collect())) == brute(docs, 3)
    assert c.collocations(frame(spark, [])).count() == 0 and c.collocations(frame(spark, [(None, None)])).count() == 0


def test_bitmaps_prune(spark):
    rng = random.Random(2)
    docs = [(" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) + " very often so", "en") for _ in range(60)]
    got, _ = c.frequent_phrases(frame(spark, docs))
    assert {r.phrase for r in got.filter("words > 1").collect()} == {"very often", "often so", "very often so"}
    words = np.array([1, 2, 3, 0, 1, 2], np.int32)
    hashes = np.array([0, 1 << 63, 3 << 61, 5 << 59], np.uint64)[words]
    assert c.grams(words, hashes, 2, c.Bitmap(16, None), c.Bitmap(16, None)).tolist() == [0, 1, 4]
    only = np.zeros(8192, np.uint8)
    for h in hashes[:2]:
        at = int(h) >> 48
        only[at >> 3] |= 1 << (at & 7)
    assert c.grams(words, hashes, 2, c.Bitmap(16, only.tobytes()), c.Bitmap(16, None)).tolist() == [0, 4]


def test_products_beyond_64_bits(spark):
    rows = [("x", "a", 1, 10**13), ("x", "b", 1, 10**13 + 3), ("x", "a b", 2, 10**13 - 7)]
    got = c.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [r.score for r in got] == [2_000_000 * (10**13 - 7) // (2 * 10**13 + 3)]


def test_large_vocabulary_is_counted_exactly():
    words = np.random.default_rng(1).integers(1, 4, 1000).astype(np.int32) * 2_000_000_000 // 4
    at = np.arange(997)
    got = {tuple(words[p : p + 4]): n for p, n in zip(*c.counted(words, at, 4, 2_000_000_000), strict=True)}
    assert got == Counter(tuple(words[p : p + 4]) for p in at)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(db.execute(queries.ORACLES["op12_collocations"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op12_collocations"](spark, sf).collect())) == want and want
