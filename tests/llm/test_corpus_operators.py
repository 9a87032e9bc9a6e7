"""Deduplication, packing, files, archives and the host graph against brute force, with the odd cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gemello.llm import components, exact_dedup, packing, simhash, token_binary, url_graph, warc
from gemello.session import shared_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "Same Text", "a"), (5, "same text", "a"), (3, "SAME TEXT", "b"), (5, "same text", "a"), (2, None, "x"), (4, "", "x"), (None, "lone é É", "y"), (7, "lone É é", "y"), (8, "lone É É", "y"), (9, "long " * 50_000, "z"), (10, "LONG " * 50_000, "z")]
SCHEMA = "doc_id long, text string, digest string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("capacity", [2, 1000])
def test_exact_groups(spark, weak, capacity):
    docs = spark.createDataFrame(ODD, SCHEMA)
    kinds = {"key": lambda c: F.pmod(F.xxhash64(c), F.lit(3))} if weak else {}
    got = sorted(((r.doc_id or -1, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, capacity, **kinds).collect()), key=str)
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[lower(t)].append(i)
    top = lambda g: max((x for x in g if x is not None), default=None)
    want = sorted(((i or -1, hashlib.sha256(lower(t).encode()).hexdigest(), top(groups[lower(t)]), len(groups[lower(t)]), i == top(groups[lower(t)])) for i, t, _ in ODD), key=str)
    assert got == want


def test_drop_exact_keeps_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = exact_dedup.drop_exact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 4, 5, 5, 7, 8, 10]
    assert exact_dedup.drop_exact(docs.limit(0)).count() == 0 and exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("key")))
    rows = exact_dedup.directory(keys, capacity=600, width=8).collect()
    assert all(len(r.bucket) == r.depth and format(r.prefix, "08b").startswith(r.bucket) for r in rows)
    names = {r.bucket for r in rows}
    assert len(names) > 4 and not any(a != b and b.startswith(a) for a in names for b in names)
    held = defaultdict(int)
    for r in rows:
        held[r.bucket] += r.n
    assert all(r.held == held[r.bucket] and (r.held <= 600 or r.depth == 8) for r in rows)
    parents = defaultdict(int)  # none was split without need
    for b, n in held.items():
        for k in range(len(b)):
            parents[b[:k]] += n
    assert all(n > 600 for n in parents.values())


def test_directories_go_as_deep_as_keys_ask(spark):
    low = spark.range(40).select(F.col("id").alias("key"))  # they differ in their last six bits only
    keys = low.unionByName(spark.range(100).select(F.xxhash64("id").alias("key")))
    tables = exact_dedup.directories(keys, capacity=10)
    assert len(tables) > 3 and tables[-1][0] > 60
    placed = exact_dedup.with_bucket(keys, tables, 10).collect()
    assert sorted(r.key for r in placed) == sorted(r.key for r in keys.collect())
    held = defaultdict(int)
    for r in placed:
        held[r.bucket] += 1
        assert len(r.bucket) == r.depth and format(r.key & (2**64 - 1), "064b").startswith(r.bucket)
    assert max(held.values()) <= 10


def test_index_chains_texts_of_one_key(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text")
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    keys = docs.select("doc_id", weak(exact_dedup.normalized(F.col("text"))).alias("key"))
    index = exact_dedup.build_index(docs, keys, 2, weak).collect()
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[lower(t)].append(i)
    assert sum(r.n for r in index) == len(ODD) and len(index) == len(groups)
    for key in {r.key for r in index}:
        own = sorted((r for r in index if r.key == key), key=lambda r: r.chain)
        assert [r.chain for r in own] == list(range(len(own)))
        if len(own) > 1:
            assert all(r.chained and r.n == len(groups[r.norm]) for r in own) and [r.norm.encode() for r in own] == sorted(r.norm.encode() for r in own)


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    own = defaultdict(list)
    for i in range(len(fps)):
        own[find(i)].append(ids[i])
    return {i: min((x for x in own[find(i)] if x is not None), default=None) for i in range(len(fps))}


def test_fingerprint():
    for t in [None, "", " \t", "one", "One two three four", "a b c d e f g h" * 40, "é É x\x1cy z"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_golay_code_is_perfect():
    own, _ = simhash.golay()
    assert len(np.unique(own)) == 4096 and np.bincount(own).min() == np.bincount(own).max() == 2048


@pytest.mark.parametrize("block", [16, 2048])
def test_links_lose_nothing(spark, block):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    hub = fps[0]
    for k in range(240):  # near ones of all distances, a crowd around one
        f = hub if k % 2 else fps[int(rng.integers(0, 60))]
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = brute_components(fps, signed)
    assert {f: found.get(f, f) for f in signed} == {signed[i]: c for i, c in want.items()}


def test_near_duplicates_odd_tables(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river to the old mill where it sleeps " * 5
    rows = [(4, base), (2, base + "end"), (2, base + "end"), (9, "entirely other words are found here, so it is alone in its group"), (7, None), (6, ""), (None, base), (8, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    assert got == sorted((rows[i][0] or -1, c) for i, c in want.items())
    out = simhash.drop_near(docs)
    assert out.columns == docs.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 2, 2, 6, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 500 + k) for k in range(1, 300)] + [(1000, 1000)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert all(out[k] == 0 for k in range(201)) and all(out[500 + k] == 500 for k in range(300))


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for rule in ("residual", "dot"):
        for cap in (packing.Capacities(100, 100, 10_000, rule=rule), packing.Capacities(100, 4, 4000, rule=rule)):
            lengths = rng.integers(1, 60, 500)
            runs = packing.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), cap)
            held = defaultdict(list)
            for length, a, b, first, offset in runs.tolist():
                for k in range(b - a):
                    held[first + k].append((offset, length))
            assert sum(map(len, held.values())) == 500
            for own in held.values():
                own.sort()
                assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
                assert sum(n for _, n in own) <= cap.tokens and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.cost
            if cap.documents == 100:
                assert len(held) <= -(-lengths.sum() // 100) * 1.03 + 1
    with pytest.raises(ValueError):
        packing.plan({101: 1}, packing.Capacities(100))
    assert len(packing.plan({})) == 0


def ids_of(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1]


def test_pack_odd_tables(spark):
    texts = ["one two", None, "", "word " * 9000, "one two", "x"]
    docs = spark.createDataFrame([(k if k != 5 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(docs, WORDS).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for t in texts)
    for k, t in enumerate(texts[:5]):
        ids = np.asarray(ids_of(t), "<u4")
        for r in (x for x in got if x.doc_id == k):
            assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(o for o, _ in s) == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1]) and sum(n for _, n in s) <= 4096 for s in held.values())
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_many_rows_of_one_id_are_spread(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one shard
    try:
        manifest = token_binary.write_tokens(docs, shared_dir(spark, "tokens"), WORDS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = [r.n_docs for r in spark.read.parquet(manifest).collect()]
    assert sum(shards) == 4000 and max(shards) < 2600
    got = token_binary.read_tokens(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: (i is not None, i or 0)) and sum(r.doc_id is None for r in got) == 1334


def test_token_files_round_trip(spark):
    texts = {3: "some words", 1: None, 2: "", 9: "word " * 20_000, 4: "é 日本"}
    docs = spark.createDataFrame([*((k, t, 5) for k, t in texts.items()), (4, "é 日本", 5), (None, "null id", 5), (-(2**63), "least id", 5)], "doc_id long, text string, start int")
    folder = shared_dir(spark, "tokens")
    manifest = token_binary.write_tokens(docs, folder, WORDS)
    rows = sorted(token_binary.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -(2**63), 1, 2, 3, 4, 4, 9]
    texts[-(2**63)] = "least id"
    at = 0
    for r in rows:
        ids = np.asarray(ids_of("null id" if r.doc_id is None else texts[r.doc_id]), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for s in spark.read.parquet(manifest).collect():
        shard = token_binary.Shard(s.path)
        for k, doc in enumerate(shard.doc_ids.tolist()):
            assert (k < shard.nulls or k in shard.find(doc)) and np.frombuffer(shard.document(k), "<u4").tolist() == ids_of("null id" if k < shard.nulls else texts[doc])
    assert token_binary.token_files(docs.limit(0), WORDS).count() == 0


def test_dictionary_is_checked(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.repeat(F.lit(" more words"), F.lit(20))).alias("text"))
    folder = shared_dir(spark, "tokens")
    manifest = token_binary.write_tokens(docs, folder, WORDS)
    assert token_binary.read_tokens(spark, manifest).count() == 300
    fs, path = token_binary.open_fs(folder)
    name = next(f.path for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(path)) if f.path.endswith(".zdict"))
    with fs.open_output_stream(name) as f:
        f.write(b"other")
    token_binary._dictionary.cache_clear()
    with pytest.raises(ValueError):
        token_binary.Shard(spark.read.parquet(manifest).first().path)


def test_warc_round_trip_at_every_split(spark):
    body = "<p>" + "text " * 300 + "\x1f</p>"
    rows = [(1, "http://a/1", body), (2, "http://a/2", None), (3, None, ""), (9, "http://a/9", body), (9, "http://a/9", body), (None, "u v\nw", body), (5, "http://b", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, size string").repartition(3)
    manifest = warc.write_archives(pages.select("page_id", "url", "html"), shared_dir(spark, "warc"))
    for split in (37, 1000, 1 << 24):
        got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, manifest, split).collect()), key=str)
        n = len(body.encode())
        assert got == sorted([(-1, n, "revisit", 9), (1, n, "revisit", 9), (9, n, "response", None), (9, n, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (5, 200_000, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=10).collect()}
    assert small[2] == small[3] == "response" and small[1] == "revisit"


def test_reader_rejects_false_members(tmp_path):
    import gzip

    real = gzip.compress(warc.record(1, "u", "p", "D", 1, None, False))
    noise = warc.MAGIC + b"\x00not a member" + gzip.compress(b"not a record") + warc.MAGIC
    path = tmp_path / "x.warc.gz"
    path.write_bytes(noise + real + noise + real)
    places = [p for p, _ in warc.members(str(path), 0, 10**6)]
    assert places == [len(noise), 2 * len(noise) + len(real)]
    by_range = [p for s in range(0, path.stat().st_size, 7) for p, _ in warc.members(str(path), s, s + 7)]
    assert by_range == places


def test_damaged_records_are_an_error(spark, tmp_path):
    import gzip

    whole = [gzip.compress(warc.record(k, "u", "p" * 50 * k, "D", 50 * k, 0, True)) for k in range(1, 6)]
    path = tmp_path / "x.warc.gz"
    for k in range(5):
        cut = bytearray(whole[k])
        cut[len(cut) // 2] ^= 0xFF
        raw = b"".join([*whole[:k], bytes(cut), *whole[k + 1 :]])
        path.write_bytes(raw)
        for split in (11, 100, 10**6):
            with pytest.raises(ValueError):
                for at in range(0, len(raw), split):
                    list(warc.members(str(path), at, at + split, True, len(raw)))
    raw = b"".join(whole)
    for end in (len(raw), len(raw) - 9, len(raw) - len(whole[-1])):
        path.write_bytes(raw[:end])
        got = lambda: [p for at in range(0, len(raw), 40) for p, _ in warc.members(str(path), at, at + 40, True, len(raw))]
        if end == len(raw):
            assert len(got()) == 5
        else:
            with pytest.raises(ValueError):
                got()


RULES = [url_graph.Rule(*r) for r in (("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False))]


@pytest.mark.parametrize("many", [False, True])
def test_url_rules(spark, many, monkeypatch):
    if many:
        monkeypatch.setattr(url_graph, "INLINE_RULES", 0)
    urls = {
        "http://www.Example.COM/en/71?x": ("www.example.com", "/en/71", "example.com/en/7", "allow"), "http://a.com/en/1#t": ("a.com", "/en/1", "com/en/", "block"), "HTTP://xcom/en/": ("xcom", "/en/", None, "allow"),
        "no scheme": ("", "", None, "allow"), "//x": ("", "", None, "allow"), "x://example.net/de/8/9": ("example.net", "/de/8/9", "example.net/de/8", "block"), "a://b.net": ("b.net", "", None, "allow"), "http://É.org?/es/": ("É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(urls)] + [(99, None, "x", "z")], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(pages, RULES).collect()}
    assert got == {**dict(enumerate(urls.values())), 99: ("", "", None, "allow")}
    assert url_graph.judge(pages.limit(0), RULES).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.net/de/1", link("fine.io")), (2, "http://bad.org/es/1", link("elsewhere.io")), (3, "http://farm.io/", link("bad.org", "bad.org")), (4, "http://fine.io/", None), (5, "http://elsewhere.io/", ""), (6, "http://bad.org/other", None), (7, "http://bad.org/es/2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_graph.judge(pages, RULES).collect()}
    assert got[6].verdict == "block" and got[4].verdict == got[5].verdict == "allow" and got[3].verdict == "block"
    # the same by a dense power iteration; hosts of two labels have no domain
    hosts = ["good.net", "fine.io", "bad.org", "elsewhere.io", "farm.io"]
    at = {h: k for k, h in enumerate(hosts)}
    for name, seed, arrows in (("trust", {"good.net": 1.0}, [("good.net", "fine.io", 1.0), ("bad.org", "elsewhere.io", 1.0), ("farm.io", "bad.org", 1.0)]), ("distrust", {"bad.org": 2 / 3}, [("fine.io", "good.net", 1.0), ("elsewhere.io", "bad.org", 1.0), ("bad.org", "farm.io", 1.0)])):
        s, m = np.zeros(5), np.zeros((5, 5))
        for h, x in seed.items():
            s[at[h]] = x
        for a, b, x in arrows:
            m[at[b], at[a]] = x
        r = s.copy()
        for _ in range(url_graph.ROUNDS):
            r = 0.15 * s + 0.85 * m @ r
        assert all(abs(getattr(got[p], name) - r[at[got[p].host]]) < 1e-9 for p in got)


def test_domains_and_bases_are_edges(spark):
    rows = [(1, "http://a.bad.org/es/1", None), (2, "http://b.bad.org/other", None), (3, "http://c.d.fine.net/de/1", '<base href="//far.io/"><a href="x">1</a><a href=y>2</a><a href="#z">'), (4, "http://far.io/", "<a href='/own'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.src, r.dst): r.n for r in url_graph.host_edges(pages.select(url_graph.host_of(F.col("url")).alias("host"), "html")).collect()}
    up = [("a.bad.org", "bad.org"), ("b.bad.org", "bad.org"), ("c.d.fine.net", "d.fine.net"), ("d.fine.net", "fine.net")]
    # the base itself and the two links that it holds for
    assert edges == {("c.d.fine.net", "far.io"): 3, **{e: 1 for e in up}, **{(b, a): 1 for a, b in up}}
    got = {r.page_id: r for r in url_graph.judge(pages, RULES).collect()}
    # b.bad.org has no blocked page of its own: what reaches it comes over its domain
    assert got[2].distrust > 0.075 and got[2].trust == 0 and got[2].verdict == "block" and got[4].verdict == "allow" and got[4].trust > 0
