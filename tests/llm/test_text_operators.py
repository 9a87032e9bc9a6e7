"""Extraction, decontamination, token counts and quality against brute force, with the odd cases."""

import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gemello.llm import decontaminate, html_extract, line_crf, token_counts
from gemello.llm.tokens import SpanTokenizer, WordTokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPANS = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.lists(st.sampled_from(list("abXY'stl 19\n\t!?.é≠ßΣİ\x1c\u00a0日") + ["it's ", "<|endoftext|>"]), max_size=60).map("".join)
PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu here</a></li></ul></nav><div class="ad">Buy</div>'
    "<article><h1>Head &amp; title</h1><p>First   paragraph with some words<br>in it.<p>Second <b>bold</b> paragraph of the text here.</p><div class='comments'><p>I like it a lot, really.</p></div></article>"
    "<footer>&copy; somebody</footer></body></html>"
)


@pytest.fixture(scope="module")
def tokenizers():
    return WordTokenizer(WORDS), Tokenizer.from_file(WORDS), SpanTokenizer(SPANS), SpanTokenizer(SPANS).tokenizer


@settings(max_examples=150, deadline=None)
@given(text=TEXT)
def test_memoised_tokenisation_is_the_librarys(tokenizers, text):
    own, lib, spans, lib_spans = tokenizers
    assert np.frombuffer(own(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert [tuple(r) for r in spans(text).tolist()] == [tuple(r) for r in lib_spans.encode(text, add_special_tokens=False).offsets]


def test_memo_generations(monkeypatch):
    import gemello.llm.tokens as t

    monkeypatch.setattr(t, "MEMO", 3)
    own = WordTokenizer(WORDS)
    text = "a bb cc dd ee a bb ff a gg"
    assert np.frombuffer(own(text), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert len(own.memo) <= 3


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & title\n\nFirst paragraph with some words in it.\n\nSecond bold paragraph of the text here."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    plain = "<body><div id=menu><a href=x>a</a></div><div><h2>Title</h2><p>" + "Some long text of a page. " * 8 + "</p><p>" + "More of this text here. " * 8 + "</p></div><div class=footer>end</div></body>"
    assert html_extract.main_text(plain).split("\n\n")[0] == "Title" and "end" not in html_extract.main_text(plain)
    assert html_extract.main_text(PAGE[:-40]).endswith("text here.")


PARAS = "".join(f"<p>{w} paragraph of the article with a number of plain words in it, and some more.</p>" for w in ("First", "Second", "Third"))
ARTICLE = "\n\n".join(f"{w} paragraph of the article with a number of plain words in it, and some more." for w in ("First", "Second", "Third"))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><article><h1>Title</h1>{}</article></div>",
        "<form id=aspnetForm><article><h1>Title</h1>{}</article></form>",
        "<form><div class='page widget'><h1>Title</h1>{}</div></form>",
        "<body class='with-comments'><div id=sidebar-layout><main><h1 class='post-header'>Title</h1>{}</main></div>",
        "<article class='post comments-open'><div class='article-header'><h1>Title</h1></div>{}</article>",
        "<div><section><h1>Title</h1>{}</section></div><div class='comments'><h3>Two</h3><article><p>I liked this text a lot, it is so good.</p></article></div>",
        "<article><header><h1>Title</h1></header>{}<div class='post-comments'>" + "<p>A very long comment of a reader on the text, as there are many here.</p>" * 9 + "</div></article>",
        "<div><h1>Title</h1>{}</div><div>" + "<a href=x>Some linked text that is long, longer than the text itself</a><br>" * 9 + "</div>",
        "<div id=x><h1>Title</h1>{}<aside><p>By the way, a note that is beside the text.</p></aside></div><p class='ad-banner'>Buy these things, they are cheap now.</p>",
    ],
)
def test_wrappers_keep_their_article(page):
    assert html_extract.main_text(f"<html><nav><a href=/>Home</a></nav>{page.format(PARAS)}<footer>The end of it all</footer>") == f"Title\n\n{ARTICLE}"


def test_short_blocks_at_the_end_stay():
    items = "".join(f"<li>item {k} of the closing list</li>" for k in range(6))
    text = html_extract.main_text(f"<body><div>{'<p>' + 'long text ' * 50 + '</p>'}{'<p>' + 'more text ' * 50 + '</p>'}<ul>{items}</ul></div><div><a href=x>elsewhere</a></div>")
    assert text.count("closing list") == 6 and "elsewhere" not in text


def test_ratios_decide_between_equal_elements(monkeypatch):
    # the list has more text and no mark; without the ratios it would be the region
    links = "<div>" + "".join(f"<li><a href={k}>a link to the page number {k} of all the pages</a></li>" for k in range(30)) + "</div>"
    page = f"<div>{PARAS}</div>{links}"
    assert html_extract.main_text(page) == ARTICLE
    monkeypatch.setattr(html_extract, "clusters", lambda lines: np.ones(len(lines), bool))
    assert html_extract.main_text(page) != ARTICLE


@settings(max_examples=100, deadline=None)
@given(lines=st.lists(st.tuples(st.integers(0, 300), st.integers(0, 6), st.integers(0, 300)), min_size=1, max_size=30))
def test_clusters_against_brute_force(lines):
    lines = [("x" * max(1, n), tags, min(links, max(1, n)), 0) for n, tags, links in lines]
    own = [(len(t) - links) / (tags + 1) for t, tags, links, _ in lines]
    kernel = {d: np.exp(-d * d / 2) for d in range(-2, 3)}
    smoothed = []
    for k in range(len(own)):
        near = [(kernel[d], own[k + d]) for d in kernel if 0 <= k + d < len(own)]
        smoothed.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(smoothed) / len(smoothed)
    bound = 0.5 * (sum((x - mean) ** 2 for x in smoothed) / len(smoothed)) ** 0.5
    got = html_extract.clusters(lines)
    assert all(g == (s > bound and o >= 1) for g, s, o in zip(got.tolist(), smoothed, own, strict=True) if abs(s - bound) > 1e-9)


def test_tags_that_are_not_well_formed():
    assert html_extract.main_text("<p>one two three<p title='x\">four five six</p><p>seven <b") == "one two three\n\nfour five six\n\nseven"
    assert html_extract.main_text("<p>a < b & c &lt; d</p><!-- no > no --><p>e</p><script>if (a < b) '<p>'</script ><p>f<!-- g") == "a < b & c < d\n\ne\n\nf"
    plain = "<p class=a id='b' x=\"<>\">t</p><br/><A HREF=x>u</A>"
    assert html_extract.well_formed(plain) == plain


@pytest.mark.parametrize("unit", ["<div>x", "<a ", "<a x=\"", "<!--", "<b>", "</i>", '<a b=">" ', "<i><div>", "&#", "<script>", "<li>x"])
def test_long_odd_pages_take_time_in_proportion(unit):
    import time

    start = time.process_time()
    html_extract.main_text(unit * (300_000 // len(unit)))
    assert time.process_time() - start < 5  # a scan that goes back takes minutes


def test_main_text_of_a_long_page():
    body = "<p>" + "word &amp; word " * 20_000 + "</p>"
    assert html_extract.main_text(f"<article>{body}</article>") == ("word & word " * 20_000).strip()


def test_extract_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, PAGE, "x", 1), (1, None, PAGE, "x", 1), (2, "u", None, None, None), (None, "u", "", None, None)]
    out = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in out) == [(-1, 0), (1, len(out[0].text)), (1, len(out[0].text)), (2, 0)]
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(item=st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), text=st.binary(max_size=25).map(lambda b: bytes(97 + x % 3 for x in b)), edits=st.integers(0, 5))
def test_banded_alignment(item, text, edits):
    best, got = edit_distance(item, text), decontaminate.align(item, text, edits)
    assert (got[0] == best) if best <= edits else got is None


def test_search_finds_all_within_the_budget():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    rand = lambda n: decontaminate.normal(rng.choice(letters, n).tobytes().decode())
    items = [rand(n) for n in (20, 60, 120, 300)] + [b"ab cd", b"x"]
    texts = []
    for k in range(60):
        own = bytearray(items[k % len(items)])
        for _ in range(int(rng.integers(0, 1 + 2 * int(0.08 * len(own))))):
            p = int(rng.integers(0, len(own)))
            if rng.random() < 0.5:
                own[p] = int(rng.choice(letters))
            else:
                del own[p]
        texts.append(rand(200) + b" " + bytes(own) + b" " + rand(100))
    block = decontaminate.Block(list(range(len(items))), items)
    got = {(t, i): e for t, i, _, _, e in block.search(texts)}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            if block.edits[i]:
                best = edit_distance(item, text)
                assert got.get((t, i)) == (best if best <= block.edits[i] else None)
            else:
                assert ((t, i) in got) == (b" " + item + b" " in b" " + text + b" ")


@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_search_of_repetitive_texts_against_brute_force(data):
    """Few letters and repeats, small pieces and windows of hits: places in every piece, repeated q-grams and many hits."""
    unit = st.sampled_from([b"0", b"ab", b"abc ", b"aab", b"x1y2z3w4v5u6t7"])
    part = st.tuples(unit, st.integers(1, 12)).map(lambda p: p[0] * p[1])
    make = st.lists(part, min_size=1, max_size=5).map(b"".join)
    items = data.draw(st.lists(make.filter(lambda x: len(x) > 12), min_size=1, max_size=3))
    texts = []
    for _ in range(data.draw(st.integers(1, 3))):
        own = bytearray(data.draw(make) + data.draw(st.sampled_from(items)) + data.draw(make))
        for _ in range(data.draw(st.integers(0, 4))):
            own[data.draw(st.integers(0, len(own) - 1))] = data.draw(st.sampled_from(b"0ab7"))
        texts.append(bytes(own))
    kept = decontaminate.HITS, decontaminate.TEXT_BYTES, decontaminate.REPEAT
    try:
        decontaminate.HITS, decontaminate.TEXT_BYTES, decontaminate.REPEAT = data.draw(st.sampled_from([(5, 16, 1), (50, 64, 2), (1 << 21, 1 << 20, 8)]))
        block = decontaminate.Block(list(range(len(items))), items)
        found = block.search(texts)
    finally:
        decontaminate.HITS, decontaminate.TEXT_BYTES, decontaminate.REPEAT = kept
    got = {(t, i): e for t, i, _, _, e in found}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            best = edit_distance(item, text)
            assert got.get((t, i)) == (best if best <= block.edits[i] else None)
    assert all(edit_distance(items[i], texts[t][a:b]) <= e for t, i, a, b, e in found)


def test_repetitive_long_texts_take_bounded_memory():
    import tracemalloc

    item, near = b"0" * 800, b"0" * 400 + b"1" + b"0" * 399
    texts = [b"0" * 80_000, (b"0" * 300 + b"1") * 20, b"a" * 3_000_000 + item]
    tracemalloc.start()
    got = {(t, i): e for t, i, _, _, e in decontaminate.Block([1], [item]).search(texts)}
    got |= {(t, i + 1): e for t, i, _, _, e in decontaminate.Block([2], [near]).search([x[-6000:] for x in texts])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): edit_distance(item, texts[1][:2000]), (1, 1): 2, (2, 0): 0, (2, 1): 1} and peak < 500e6


def test_items_of_one_edit_below_sixteen_bytes():
    items = [b"thirteen chrs", b"fourteen chars", b"fifteen charsss"]
    block = decontaminate.Block([0, 1, 2], items)
    texts = [b"a " + x[:5] + b"#" + x[6:] + b" b" for x in items] + [b"thirtee chrs"]
    assert {(t, i, e) for t, i, _, _, e in block.search(texts)} == {(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 0, 1)}


def test_decontaminate_odd_tables(spark):
    passage = "The quick brown fox jumps over the lazy dog near the old river bank, and then it goes home to sleep."
    docs = spark.createDataFrame([(1, "Before. " + passage.upper() + " After.", 9), (2, "something else entirely " * 9, 9), (2, "something else entirely " * 9, 9), (3, None, 9), (None, passage, 9), (4, "x " * 100_000 + passage, 9)], "doc_id long, text string, item_ids int")
    bench = spark.createDataFrame([(7, passage, 1), (7, passage, 1), (8, None, 1), (9, "", 1), (None, "short one", 1)], "item_id long, text string, doc_id int")
    out = {(r.doc_id, r.contaminated): list(r.item_ids) for r in decontaminate.judged(docs, bench).collect()}
    assert out == {(1, True): [7], (2, False): [], (3, False): [], (None, True): [7], (4, True): [7]}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 6 and decontaminate.judged(docs.limit(0), bench).count() == 0
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7, 0), (None, 7, 0), (4, 7, 0)}


def test_decontaminate_in_blocks(spark):
    bench = spark.createDataFrame([(k, f"item number {k} with its own words {k * 7919} and {k * 104729} in the middle of it") for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"lead {k} item number {k} with its own words {k * 7919} and {k * 104729} in the middle of it tail") for k in range(0, 20, 3)], "doc_id long, text string")
    assert len(decontaminate.write_blocks(bench, 200)) > 3
    whole = sorted((r.doc_id, r.item_ids) for r in decontaminate.judged(docs, bench).collect())
    assert all(i in items for i, items in whole)
    assert sorted((r.doc_id, r.item_ids) for r in decontaminate.judged(docs, bench, 200).collect()) == whole
    assert decontaminate.drop_contaminated(docs, bench, 200).count() == 0 and decontaminate.matches(docs, bench, 200).count() == decontaminate.matches(docs, bench).count()


def test_token_counts_against_brute_force(spark):
    texts = ["one two\nthree  four\n\nfive", "", None, "a" * 5000 + "\n" + "é" * 300, "\n\n", "no end"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, section string")
    lib = SpanTokenizer(SPANS).tokenizer
    got = token_counts.count_sections(docs, SPANS).collect()
    for k, text in enumerate(texts):
        own = sorted({(r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == k})
        ends = [m.end() for m in re.finditer("\n", text or "")]
        ends = ends if ends and ends[-1] == len(text or "") else [*ends, len(text or "")]
        assert [(s, e) for _, s, e, _ in own] == list(zip([0, *ends], ends, strict=False))
        want = [0] * len(ends)
        for a, b in lib.encode(text or "", add_special_tokens=False).offsets:
            shares = [min(b, e) - max(a, s) for s, e in zip([0, *ends], ends, strict=False)]
            want[shares.index(max(shares))] += 1
        assert [n for *_, n in own] == want
    assert sum(r.doc_id == 0 for r in got) == 8 and token_counts.count_sections(docs.limit(0), SPANS).count() == 0


def test_token_counts_of_fields_and_crossings(spark):
    rows = spark.createDataFrame([(1, "http://x.y/z", "some text")], "doc_id long, url string, text string")
    got = token_counts.count_sections(rows, SPANS, ("url", "text"), separator="(?!)").collect()
    assert sum(r.n_tokens for r in got) == len(SpanTokenizer(SPANS)("http://x.y/z\nsome text"))
    tokens, crossing = token_counts.attribute(np.asarray([(0, 4), (4, 8), (8, 9)]), np.asarray([2, 7, 9]))
    assert tokens.tolist() == [1, 1, 1] and crossing.tolist() == [1, 1, 0]


def test_token_counts_in_columns_of_several_fields(spark):
    rows = spark.createDataFrame([(1, "u\n", "a b\nc"), (None, None, ""), (2, "v", None)], "doc_id long, url string, text string").coalesce(1)
    got = [tuple(r)[:5] for r in token_counts.count_sections(rows, SPANS, ("url", "text")).collect()]
    assert got == [
        (1, "url", 0, 0, 2), (1, "text", 0, 0, 4), (1, "text", 1, 4, 5),
        (None, "url", 0, 0, 0), (None, "text", 0, 0, 0),
        (2, "url", 0, 0, 1), (2, "text", 0, 0, 0),
    ]


def brute_marginals(e, t):
    import itertools

    total, good = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(sum(e[k] for k in range(len(e)) if y[k]) + sum(t[y[k - 1], y[k]] for k in range(1, len(e))))
        total += w
        good += w * np.asarray(y)
    return good / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.asarray([3, 1, 5, 5, 2])
    bins = rng.integers(0, 5, (lengths.sum(), line_crf.N_FEATURES)).astype(np.int8)
    field = line_crf.Field(rng.normal(size=(3, line_crf.N_FEATURES, line_crf.BINS + 1)), rng.normal(size=(2, 2)))
    chains = line_crf.Chains(bins, lengths)
    e = chains.emissions(field)
    a, b = chains.run(e, field.transitions)
    p, at = line_crf.sigmoid(a + b)[chains.place], 0
    for n in lengths:
        assert np.allclose(p[at : at + n], brute_marginals(e[chains.place][at : at + n], field.transitions))
        at += n


def test_quality_odd_tables(spark):
    good, bad = "Some plain words here, and a few more of them.\nA second line of it.", "BUY!! NOW!! CHEAP!! PILLS!!\nBUY!! NOW!! CHEAP!! PILLS!!"
    rows = [(k, good if k % 2 else bad, "v", 0.5) for k in range(60)] + [(100, None, "v", 0.5), (101, "", "v", 0.5), (101, "", "v", 0.5), (None, good, "v", 0.5), (102, good + "\n" * 3000, "v", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = line_crf.scored(docs.select("doc_id", "text"), line_crf.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) for r in out if r.doc_id is not None and r.doc_id < 60)
    kept = line_crf.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and 30 <= kept.count() < len(rows)
    assert line_crf.train(docs, labels.limit(0)) == 1.0 and line_crf.train(docs, labels.filter("quality = 1")) == 1.0
    assert line_crf.scored(docs.limit(0).select("doc_id", "text"), 1.0).count() == 0


def test_held_out_labels_are_not_learned(spark):
    import zlib

    docs = spark.createDataFrame([(k, "Plain words in a line.") for k in range(40)], "doc_id long, text string")
    out = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2]
    labels = spark.createDataFrame([(k, 0 if k in out else 1) for k in range(40)], "doc_id long, quality int")
    assert line_crf.train(docs, labels) == 1.0  # every label that may be learned is 1
