"""Pages and urls that ordinary crawls hold and that once went wrong."""

import random
import string
import time

import pytest

from gemello.llm import warc
from gemello.llm.html_extract import main_text

SIDE = '<div class="sidebar">' + "".join(f"<p>Other news of the day, number {i}, with some words to read.</p>" for i in range(40)) + "</div>"
TEXT = "The article itself has a good many words in it, so that anyone would see that it is the text of the page. " * 8
ARTICLE = f"<div id=content><h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p></div>"


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><title>T</title><meta charset=utf-8><style>p{}</style><script>x()</script>", "<head><noscript><img src=x></noscript>", "<head>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_a_head_need_not_end(head, body):
    page = f"<!DOCTYPE html><html>{head}{body}<article><h1>Title</h1><p>{TEXT}</p></article>"
    assert main_text(page) == "Title\n\n" + TEXT.strip()
    assert main_text(page.replace("<article>", "</head><article>", 1)) == "Title\n\n" + TEXT.strip()


def test_a_body_ends_whatever_is_open_in_the_head():
    assert main_text(f"<html><head><title>T</title><noscript><p>x</p><body><article><p>{TEXT}</p></article>") == TEXT.strip()


@pytest.mark.parametrize("odd", ['<i x="1"y="2">w</i> ', "<i x='1'y>w</i> ", '<i "">w</i> ', '<i x="a>w</i> " '])
@pytest.mark.parametrize("n", [3, 3000])
def test_odd_tags_leave_later_ones_alone(odd, n):
    page = f"<html><body>{ARTICLE}<div class=\"ad\">{odd * n}</div>{SIDE}</body></html>"
    assert main_text(page).split("\n\n")[:2] == ["Title", TEXT.strip()] and "Other news" not in main_text(page)
    page = f"<html><body><div class=\"ad\">{odd * n}</div>{SIDE}{ARTICLE}</body></html>"
    assert "Other news" not in main_text(page)


def test_odd_tags_take_time_in_proportion():
    for odd in ('<i x="1"y="2">', "<a x='", '<a x="1>', "<a b", "<a <a", '<a x="y\' ', "<a x='\">"):
        took = []
        for n in (20_000, 80_000):
            start = time.process_time()
            main_text(odd * n)
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 0.5, (odd, took)


def test_a_long_tag_keeps_its_class():
    data = "A" * 300_000
    page = f'<html><body>{ARTICLE}<div style="background:url(data:image/png;base64,{data})" class="sidebar">{SIDE}</div></body></html>'
    assert "Other news" not in main_text(page) and "AAAA" not in main_text(page)


def test_long_urls_come_back(spark):
    rng = random.Random(3)
    long = "https://example.com/" + "".join(rng.choices(string.ascii_letters, k=1_000_000))
    rows = [(1, long, "<p>a</p>", 1), (2, "https://example.com/b", "<p>a</p>", 1), (3, long[:200_000], "<p>c</p>", 1)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("revisit", 2, 8), 2: ("response", None, 8), 3: ("response", None, 8)}
    assert got[1].target_uri == long and got[3].target_uri == long[:200_000]
