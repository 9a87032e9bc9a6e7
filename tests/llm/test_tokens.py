"""The tokenizers against the library over every assigned code point and some that aren't, alone and beside other characters."""

import json
import random
import time
import unicodedata
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from gemello.llm.tokens import LATIN, SpanTokenizer, WordTokenizer

POINTS = [chr(c) for c in range(0x110000) if (k := unicodedata.category(chr(c))) not in ("Cs", "Cn", "Co") or (k != "Cs" and c % 101 == 0)]
NEAR = [c for c in POINTS if c < "\u3000"]


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize(("form", "points"), [("É{0}b,", POINTS), ("{0} a{0}b 1{0}'s {0}é", NEAR)])
def test_word_ids_of_every_code_point(words, form, points):
    own = lambda t, w: np.frombuffer(words(t), "<u4").tolist() == w.ids
    bad = []
    for at in range(0, len(points), 50_000):
        texts = [form.format(c) for c in points[at : at + 50_000]]
        wanted = words.tokenizer.encode_batch(texts, add_special_tokens=False)
        bad += [ascii(t) for t, w in zip(texts, wanted, strict=True) if not own(t, w)]
        words.memo.forget()
    assert not bad, (len(bad), bad[:20])


def test_control_characters_and_pairs_keep_their_ids(words):
    odd = [chr(c) for c in range(128)] + list("éÉßİſŉΣςσ́₝‍日가") + ["\U000105d7", "\U0001f600"]
    texts = [a + b for a in odd for b in odd] + [f"{a}x{b}." for a in odd for b in odd]
    wanted = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert not [ascii(t) for t, w in zip(texts, wanted, strict=True) if np.frombuffer(words(t), "<u4").tolist() != w.ids]
    assert np.frombuffer(words("\x07"), "<u4").tolist() == [451]


def test_letters_that_are_split_here_are_stable():
    import re

    for c in filter(re.compile(f"[{LATIN}]").match, POINTS):
        assert c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c


def test_spans_from_lengths_are_the_librarys_offsets():
    spans = SpanTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "\n\n x", "<|endoftext|>a<|endoftext|>", "a\u0301\u200d\U0001f468\u200d\U0001f469 日本語\t\x00\x07"]
    texts += ["".join(POINTS[at : at + 500]) for at in range(0, len(POINTS), 500)] + [f"{c} a{c}b 1{c}'s" for c in NEAR]
    for t in texts:
        assert np.array_equal(spans(t), spans.by_offsets(t)), ascii(t[:80])
    spans.sizes[:] = 0  # lengths that don't add up
    assert np.array_equal(spans("some text"), spans.by_offsets("some text"))


@pytest.fixture
def spans():
    return SpanTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_spans_of_mixed_texts_are_the_librarys_offsets(spans, monkeypatch):
    monkeypatch.setattr("gemello.llm.tokens.MEMO", 50)  # so that words leave the memo and come back
    rng = random.Random(3)
    odd = [*"aZé9 _'.-\t\n\r\x0b\x1c\x85\xa0  　٣²ßſ日가́ꟶ﻿\U0001f600\U000105d7", "  ", "\r\n", "'s", " 'LL", "<|endoftext|>", "word", " word"]
    for chars in (odd, [c for c in odd if c.isascii()]):
        for _ in range(4000):
            t = "".join(rng.choices(chars, k=rng.randrange(1, 30)))
            assert np.array_equal(spans(t), spans.by_offsets(t)), ascii(t)


def test_spans_encode_each_distinct_word_once(spans):
    words = []
    encode, spans.memo.encode = spans.memo.encode, lambda w: words.append(w) or encode(w)
    texts = [" ".join(f"word{k % 97} né, it's" for k in range(j, j + 400)) for j in range(100)]
    assert all(np.array_equal(spans(t), spans.by_offsets(t)) for t in texts)
    assert len(words) == len(set(words)) < 150

    def seconds(f):
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    library = lambda t: spans.tokenizer.encode_batch_fast([t], add_special_tokens=False)
    assert min(seconds(spans) for _ in range(3)) < min(seconds(library) for _ in range(3))
    spans.forget()
    assert not spans.memo and not spans.memo.old


def test_spans_of_files_that_split_otherwise(tmp_path):
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    word = {"id": 50257, "content": "rd w", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for change in ({"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}, {"added_tokens": [*spec["added_tokens"], word]}):
        (path := tmp_path / "other.json").write_text(json.dumps(spec | change))
        other = SpanTokenizer(str(path))
        for t in ("a word word\n\n 12ab", "word  word", "é word"):
            assert np.array_equal(other(t), other.by_offsets(t)), (change, t)
