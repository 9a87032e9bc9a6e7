"""Whole-text tokenisation by the tokenizers library, memoised by pre-token.

Both kinds of file split a text into pre-tokens with a fixed pattern and encode each pre-token on its own, so the tokens of a text are the
concatenated tokens of its pre-tokens, and the library encodes each distinct one once. Only characters whose class, case and normal form are surely
the library's are split here: printable ASCII and the letters of ``LATIN`` for word BPE, all but ``UNSURE`` for byte BPE. Other words, and for
byte BPE other texts, go to the library as they are; so do texts that name a special token of a word BPE file.
"""

from __future__ import annotations

import json
import re
import string
import struct
import sys
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from gemello.llm.batches import release

#: Distinct pre-tokens (or blank-separated words) kept in each of two generations in a worker, so that its memory is bounded.
MEMO = 200_000

# The tokenizers' pre-token patterns, the first for text that is already lower-cased.
WORD_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPAN_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
SPAN_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Letters beside ASCII that no normal form changes and that lower() maps one to one.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017f"
_PLAIN = re.compile(f"[!-~{LATIN}]+")
_LETTERS = re.compile(f"[A-Za-z{LATIN}]+")
MARKS = frozenset(string.punctuation)
#: Characters whose class may be another one in a newer or older version of Unicode.
UNSURE = re.compile("[\u0557-\u0560\u0588-\u0590\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7cb-\ua7f6\uab6c-\uab6f\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]")
#: Whether an array of four-byte integers already has the bytes of little-endian ids.
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

#: Python's split() also splits at these, the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"


class _Memo(dict):
    """word -> bytes, in two generations: a full one becomes the old one, whose words come back when they are used."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.encode(word)
        return self.keep(word, out)

    def keep(self, word: str, out: bytes) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


class _Words(_Memo):
    """As before; letters with one ASCII mark behind them are those letters' bytes and the mark's, and aren't kept themselves."""

    def __missing__(self, word: str) -> bytes:
        if word[-1] in MARKS and (head := word[:-1]).isalpha() and (head.isascii() or _LETTERS.fullmatch(head)):
            return self[head] + self[word[-1]]
        return self.keep(word, self.old.get(word) or self.encode(word))


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if it is printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordTokenizer:
    """Encodes texts with a lower-casing word BPE file into little-endian 32-bit id bytes.

    No pre-token of its pattern spans white space or looks beyond itself, so blank-separated words are encoded apart.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo = _Words(self._word)

    def forget(self) -> None:
        """Empty the memo, at the end of a task: an idle worker then holds the vocabulary alone."""
        self.memo.forget()
        release()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word without white space."""
        letters = word.isalpha()
        if not (letters and word.isascii()) and not _PLAIN.fullmatch(word):
            return self.whole(word)
        ids, word = [], word.lower()
        for part in (word,) if letters else WORD_ANY.findall(word):
            if not part.isascii():
                part = "".join(map(self.letters.__getitem__, part.encode()))
            ids += [t.id for t in self.model.tokenize(part)]
        return array("I", ids).tobytes() if _LITTLE else struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text; a null text counts as empty."""
        if not text:
            return b""
        if any(c in text for c in _ODD) or ("<|" in text and any(s in text for s in self.special)):
            return self.whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()  # no letter of Latin-1 has more than one normal form, and each has one lower case
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.memo.__getitem__, text.split()))


class SpanTokenizer:
    """Encodes whole texts with a byte-level BPE file (no normaliser) into the character spans of their tokens.

    Tokens of such a file are the text's bytes, in order and without gaps, so the length of each token gives the spans; the library's own
    offsets take longer to fetch. They are taken where the lengths don't add up to the text. Lengths come by pre-token where the file
    splits texts by the common pattern alone and the text has no ``UNSURE`` character, else from one call for the text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token)  # a letter for each byte
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.by_word = _splits_alone(json.loads(self.tokenizer.to_str()))
        self.memo = _Memo(self._word)

    def forget(self) -> None:
        """Empty the memo, at the end of a task."""
        self.memo.forget()
        release()

    def _word(self, word: str) -> bytes:
        """Lengths of the tokens of a pre-token."""
        return array("I", [len(t.value) for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def lengths(self, text: str) -> np.ndarray:
        """Of each token of a text, in bytes."""
        if self.by_word and (text.isascii() or not UNSURE.search(text)):
            words = (SPAN_ASCII if text.isascii() else SPAN_ANY).findall(text)
            return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "I")
        return self.sizes[np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Rows (start, end) in characters, in token order; tokens inside one character share its span."""
        text = text or ""
        raw = text.encode()
        sizes = self.lengths(text)
        ends = np.cumsum(sizes, dtype=np.int64)
        if (int(ends[-1]) if len(ends) else 0) != len(raw) or not sizes.all():
            return self.by_offsets(text)
        starts = ends - sizes
        if len(raw) != len(text):
            character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            starts, ends = character[starts] - 1, character[ends - 1]
        return np.stack([starts, ends], axis=1)

    def by_offsets(self, text: str) -> np.ndarray:
        """The same from the library's offsets."""
        spans = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def _splits_alone(spec: dict) -> bool:
    """Whether a tokenizer's file only splits texts by the common byte-level pattern and encodes the parts."""
    split = spec["pre_tokenizer"] or {}
    common = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    found = any(not t["special"] for t in spec["added_tokens"])  # other added tokens are looked for in the text
    return bool(common and spec["model"]["type"] == "BPE" and not (found or spec["normalizer"] or spec["truncation"] or spec["padding"]))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def span_tokenizer(path: str) -> SpanTokenizer:
    return SpanTokenizer(path)
