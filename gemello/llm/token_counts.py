"""Token counts of fields and sections from one encoding of the whole document.

A document is the text of its fields, one after the other with a separator between; it is encoded once, with character offsets. Sections are the parts
of a field between separators (lines, by default). Token spans and section spans are both in order and are joined as intervals; a token that
crosses a boundary goes whole to the section that holds most of its characters, to the earlier of equals, so that the counts of all
sections add up to the tokens of the document. Separators between sections belong to the section before them.

A null or empty field has one empty section without tokens. Repeated rows are rows of their own, and so is a null doc_id. An empty table gives no rows.
A text of any length is encoded whole: it is cut at no place but between the pre-tokens of the file. Only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gemello.llm.batches import slices
from gemello.llm.tokens import span_tokenizer

SECTIONS = "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long"


def section_ends(text: str, separator: re.Pattern) -> list[int]:
    """Ends of the sections of a text, each with the separator that follows it."""
    ends = [m.end() for m in separator.finditer(text) if m.end() > m.start()]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def attribute(spans: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of each section, for token spans and ends of sections that tile the text."""
    start, end = spans[:, 0], spans[:, 1]
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, np.maximum(end - 1, start), "right")
    first, last = np.minimum(first, len(ends) - 1), np.minimum(last, len(ends) - 1)
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for k in crossing:  # few: the tokenizer seldom joins characters over a line's end
        edges = np.concatenate([[start[k]], ends[first[k] : last[k]], [end[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[crossing], minlength=len(ends))


def count_sections(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("text",), separator: str = "\n", between: str = "\n", ident: str = "doc_id") -> DataFrame:
    """Per section of each field of docs: doc_id, field, section, start, end (characters in the field), n_tokens, n_crossing."""

    def run(batches):
        encode, pattern = span_tokenizer(tokenizer), re.compile(separator)
        for b in slices(batches):
            made, ids = _Columns(), b.column(0).to_pylist()
            columns = [b.column(k + 1).to_pylist() for k in range(len(fields))]
            for k, doc in enumerate(ids):
                texts = [c[k] or "" for c in columns]
                ends, offset, parts = [], 0, []
                for name, text in zip(fields, texts, strict=True):
                    own = section_ends(text, pattern)
                    parts.append((name, own))
                    ends += [offset + e for e in own]
                    offset += len(text) + len(between)
                    ends[-1] = offset if name != fields[-1] else ends[-1]  # what stands between fields belongs to the field before
                made.add(doc, parts, *attribute(encode(between.join(texts)), np.asarray(ends)))
                if made.rows >= 16_384:
                    yield made.batch()
                    made = _Columns()
            if made.rows:
                yield made.batch()
        encode.forget()

    return docs.select(ident, *fields).mapInArrow(run, SECTIONS)


class _Columns:
    """Sections of some documents, a column at a time."""

    def __init__(self):
        self.rows, self.docs, self.sizes, self.fields, self.lengths = 0, [], [], [], []
        self.numbers: tuple[list, ...] = ([], [], [])  # ends, tokens, crossing

    def add(self, doc: int | None, parts: list[tuple[str, list[int]]], tokens: np.ndarray, crossing: np.ndarray) -> None:
        """parts: each field and the ends of its sections."""
        self.rows += len(tokens)
        self.docs.append(doc)
        self.sizes.append(len(tokens))
        for name, ends in parts:
            self.fields.append(name)
            self.lengths.append(len(ends))
            self.numbers[0].extend(ends)
        self.numbers[1].append(tokens)
        self.numbers[2].append(crossing)

    def batch(self) -> pa.RecordBatch:
        lengths = np.asarray(self.lengths)
        first = np.cumsum(lengths) - lengths
        end = np.asarray(self.numbers[0], np.int64)
        start = np.roll(end, 1)
        start[first] = 0
        columns = [
            pa.array(self.docs, pa.int64()).take(pa.array(np.repeat(np.arange(len(self.docs)), self.sizes))),
            pa.array(self.fields, pa.string()).take(pa.array(np.repeat(np.arange(len(self.fields)), lengths))),
            pa.array(np.arange(self.rows) - np.repeat(first, lengths), pa.int32()),
            *(pa.array(c, pa.int64()) for c in (start, end, *map(np.concatenate, self.numbers[1:]))),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SECTIONS.split(", ")])
