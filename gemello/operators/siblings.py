"""Runs of siblings found again on the other side, by ranks that double in length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType


#: Nodes that are looked at together, unless a file has more.
NODES = 1 << 16
_RUNS = ["file", "side", "id", "n"]


def matching_siblings(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (file, side, id, n) with ids: the first n siblings on the other side whose keys are those of the n siblings from id on.

    nodes are (file, side, parent_id, ord, id, pre, key), siblings numbered by ord without gaps. First is the run whose parent comes first in
    pre-order, then the leftmost. ids is empty if no node of the run has its key on the other side, and null if some have but no run fits. A run that goes beyond the last
    sibling gives null too.

    Nodes and runs are dealt by file, once each; a task holds one file's at a time.
    """
    nodes = _nodes(nodes)
    # columns of their own, as runs often come from nodes and a cogroup doesn't tell equal ones apart
    asked = runs.select(*(F.col(c).alias(c) for c in ("file", "side")), *(F.col(c).cast("long").alias(c) for c in ("id", "n")))
    schema = StructType([*asked.schema.fields]).add("ids", ArrayType(LongType()))
    arrow, of_nodes = to_arrow_schema(schema), to_arrow_schema(nodes.schema)

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:  # such a side may come without its columns
            return arrow.empty_table()
        return _answered(own if own.num_rows else of_nodes.empty_table(), wanted, arrow)

    return nodes.groupBy("file").cogroup(asked.groupBy("file")).applyInArrow(run, schema)


def matching_siblings_in_place(nodes: DataFrame, runs: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The same without a shuffle, for nodes of which a file's rows stand together in a partition, as parse.tree() leaves them if both its texts do.

    runs makes the runs of a table of such nodes, which holds all those of some files.
    """
    nodes = _nodes(nodes)
    fields = {f.name: f for f in nodes.schema.fields}
    schema = StructType([fields["file"], fields["side"]]).add("id", LongType()).add("n", LongType()).add("ids", ArrayType(LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_files(batches):
            yield from _answered(own, runs(own), arrow).to_batches()

    return nodes.mapInArrow(run, schema)


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("file", "side", *(F.col(c).cast("long").alias(c) for c in ("parent_id", "ord", "id", "pre")), "key")


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables that end where a file does."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < NODES:
            continue
        t = pa.Table.from_batches(held)
        file = _codes(t["file"])
        cut = np.flatnonzero(file[1:] != file[:-1])
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1)
            t = t.slice(int(cut[-1]) + 1)
        held, rows = t.to_batches(), 0 if len(cut) else -t.num_rows  # a file that goes on is looked at again when it has twice as many
    if held:
        yield pa.Table.from_batches(held)


def _answered(own: pa.Table, wanted: pa.Table, schema: pa.Schema) -> pa.Table:
    wanted = wanted.group_by(_RUNS, use_threads=False).aggregate([]).select(_RUNS)
    return pa.table([*wanted.columns, _found(own, wanted)], names=schema.names).cast(schema)


def _numbers(t: pa.Table, name: str, null: int = -1) -> np.ndarray:
    return pc.fill_null(t[name], null).to_numpy().astype(np.int64)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value; null is one too."""
    return values.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _found(own: pa.Table, wanted: pa.Table) -> pa.Array:
    """The ids of each wanted run of some files.

    Nodes stand by file and side, parent in pre-order and place. Two runs of 2^j are equal exactly if their ranks are; a rank of 2^(j+1) numbers the pairs of
    ranks 2^j apart. A run of n is two overlapping ones of a power of two, equal at any length exactly if both ranks are.
    """
    total = own.num_rows
    file = _codes(pa.chunked_array([*own["file"].chunks, *wanted["file"].cast(own["file"].type).chunks], own["file"].type))
    lhs, asked_lhs = (pc.fill_null(pc.equal(t["side"], "lhs"), False).to_numpy().astype(bool) for t in (own, wanted))
    side, asked_side = 2 * file[:total] + lhs, 2 * file[total:] + asked_lhs
    parent, ident, pre = (_numbers(own, c) for c in ("parent_id", "id", "pre"))
    order = np.lexsort((ident, side))
    at = _Places(side[order], ident[order]).of(side, parent)
    pre = np.append(pre[order], -1)[at]  # of the parent: -1 for none
    order = np.lexsort((_numbers(own, "ord"), parent, pre, side))
    # keys of different files are different
    words = _codes(own["key"])
    key = np.unique(file[:total] * (int(words.max(initial=0)) + 1) + words, return_inverse=True)[1][order]
    there = own["key"].is_valid().to_numpy()[order]
    side, parent, ident, lhs = side[order], parent[order], ident[order], lhs[order]
    new = np.ones(total, bool)
    new[1:] = (side[1:] != side[:-1]) | (parent[1:] != parent[:-1])
    starts = np.flatnonzero(new)
    left = np.repeat(np.append(starts[1:], total), np.diff(np.append(starts, total))) - np.arange(total)  # siblings from a node on
    # how many nodes up to each have their key on the other side
    sides = np.zeros(total, np.int64)
    sides[key[lhs & there]] |= 1
    sides[key[~lhs & there]] |= 2
    met = np.concatenate([[0], np.cumsum((sides[key] & np.where(lhs, 2, 1)) > 0)])

    n = _numbers(wanted, "n", 0)
    by_id = np.lexsort((ident, side))
    begin = np.append(by_id, -1)[_Places(side[by_id], ident[by_id]).of(asked_side, _numbers(wanted, "id"))]
    fits = (begin >= 0) & (n > 0)
    fits[fits] = n[fits] <= left[begin[fits]]
    first = np.full(len(n), -1)
    rank, j = key, 0
    for length in np.unique(n[fits]).tolist():
        while 2 ** (j + 1) <= length:
            rank, j = _doubled(rank, left, 2**j), j + 1
        places = np.flatnonzero(left >= length)  # in the order of what comes first
        pairs = rank[places] * (total + 1) + rank[places + length - 2**j]
        rows = np.flatnonzero(fits & (n == length))
        for on_left in (True, False):
            theirs = lhs[places] != on_left
            values, earliest = np.unique(pairs[theirs], return_index=True)
            mine = rows[asked_lhs[rows] == on_left]
            want = pairs[np.searchsorted(places, begin[mine])]
            k = np.searchsorted(values, want)
            hit = k < len(values)
            hit[hit] = values[k[hit]] == want[hit]
            first[mine[hit]] = places[theirs][earliest[k[hit]]]
    found = first >= 0
    none = fits & ~found
    none[none] = met[begin[none] + n[none]] == met[begin[none]]
    size = np.where(found, n, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    ids = ident[np.repeat(first, size) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int64()), mask=pa.array(~(found | none)))
    return lists.cast(pa.list_(pa.int64()))


def _doubled(rank: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks of runs twice as long; -1 where one would end beyond the last sibling."""
    out = np.full(len(rank), -1)
    whole = np.flatnonzero(left >= 2 * step)
    out[whole] = np.unique(rank[whole] * (len(rank) + 1) + rank[whole + step], return_inverse=True)[1]
    return out


class _Places:
    """Where pairs of numbers stand in two columns that are sorted by them."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.values, codes = np.unique(b, return_inverse=True)
        self.pairs = a * (len(self.values) + 1) + codes

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair; -1 if it stands nowhere."""
        k = np.searchsorted(self.values, b)
        known = k < len(self.values)
        known[known] = self.values[k[known]] == b[known]
        want = a * (len(self.values) + 1) + k
        at = np.searchsorted(self.pairs, want)
        known &= at < len(self.pairs)
        known[known] = self.pairs[at[known]] == want[known]
        return np.where(known, at, -1)
