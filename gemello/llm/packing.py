"""Best-fit packing of token pieces under several capacities at once.

A piece takes (tokens, one document, tokens squared as attention cost) of a sequence's capacities. What a piece takes depends on
its length alone, so the plan is made on the histogram of lengths, which has ``capacity`` entries at most however large the
corpus is: lengths go in descending order, and pieces of one length go together to the open sequences of one residual state
that scores best - by the least weighted residual norm, or the greatest weighted dot product, after every constraint - and open new
sequences only if no state fits. The plan is a list of runs (length, ranks from..to, first sequence, offset); a piece finds its run by its rank among
the pieces of its length, which is the number of such pieces in earlier partitions plus its place in its own.

Null texts count as empty (the end id only). Repeated rows are packed each, and a null doc_id is one of its own. An empty table gives no rows. Texts
of any length are encoded whole and cut. Of states that score the same the one made first is taken, so that a plan follows from the histogram.
Only doc_id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.llm.batches import slices
from gemello.llm.files import open_fs
from gemello.llm.tokens import word_tokenizer
from gemello.session import shared_dir, written

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacities:
    """Of one sequence, and what each of them weighs when a sequence is chosen.

    All three weigh the same: of sequences that fit, a piece takes one by what is left of tokens, documents and cost together. The default
    documents and cost leave no piece out that the tokens let in (a sequence may hold 4096 pieces, and cost grows with the square of a
    length); smaller ones bind.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    cost: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "residual"  # or "dot"


def plan(histogram: dict[int, int], cap: Capacities = Capacities()) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, offset) that place every piece of the histogram."""
    full = (cap.tokens, cap.documents, cap.cost)
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual state -> runs of sequences (first, count)
    # the states in order of their making: rows of an array, of which those that are no more have no tokens left
    states, rows, used_rows = np.zeros((64, 3), np.int64), {}, 0
    fresh, runs = 0, []
    w = np.asarray(cap.weights) / np.asarray(full, float) ** (2 if cap.rule == "dot" else 1)

    def put(state, first, count):
        nonlocal states, rows, used_rows
        if state[0] <= 0 or state[1] <= 0 or state[2] <= 0:
            return
        if state not in groups:
            groups[state] = []
            if used_rows == len(states):  # leave out the states that are no more, and make room
                live = np.flatnonzero(states[:, 0])
                states = np.concatenate([states[live], np.zeros((max(64, len(live)), 3), np.int64)])
                rows, used_rows = {tuple(s): k for k, s in enumerate(states[: len(live)].tolist())}, len(live)
            states[used_rows] = state
            rows[state] = used_rows
            used_rows += 1
        groups[state].append((first, count))

    for length in sorted(histogram, reverse=True):
        need = (length, 1, length * length)
        if any(n > f for n, f in zip(need, full, strict=True)):
            raise ValueError(f"no sequence can hold a piece of {length} tokens")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((states[:used_rows] >= need).all(axis=1))
            if len(fits):
                if cap.rule == "dot":
                    best = fits[np.argmax((states[fits] * w) @ np.asarray(need, float))]
                else:
                    best = fits[np.argmin((((states[fits] - need) * w) ** 2).sum(axis=1))]
                state = tuple(states[best].tolist())
                first, count = groups[state].pop()
                if not groups[state]:
                    del groups[state]
                    states[rows.pop(state)] = 0
                used = min(left, count)
                if used < count:
                    put(state, first + used, count - used)
            else:
                # as many copies side by side as fit one sequence, so that a run of equal pieces opens whole sequences
                state, first = full, fresh
                each = min(f // n for n, f in zip(need, full, strict=True))
                used = -(-left // each)
                fresh += used
            runs.append((length, rank, rank + used, first, full[0] - state[0]))
            rank += used
            left -= used
            put(tuple(s - n for s, n in zip(state, need, strict=True)), first, used)
    out = np.asarray(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, tokenizer: str, size: int = CAPACITY) -> DataFrame:
    """Ids of every whole text and the end id, cut into pieces of at most size; nth counts pieces of a length in a task."""

    def cut(batches):
        encode, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        end, seen = np.asarray([END_ID], "<u4").tobytes(), {}
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    own = raw[at : at + 4 * size]
                    n = len(own) // 4
                    seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, seen[n]))
            if rows:
                doc, k, at, n, crc, part_, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(c, pa.int64()) for c in (at, n, crc)), pa.array(part_, pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )
        encode.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, cap: Capacities = Capacities()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, cap.tokens), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # cap.tokens rows at most
    runs = plan(histogram, cap)
    # what earlier tasks have of each length, in a small file for each task that cut pieces; no row travels to meet it
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    folder = shared_dir(docs.sparkSession, "bases")
    bases.repartition("part").write.partitionBy("part").parquet(folder)
    # a key that sorts runs by (length, rank); the ranks of one length stay below 2**48
    keys = (runs[:, 0] << 48) | runs[:, 1]

    def place(batches):
        for b in batches:
            part, length, rank = b.column(5).to_numpy(), b.column(3).to_numpy(), b.column(6).to_numpy().copy()
            for p in np.unique(part).tolist():
                mine = part == p
                rank[mine] += read_bases(folder, p)[length[mine]]
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            run = runs[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.mapInArrow(place, PACKED)


@lru_cache(maxsize=8)
def read_bases(folder: str, part: int) -> np.ndarray:
    """By length, the pieces of that length which tasks before this one have."""
    fs, path = open_fs(f"{folder}/part={part}")
    rows = []
    for info in fs.get_file_info(arrow_fs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                rows.append(pq.ParquetFile(f).read(["length", "base"]))
    rows = pa.concat_tables(rows)
    out = np.zeros(int(pc.max(rows["length"]).as_py()) + 1, np.int64)
    out[rows["length"].to_numpy()] = rows["base"].to_numpy()
    return out
