"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code (23, 12). If two
fingerprints differ in at most 4 bits, then by the pigeonhole principle two of the three segments together differ in at most 2. For
each pair of segments a fingerprint gets the keys

    (c', c(b)) and (c(a), c') over the codewords c' that words at distance at most 1 from the other segment decode to,

about ten 24-bit keys in place of one. Whatever way two errors fall on the two segments - (2, 0), (0, 2), (1, 1) or fewer - both
fingerprints have a key in common: a word half way between decodes to the same codeword for both, or each one's own
codeword lies among the other's near ones. Rows that share a key are verified by their full distance.

Fingerprints are made distinct first. Inside a key the links are kept as a spanning forest, not as all pairs; a key with more than
``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is a task of its own, so that no task holds more than two blocks.

Null texts count as empty; texts without a word have fingerprint zero and link like any other. A null doc_id gets the component of its
fingerprint, or null if no document with an id is reachable. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.llm.batches import slices
from gemello.llm.components import connected_components
from gemello.llm.prefilter import with_maybe
from gemello.session import written

WORDS = 4
DISTANCE = 4
SEED = 42
BLOCK = 2048
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of the XXH64 of all word shingles; a bit is set if it is so in over half of them."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends[: len(parts) - words + 1] - np.fromiter(map(len, parts[: len(parts) - words + 1]), np.int64) - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
    n = len(starts)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is summed in parts
        bits += np.unpackbits(np.frombuffer(raw, np.uint8, min(n - at, 1 << 16) * 8, at * 8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp is the fingerprint as a signed 64-bit integer."""

    def of(batches):
        for b in slices(batches):
            fp = np.asarray([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(own, near): the 12-bit index of the codeword that each 23-bit word decodes to, and of a word's 23 neighbours' (by bit).

    Made from the generator: the syndrome of each error pattern of weight 3 or less is its own, as the code is perfect.
    """

    def syndrome(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    ones = [1 << i for i in range(23)]
    errors = np.asarray([0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)], np.int32)
    leader = np.zeros(1 << 11, np.int32)
    leader[syndrome(errors)] = errors
    own = np.empty(1 << 23, np.int16)
    for at in range(0, len(own), 1 << 17):  # in parts, as a worker's memory is small
        words = np.arange(at, at + (1 << 17), dtype=np.int32)
        own[words] = (words ^ leader[syndrome(words)]) >> 11
    return own, np.asarray(ones, np.int64)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned fingerprints, each key of a row once; a key holds the pair of segments and two codeword indices."""
    own, ones = golay()
    rows = np.arange(len(fp))
    words = [((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    codes = [own[w].astype(np.int64) for w in words]
    near = []
    for w, c in zip(words, codes, strict=True):
        # sorted, so that repeats of an index stand together and can be left out
        x = np.sort(np.concatenate([c[:, None], own[w[:, None] ^ ones].astype(np.int64)], axis=1), axis=1)
        near.append((x, np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1)))
    row_out, key_out = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ni, fi), (nj, fj) = near[i], near[j]
        a = (ni << 12) | codes[j][:, None]
        b = (codes[i][:, None] << 12) | nj
        fb = fj & (nj != codes[j][:, None])  # (c(a), c(b)) is among the first
        for k, first in ((a, fi), (b, fb)):
            r, c = np.nonzero(first)
            row_out.append(rows[r])
            key_out.append(k[r, c] | (pair << 24))
    return np.concatenate(row_out), np.concatenate(key_out)


def _keys(batches):
    for b in slices(batches, 4096):
        fp = b.column(0).to_numpy()
        row, key = keys_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], ["key", "fp"])


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the distinct fingerprints that differ in at most distance bits, by breadth-first search."""
    left, out, queue = np.arange(len(fp)), [], []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        if len(left):
            close = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if close.any():
                found = left[close]
                out += [(at, k) for k in found]
                queue += found.tolist()
                left = left[~close]
    return out


def _links(distance: int):
    """From rows (unit, fp) sorted by unit: edges inside each unit."""

    def run(batches):
        held_u, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            u, f = np.concatenate([held_u, b.column(0).to_numpy()]), np.concatenate([held_f, b.column(1).to_numpy()])
            if not len(u):
                continue
            cut = int(np.searchsorted(u, u[-1]))  # the last unit may go on in the next batch
            held_u, held_f = u[cut:], f[cut:]
            yield from _edges(u[:cut], f[:cut], distance)
        yield from _edges(held_u, held_f, distance)

    return run


def _edges(unit: np.ndarray, fp: np.ndarray, distance: int):
    if len(unit) < 2:
        return
    fp = fp.view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(starts, len(unit)))
    a, b = [], []
    size_of = np.repeat(sizes, sizes)
    for step in range(1, 8):  # small units by shifts, all units at once
        at = np.flatnonzero((unit[step:] == unit[:-step]) & (size_of[step:] <= 8))
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        a.append(fp[at])
        b.append(fp[at + step])
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        own = np.unique(fp[s : s + n])
        if found := forest(own, distance):
            pairs = np.asarray(found)
            a.append(own[pairs[:, 0]])
            b.append(own[pairs[:, 1]])
    u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of distinct (fp) which differ in at most distance (4 or less) bits."""
    if distance > 4:
        raise ValueError("the keys hold for 4 differing bits at most")
    keys = distinct.select("fp").mapInArrow(_keys, "key int, fp long")
    hot = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "hot")
    # A key over the block size is cut by hash into blocks, and each row goes to the pairs of blocks that hold its own.
    blocks = hot.select("key", F.ceil(F.col("n") * 1.25 / block).cast("int").alias("blocks"))
    marked = keys.join(blocks, "key", "left")
    plain = marked.filter(F.col("blocks").isNull()).select(F.col("key").cast("long").alias("unit"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    paired = (
        marked.filter(F.col("blocks").isNotNull())
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> own)")).alias("other"))
    )
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(-(2**63)))
    units = plain.unionByName(paired.select(pair.alias("unit"), "fp"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(distance), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp and component_id, the least doc_id reachable over links."""
    prints = written(fingerprints(docs, words), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = connected_components(links(distinct, distance, block))
    nodes = found.join(distinct, found.node == distinct.fp).select("fp", "component", "first")
    least = nodes.groupBy("component").agg(F.min("first").alias("least"))
    linked = nodes.join(least, "component").select("fp", "least")
    # written, so that the join below stands alone and a fingerprint that many rows share can be split
    of = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each group, the one whose doc_id names it; all columns of docs, whatever their names. Rows without a doc_id stay."""
    near = near_duplicates(docs, words, distance)
    gone = written(near.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"))
    ident = F.xxhash64(F.col("row.doc_id").cast("long"))
    marked = with_maybe(rows, ident, gone.select(F.xxhash64("doc_id").alias("key")))
    rest = marked.filter("maybe").join(gone, F.col("row.doc_id") == gone.doc_id, "left_anti")
    return marked.filter("NOT maybe").select("row.*").unionByName(rest.select("row.*"))
