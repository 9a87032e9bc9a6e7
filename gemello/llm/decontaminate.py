"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are brought to lower-case words with single blanks. An item of m bytes that occurs in a text with at most e
edits shares at least m + 1 - q - q e of its q-grams with that place, on diagonals (text position less item position) at most e apart. For each
item the hits of its q-grams in a text are counted in bands of diagonals 2 e + 1 wide that overlap by half, so that every such
place lies within one band; bands that meet the count are verified by banded alignment (edit distance of the whole item to
any part of the region). Items with an edit that are too short for q = 8 take a smaller q; items too short for an edit are looked for as whole words.

Memory is bounded for any text and item. Long texts are searched in pieces that overlap by more than an item; hits are made for so many places
of a piece, or for such a part of the items, as give ``HITS`` at most. A q-gram that stands over ``REPEAT`` times in an item makes no
hits: the count to be met is less by its places, and an item made of such q-grams has its places counted along the text without diagonals.

The benchmark is a query set: it is written to the shared folder in blocks of bounded size, and a task reads one block at a time, for each batch of documents,
so that neither what is sent nor the plan grows with it.

Null texts count as empty; items without a word match nothing. Repeated rows are rows of their own, repeated items are reported by each of their ids, once each.
Null ids are ids. Of places of an item with equally few edits the first found counts. Empty tables give no matches. judged and matches read
doc_id and text alone; drop_contaminated passes all other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.llm.batches import ROWS, slices
from gemello.llm.files import open_fs
from gemello.session import shared_dir

Q = 8
#: For items that have an edit but are too short for Q.
SMALL_Q = 6
#: Edits allowed, as a share of an item's bytes.
EDITS = 0.08
#: Bytes of items in a block, and bits of the table of q-grams that most places of a text are dismissed by.
BLOCK_BYTES, TABLE_BITS = 1 << 20, 22
#: Bytes of text looked at at once, and hits held at once.
TEXT_BYTES, HITS = 1 << 20, 1 << 21
#: Places that a q-gram may have in an item to make hits.
REPEAT = 8
#: Counters that bands are hashed to before the exact count.
SLOTS = 1 << 20
MATCHES = "doc_id long, item_id long, start long, end long, edits int"
_WORD = regex.compile(r"\w+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b == 95 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio


def normal(text: str | None) -> bytes:
    """Lower-case words (letters, digits, underscores) with single blanks between them."""
    if not text:
        return b""
    if text.isascii():
        return b" ".join(text.encode().translate(_TABLE).split())
    return " ".join(_WORD.findall(text.lower())).encode()


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at each place of bytes, as an integer (q is 8 at most)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        return np.stack([data[k : k + n] for k in range(8)], axis=1).view(np.uint64).ravel()
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Block:
    """Some benchmark items, indexed by q-gram."""

    ids: list[int]
    items: list[bytes]
    q: int = Q
    rate: float = EDITS
    ready: bool = field(default=False, repr=False)

    def index(self) -> None:
        """Made in the task, so that only the items travel."""
        if self.ready:
            return
        self.edits = [int(self.rate * len(x)) for x in self.items]
        self.least = [len(x) + 1 - self.q - self.q * e for x, e in zip(self.items, self.edits, strict=True)]
        need, keys, item, place, self.dense = list(self.least), [], [], [], {}
        for k, x in enumerate(self.items):
            if self.least[k] > 0:
                g = grams(np.frombuffer(x, np.uint8), self.q)
                kinds, at, n = np.unique(g, return_inverse=True, return_counts=True)
                few = n[at] <= REPEAT
                need[k] -= int((~few).sum())
                if need[k] <= 0:
                    self.dense[k] = kinds
                else:
                    keys.append(g[few])
                    item.append(np.full(int(few.sum()), k))
                    place.append(np.flatnonzero(few))
        self.short = [k for k, x in enumerate(self.items) if x and not self.edits[k] and self.least[k] <= 0]
        small = [k for k, x in enumerate(self.items) if self.edits[k] and self.least[k] <= 0]
        self.small = Block(small, [self.items[k] for k in small], SMALL_Q, self.rate) if small else None
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        key, item, place = cat(keys, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.lexsort((key, _slot(key)))
        key, self.item, self.place = key[order], item[order], place[order]
        self.first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        self.key, self.count = key[self.first], np.diff(np.append(self.first, len(key)))
        # slot -> the first of its keys, which stand together; 0 for none
        slots = _slot(self.key)
        head = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])[: len(slots)])
        self.table = np.zeros(1 << TABLE_BITS, np.int32)
        self.table[slots[head]] = head + 1
        self.chain = int(np.diff(np.append(head, len(slots))).max(initial=0))
        self.crowd = np.unique(np.concatenate(list(self.dense.values()))) if self.dense else None
        self.half, self.need = np.asarray(self.edits, np.int64) + 1, np.asarray(need, np.int64)
        self.longest = max(map(len, self.items), default=0)
        #: Bytes of a text from the first hit of an item's place to its end.
        self.reach = self.longest + 2 * max(self.edits, default=0) + self.q
        self.ready = True

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits): the best place of each item in each text that holds it within its edits."""
        self.index()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for group in self._pieces(texts):
            self._grams_of(group, best)
        out = [(t, i, a, b, e) for (i, t), (e, a, b) in best.items()]
        for k in self.short:
            for t, text in enumerate(texts):
                p = (b" " + text + b" ").find(b" " + self.items[k] + b" ")
                if p >= 0:
                    out.append((t, k, p, p + len(self.items[k]), 0))
        if self.small:
            out += [(t, self.small.ids[k], a, b, e) for t, k, a, b, e in self.small.search(texts)]
        return out

    def _pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (text, offset, piece) of about TEXT_BYTES; pieces of one text overlap by an item's reach."""
        group, size, step = [], 0, max(TEXT_BYTES, 4 * self.reach)
        for t, text in enumerate(texts):
            for at in range(0, max(1, len(text)), step):
                group.append((t, at, text[at : at + step + self.reach] if len(text) > step else text))
                size += len(group[-1][2])
                if size >= TEXT_BYTES:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def _grams_of(self, group: list[tuple[int, int, bytes]], best: dict) -> None:
        joined = b"\n".join([text for _, _, text in group])
        starts = np.cumsum([0, *(len(text) + 1 for _, _, text in group)])
        g = grams(np.frombuffer(joined, np.uint8), self.q)
        head = self.table[_slot(g)]
        at = np.flatnonzero(head)
        found, own, real = head[at].astype(np.int64) - 1, g[at], np.zeros(len(at), bool)
        for _ in range(self.chain):  # keys of one slot stand together
            other = np.flatnonzero(~real & (self.key[found] != own)) if len(at) else at
            real = np.ones(len(at), bool)
            real[other] = False
            found[other] = np.minimum(found[other] + 1, len(self.key) - 1)
        at, found = at[real], found[real]
        done, sums = 0, np.cumsum(self.count[found])
        while done < len(at):
            # places from done to end are the window's own; those within reach behind them complete what starts there
            end = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + HITS, "right")))
            last = len(at) if end >= len(at) else int(np.searchsorted(at, at[end - 1] + self.reach, "right"))
            parts = -(-int(sums[last - 1] - (sums[done - 1] if done else 0)) // (2 * HITS))
            for part in range(parts):
                self._bands(joined, starts, *self._hits(at[done:last], found[done:last], part, parts), group, best)
            done = end
        if self.crowd is not None:
            near = np.flatnonzero(np.isin(g, self.crowd))
            if len(near):
                self._crowded(joined, starts, g[near], near, group, best)

    def _hits(self, at: np.ndarray, found: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of each hit of one part of the items."""
        out, k, sums = [], 0, np.cumsum(self.count[found])
        while k < len(at):
            end = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + HITS, "right")))
            n = self.count[found[k:end]]
            post = np.repeat(self.first[found[k:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hit, item, place = np.repeat(at[k:end], n), self.item[post], self.place[post]
            if parts > 1:
                mine = item % parts == part
                hit, item, place = hit[mine], item[mine], place[mine]
            out.append((hit, item, place))
            k = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]

    def _bands(self, joined: bytes, starts: np.ndarray, hit: np.ndarray, item: np.ndarray, place: np.ndarray, group: list, best: dict) -> None:
        half, least = self.half[item], self.need[item]
        # the diagonal has the place in the joined text, so bands of different texts mix at most at a seam, which is looked at again
        step = (hit - place + self.longest) // half
        # hits in bands that can't reach the count: sums over slots that several bands may share are never too low
        keep = np.zeros(len(hit), bool)
        for shift in (0, 1):
            slot = (((step + shift) >> 1) * 1_000_003 + item * 7_368_787) & (SLOTS - 1)
            keep |= np.bincount(slot, minlength=SLOTS)[slot] >= least
        hit, item, place, step = hit[keep], item[keep], place[keep], step[keep]
        for shift in (0, 1):
            # shared q-grams are counted by places of the item, each once in a band
            order = np.lexsort((place, (step + shift) >> 1, item))
            i, band, p = item[order], ((step + shift) >> 1)[order], place[order]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (band[1:] != band[:-1])])[: len(i)]
            once = new | np.concatenate([[True], p[1:] != p[:-1]])[: len(i)]
            heads = np.flatnonzero(new)
            enough = np.bincount(np.cumsum(new) - 1, once, len(heads)) >= self.need[i[heads]]
            for head, end in zip(heads[enough], np.append(heads[1:], len(i))[enough], strict=True):
                self._verify(joined, starts, int(i[head]), hit[order[head:end]], p[head:end], group, best)

    def _crowded(self, joined: bytes, starts: np.ndarray, g: np.ndarray, near: np.ndarray, group: list, best: dict) -> None:
        """Items of repeated q-grams: a place with few edits has as many of their q-grams as the lemma says, one after the other."""
        for i, kinds in self.dense.items():
            at = near[np.isin(g, kinds)]
            size, edits, least = len(self.items[i]), self.edits[i], self.least[i]
            if len(at) < least:
                continue
            ends = np.searchsorted(at, at + size + edits)
            heads = at[ends - np.arange(len(at)) >= least]
            if not len(heads):
                continue
            cut = np.flatnonzero(np.diff(heads) > size)
            for lo, hi in zip(heads[np.concatenate([[0], cut + 1])].tolist(), heads[np.append(cut, len(heads) - 1)].tolist(), strict=True):
                for t in range(int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi + size, "right"))):
                    # an occurrence may begin at most size bytes before a place with enough behind it; in steps, so that an alignment stays narrow
                    first, last = max(lo - size, int(starts[t])), min(hi + size + edits, int(starts[t + 1]) - 1) if t + 1 < len(starts) else -1
                    while first < last and best.get((i, group[t][0]), (1,))[0]:
                        end = min(last, first + 2 * (size + edits))
                        self._align(joined, int(starts[t]), i, first, end, group[t], best)
                        first = last if end == last else first + size + edits

    def _verify(self, joined: bytes, starts: np.ndarray, i: int, hit: np.ndarray, place: np.ndarray, group: list, best: dict) -> None:
        """Align item i with the region of a band's hits, in each piece that they lie in."""
        text = np.searchsorted(starts, hit, "right") - 1
        edits, size = self.edits[i], len(self.items[i])
        for t in np.unique(text).tolist():
            if best.get((i, group[t][0]), (1,))[0] == 0:
                continue
            diagonal = (hit - place)[text == t]
            lo = max(int(diagonal.min()) - edits, int(starts[t]))
            hi = min(int(diagonal.max()) + size + edits, int(starts[t + 1]) - 1)
            self._align(joined, int(starts[t]), i, lo, hi, group[t], best)

    def _align(self, joined: bytes, start: int, i: int, lo: int, hi: int, piece: tuple[int, int, bytes], best: dict) -> None:
        """Align item i with joined[lo:hi], a region of the piece that starts at start."""
        t, offset, _ = piece
        done = align(self.items[i], joined[lo:hi], self.edits[i])
        if done is not None and ((i, t) not in best or done[0] < best[i, t][0]):
            best[i, t] = (done[0], offset + lo - start + done[1], offset + lo - start + done[2])


def align(item: bytes, region: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of region nearest to item, if it is within edits; banded over all of the region's diagonals.

    A row of the alignment holds the columns from its own diagonal to the last one that the region leaves over.
    """
    p = region.find(item)
    if p >= 0:
        return 0, p, p + len(item)
    m, n = len(item), len(region)
    width = n - m + 2 * edits + 1  # diagonals from -edits to n - m + edits
    if width <= 0:
        return None
    r = np.frombuffer(b"\0" * edits + region + b"\0" * (m + width), np.uint8)
    big = np.int64(1 << 30)
    d = np.arange(width) - edits
    cost = np.where(d >= 0, 0, big)  # row 0: the part may start anywhere
    start = np.where(d >= 0, d, 0)
    step = np.arange(width)
    for i, c in enumerate(item, 1):
        place = d + i  # column of each diagonal
        sub = cost + (r[step + i - 1] != c)
        sub[(place < 1) | (place > n)] = big
        drop = np.append(cost[1:], big) + 1  # from the cell above, one diagonal further
        drop[(place < 0) | (place > n)] = big
        use = drop < sub
        new, origin = np.where(use, drop, sub), np.where(use, np.append(start[1:], 0), start)
        # from the left along the row: the least of cost - column so far
        run = new - step
        low = np.minimum.accumulate(run)
        who = np.maximum.accumulate(np.where(run == low, step, 0))
        new, origin = low + step, origin[who]
        new[(place < 0) | (place > n)] = big
        cost, start = new, origin
        if cost.min() > edits:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(d[k] + m)


def write_blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> list[str]:
    """Write the benchmark to the shared folder in blocks of about size bytes, by hash; returns the blocks' folders."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return []
    n, path = -(-total // size), shared_dir(spark, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={k}" for k in range(n)]


@lru_cache(maxsize=1)
def read_block(folder: str) -> Block:
    """One block at a time is held by a worker."""
    fs, path = open_fs(folder)
    ids, items = [], []
    for info in sorted(fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                rows = pq.ParquetFile(f).read(["item_id", "text"])
            for i, text in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                if x := normal(text):
                    ids.append(i)
                    items.append(x)
    return Block(ids, items)


def _sought(columns: list[str], blocks: list[str], found: Callable):
    """Search batches for the items of each block in turn; found(batch, [(row, item_id, start, end, edits)]) makes the output."""
    at = columns.index("text")

    def run(batches):
        for b in slices(batches, 1 << 30 if len(blocks) > 1 else ROWS):
            hits = []
            for folder in blocks:
                block = read_block(folder)
                for k in range(0, b.num_rows, ROWS):
                    texts = [normal(t) for t in b.column(at).slice(k, ROWS).to_pylist()]
                    hits += [(k + t, block.ids[i], *rest) for t, i, *rest in block.search(texts)]
            yield from found(b, hits)

    return run


def _order(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each item's best place, in bytes of the normalised text, in each text that holds it."""
    docs = docs.select("doc_id", "text")

    def found(b, hits):
        if hits:
            t, i, start, end, edits = zip(*sorted(hits, key=lambda h: (h[0], _order(h[1]), h[2:])), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(t)), pa.array(i, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())], ["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(_sought(docs.columns, write_blocks(benchmark, block_bytes), found), MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs that hold no benchmark item; all columns of docs. It is a filter in place, without a shuffle."""

    def found(b, hits):
        keep = np.ones(b.num_rows, bool)
        keep[[h[0] for h in hits]] = False
        yield b.filter(pa.array(keep))

    return docs.mapInArrow(_sought(docs.columns, write_blocks(benchmark, block_bytes), found), docs.schema)


def judged(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, contaminated, item_ids (sorted, of all items it holds)."""
    docs = docs.select("doc_id", "text")

    def found(b, hits):
        ids = [set() for _ in range(b.num_rows)]
        for t, i, *_ in hits:
            ids[t].add(i)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([bool(x) for x in ids]), pa.array([sorted(x, key=_order) for x in ids], pa.list_(pa.int64()))], ["doc_id", "contaminated", "item_ids"])

    return docs.mapInArrow(_sought(docs.columns, write_blocks(benchmark, block_bytes), found), "doc_id long, contaminated boolean, item_ids array<long>")
