"""Ranked lexical search over shards of an inverted index, with MaxScore.

1. A task of ``build`` turns its documents into shards of at most ``SHARD_TERMS`` terms (a longer document is a shard of its own) and writes
   for each shard a row with ids and lengths of its documents and a row for each term: ascending places of its documents, occurrences, and bounds
   (for each number of occurrences the least length of a document that has it).
2. Documents, terms and document frequencies are sums over these rows, for all shards.
3. ``search`` brings the lists of each shard together that a bitmap of the queries' terms lets pass, and a task reads the queries with their terms'
   weights from the shared folder; no list is joined by its term, which many shards share. For each query a shard orders its terms by the most
   that they can add. While the lists at the low end together can't lift a document over the lowest of the best k, they are non-essential: only documents of the other lists are candidates, and the low lists are probed for these, highest first, while a
   candidate can still qualify. Documents go by blocks in ascending id, so that the lowest of the best k rises early.
4. The best k of each shard are reduced to the best k of each query.

Scores are whole numbers, as op11's contract has them; ``score`` states them. Null and empty texts have no terms: such documents are never found and don't
count, such queries find nothing. Equal scores go by ascending id, a null id last; repeated rows are documents of their own, repeated rows of a query
one query, and different texts under one query id queries of their own. Very long texts are read whole by the task that holds them. An empty table
gives no rows. Columns other than the id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.llm.batches import release, slices
from gemello.llm.files import open_fs
from gemello.llm.prefilter import with_maybe
from gemello.session import shared_dir, written

K = 10
#: Terms with repeats in a shard, but for a longer document.
SHARD_TERMS = 4_000_000
#: Documents that are ranked together between two looks at the lowest of the best k.
BLOCK = 1024
#: Rows of query terms that a search task holds at a time.
QUERY_ROWS = 100_000
INDEX = "shard long, term string, docs binary, counts binary, bound_counts binary, bound_lengths binary, n long, ids binary"
# A-Z become a-z, other ASCII characters than letters and digits blanks; all bytes of other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(TABLE).split()


class Shard:
    """Documents of one shard while it is built."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.ids, self.lengths, self.held = [], [], 0
        self.of: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        counts = Counter(terms)
        known = self.terms
        self.of.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.held += len(terms)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The rows of the index; documents are placed by ascending id, those without id last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        lengths = np.array([self.lengths[i] for i in order], np.int64)
        ids = np.array([-1 if self.ids[i] is None else self.ids[i] for i in order], np.int64)
        null = np.array([self.ids[i] is None for i in order], np.uint8)
        yield rows([(shard, None, null.tobytes(), None, None, lengths.tobytes(), int(lengths.sum()), ids.tobytes())])
        term = np.concatenate([self.of[i] for i in order])
        count = np.concatenate([self.counts[i] for i in order])
        doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(self.of[i]) for i in order])
        self.of, self.counts = [], []
        by = np.argsort(term, kind="stable")
        term, count, doc = term[by], count[by], doc[by]
        starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # the least length for each (term, count)
        least = np.lexsort((lengths[doc], count, term))
        first = np.flatnonzero(np.r_[True, (np.diff(term[least]) != 0) | (np.diff(count[least]) != 0)])
        bound_term, bound_count, bound_length = term[least][first], count[least][first], lengths[doc[least][first]]
        bounds = np.searchsorted(bound_term, np.arange(len(self.terms) + 1))
        out = []
        for t, k in self.terms.items():
            a, b, c, d = starts[k], starts[k + 1], bounds[k], bounds[k + 1]
            out.append((shard, t.decode(), doc[a:b].tobytes(), count[a:b].tobytes(), bound_count[c:d].tobytes(), bound_length[c:d].tobytes(), int(b - a), None))
            if len(out) == 4096:
                yield rows(out)
                out = []
        if out:
            yield rows(out)


def rows(data: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*data, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def build(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of docs (doc_id, text) on shared files. A row with a null term has its shard's documents: ids, lengths (bound_lengths) and the sum of
    these (n); docs marks null ids there. Rows of terms have the number of their documents in n."""

    def of(batches):
        base, k, shard = TaskContext.get().partitionId() << 32, 0, Shard()
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if shard.held and shard.held + len(terms) > shard_terms:
                    yield from shard.batches(base + k)
                    k, shard = k + 1, Shard()
                if terms:
                    shard.add(doc_id, terms)
        if shard.held:
            yield from shard.batches(base + k)
        release()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, INDEX), "search-index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term, repeats) of queries (item_id, text); query tells different texts under one id apart."""

    def of(batches):
        for b in slices(batches):
            found = [(q, i, t.decode(), n) for q, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True) for t, n in Counter(terms_of(x)).items()]
            q, i, t, n = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(i, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["query", "item_id", "term", "repeats"])

    distinct = queries.select(F.col("item_id").cast("long"), "text").distinct()
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return distinct.select(key.alias("query"), "item_id", "text").mapInArrow(of, "query string, item_id long, term string, repeats long")


def saturation(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """8 * m for documents of these lengths, m = 25 + (75 * length * documents) div terms; exact where the product passes 64 bits."""
    if len(lengths) and 75 * int(lengths.max()) * documents >= 2**63:
        return np.array([8 * (25 + 75 * int(x) * documents // terms) for x in lengths], np.int64)
    return 8 * (25 + 75 * lengths * documents // max(terms, 1))


def score(weight, counts, eight_m):
    """What a term adds to the score of documents where it occurs counts times; grows with counts, falls with m."""
    counts = np.asarray(counts, np.int64)
    return weight * (1_000_000_000 * counts // (1000 * counts + eight_m))


class Lists:
    """The lists of a shard by term, read when asked for."""

    def __init__(self, table: pa.Table, documents: int, terms: int) -> None:
        head = table.filter(pc.is_null(table.column("term")))
        self.ids = np.frombuffer(head.column("ids")[0].as_buffer(), np.int64)
        self.null = np.frombuffer(head.column("docs")[0].as_buffer(), np.uint8)
        self.eight_m = saturation(np.frombuffer(head.column("bound_lengths")[0].as_buffer(), np.int64), documents, terms)
        self.documents, self.terms = documents, terms
        self.table = table
        self.at = {t: i for i, t in enumerate(table.column("term").to_pylist()) if t is not None}
        self.bounds: dict[str, int] = {}

    def column(self, name: str, term: str, kind) -> np.ndarray:
        return np.frombuffer(self.table.column(name)[self.at[term]].as_buffer(), kind)

    def bound(self, term: str) -> int:
        """The most that a term of weight 1 adds to any document of the shard."""
        if term not in self.bounds:
            eight_m = saturation(self.column("bound_lengths", term, np.int64), self.documents, self.terms)
            self.bounds[term] = int(score(1, self.column("bound_counts", term, np.int32), eight_m).max())
        return self.bounds[term]


def best(lists: Lists, query: dict[str, int], k: int = K, block: int = BLOCK) -> list[tuple[int, int]]:
    """The (place, score) of the shard's k best documents for a query {term: weight}, best first, equal scores by ascending place."""
    terms = sorted((t for t in query if t in lists.at), key=lambda t: (lists.bound(t) * query[t], t))
    most = np.cumsum([lists.bound(t) * query[t] for t in terms])
    docs = [lists.column("docs", t, np.int32) for t in terms]
    counts = [lists.column("counts", t, np.int32) for t in terms]
    weights = [query[t] for t in terms]
    ends = np.zeros(len(terms), np.int64)
    top = np.zeros(0, np.int64)  # scores of the best so far, highest first, and their places
    places = np.zeros(0, np.int64)
    for a in range(0, len(lists.ids), block):
        b = a + block
        low = int(top[k - 1]) if len(top) == k else 0
        # places ascend, so a document must beat the lowest of the best
        essential = int(np.searchsorted(most, low, "right"))
        if essential == len(terms):
            break
        sums = np.zeros(block, np.int64)
        for i in range(essential, len(terms)):
            end = int(np.searchsorted(docs[i], b))
            d = docs[i][ends[i] : end]
            sums[d - a] += score(weights[i], counts[i][ends[i] : end], lists.eight_m[d])
            ends[i] = end
        found = np.flatnonzero(sums)
        sums = sums[found]
        found += a
        for i in range(essential - 1, -1, -1):
            able = sums + most[i] > low
            found, sums = found[able], sums[able]
            if not len(found):
                break
            at = np.searchsorted(docs[i], found)
            there = at < len(docs[i])
            there[there] = docs[i][at[there]] == found[there]
            at = at[there]
            sums[there] += score(weights[i], counts[i][at], lists.eight_m[found[there]])
        able = sums > low
        top, places = np.r_[top, sums[able]], np.r_[places, found[able]]
        order = np.lexsort((places, -top))[:k]
        top, places = top[order], places[order]
    return list(zip(places.tolist(), top.tolist(), strict=True))


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each of queries (item_id, text), with scores above 0."""
    documents, terms = index.filter("term IS NULL").agg(F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).cast("long"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = written(query_terms(queries), "search-queries")
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1)
    weights = index.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))
    folder = shared_dir(index.sparkSession, "search-terms")
    asked.join(weights, "term").select("query", "item_id", "term", (F.col("repeats") * F.col("weight")).alias("weight")).repartition("query").sortWithinPartitions("query").write.parquet(folder)
    keys = asked.select(F.xxhash64("term").alias("key"))
    lists = with_maybe(index, F.xxhash64("term"), keys).filter("maybe OR term IS NULL").drop("maybe")

    def of(table: pa.Table) -> pa.Table:
        shard, out = None, []
        if table.num_rows > 1:
            shard = Lists(table.combine_chunks(), documents, terms)
            for query, item, wanted in weighted(folder):
                out += [(query, item, None if shard.null[d] else int(shard.ids[d]), s) for d, s in best(shard, wanted, k)]
        q, i, d, s = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(q, pa.string()), pa.array(i, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "item_id", "doc_id", "score"])

    found = lists.groupBy("shard").applyInArrow(of, "query string, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def weighted(folder: str) -> Iterator[tuple[str, int, dict[str, int]]]:
    """Each (query, item_id, {term: weight}) of the written terms; a query's rows are consecutive in one file."""
    system, path = open_fs(folder)
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                last, item, terms = None, None, {}
                for b in pq.ParquetFile(source).iter_batches(QUERY_ROWS):
                    for q, i, t, w in zip(*(b.column(c).to_pylist() for c in ("query", "item_id", "term", "weight")), strict=True):
                        if q != last:
                            if terms:
                                yield last, item, terms
                            last, item, terms = q, i, {}
                        terms[t] = w
                if terms:
                    yield last, item, terms
