"""Phrase collocations: n-grams counted by PCY/DHP, and their scores.

Pass k counts the k-word phrases that can be frequent, exactly, and at the same time how many (k+1)-word phrases fall into each of 2^bits buckets.
Before pass k + 1 the phrases and buckets with at least ``SUPPORT`` occurrences become two bitmaps, which are broadcast. A phrase is then counted only if

* its first and last k words are marked as frequent (Apriori; the bitmap holds hashes, so that it lets all frequent ones pass), and
* its bucket is marked (PCY), where the buckets of pass k took only phrases whose parts could be frequent there (DHP).

Both bitmaps have false positives and no false negatives, and whatever passes is counted exactly by its words: the result is that of counting all.

Phrases are contiguous words of a piece (texts are split at punctuation and line ends), counted for each language. A phrase's score is the lowest
of its cuts in two; phrases that stand in a longer one almost as often are left out; the best of each language are ranked.

Null texts count as empty and have no words; a null language is ``und``. Repeated rows each count. Very long texts are read whole by the task that
holds them. Equal scores go by occurrences, then by the phrase's bytes. An empty table gives no rows, and a language without a frequent phrase
none. Columns other than text and lang, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.llm.batches import release, slices
from gemello.session import written

#: Occurrences that a phrase needs, and words that it may have.
SUPPORT = 30
WORDS = 4
#: Phrases of a language that are ranked.
TOP = 2000
#: A phrase is left out if a longer one around it has this percentage of its occurrences.
COVERED = 80
#: Bits of a bucket's number: a bucket for some 16 bytes of text, within these bounds. The greatest bitmap that is broadcast has 128 MiB.
LEAST_BITS, MOST_BITS, TEXT_BYTES = 16, 30, 16
#: Words that a task counts together, but for a longer document.
CHUNK = 2_000_000
#: Parts of a language that are ranked on their own first.
PARTS = 32
COUNTS = "lang string, phrase string, bucket long, n long"
# A-Z become a-z, ends of pieces line feeds, tabs blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Stands between pieces; no byte of UTF-8 is so.
END = b"\xff"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, with END between pieces."""
    return list(filter(None, (text or "").encode().translate(TABLE).replace(b"\n", b" \xff ").split(b" ")))


class Vocabulary(dict):
    """Numbers words as they come; END is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Bitmap:
    """A set of buckets of hashes; with no bits, the set of all."""

    def __init__(self, bits: int, held: bytes | None) -> None:
        self.bits, self.held = bits, held

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.held is None:
            return np.ones(len(hashes), bool)
        at = bucket(hashes, self.bits)
        return (np.frombuffer(self.held, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def grams(words: np.ndarray, hashes: np.ndarray, k: int, frequent: Bitmap, buckets: Bitmap) -> np.ndarray:
    """The places of the k-word phrases of a run of words that can be frequent; hashes are the words' own, word 0 ends pieces.

    frequent has the phrases of k - 1 words, buckets those of k.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = words != 0
    whole = inside[:n].copy()
    for i in range(1, k):
        whole &= inside[i : n + i]
    at = np.flatnonzero(whole)
    shorter = hashes[at]
    for i in range(1, k - 1):
        shorter = mixed(shorter, hashes[at + i])
    if k > 1:
        rest = hashes[at + 1]
        for i in range(2, k):
            rest = mixed(rest, hashes[at + i])
        ok = frequent.has(shorter) & frequent.has(rest)
        at, shorter = at[ok], shorter[ok]
        shorter = mixed(shorter, hashes[at + k - 1])
    return at[buckets.has(shorter)]


def counted(words: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the different phrases of k words at the places; words are below size."""
    ids, held = words[at].astype(np.int64), size
    for i in range(1, k):
        if held * size >= 2**63:
            different, ids = np.unique(ids, return_inverse=True)
            held = len(different)
        ids = ids * size + words[at + i]
        held *= size
    _, first, n = np.unique(ids, return_index=True, return_counts=True)
    return at[first], n


def counts_of(docs: DataFrame, k: int, bits: int, frequent: Bitmap, buckets: Bitmap) -> DataFrame:
    """(lang, phrase, n) of the phrases of k words and (bucket, n) of those of k + 1, summed over all documents, with SUPPORT
    occurrences at least. The first pass gives languages their words too: lang without phrase or bucket."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, buckets))

    def emit(lang: str, vocabulary: Vocabulary, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        frequent, buckets = sent.value
        words = np.concatenate(ids)
        names = list(vocabulary)
        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))[words]
        at = grams(words, hashes, k, frequent, buckets)
        del ids
        if k == 1:
            yield batch(pa.array([lang]), pa.nulls(1, pa.string()), [None], [len(at)])
        if k < WORDS:
            # phrases of k + 1 words whose parts are counted here
            marks = np.zeros(len(words), bool)
            marks[at] = True
            both = at[marks[np.minimum(at + 1, len(words) - 1)] & (at + 1 < len(words))]
            longer = hashes[both]
            for i in range(1, k + 1):
                longer = mixed(longer, hashes[both + i])
            number, n = np.unique(bucket(longer, bits), return_counts=True)
            del marks, both, longer
            for a in range(0, len(number), 1 << 16):
                m = len(number[a : a + (1 << 16)])
                yield batch(pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), number[a : a + m], n[a : a + m])
        at, n = counted(words, at, k, len(names))
        held = pa.array(names, pa.binary())
        for a in range(0, len(at), 1 << 14):
            some = at[a : a + (1 << 14)]
            phrases = pc.binary_join_element_wise(*[held.take(pa.array(words[some + i])) for i in range(k)], b" ").cast(pa.string())
            yield batch(pa.array([lang] * len(some), pa.string()), phrases, pa.nulls(len(some), pa.int64()), n[a : a + len(some)])

    def of(batches):
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        n = 0
        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    words.append(END)
                    vocabulary, ids = held.setdefault(lang, (Vocabulary({END: 0}), []))
                    ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                if n > CHUNK:
                    for own in list(held):
                        yield from emit(own, *held.pop(own))
                    n = 0
        for own in list(held):
            yield from emit(own, *held.pop(own))
        release()

    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(of, COUNTS)
    return rows.groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT)


def batch(lang, phrase, number, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(number, pa.int64()), pa.array(n, pa.int64())], ["lang", "phrase", "bucket", "n"])


def bitmap(numbers: DataFrame, bits: int) -> Bitmap:
    """The bitmap of a column of buckets counted from 1: its parts of 4 KiB are made on the executors."""
    parts = (
        numbers.toDF("at")
        .groupBy(F.call_function("bitmap_bucket_number", F.col("at")).alias("part"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bits"))
    )
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return Bitmap(bits, out.tobytes())


def phrase_buckets(phrases: DataFrame, bits: int) -> DataFrame:
    """The buckets, counted from 1, of the hashes that tasks give phrases (lang, phrase)."""

    def of(batches):
        for b in slices(batches, 4096):
            out = np.zeros(b.num_rows, np.uint64)
            for j, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                seed = xxhash.xxh64_intdigest(lang.encode())
                h = np.array([xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")], np.uint64)
                x = h[:1]
                for i in range(1, len(h)):
                    x = mixed(x, h[i : i + 1])
                out[j] = x[0]
            yield pa.RecordBatch.from_arrays([pa.array(bucket(out, bits) + 1)], ["at"])

    return phrases.select("lang", "phrase").mapInArrow(of, "at long")


def frequent_phrases(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, f) of all phrases of 1 to WORDS words with at least SUPPORT occurrences in docs (text, lang), and
    (lang, n), the occurrences of all words."""
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / TEXT_BYTES + 1))))
    frequent = buckets = Bitmap(bits, None)
    out = totals = None
    for k in range(1, WORDS + 1):
        found = written(counts_of(docs, k, bits, frequent, buckets), "phrases")
        if k == 1:
            totals = found.filter("phrase IS NULL AND bucket IS NULL").select("lang", "n")
        here = found.filter("phrase IS NOT NULL")
        phrases = here.select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("f"))
        out = phrases if out is None else out.unionByName(phrases)
        if k < WORDS:
            frequent = bitmap(phrase_buckets(here, bits), bits)
            buckets = bitmap(found.filter("bucket IS NOT NULL").select(F.col("bucket") + 1), bits)
    return out, totals


def part(first, n):
    """SQL: n words of the array w from place first, joined."""
    return F.array_join(F.slice("w", first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more: the cut with the lowest score, of equal ones the first."""
    longer = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    counts = phrases.filter(F.col("words") < WORDS).select("lang", F.col("phrase").alias("part"), "f")
    both = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("(cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    least = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covering(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): of phrases of two words and more, the most occurrences of a longer one that holds them."""
    longer = phrases.filter("words > 2").withColumn("w", F.split("phrase", " "))
    sizes = longer.select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = sizes.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    return inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best top phrases of each language of docs (text, lang)."""
    found, totals = frequent_phrases(docs, bits)
    phrases = written(found, "frequent")
    kept = scored(phrases).join(covering(phrases), ["lang", "phrase"], "left").filter(f"most IS NULL OR cast(most as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {COVERED}")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language is ranked in parts first, so that no task sorts all of it
    first = Window.partitionBy("lang", "part").orderBy(*best)
    few = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
