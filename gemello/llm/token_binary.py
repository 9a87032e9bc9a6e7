"""Token ids in binary shards, each document compressed apart with one shared zstandard dictionary.

A shard file (all numbers little-endian):

    magic "GEMTOK1\\n", sha-256 of the dictionary (32 bytes)
    frames: one zstandard frame for each document, made with the dictionary, of its ids as 32-bit unsigned integers
    index: doc_id int64[n], frame offset uint64[n + 1], ids uint64[n]
    footer: offset of the index uint64, n uint64, documents without a doc_id uint64, magic

Shards hold ascending doc_id ranges in ascending order; the dictionary lies beside them in a file named by its hash, and a manifest
table names the shard files that count. A reader of one short document reads the footer, the index and one frame.

Null texts count as empty and hold the end id only. Rows that repeat a doc_id go in the order of their texts' hashes, so that many of them are
spread over shards. Rows with a null doc_id are written first, as the footer tells. An empty table gives a dictionary-less empty manifest and no rows.
A text of any length is one frame. Only doc_id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemello.llm.batches import slices
from gemello.llm.files import attempt_path, open_fs
from gemello.llm.tokens import word_tokenizer
from gemello.session import shared_dir

MAGIC = b"GEMTOK1\n"
END_ID = 1
#: What stands in the index for a null doc_id.
NULL_ID = -(2**63)
#: Documents the dictionary is trained on (about so many are taken, by hash), bytes taken of each, and the dictionary's bytes.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 16_384, 65_536
#: Chunks in which the bytes of a longer document are taken.
CHUNKS = 16
LEVEL = 3
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
ROWS = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def spread(ids: bytes) -> bytes:
    """SAMPLE_BYTES of 32-bit ids in even chunks from the first to the last of them; all if there are no more."""
    if len(ids) <= SAMPLE_BYTES:
        return ids
    size = SAMPLE_BYTES // CHUNKS
    starts = [(len(ids) - size) * k // (CHUNKS - 1) // 4 * 4 for k in range(CHUNKS)]
    return b"".join(ids[at : at + size] for at in starts)


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary of serialised id arrays of a bounded sample; b"" if the sample is too small to train on."""
    n = docs.count()
    part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // sample_docs))) == 0).select("text").limit(2 * sample_docs)

    def ids(batches):
        encode = word_tokenizer(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"ids": [spread(encode(t)) for t in b.column(0).to_pylist()]}, schema=pa.schema([("ids", pa.binary())]))
        encode.forget()

    samples = [bytes(r.ids) for r in part.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> str:
    """Write docs (doc_id, text) to shards under folder; returns the path of the manifest."""
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    where, path = open_fs(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{digest.hex()}.zdict") as out:
        out.write(dictionary)

    def write(batches):
        fs, _ = open_fs(folder)
        shard = TaskContext.get().partitionId()
        encode = word_tokenizer(tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(folder, digest))
        end = np.asarray([END_ID], "<u4").tobytes()
        uri = attempt_path(folder, shard, ".tok")
        ids, offsets, counts, at, out, nulls = [], [], [], len(MAGIC) + 32, None, 0
        for b in slices(batches):
            if out is None:
                out = fs.open_output_stream(open_fs(uri)[1])
                out.write(MAGIC + digest)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                frame = packer.compress(raw)
                out.write(frame)
                ids.append(NULL_ID if doc is None else doc)
                nulls += doc is None
                offsets.append(at)
                counts.append(len(raw) // 4)
                at += len(frame)
        encode.forget()
        if out is not None:
            with out:
                out.write(np.asarray(ids, "<i8").tobytes() + np.asarray([*offsets, at], "<u8").tobytes() + np.asarray(counts, "<u8").tobytes())
                out.write(np.asarray([at, len(ids), nulls], "<u8").tobytes() + MAGIC)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [len(ids)], "n_tokens": [sum(counts)]})

    manifest = f"{folder}/manifest"
    mixed = docs.withColumn("mix", F.xxhash64("text"))  # rows of one doc_id can be split
    mixed.repartitionByRange("doc_id", "mix").sortWithinPartitions("doc_id", "mix", "text").select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(manifest)
    return manifest


@lru_cache(maxsize=4)
def _dictionary(folder: str, digest: bytes) -> zstandard.ZstdCompressionDict | None:
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/{digest.hex()}.zdict") as f:
        raw = f.read()
    if hashlib.sha256(raw).digest() != digest:
        raise ValueError("the dictionary is not the one that the shard was written with")
    if not raw:
        return None
    out = zstandard.ZstdCompressionDict(raw)
    out.precompute_compress(level=LEVEL)  # its tables once in a worker, not in each compressor
    return out


class Shard:
    """Reads one shard: all of it in order, or single documents by their place in the index."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(32, size - 32)
        at, n, self.nulls = (int(x) for x in np.frombuffer(foot, "<u8", 3))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if foot[24:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        raw = self.file.read_at(24 * n + 8, at)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(raw, "<u8", n, 16 * n + 8)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(uri.rpartition("/")[0], head[len(MAGIC) :])).decompress

    def document(self, k: int) -> bytes:
        """Id bytes of the k-th document: one ranged read."""
        at, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return self.unpack(self.file.read_at(end - at, at))

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id."""
        return [k for k in range(int(np.searchsorted(self.doc_ids, doc_id)), int(np.searchsorted(self.doc_ids, doc_id, "right"))) if k >= self.nulls]

    def documents(self, chunk: int = 1 << 22):
        """Id bytes of all documents, by reads of about chunk bytes."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.offsets, int(self.offsets[k]) + chunk, "right")) - 1)
            end = min(end, n)
            base = int(self.offsets[k])
            raw = memoryview(self.file.read_at(int(self.offsets[end]) - base, base))
            for i in range(k, end):
                yield self.unpack(raw[int(self.offsets[i]) - base : int(self.offsets[i + 1]) - base])
            k = end


def read_tokens(spark: SparkSession, manifest: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; shard as well."""
    shards = spark.read.schema(MANIFEST).parquet(manifest)
    # One row for each shard file: a running sum over them is small whatever the number of documents.
    based = shards.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))

    def read(batches):
        for b in batches:
            for shard, uri, base in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "base")), strict=True):
                file, at, rows = Shard(uri), base or 0, []
                for k, (doc, raw) in enumerate(zip(file.doc_ids.tolist(), file.documents(), strict=True)):
                    rows.append((shard, None if k < file.nulls else doc, at, len(raw) // 4, zlib.crc32(raw)))
                    at += len(raw) // 4
                    if len(rows) >= 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, shards.count())
    return based.select("shard", "path", "base").repartition(n, "shard").mapInArrow(read, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    shard, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs in the file format below the shared folder and read the files back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, shared_dir(spark, "tokens"), tokenizer))
