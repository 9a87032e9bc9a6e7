"""WARC archives of web pages: a writer with deduplicated payloads and a splittable reader.

Writer. Pages are digested once; of pages with equal payloads (same SHA-1, length and second hash) of at least ``min_bytes`` bytes the one
with the largest page_id is written as a response, the others as revisits of it. Each record is a gzip member of its own; a
task writes one archive, and a manifest table names the archives that count.

Reader. Archives are cut into byte ranges without an index. A task looks for the gzip magic in its range, takes a candidate as a
member only if it inflates to a WARC version line and header block, and owns the records that start inside its range; it reads
on past the end of the range to finish the last one. After a member the next one starts where the inflater stopped. Archives of a manifest have
nothing between members: a task that finds no member where its last one ended, in its range or behind it, or none at the start of the archive, fails,
as a damaged or cut record would be lost otherwise.

A null html counts as empty. Rows that repeat a page_id are records of their own; equal payloads refer to the largest page_id, and
all rows that carry it are responses. A null page_id sorts below all others, and its records refer like others. An empty
table gives no archive and no rows. A payload of any length is one record. Only page_id, url and html are read, so that other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.llm.batches import slices
from gemello.llm.files import attempt_path, open_fs
from gemello.session import shared_dir, written

#: Bytes of an archive that one task reads.
SPLIT = 16 << 20
#: Bytes read at a time.
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "archive string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_offset long, archive string"
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _clean(value: object) -> str:
    """A header value: on one line."""
    return " ".join(str(value).split())


def record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit has no payload, but the size and digest of the full one."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if not revisit:
        body += (html or "").encode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": size,
        "Content-Length": len(body),
    }
    if url is not None:
        head["WARC-Target-URI"] = _clean(url)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with sha1, size, and refers_to, the page_id of the response for a revisit (else null)."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", "html", F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("size"), F.xxhash64(html).alias("second"))
    groups = (
        full.filter(F.col("size") >= min_bytes)
        .groupBy("sha1", "size", "second")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return full.join(written(groups, "payloads"), ["sha1", "size", "second"], "left").select(
        "page_id", "url", "html", "sha1", "size", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> str:
    """Write pages (page_id, url, html) to archives under folder; returns the path of the manifest."""
    where, path = open_fs(folder)
    where.create_dir(path, recursive=True)

    def write(batches):
        uri, out, at, n = attempt_path(folder, TaskContext.get().partitionId(), ".warc.gz"), None, 0, 0
        for b in slices(batches):
            if out is None:
                fs, own = open_fs(uri)
                out = fs.open_output_stream(own, compression=None)
            for page, url, html, sha1, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, html, digest, size, refers, refers is not None)) + pack.flush()
                out.write(member)
                at += len(member)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [uri], "bytes": [at], "records": [n]})

    manifest = f"{folder}/manifest"
    plan_records(pages, min_bytes).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return manifest


class _Window:
    """Bytes of a file by absolute place, read ahead in chunks; what lies before the place last asked for is let go."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.base or place > self.base + len(self.held):
            self.base, self.held = place, b""
        if place + n > self.base + len(self.held):
            self.held = self.held[place - self.base :]
            self.base = place
            more = max(CHUNK, n - len(self.held))
            self.held += self.file.read_at(min(more, max(0, self.size - self.base - len(self.held))), self.base + len(self.held))
        return self.held[place - self.base : place - self.base + n]


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The content of the WARC record in a gzip member at start and where the member ends; None if there is no such member."""
    inflate, parts, at, known = zlib.decompressobj(31), [], start, False
    head, last = b"", b""  # the first bytes, which say whether it is a record, and the last ones before the part at hand
    try:
        while not inflate.eof:
            raw = window.at(at, 65536)
            if not raw:
                return None
            out = inflate.decompress(raw)
            parts.append(out)
            at += len(raw) - len(inflate.unused_data)
            if not known:
                head += out[: 7 - len(head)]
                if not b"WARC/1.".startswith(head):
                    return None
                known = b"\r\n\r\n" in last + out
                last = (last + out)[-3:]
    except zlib.error:
        return None
    return (b"".join(parts), at) if known else None


def members(uri: str, start: int, end: int, strict: bool = False, expected: int | None = None):
    """(place, content) of the WARC records of an archive that start in [start, end).

    If strict, what lies between members is an error, as is an archive that isn't of the expected bytes.
    """
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        size = file.size()
        if strict and expected is not None and size != expected:
            raise ValueError(f"{uri} has {size} bytes, not {expected}")
        window, at = _Window(file, size), start
        sure = strict and start == 0  # a member has to start here
        while at < min(end, size):
            raw = window.at(at, CHUNK)
            if sure and not raw.startswith(MAGIC):
                raise ValueError(f"no record at {at} of {uri}")
            k = raw.find(MAGIC)
            if k < 0:
                at += max(1, len(raw) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
            found = _member(window, at)
            if found is None:
                if sure:
                    raise ValueError(f"the record at {at} of {uri} is damaged")
                at += 1
            else:
                yield at, found[0]
                at, sure = found[1], strict
        # the record that starts behind the range is another task's, which can't tell a damaged one from the end of this one
        if sure and at < size and _member(window, at) is None:
            raise ValueError(f"the record at {at} of {uri} is damaged")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _row(place: int, raw: bytes, uri: str) -> tuple:
    fields, block = parse(raw)
    kind = fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(fields["x-payload-length"])
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"the payload of the record at {place} of {uri} is damaged")
    ident = lambda k: int(v) if (v := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) and v != "None" else None
    return ident("warc-record-id"), size, digest, kind, ident("warc-refers-to"), fields.get("warc-target-uri"), place, uri


def read_archives(spark: SparkSession, manifest: str, split: int = SPLIT) -> DataFrame:
    """Records of the archives that a manifest names, by byte ranges of split bytes."""
    archives = spark.read.schema(MANIFEST).parquet(manifest)
    ranges = archives.select("archive", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))

    def read(batches):
        for b in batches:
            rows = []
            for uri, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for place, raw in members(uri, start, start + split, True, size):
                    rows.append(_row(place, raw, uri))
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    n = max(1, int(archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1))
    return ranges.repartition(n, "archive", "start").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives below the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages.select("page_id", "url", "html"), shared_dir(spark, "warc"), min_bytes))
