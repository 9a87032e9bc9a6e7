"""Record files, streams in chunks, and JSON members of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.operators.variants import flatten
from gemello.queries.carriers import documents, table
from gemello.registry import query
from gemello.session import shared_dir
from gemello.sources.record_source import read_stream, write_stream
from gemello.sources.records import decode, problems

#: Bytes of a range in these queries: less than a file, so that records go over ranges.
SPLIT = 20_000


def file_records(spark: SparkSession, d: str) -> DataFrame:
    """(source, doc_id, line, failed): a file record of each document; every ninth failed."""
    doc = documents(spark, d)
    record = F.to_json(F.struct(F.lit("file").alias("type"), F.col("doc_id").cast("string").alias("file_key"), F.col("lang").alias("status"), F.col("n_chars").alias("added"), F.col("text").alias("text")))
    return doc.select("source", "doc_id", record.alias("line"), (F.col("doc_id") % 9 == 0).alias("failed"))


@query(
    "k2_record_files",
    """SELECT 'start' AS type, 3 AS version, count(*) AS files, NULL AS file_key, NULL AS status, NULL AS added, NULL AS succeeded, NULL AS failed, 'start' AS place FROM documents UNION ALL
    SELECT 'file', NULL, NULL, CAST(doc_id AS VARCHAR), lang, n_chars, NULL, NULL, 'between' FROM documents UNION ALL
    SELECT 'complete', NULL, NULL, NULL, NULL, NULL, count(*) FILTER (doc_id % 9 <> 0), count(*) FILTER (doc_id % 9 = 0), 'end' FROM documents""",
)
def k2_files(spark, d):
    """All documents as records, written by many tasks and read back by byte ranges; place says where the ends of the stream stand."""
    path = shared_dir(spark, "records")
    write_stream(file_records(spark, d).repartition("doc_id"), path)
    back = decode(read_stream(spark, path, SPLIT))
    ends = back.agg(F.min(F.struct("file", "offset")).alias("a"), F.max(F.struct("file", "offset")).alias("b"))
    at = F.struct("file", "offset")
    place = F.when(at == F.col("a"), "start").when(at == F.col("b"), "end").otherwise("between")
    return back.crossJoin(F.broadcast(ends)).select("type", "version", "files", "file_key", "status", "added", "succeeded", "failed", place.alias("place"))


@query(
    "s12_replay_files",
    """WITH damage(kind, problem) AS (VALUES (1, 'incomplete'), (2, 'unknown version'), (3, 'repeated file'), (3, 'wrong counts'), (4, 'invalid record'), (4, 'wrong counts'), (4, 'incomplete'), (5, 'record after complete'), (5, 'wrong counts'), (5, 'repeated file'))
    SELECT kind, count(DISTINCT doc_id) AS listed, problem FROM documents JOIN damage ON doc_id % 6 = kind GROUP BY kind, problem""",
)
def s12_files(spark, d):
    """Streams of every sixth part of the documents, each damaged in its own way, as text files read by byte ranges, with what is found wrong."""
    out = None
    records = file_records(spark, d)
    for kind in range(6):
        own = records.filter(F.col("doc_id") % 6 == kind).select("doc_id", "line")
        n, least = own.agg(F.count(F.lit(1)), F.min("doc_id")).first()
        start = f'{{"type":"start","version":{9 if kind == 2 else 3},"files":{n}}}'
        done = f'{{"type":"complete","succeeded":{n},"failed":0}}'
        ends = [(0, 0, start)] + [(2, 0, done)] * (kind not in (1, 4)) + [(2, 0, '{"type":"file","file_key":')] * (kind == 4)
        body = own.select(F.lit(1).alias("ord"), "doc_id", "line")
        if kind in (3, 5):
            body = body.unionByName(body.filter(F.col("doc_id") == least).withColumn("ord", F.lit(1 if kind == 3 else 3)))
        if kind == 4:
            body = body.filter(F.col("doc_id") != least)
        folder = shared_dir(spark, "replay")
        # the records of a kind go over many files too, between those with its ends
        body.unionByName(spark.createDataFrame(ends, "ord int, doc_id long, line string")).repartitionByRange("ord", "doc_id").sortWithinPartitions("ord", "doc_id").select("line").write.text(folder)
        back = decode(read_stream(spark, folder, SPLIT)).withColumn("seq", F.struct("file", "offset"))
        found = problems(back).select(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("listed"), "problem")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "s13_chunked_records",
    """WITH l AS (SELECT source AS stream, 1 + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, '{"type":"file","file_key":"' || doc_id || '","bytes":' || octet_length(encode(coalesce(text, ''))) || '}' AS line FROM documents),
    a AS (SELECT source AS stream, 1 AS n, '{"type":"start","version":3,"files":' || count(*) || '}' AS line FROM documents GROUP BY source UNION ALL SELECT * FROM l
      UNION ALL SELECT source, 2 + count(*), '{"type":"complete","succeeded":' || count(*) || ',"failed":0}' FROM documents WHERE source NOT LIKE '%3' GROUP BY source)
    SELECT stream, n - 1 AS seq, line, NULL AS problem FROM a UNION ALL SELECT source, 1 + count(*), NULL, 'incomplete' FROM documents WHERE source LIKE '%3' GROUP BY source""",
)
def s13(spark, d):
    """A stream of records for each source, cut into chunks of 997 bytes wherever that falls, which arrive in several files and out of order. Those of
    sources that end in 3 stop without their last record and are given up when the others end, days later."""
    from gemello.streaming import chunks

    doc = documents(spark, d).select(F.col("source").alias("stream"), "doc_id", F.concat(F.lit('{"type":"file","file_key":"'), F.col("doc_id").cast("string"), F.lit('","bytes":'), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("}\n")).alias("line"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda r: r["line"]), "")
    n = F.count(F.lit(1)).cast("string")
    last = F.when(F.col("stream").endswith("3"), "").otherwise(F.concat(F.lit('{"type":"complete","succeeded":'), n, F.lit(',"failed":0}\n')))
    text = doc.groupBy("stream").agg(F.encode(F.concat(F.lit('{"type":"start","version":3,"files":'), n, F.lit("}\n"), rows, last), "UTF-8").alias("b"))
    cut = text.select("stream", "b", F.posexplode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(997))).alias("n", "at"))
    parts = cut.select("stream", F.col("n").cast("long").alias("n"), F.substring("b", F.col("at") + 1, F.lit(997)).alias("bytes"))
    at = lambda seconds: F.timestamp_seconds(1_700_000_000 + seconds)
    ends = cut.filter("NOT endswith(stream, '3')").groupBy("stream").agg((F.max("n") + 1).cast("long").alias("n")).select("stream", "n", F.lit(None).cast("binary").alias("bytes"), at(F.lit(3 * 86400)).alias("at"))
    folder, out = shared_dir(spark, "chunks"), shared_dir(spark, "chunk-records")
    parts.withColumn("at", at(F.col("n"))).repartition(3, F.xxhash64("n")).write.parquet(folder)
    ends.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("stream string, n long, bytes binary, at timestamp").option("maxFilesPerTrigger", 2).parquet(folder)
    stream = chunks.records(stream, "1 day")
    chunks.run_to_files(stream, out, shared_dir(spark, "chunk-state"))
    return spark.read.schema(chunks.OUT).parquet(out)


@query(
    "e9_json_members",
    """WITH e AS (SELECT event_id, event_type, props, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
    SELECT event_id, 'user' AS key, 'number' AS type, CAST(user_id AS VARCHAR) AS value, TRUE AS is_leaf FROM events UNION ALL
    SELECT event_id, 'by', 'object', CASE WHEN event_type < 'none' THEN '{"' || event_type || '":{"k":' || k || '},"none":null}' ELSE '{"none":null,"' || event_type || '":{"k":' || k || '}}' END, FALSE FROM e UNION ALL
    SELECT event_id, 'by.' || event_type, 'object', '{"k":' || k || '}', FALSE FROM e UNION ALL
    SELECT event_id, 'by.' || event_type || '.k', 'number', k, TRUE FROM e UNION ALL
    SELECT event_id, 'by.none', 'null', 'null', TRUE FROM e UNION ALL
    SELECT event_id, 'list', 'array', '[' || event_id || ',{"a":true}]', TRUE FROM e UNION ALL
    SELECT event_id, 'even', 'boolean', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, TRUE FROM e UNION ALL
    SELECT event_id, 'name', 'string', '"' || event_type || '"', TRUE FROM e""",
)
def e9(spark, d):
    e = table(spark, d, "events")
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    json = F.concat(
        F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "by": {"'), kind, F.lit('": '), "props", F.lit(', "none": null}, "list": ['), n, F.lit(', {"a": true}], "even": '),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "name": "'), kind, F.lit('"}'),
    )
    return flatten(e.select("event_id", json.alias("json")), ["event_id"])


@query(
    "x17_wrap",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations),
    words AS (SELECT conv_id, turn, i - 1 AS i, w[i] AS word, sum(length(w[i]) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS stop FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM t WHERE text <> ''), unnest(generate_series(1, len(w))) AS u(i)),
    fits AS (SELECT a.conv_id, a.turn, a.i, max(b.i) + 1 AS nxt, string_agg(b.word, ' ' ORDER BY b.i) AS text FROM words a JOIN words b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.i >= a.i AND b.i <= a.i + 40 AND b.stop <= a.stop - length(a.word) + 40 GROUP BY ALL),
    go(conv_id, turn, line, i) AS (SELECT DISTINCT conv_id, turn, 0, 0 FROM words UNION ALL SELECT g.conv_id, g.turn, g.line + 1, f.nxt FROM go g JOIN fits f ON f.conv_id = g.conv_id AND f.turn = g.turn AND f.i = g.i)
    SELECT conv_id, turn, line, text FROM go JOIN fits USING (conv_id, turn, i) UNION ALL SELECT conv_id, turn, 0, '' FROM t WHERE text = ''""",
)
def x17(spark, d):
    from gemello.operators.wrap import wrap

    return wrap(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], 40)


OIDS = "ids AS (SELECT DISTINCT sha1(encode('blob ' || CAST(octet_length(encode(coalesce(text, ''))) AS VARCHAR)) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS oid FROM documents)"


def oids(spark: SparkSession, d: str) -> DataFrame:
    from gemello.sources.snapshots import blob_oid

    return documents(spark, d).select(blob_oid(F.coalesce("text", F.lit(""))).alias("oid"))


@query(
    "s3_short_ids",
    f"""WITH {OIDS}, p AS (SELECT oid, k, left(oid, k) AS prefix FROM ids, (SELECT unnest(range(4, 41)) AS k)), n AS (SELECT prefix, count(*) AS n FROM p GROUP BY prefix)
    SELECT oid, arg_min(prefix, k) AS short FROM p JOIN n USING (prefix) WHERE n = 1 GROUP BY oid""",
)
def s3(spark, d):
    from gemello.sources.short_ids import shortest

    return shortest(oids(spark, d))


@query(
    "s3_resolve_prefixes",
    f"""WITH {OIDS}, asked AS (SELECT left(oid, k) AS prefix FROM ids, (SELECT unnest([3, 4, 5]) AS k) UNION SELECT reverse(left(oid, 6)) FROM ids)
    SELECT prefix, CASE WHEN length(prefix) < 4 THEN 'too_short' WHEN count(oid) = 1 THEN 'found' WHEN count(oid) > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome, CASE WHEN length(prefix) >= 4 AND count(oid) = 1 THEN min(oid) END AS oid
    FROM asked LEFT JOIN ids ON starts_with(oid, prefix) GROUP BY prefix""",
)
def s3_resolve(spark, d):
    from gemello.sources.short_ids import resolve

    ids = oids(spark, d)
    asked = ids.select(F.explode(F.array(*[F.left("oid", F.lit(k)) for k in (3, 4, 5)], F.reverse(F.left("oid", F.lit(6))))).alias("prefix"))
    return resolve(asked, ids)
