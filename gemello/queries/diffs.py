"""Alignments, syntax, whole comparisons and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gemello.operators import alignment as a
from gemello.plans import compare
from gemello.queries.carriers import SNAPSHOTS, documents, snapshots, spread, table, values
from gemello.registry import query
from gemello.session import shared_dir

#: Consecutive turns of one role in a conversation.
TURNS = """
pairs AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || role AS file_key, text AS lhs,
    lead(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS rhs FROM conversations
)"""


def turn_pairs(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return table(spark, d, "conversations").select(key.alias("file_key"), F.col("text").alias("lhs"), F.lead("text").over(w).alias("rhs")).filter("rhs IS NOT NULL AND lhs IS NOT NULL")


def edit_pairs(spark, d):
    """Files of both snapshots whose texts differ."""
    base, head = snapshots(spark, d)
    return base.select(F.col("path").alias("file_key"), F.col("text").alias("lhs"), F.col("oid").alias("lo")).join(head.select(F.col("path").alias("file_key"), F.col("text").alias("rhs"), F.col("oid").alias("ro")), "file_key").filter("lo <> ro").drop("lo", "ro")


N_LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split(regexp_replace({0}, '\\n$', ''), chr(10))) END"


@query("m4_line_alignment")
def m4(spark, d):
    rows = a.aligned(edit_pairs(spark, d))
    return rows.groupBy("file_key").agg(F.count_if(F.col("kind") == "unchanged").alias("unchanged"), F.count_if(F.col("kind") == "novel").alias("novel"))


@query(
    "t11_row_coverage",
    f"WITH {TURNS} SELECT file_key, {N_LINES.format('lhs')} AS lhs_lines, {N_LINES.format('rhs')} AS rhs_lines, TRUE AS in_order FROM pairs WHERE rhs IS NOT NULL AND lhs IS NOT NULL AND (lhs <> '' OR rhs <> '')",
)
def t11(spark, d):
    """Every line of both sides stands once and in order: counted from the rows."""
    w = Window.partitionBy("file_key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = a.aligned(turn_pairs(spark, d))
    ok = lambda c: F.col(c).isNull() | (F.coalesce(F.max(c).over(w), F.lit(-1)) == F.col(c) - 1)
    return rows.withColumn("ok", ok("lhs") & ok("rhs")).groupBy("file_key").agg(F.count("lhs").alias("lhs_lines"), F.count("rhs").alias("rhs_lines"), F.bool_and("ok").alias("in_order"))


@query(
    "t26_line_edits_all",
    f"""WITH {SNAPSHOTS}, p AS (
      SELECT b.path AS file_key, b.text AS lhs, h.text AS rhs, CAST(regexp_extract(b.path, '([0-9]+)[.]txt$', 1) AS BIGINT) % 10 AS k FROM base b JOIN head h ON b.path = h.path WHERE b.oid <> h.oid
    ), n AS (SELECT *, {N_LINES.format('lhs')} AS nl, {N_LINES.format('rhs')} AS nr FROM p)
    SELECT file_key, CAST(CASE WHEN k = 3 THEN 1 ELSE 0 END AS BIGINT) AS appended, CAST(CASE WHEN k = 2 THEN nl - nr ELSE 0 END AS BIGINT) AS removed FROM n WHERE nl > 0 OR nr > 0""",
)
def t26_all(spark, d):
    """Of all edited files: the appended line alone on its row, and lines of the base alone on theirs."""
    last = F.max("rhs").over(Window.partitionBy("file_key"))
    rows = a.aligned(edit_pairs(spark, d)).withColumn("last", last)
    return rows.groupBy("file_key").agg(F.count_if((F.col("rhs") == F.col("last")) & F.col("lhs").isNull()).alias("appended"), F.count_if(F.col("lhs").isNotNull() & F.col("rhs").isNull()).alias("removed"))


@query("a1_textual_counts")
def a1(spark, d):
    return a.textual_counts(turn_pairs(spark, d))


@query("t26_positions")
def t26_positions(spark, d):
    return a.positions(turn_pairs(spark, d)).groupBy("file_key", "side", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m5_common_ends",
    f"""WITH {TURNS}, l AS (SELECT file_key, string_split(lhs, chr(10)) AS a, string_split(rhs, chr(10)) AS b FROM pairs WHERE lhs IS NOT NULL AND rhs IS NOT NULL)
    SELECT file_key, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS prefix FROM l""",
)
def m5(spark, d):
    x, y = F.split("lhs", "\n"), F.split("rhs", "\n")
    same = F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda k: F.slice(x, 1, k) == F.slice(y, 1, k))
    return turn_pairs(spark, d).select("file_key", F.size(same).cast("long").alias("prefix"))


@query(
    "m8_common_unique_lines",
    """WITH x AS (SELECT doc_id % 20 AS g, doc_id % 2 AS side, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT g // 2 AS f, side, line FROM x GROUP BY 1, 2, 3 HAVING count(*) = 1)
    SELECT f, line FROM c GROUP BY f, line HAVING count(DISTINCT side) = 2""",
)
def m8(spark, d):
    own = documents(spark, d).select(F.expr("(doc_id % 20) div 2").alias("f"), (F.col("doc_id") % 2).alias("side"), F.explode(F.split("text", "\n")).alias("line"))
    once = own.groupBy("f", "side", "line").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    side = lambda k: once.filter(F.col("side") == k).select("f", "line")
    return side(0).intersect(side(1))


@query("m12_partners", "SELECT doc_id AS file, 1 AS lhs_id, 2 AS rhs_id FROM documents WHERE doc_id % 3 = 0")
def m12(spark, d):
    from gemello.operators.tree import partners

    ids = documents(spark, d).select(F.col("doc_id").alias("file"))
    left = ids.select("file", F.lit("lhs").alias("side"), F.lit(1).alias("id"), F.lit("unchanged").alias("kind"), F.lit(2).alias("opposite_id"))
    right = ids.select("file", F.lit("rhs").alias("side"), F.lit(2).alias("id"), F.lit("unchanged").alias("kind"), F.when(F.col("file") % 3 == 0, 1).when(F.col("file") % 3 == 1, 7).alias("opposite_id"))
    return partners(left.unionByName(right))


def _tree_pairs(spark, d, language):
    if language == "HTML":
        p = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
        head = F.regexp_replace("html", "<h1>", "<h1 class='x'>")
        return p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_key"), F.col("html").alias("lhs"), head.alias("rhs"), F.lit("HTML").alias("language"), F.lit("structural").alias("cause"))
    e = table(spark, d, "events").filter("props IS NOT NULL")
    return e.select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("file_key"), F.col("props").alias("lhs"), F.regexp_replace("props", r"\}$", ', "added": true}').alias("rhs"), F.lit("JSON").alias("language"), F.lit("structural").alias("cause"))


@query("m9_tree_diff_json")
def m9_json(spark, d):
    return compare.diffs(_tree_pairs(spark, d, "JSON")).select("file_key", "cause", "added", "removed")


@query("m9_tree_diff_html")
def m9_html(spark, d):
    return compare.diffs(_tree_pairs(spark, d, "HTML")).select("file_key", "cause", "added", "removed")


@query("compare_records")
def compare_records(spark, d):
    return compare.records(*snapshots(spark, d))


@query("k1_record_lines", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"' || CASE WHEN doc_id % 2 = 0 THEN ',\"flag\":true' ELSE '' END || '}' AS line FROM documents")
def k1(spark, d):
    from gemello.sinks import record_lines

    rows = documents(spark, d).select("doc_id", "lang", (F.col("doc_id") % 2 == 0).alias("flag"), F.lit(None).cast("string").alias("gone"), F.array().cast("array<string>").alias("tags"))
    return record_lines(rows, ["doc_id", "lang", "flag", "gone", "tags"]).select("doc_id", "line")


@query(
    "k2_envelope",
    """SELECT 0 AS seq, '{"type":"start","version":3,"files":' || count(*) || '}' AS line FROM documents UNION ALL SELECT row_number() OVER (ORDER BY doc_id), CAST(doc_id AS VARCHAR) FROM documents
    UNION ALL SELECT count(*) + 1, '{"type":"complete","succeeded":' || (count(*) - count(*) FILTER (doc_id % 9 = 0)) || ',"failed":' || count(*) FILTER (doc_id % 9 = 0) || '}' FROM documents""",
)
def k2(spark, d):
    from gemello.sinks import envelope

    from gemello.operators.ranking import global_row_number

    own = documents(spark, d).select("doc_id")
    files = global_row_number(own, "doc_id", "n").select((F.col("n") - 1).alias("ord"), F.col("doc_id").cast("string").alias("line"), (F.col("doc_id") % 9 == 0).alias("failed"))
    return envelope(own, files)


@query("s12_replay_problems", "SELECT * FROM (VALUES ('incomplete'), ('repeated file'), ('wrong counts'), ('invalid record')) t(problem)")
def s12(spark, d):
    from gemello.sources.records import decode, problems

    lines = [(0, '{"type":"start","version":3,"files":3}'), (1, '{"type":"file","file_key":"a","more":1}'), (2, '{"type":"file","file_key":"a"}'), (3, "{oops")]
    return problems(decode(values(spark, lines, "seq long, line string")))


@query("s14_decode", "SELECT doc_id, 'file' AS type, lang AS file_key FROM documents")
def s14(spark, d):
    from gemello.sources.records import decode

    lines = documents(spark, d).select("doc_id", F.to_json(F.struct(F.lit("file").alias("type"), F.col("lang").alias("file_key"), F.lit(1).alias("unknown"))).alias("line"))
    return decode(lines).select("doc_id", "type", "file_key")


@query("k8_render")
def k8(spark, d):
    pairs = compare.file_pairs(*snapshots(spark, d))
    return compare.render(compare.diffs(pairs), pairs)


@query("stream_counts")
def stream_counts(spark, d):
    """Textual counts of pairs that arrive as files."""
    from gemello.streaming import events as s

    folder = shared_dir(spark, "arrivals")
    turn_pairs(spark, d).repartition(3).write.parquet(folder)
    name = "counts_" + folder[-8:]
    s.run_to_memory(s.counted(s.stream_pairs(spark, folder)), name)
    return spark.table(name)


@query("stream_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """Windowed counts of the event stream with a watermark, all windows as the stream has left them."""
    from gemello.streaming import events as s

    source = table(spark, d, "events")
    folder = shared_dir(spark, "events")
    source.write.parquet(folder)
    name = "windows_" + folder[-8:]
    stream = spark.readStream.schema(source.schema).parquet(folder)
    s.run_to_memory(s.event_counts(stream), name, "complete")
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_slots")
def stream_slots(spark, d):
    """Manifest slots of comparisons as state over a stream of records."""
    from gemello.streaming import events as s

    own = documents(spark, d).select(F.col("lang").alias("comparison"), F.col("doc_id").cast("string").alias("file_key"))
    folder = shared_dir(spark, "slots")
    own.withColumn("type", F.lit("start")).unionByName(own.filter("file_key % 2 = 0").withColumn("type", F.lit("file"))).coalesce(1).write.parquet(folder)
    name = "slots_" + folder[-8:]
    stream = spark.readStream.schema("comparison string, file_key string, type string").parquet(folder)
    s.run_to_memory(s.slot_updates(stream), name, "update")
    return spark.table(name)
