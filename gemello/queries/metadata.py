"""Snapshots, manifests and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.operators import manifest as m
from gemello.queries.carriers import MANIFEST, SNAPSHOTS, documents, snapshots, sql_values, values
from gemello.registry import query
from gemello.sources import snapshots as s


def _changes(spark, d):
    return m.manifest(*snapshots(spark, d))


@query("s1_snapshot_scan", f"WITH {SNAPSHOTS} SELECT path, mode, oid FROM base")
def s1(spark, d):
    return snapshots(spark, d)[0].select("path", "mode", "oid")


@query(
    "s2_worktree_overlay",
    f"""WITH {SNAPSHOTS}, num AS (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS BIGINT) AS n FROM base)
    SELECT path, CASE WHEN n % 7 IN (2, 3) THEN '100755' ELSE mode END AS mode,
      CASE WHEN n % 7 = 1 THEN sha1(encode('blob ' || CAST(octet_length(encode(text || '!')) AS VARCHAR)) || '\\x00'::BLOB || encode(text || '!')) ELSE oid END AS oid
    FROM num WHERE n % 7 <> 0""",
)
def s2(spark, d):
    base, _ = snapshots(spark, d)
    n = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long") % 7
    change = F.when(n == 0, "removed").when(n == 1, "content").when(n == 2, "mode").when(n == 3, "type")
    deltas = base.select("path", change.alias("change"), F.lit("100755").alias("mode"), F.concat("text", F.lit("!")).alias("text")).filter("change is not null")
    return s.overlay(base, deltas).select("path", "mode", "oid")


COMMITS = [("f", "e"), ("e", "c"), ("d", "b"), ("c", "b"), ("b", "a"), ("g", "d"), ("g", "c"), ("a", None)]


@query(
    "s5_merge_base",
    f"""WITH RECURSIVE commits(id, parent) AS ({sql_values(COMMITS)}),
    l(id, k) AS (SELECT 'f', 0 UNION SELECT parent, k + 1 FROM l JOIN commits USING (id) WHERE parent IS NOT NULL),
    r(id, k) AS (SELECT 'g', 0 UNION SELECT parent, k + 1 FROM r JOIN commits USING (id) WHERE parent IS NOT NULL)
    SELECT id FROM l JOIN r USING (id) ORDER BY l.k + r.k, id LIMIT 1""",
)
def s5(spark, d):
    return s.merge_base(values(spark, COMMITS, "id string, parent string"), "f", "g")


@query("s6_swap_sides", f"WITH {MANIFEST} SELECT CASE status WHEN 'added' THEN 'deleted' WHEN 'deleted' THEN 'added' ELSE status END AS status, count(*) AS n FROM manifest GROUP BY 1")
def s6(spark, d):
    base, head = snapshots(spark, d)
    return m.manifest(head, base).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("s7_two_files", "SELECT 'a.txt' AS path, 'one' AS lhs, CAST(NULL AS VARCHAR) AS rhs, 'deleted' AS status")
def s7(spark, d):
    pair = s.pair_of_files(spark, "one", None, "a.txt")
    return pair.withColumn("status", F.when(F.col("lhs").isNull(), "added").when(F.col("rhs").isNull(), "deleted").otherwise("modified"))


@query(
    "s8_lazy_blobs",
    f"WITH {MANIFEST} SELECT m.path, length(b.text) AS lhs_chars, length(h.text) AS rhs_chars FROM manifest m LEFT JOIN base b ON b.path = m.lhs_path LEFT JOIN head h ON h.path = m.rhs_path",
)
def s8(spark, d):
    base, head = snapshots(spark, d)
    blob = lambda df, n: df.select(F.col("path").alias(f"{n}_path"), F.length("text").cast("long").alias(f"{n}_chars"))
    return _changes(spark, d).join(blob(base, "lhs"), "lhs_path", "left").join(blob(head, "rhs"), "rhs_path", "left").select("path", "lhs_chars", "rhs_chars")


@query("s9_clean_lines", "SELECT doc_id, length(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS n FROM documents")
def s9(spark, d):
    return documents(spark, d).select("doc_id", F.length(s.clean_lines(F.regexp_replace("text", "\n", "\r\n"))).cast("long").alias("n"))


@query(
    "s10_content_kind",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'binary' WHEN doc_id % 5 = 1 THEN 'not_utf8' ELSE 'text' END AS kind FROM documents",
)
def s10(spark, d):
    k = F.col("doc_id") % 5
    body = F.encode("text", "UTF-8")
    rhs = F.when(k == 0, F.concat(body, F.lit(b"\x00"))).when(k == 1, F.concat(body, F.lit(b"\xff"))).when(k == 2, None).otherwise(body)
    return documents(spark, d).select("doc_id", s.content_kind(body, rhs).alias("kind"))


@query("s11_list", f"WITH {MANIFEST} SELECT path, status, coalesce(lhs_oid, repeat('0', 40)) AS lhs_oid, coalesce(rhs_oid, repeat('0', 40)) AS rhs_oid FROM manifest")
def s11(spark, d):
    return _changes(spark, d).select("path", "status", *(F.coalesce(c, F.lit(s.NULL_OID)).alias(c) for c in ("lhs_oid", "rhs_oid")))


ATTRIBUTES = [(1, "[.]txt$", "text"), (2, "/fr/", "french"), (3, "^src1/", None), (4, "^src1/en/", "first")]


@query(
    "s15_attributes",
    f"""WITH {SNAPSHOTS}, rules(ord, pattern, value) AS ({sql_values(ATTRIBUTES)})
    SELECT path, arg_max_null(value, ord) AS value FROM base LEFT JOIN rules ON regexp_matches(path, pattern) GROUP BY path""",
)
def s15(spark, d):
    return s.attribute_of(snapshots(spark, d)[0].select("path"), values(spark, ATTRIBUTES, "ord int, pattern string, value string"))


@query("m1_manifest", f"WITH {MANIFEST} SELECT * FROM manifest")
def m1(spark, d):
    return _changes(spark, d)


RENAMED = (
    MANIFEST
    + """, gone AS (SELECT *, row_number() OVER (PARTITION BY lhs_oid ORDER BY path) AS n FROM manifest WHERE status = 'deleted'),
came AS (SELECT *, row_number() OVER (PARTITION BY rhs_oid ORDER BY path) AS n FROM manifest WHERE status = 'added'),
pairs AS (SELECT g.lhs_path, c.rhs_path, g.lhs_oid, c.rhs_oid, g.lhs_mode, c.rhs_mode FROM gone g JOIN came c ON g.lhs_oid = c.rhs_oid AND g.n = c.n),
renamed AS (
  SELECT * FROM manifest WHERE NOT (status = 'deleted' AND path IN (SELECT lhs_path FROM pairs)) AND NOT (status = 'added' AND path IN (SELECT rhs_path FROM pairs))
  UNION ALL SELECT rhs_path, 'renamed', lhs_path, rhs_path, lhs_oid, rhs_oid, lhs_mode, rhs_mode FROM pairs
)"""
)


@query("m2_rename_exact", f"WITH {RENAMED} SELECT * FROM renamed")
def m2(spark, d):
    return m.exact_renames(_changes(spark, d))


@query(
    "m2_rename_similar",
    """WITH f AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS line FROM f),
    t AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM x),
    p AS (SELECT a.doc_id AS lhs, b.doc_id AS rhs, count(*) AS shared FROM t a JOIN t b ON a.line = b.line AND a.k = b.k WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY 1, 2),
    n AS (SELECT doc_id, len(l) AS n FROM f)
    SELECT CAST(lhs AS VARCHAR) AS lhs_path, CAST(rhs AS VARCHAR) AS rhs_path, shared FROM p JOIN n a ON a.doc_id = lhs JOIN n b ON b.doc_id = rhs
    WHERE shared / greatest(a.n, b.n) >= 0.5""",
)
def m2_similar(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    return m.similar_pairs(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")).drop("score")


@query(
    "m3_conflicts",
    f"WITH {MANIFEST}, u AS (SELECT path FROM base WHERE path LIKE 'src3/%') SELECT path, status FROM manifest WHERE path NOT IN (SELECT path FROM u) UNION ALL SELECT path, 'conflicted' FROM u",
)
def m3(spark, d):
    base, head = snapshots(spark, d)
    return m.split_conflicts(base, head, base.filter(F.col("path").startswith("src3/")).select("path"))


@query("f1_pathspec", f"WITH {MANIFEST} SELECT path, status FROM manifest WHERE path LIKE 'src1/%' OR regexp_matches(path, '^moved/.*/de/.*[.]txt$')")
def f1(spark, d):
    return m.select_paths(_changes(spark, d), ["src1/", "moved/*/de/*.txt"]).select("path", "status")


@query("f3_identical", f"WITH {SNAPSHOTS} SELECT b.path FROM base b JOIN head h USING (path) WHERE b.oid = h.oid")
def f3(spark, d):
    base, head = snapshots(spark, d)
    return base.select("path", "oid").join(head.select("path", F.col("oid").alias("other")), "path").filter("oid = other").select("path")


@query(
    "f4_fallback",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'hidden' WHEN doc_id % 10 = 4 THEN 'generated' WHEN lang = 'de' THEN 'unsupported_language' WHEN octet_length(encode(text)) > 3000 THEN 'too_large' ELSE 'structural' END AS cause FROM documents",
)
def f4(spark, d):
    from gemello.functions.languages import static_fallback

    k = F.col("doc_id") % 10
    language = F.when(F.col("lang") != "de", F.col("lang"))
    return documents(spark, d).select("doc_id", static_fallback(k == 3, k == 4, language, F.col("text"), F.col("text"), 3000).alias("cause"))


@query("f5_byte_limit", "SELECT doc_id, octet_length(encode(text)) > 2000 AS over, octet_length(encode(text)) AS bytes FROM documents")
def f5(spark, d):
    from gemello.functions.languages import over_limit

    over, size = over_limit(F.col("text"), F.lit("x"), 2000)
    return documents(spark, d).select("doc_id", over.alias("over"), size.alias("bytes"))


@query("o1_manifest_order", f"WITH {RENAMED} SELECT path, status, row_number() OVER (ORDER BY encode(coalesce(rhs_path, lhs_path))) AS ord FROM renamed")
def o1(spark, d):
    return m.ordered(m.exact_renames(_changes(spark, d))).select("path", "status", "ord")


@query("k3_name_only", f"WITH {RENAMED} SELECT coalesce(rhs_path, lhs_path) AS line FROM renamed")
def k3(spark, d):
    return m.exact_renames(_changes(spark, d)).select(F.coalesce("rhs_path", "lhs_path").alias("line"))


@query(
    "k4_name_status",
    f"""WITH {RENAMED} SELECT CASE status WHEN 'renamed' THEN 'R' || chr(9) || lhs_path || chr(9) || rhs_path WHEN 'added' THEN 'A' || chr(9) || rhs_path
    WHEN 'deleted' THEN 'D' || chr(9) || lhs_path WHEN 'type_changed' THEN 'T' || chr(9) || rhs_path ELSE 'M' || chr(9) || rhs_path END AS line FROM renamed""",
)
def k4(spark, d):
    return m.name_status(m.exact_renames(_changes(spark, d)))


COUNTS = (
    RENAMED
    + """, sides AS (
  SELECT r.path, b.text, -1 AS w FROM renamed r JOIN base b ON b.path = r.lhs_path UNION ALL SELECT r.path, h.text, 1 FROM renamed r JOIN head h ON h.path = r.rhs_path
), each AS (SELECT path, w, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM sides WHERE text <> ''),
net AS (SELECT path, line, sum(w) AS w FROM each GROUP BY 1, 2),
counts AS (
  SELECT r.path, r.status, CAST(coalesce(sum(greatest(w, 0)), 0) AS BIGINT) AS added, CAST(coalesce(sum(greatest(-w, 0)), 0) AS BIGINT) AS removed
  FROM renamed r LEFT JOIN net USING (path) GROUP BY 1, 2
)"""
)


def _counts(spark, d):
    base, head = snapshots(spark, d)
    return m.line_counts(m.exact_renames(m.manifest(base, head)), base, head)


@query("a2_line_counts", f"WITH {COUNTS} SELECT * FROM counts")
def a2(spark, d):
    return _counts(spark, d)


@query("k5_numstat", f"WITH {COUNTS} SELECT CAST(added AS VARCHAR) || chr(9) || CAST(removed AS VARCHAR) || chr(9) || path AS line FROM counts")
def k5(spark, d):
    return _counts(spark, d).select(F.concat_ws("\t", F.col("added").cast("string"), F.col("removed").cast("string"), "path").alias("line"))


@query(
    "k6_stat",
    f"""WITH {COUNTS}, t AS (SELECT max(length(path)) AS nw, max(added + removed) AS most FROM counts),
    s AS (SELECT *, length(CAST(most AS VARCHAR)) AS digits FROM t),
    z AS (SELECT *, greatest(7, CASE WHEN 80 > nw + digits + 5 THEN 80 - (nw + digits + 5) ELSE 80 END) AS scale FROM s),
    j AS (SELECT *, added + removed AS total, ((added + removed) * scale + most // 2) // greatest(most, 1) AS bars FROM counts, z),
    b AS (SELECT *, bars * added // greatest(total, 1) AS plus FROM j)
    SELECT path AS name, ' ' || rpad(path, CAST(nw AS INT), ' ') || ' | ' || lpad(CAST(total AS VARCHAR), CAST(digits AS INT), ' ') || CASE WHEN total > 0 THEN ' ' ELSE '' END
      || repeat('+', CASE WHEN scale <= most AND total > 0 THEN greatest(plus, 1) ELSE added END)
      || repeat('-', CASE WHEN scale <= most AND total > 0 THEN greatest(bars - plus, 1) ELSE removed END) AS line FROM b""",
)
def k6(spark, d):
    return m.stat_table(_counts(spark, d))


@query(
    "k7_shortstat",
    f"""WITH {COUNTS}, t AS (SELECT count(*) AS n, sum(added) AS a, sum(removed) AS r FROM counts)
    SELECT ' ' || n || ' files changed, ' || a || ' insertions(+), ' || r || ' deletions(-)' AS line FROM t""",
)
def k7(spark, d):
    return m.shortstat(_counts(spark, d))


@query("a7_totals", f"WITH {COUNTS} SELECT CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, max(length(path)) AS name_width, max(added + removed) AS most FROM counts")
def a7(spark, d):
    return _counts(spark, d).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max(F.length("path")).cast("long").alias("name_width"), F.max(F.col("added") + F.col("removed")).alias("most"))


@query("a6_outcomes", "SELECT count(*) FILTER (doc_id % 7 <> 0) AS succeeded, count(*) FILTER (doc_id % 7 = 0) AS failed, bool_or(doc_id % 7 = 0) AS aborted FROM documents")
def a6(spark, d):
    bad = F.col("doc_id") % 7 == 0
    return documents(spark, d).agg(F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.bool_or(bad).alias("aborted"))


@query("k10_exit_code", f"WITH {MANIFEST} SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS code FROM manifest")
def k10(spark, d):
    from gemello.sinks import exit_code

    return exit_code(_changes(spark, d))


@query(
    "numstat_by_lang",
    f"WITH {COUNTS} SELECT regexp_extract(path, '/([a-z]+)/[0-9]+[.]txt$', 1) AS lang, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM counts GROUP BY 1",
)
def numstat_by_lang(spark, d):
    lang = F.regexp_extract("path", r"/([a-z]+)/[0-9]+\.txt$", 1).alias("lang")
    return _counts(spark, d).groupBy(lang).agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query(
    "u8_missing_lines",
    f"WITH {SNAPSHOTS} SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM base EXCEPT ALL SELECT unnest(string_split(text, chr(10))) FROM head) GROUP BY line",
)
def u8(spark, d):
    base, head = snapshots(spark, d)
    bag = lambda df: df.select(F.explode(F.split("text", "\n")).alias("line"))
    return bag(base).exceptAll(bag(head)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m25_manifest_slots",
    f"""WITH {MANIFEST}, rec AS (SELECT path FROM manifest WHERE path LIKE '%/en/%' UNION ALL SELECT path FROM manifest WHERE path LIKE 'src1/%' UNION ALL SELECT 'nowhere'),
    c AS (SELECT path, count(*) AS n FROM rec GROUP BY path)
    SELECT coalesce(m.path, c.path) AS path, CASE WHEN m.path IS NULL THEN 'unknown' WHEN c.n IS NULL THEN 'pending' WHEN c.n > 1 THEN 'duplicate' ELSE 'loaded' END AS state
    FROM manifest m FULL OUTER JOIN c ON m.path = c.path""",
)
def m25(spark, d):
    from gemello.operators.slots import slot_states

    paths = _changes(spark, d).select("path")
    records = paths.filter(F.col("path").contains("/en/")).unionByName(paths.filter(F.col("path").startswith("src1/"))).unionByName(spark.createDataFrame([("nowhere",)], "path string"))
    return slot_states(paths, records)


@query("e1_error_code", "SELECT * FROM (VALUES ('not_utf8', 'not_utf8'), ('conflict', 'conflicted'), ('missing', 'missing_blob'), ('boom', 'internal'), (NULL, 'internal')) t(cause, code)")
def e1(spark, d):
    from gemello.sinks import error_code

    causes = spark.createDataFrame([("not_utf8",), ("conflict",), ("missing",), ("boom",), (None,)], "cause string")
    return causes.select("cause", error_code(F.col("cause")).alias("code"))


@query("e4_identity", f"WITH {RENAMED} SELECT coalesce(lhs_path, '') || chr(0) || coalesce(rhs_path, '') AS identity, coalesce(rhs_path, lhs_path) AS display FROM renamed")
def e4(spark, d):
    return m.exact_renames(_changes(spark, d)).select(F.concat_ws("\x00", F.coalesce("lhs_path", F.lit("")), F.coalesce("rhs_path", F.lit(""))).alias("identity"), F.coalesce("rhs_path", "lhs_path").alias("display"))


@query(
    "a13_tree_rollup",
    f"""WITH {COUNTS}, p AS (SELECT path, added, removed, string_split(path, '/') AS l FROM counts),
    e AS (SELECT array_to_string(l[1:k], '/') AS node, k AS depth, k < len(l) AS is_dir, added, removed FROM p, unnest(generate_series(1, len(l))) AS u(k))
    SELECT node, depth, is_dir, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM e GROUP BY 1, 2, 3""",
)
def a13(spark, d):
    from gemello.operators.tree import directory_rollup

    return directory_rollup(_counts(spark, d))


@query("e6_parents", f"WITH {SNAPSHOTS}, p AS (SELECT path, string_split(path, '/') AS l FROM base) SELECT DISTINCT array_to_string(l[1:k], '/') AS dir FROM p, unnest(generate_series(1, len(l) - 1)) AS u(k)")
def e6(spark, d):
    from gemello.operators.tree import parent_directories

    return snapshots(spark, d)[0].select(F.explode(parent_directories(F.col("path"))).alias("dir")).distinct()


@query("e5_closed_directories", f"WITH {SNAPSHOTS} SELECT path FROM base WHERE NOT (path LIKE 'src1/%' OR path LIKE 'src2/fr/%')")
def e5(spark, d):
    from gemello.operators.tree import visible_paths

    return visible_paths(snapshots(spark, d)[0].select("path"), spark.createDataFrame([("src1",), ("src2/fr",)], "dir string"))


@query("o7_head_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head, left(text, 100) AS prefix FROM documents")
def o7(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n").alias("head"), F.left("text", F.lit(100)).alias("prefix"))


