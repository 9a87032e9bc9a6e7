"""Queries of what a viewer derives."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.operators import view as v
from gemello.operators import regions as r
from gemello.queries.carriers import LINES, documents, lines, values
from gemello.queries.layout import ITEMS, NODES, SPANS, _items, _nodes, _spans
from gemello.registry import query

FOLDS = SPANS + """, folds AS (SELECT doc_id AS file, CASE WHEN id % 2 = 0 THEN 'lhs' ELSE 'rhs' END AS side, id, start, "end", k FROM spans),
runs AS (SELECT doc_id AS file, 1 AS run, 0 AS lhs_start, 0 AS rhs_start, 16 AS size FROM documents)"""


def _folds(spark, d):
    return _spans(spark, d).select(F.col("doc_id").alias("file"), F.when(F.col("id") % 2 == 0, "lhs").otherwise("rhs").alias("side"), "id", "start", "end", "k")


def _runs(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("file"), F.lit(1).alias("run"), F.lit(0).cast("long").alias("lhs_start"), F.lit(0).cast("long").alias("rhs_start"), F.lit(16).cast("long").alias("size"))


@query("f8_is_novel", "SELECT * FROM (VALUES ('novel', TRUE), ('unchanged', FALSE), ('unchanged_part', TRUE), ('ignored', FALSE), ('novel_word', TRUE)) t(kind, value)")
def f8(spark, d):
    return values(spark, [("novel",), ("unchanged",), ("unchanged_part",), ("ignored",), ("novel_word",)], "kind string").select("kind", v.is_novel(F.col("kind")).alias("value"))


@query("e2_fallback_code", "SELECT * FROM (VALUES ('byte_limit', 'too_large'), ('graph_limit', 'too_complex'), ('parse_errors', 'parse_error'), ('hidden', 'hidden'), ('x', NULL)) t(cause, code)")
def e2(spark, d):
    return values(spark, [("byte_limit",), ("graph_limit",), ("parse_errors",), ("hidden",), ("x",)], "cause string").select("cause", v.fallback_code(F.col("cause")).alias("code"))


@query("e3_pairing", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'both' WHEN doc_id % 3 = 1 THEN 'left' ELSE 'right' END AS side FROM documents")
def e3(spark, d):
    k = F.col("doc_id") % 3
    return documents(spark, d).select("doc_id", v.pairing(F.when(k < 2, F.col("text")), F.when(k != 1, F.col("text"))).alias("side"))


@query("f6_parse_errors", f"WITH {LINES}, e AS (SELECT doc_id, CASE WHEN line % 2 = 0 THEN 'lhs' ELSE 'rhs' END AS side, line FROM lines WHERE length(text) % 5 = 0) SELECT doc_id, count(*) AS errors, coalesce(min(line) FILTER (side = 'rhs'), min(line)) AS first_line FROM e GROUP BY doc_id HAVING count(*) > 2")
def f6(spark, d):
    e = lines(spark, d).filter(F.length("text") % 5 == 0).select("doc_id", F.when(F.col("line") % 2 == 0, "lhs").otherwise("rhs").alias("side"), F.col("line").cast("long").alias("line"))
    return v.parse_error_cause(e, ["doc_id"], 2)


@query("o2_item_order", f'WITH {SPANS} SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, k > 2 DESC, id, id DESC) AS ord FROM spans')
def o2(spark, d):
    items = _spans(spark, d).withColumns({"is_fold": F.col("k") > 2, "byte_start": F.col("id"), "byte_end": F.col("id")})
    return v.item_order(items, ["doc_id"]).select("doc_id", "id", "ord")


@query("o8_fold_on_line", f'WITH {SPANS} SELECT doc_id, start AS line, arg_min(id, (CASE WHEN k = 4 THEN 0 ELSE 1 END) * 1000000000 - ("end" - start) * 100000 + id) AS id FROM spans GROUP BY 1, 2')
def o8(spark, d):
    return v.fold_on_line(_spans(spark, d).withColumn("is_scope", F.col("k") == 4), ["doc_id"])


@query("m13_fold_partners", f'WITH {FOLDS} SELECT a.file, a.id AS lhs_fold, b.id AS rhs_fold FROM folds a JOIN folds b ON a.file = b.file AND b.id = a.id + 1 WHERE a.side = \'lhs\'')
def m13(spark, d):
    f = _folds(spark, d).withColumn("node_id", F.col("id"))
    left = f.filter("side = 'lhs'").select("file", F.col("id").alias("lhs_id"), (F.col("id") + 1).alias("rhs_id"))
    return v.fold_partners(f, left)


@query("m14_aligned_folds", f'WITH {FOLDS} SELECT a.file, a.id AS lhs_fold, b.id AS rhs_fold FROM folds a JOIN folds b ON a.file = b.file AND a.start = b.start AND a."end" = b."end" WHERE a.side = \'lhs\' AND b.side = \'rhs\' AND a."end" <= 16')
def m14(spark, d):
    return v.aligned_folds(_folds(spark, d), _runs(spark, d))


@query("t10_unmatched_folds", f'WITH {FOLDS} SELECT file, side, id FROM folds f WHERE NOT EXISTS (SELECT 1 FROM folds o WHERE o.file = f.file AND o.side <> f.side AND o.start = f.start AND o."end" = f."end" AND o."end" <= 16)')
def t10(spark, d):
    f = _folds(spark, d)
    return v.unmatched_folds(f, v.aligned_folds(f, _runs(spark, d))).select("file", "side", "id")


@query("u3_split_lines", f'WITH {FOLDS}, own AS (SELECT file, side, start AS line FROM folds UNION SELECT file, side, "end" FROM folds) SELECT * FROM own UNION SELECT file, CASE side WHEN \'lhs\' THEN \'rhs\' ELSE \'lhs\' END, line FROM own WHERE line <= 16')
def u3(spark, d):
    return v.split_lines(_folds(spark, d).select("file", "side", "start", "end"), _runs(spark, d))


@query("u7_hidden_lines", f'WITH {SPANS} SELECT DISTINCT doc_id, l AS line FROM spans, unnest(generate_series(start, "end" - 1)) AS u(l) WHERE id % 5 = 0')
def u7(spark, d):
    return v.hidden_lines(_spans(spark, d).withColumn("collapsed", F.col("id") % 5 == 0), ["doc_id"])


@query("u2_paired_alignments", f"WITH {ITEMS} SELECT doc_id, pair_key FROM items WHERE side = 'lhs' AND pair_key IS NOT NULL INTERSECT SELECT doc_id, pair_key FROM items WHERE side = 'rhs'")
def u2(spark, d):
    i = _items(spark, d).filter("pair_key IS NOT NULL")
    return i.filter("side = 'lhs'").select("doc_id", "pair_key").intersect(i.filter("side = 'rhs'").select("doc_id", "pair_key"))


@query("u6_kept_on_both", f"WITH {LINES} SELECT doc_id AS file, 1 AS leaf, line FROM lines WHERE line % 5 = 0 UNION SELECT doc_id, 1, line + 3 FROM lines WHERE line % 7 = 0 UNION SELECT doc_id, 2, line FROM lines WHERE line % 7 = 0")
def u6(spark, d):
    own = lines(spark, d).select(F.col("doc_id").alias("file"), F.col("line").cast("long").alias("line"))
    kept = own.filter("line % 5 = 0").select("file", F.lit(1).alias("leaf"), "line").unionByName(own.filter("line % 7 = 0").select("file", F.lit(2).alias("leaf"), "line"))
    pairs = documents(spark, d).select(F.col("doc_id").alias("file"), F.lit(1).alias("leaf"), F.lit(2).alias("peer"), F.lit(3).alias("shift"))
    return v.kept_on_both(kept, pairs)


@query("e11_root_regions", f'WITH {SPANS} SELECT doc_id, max("end") AS "end" FROM spans GROUP BY doc_id')
def e11(spark, d):
    return v.root_region(_spans(spark, d), ["doc_id"])


@query("e15_hull", f'WITH {SPANS} SELECT doc_id, min(start) AS start, max("end") AS "end" FROM spans WHERE id % 3 = 1 GROUP BY doc_id')
def e15(spark, d):
    return v.hull(_spans(spark, d).filter("id % 3 = 1"), ["doc_id"])


@query("t5_fold_conflicts", f'WITH {SPANS} SELECT doc_id, id % 7 AS node FROM spans GROUP BY 1, 2 HAVING count(DISTINCT (start, "end")) > 1')
def t5(spark, d):
    return v.conflicts(_spans(spark, d).select("doc_id", (F.col("id") % 7).alias("node"), "start", "end"), ["doc_id", "node"])


@query(
    "t7_whole_lines",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS start, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS \"end\" FROM documents",
)
def t7(spark, d):
    from gemello.operators.intervals import whole_line_span

    text = F.array(F.when(F.col("doc_id") % 2 == 0, "   {").otherwise("x  {"), F.lit("a"), F.when(F.col("doc_id") % 3 == 0, "}  ").otherwise("} b"))
    start, end = whole_line_span(F.lit(0), F.lit(3), F.lit(2), F.lit(1), text)
    return documents(spark, d).select("doc_id", start.alias("start"), end.alias("end"))


@query("w12_row_window", f"WITH {LINES}, y AS (SELECT doc_id, line AS \"row\", line % 3 AS height, sum(line % 3) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM lines) SELECT doc_id, \"row\", height FROM y WHERE b - height < 9 AND (b > 4 OR height = 0 AND b - height >= 4)")
def w12(spark, d):
    rows = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("row"), (F.col("line") % 3).cast("long").alias("height"))
    return v.row_window(rows, ["doc_id"], 4, 9)


@query("t30_selection", f"WITH {LINES} SELECT DISTINCT doc_id AS file, line // 2 AS line FROM lines WHERE line BETWEEN 2 AND 7 AND line % 5 <> 0")
def t30(spark, d):
    rows = lines(spark, d).select(F.col("doc_id").alias("file"), F.col("line").alias("row"), F.when(F.col("line") % 5 != 0, F.expr("line div 2")).alias("rhs"))
    return v.selection(rows, "rhs", 2, 7)


@query("f15_has_changes", f"WITH {NODES} SELECT file, id, EXISTS (SELECT 1 FROM nodes l WHERE l.file = n.file AND l.pre BETWEEN n.pre AND n.last AND l.id % 6 = 5) AS has_changes FROM nodes n")
def f15(spark, d):
    return r.has_changes(_nodes(spark, d).withColumn("changed", F.col("id") % 6 == 5)).select("file", "id", "has_changes")


@query("t31_header_tint", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'inserted' WHEN doc_id % 4 = 1 THEN 'removed' WHEN doc_id % 4 = 2 THEN 'modified' ELSE 'neutral' END AS tint FROM documents")
def t31(spark, d):
    k = F.col("doc_id") % 4
    regions = documents(spark, d).select("doc_id", (k < 2).alias("one_sided"), F.when(k == 0, "rhs").otherwise("lhs").alias("side"), (k == 2).alias("collapsed"), F.lit(True).alias("has_changes"))
    return v.header_tint(regions).select("doc_id", "tint")


@query("a15_gutter", f"WITH {LINES} SELECT doc_id, length(CAST(max(line + 10) + 1 AS VARCHAR)) AS digits FROM lines GROUP BY doc_id")
def a15(spark, d):
    return v.gutter(lines(spark, d).select("doc_id", F.col("line").alias("lhs"), (F.col("line") + 10).alias("rhs")), ["doc_id"]).select("doc_id", F.col("digits").cast("long").alias("digits"))


@query("t21_set_collapsed", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 2 = 0 AND doc_id % 3 <> 1 AS collapsed, CASE WHEN doc_id % 3 = 0 THEN 'shut' ELSE 'old' END AS label FROM documents")
def t21(spark, d):
    regions = documents(spark, d).select("doc_id", (F.col("doc_id") % 3).alias("fold_state_id"), (F.col("doc_id") % 2 == 0).alias("collapsed"), F.lit("old").alias("label"))
    states = values(spark, [(0, True, "shut"), (1, False, None)], "fold_state_id long, new_collapsed boolean, new_label string")
    return r.set_collapsed(regions, states).select("doc_id", "collapsed", "label")


@query("t29_open_folds", "SELECT doc_id, doc_id % 4 <> 2 AS collapsed FROM documents")
def t29(spark, d):
    regions = documents(spark, d).select("doc_id", (F.col("doc_id") % 4).alias("fold_state_id"), F.lit(True).alias("collapsed"))
    return r.open_folds(regions, values(spark, [(2,)], "fold_state_id long")).select("doc_id", "collapsed")


@query("f13_hidden_branch", "SELECT doc_id, CASE WHEN lang = 'de' THEN 1 ELSE len(string_split(text, chr(10))) END AS shown FROM documents")
def f13(spark, d):
    hidden = F.col("lang") == "de"
    return documents(spark, d).select("doc_id", F.when(hidden, 1).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("shown"))


@query("e7_restore_view", "SELECT * FROM (VALUES (1, 5), (2, 7), (3, 4), (4, 0)) t(file, \"row\")")
def e7(spark, d):
    rows = values(spark, [(1, 5, "k", None, 3), (2, 7, "z", "f", None), (3, 4, None, None, 9), (4, 2, "q", None, 1)], "file int, row int, key string, fold string, line int")
    saved = values(spark, [(1, "k", "f", 1), (2, "k", "f", 1), (3, "k", "f", 8), (4, "k", "f", 5)], "file int, key string, fold string, line int")
    return v.restore_view(saved, rows)
