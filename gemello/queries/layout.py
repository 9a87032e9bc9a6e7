"""Ranges, runs, folds and display rows over documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.operators import intervals as i
from gemello.operators import tree as t
from gemello.queries.carriers import LINES, documents, lines, values
from gemello.registry import query

#: Lines with a flag: changed where they hold " the " or " de ".
FLAGGED = LINES + ", flagged AS (SELECT doc_id, line, contains(text, ' the ') OR contains(text, ' de ') AS changed, text FROM lines)"
RANGES = FLAGGED + ", ranges AS (SELECT doc_id, line AS start, line + 1 + length(text) % 3 AS \"end\" FROM flagged WHERE changed)"
MERGED = (
    RANGES
    + """, m1 AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranges),
m2 AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m1),
merged AS (SELECT doc_id, min(start) AS start, max("end") AS "end" FROM m2 GROUP BY doc_id, island)"""
)


def _flagged(spark, d):
    rows = lines(spark, d)
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), (F.col("text").contains(" the ") | F.col("text").contains(" de ")).alias("changed"), "text")


def _ranges(spark, d):
    return _flagged(spark, d).filter("changed").select("doc_id", F.col("line").alias("start"), (F.col("line") + 1 + F.length("text") % 3).alias("end"))


@query("a4_coalesce_ranges", f"WITH {MERGED} SELECT * FROM merged")
def a4(spark, d):
    return i.coalesce_ranges(_ranges(spark, d), ["doc_id"])


@query("a5_range_totals", f'WITH {MERGED} SELECT doc_id, CAST(sum("end" - start) AS BIGINT) AS total FROM merged GROUP BY doc_id')
def a5(spark, d):
    own = i.coalesce_ranges(_ranges(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    return own.select("doc_id", i.range_total(F.col("r")).alias("total"))


@query("u1_novel_lines", f'WITH {RANGES} SELECT DISTINCT doc_id, l AS line FROM ranges, unnest(generate_series(start, "end" - 1)) AS u(l)')
def u1(spark, d):
    return _ranges(spark, d).select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("line")).distinct()


@query(
    "w8_context_lines",
    f"WITH {FLAGGED} SELECT doc_id, line, max(CAST(changed AS INT)) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS kept FROM flagged",
)
def w8(spark, d):
    return i.context_lines(_flagged(spark, d), ["doc_id"]).select("doc_id", "line", "kept")


@query(
    "p6_hidden_runs",
    f"""WITH {FLAGGED}, k AS (SELECT doc_id, line, max(CAST(changed AS INT)) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS kept FROM flagged),
    g AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM k WHERE NOT kept),
    r AS (SELECT doc_id, min(line) AS start, max(line) + 1 AS "end" FROM g GROUP BY doc_id, island)
    SELECT *, ("end" - start) || ' unchanged lines' AS label FROM r WHERE "end" - start >= 2""",
)
def p6(spark, d):
    return i.hidden_runs(i.context_lines(_flagged(spark, d), ["doc_id"], 1), ["doc_id"])


@query("w4_hunk_starts", f"WITH {FLAGGED}, l AS (SELECT *, lag(changed, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY line) AS was FROM flagged) SELECT doc_id, line FROM l WHERE changed AND NOT was")
def w4(spark, d):
    return i.hunk_starts(_flagged(spark, d).withColumnRenamed("line", "row"), ["doc_id"]).select("doc_id", F.col("row").alias("line"))


ROWS = (
    FLAGGED
    + """, rws AS (SELECT doc_id, line AS "row", CASE WHEN changed THEN 'novel' ELSE 'unchanged' END AS kind, CASE WHEN NOT (changed AND line % 3 = 0) THEN line END AS lhs, CASE WHEN NOT (changed AND line % 3 = 1) THEN line + 5 END AS rhs FROM flagged)"""
)


def _rows(spark, d):
    f = _flagged(spark, d)
    return f.select(
        "doc_id", F.col("line").alias("row"), F.when(F.col("changed"), "novel").otherwise("unchanged").alias("kind"),
        F.when(~(F.col("changed") & (F.col("line") % 3 == 0)), F.col("line")).alias("lhs"), F.when(~(F.col("changed") & (F.col("line") % 3 == 1)), F.col("line") + 5).alias("rhs"),
    )


@query(
    "w2_runs",
    f"""WITH {ROWS}, n AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND (lhs IS NULL AND lag(lhs) OVER w IS NULL OR lhs = lag(lhs) OVER w + 1) AND (rhs IS NULL AND lag(rhs) OVER w IS NULL OR rhs = lag(rhs) OVER w + 1) THEN 0 ELSE 1 END AS new FROM rws WINDOW w AS (PARTITION BY doc_id ORDER BY "row")),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY "row") AS BIGINT) AS run FROM n)
    SELECT doc_id, run, kind, min(lhs) AS lhs_start, max(lhs) + 1 AS lhs_end, min(rhs) AS rhs_start, max(rhs) + 1 AS rhs_end FROM r GROUP BY 1, 2, 3""",
)
def w2(spark, d):
    return i.runs(_rows(spark, d), ["doc_id"])


@query(
    "w3_novel_hunks",
    f"""WITH {FLAGGED}, p AS (SELECT doc_id, line AS seq, CASE WHEN NOT changed THEN 'both' WHEN line % 2 = 0 THEN 'left' ELSE 'right' END AS side, text FROM flagged),
    m AS (SELECT *, CAST(sum(CASE WHEN side = 'both' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS island FROM p)
    SELECT doc_id, island, coalesce(string_agg(text, '' ORDER BY seq) FILTER (side = 'left'), '') AS lhs, coalesce(string_agg(text, '' ORDER BY seq) FILTER (side = 'right'), '') AS rhs FROM m WHERE side <> 'both' GROUP BY 1, 2""",
)
def w3(spark, d):
    side = F.when(~F.col("changed"), "both").when(F.col("line") % 2 == 0, "left").otherwise("right")
    return i.merge_hunks(_flagged(spark, d).select("doc_id", F.col("line").alias("seq"), side.alias("side"), "text"), ["doc_id"])


@query(
    "w7_outermost_folds",
    f"""WITH {RANGES}, c AS (SELECT doc_id, start, "end" - 1 AS last, max("end" - 1) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM ranges)
    SELECT doc_id, start, last FROM c WHERE covered IS NULL OR start > covered""",
)
def w7(spark, d):
    return i.outermost(_ranges(spark, d).select("doc_id", "start", (F.col("end") - 1).alias("last")), ["doc_id"])


PAIRS = FLAGGED + ", pairs AS (SELECT doc_id, line AS lhs, 2 * line + CAST(changed AS INT) AS rhs FROM flagged WHERE line % 3 <> 1)"
FILLED = (
    PAIRS
    + """, lagged AS (SELECT *, lag(lhs) OVER (PARTITION BY doc_id ORDER BY lhs) AS pl, lag(rhs) OVER (PARTITION BY doc_id ORDER BY lhs) AS pr FROM pairs),
filled AS (
  SELECT doc_id, lhs AS "at", 2 AS o, lhs, rhs FROM lagged UNION ALL
  SELECT doc_id, lhs, 0, x, NULL FROM lagged, unnest(generate_series(pl + 1, lhs - 1)) AS u(x) UNION ALL
  SELECT doc_id, lhs, 1, NULL, x FROM lagged, unnest(generate_series(pr + 1, rhs - 1)) AS u(x)
)"""
)


def _pairs(spark, d):
    return _flagged(spark, d).filter("line % 3 <> 1").select("doc_id", F.col("line").alias("lhs"), (2 * F.col("line") + F.col("changed").cast("int")).alias("rhs"))


@query("w9_fill_gaps", f"WITH {FILLED} SELECT * FROM filled")
def w9(spark, d):
    return i.fill_gaps(_pairs(spark, d), ["doc_id"])


@query(
    "w10_compact_gaps",
    f"""WITH {FILLED}, k AS (SELECT *, CASE WHEN o < 2 THEN row_number() OVER (PARTITION BY doc_id, "at", o ORDER BY coalesce(lhs, rhs)) ELSE 1073741824 END AS k FROM filled)
    SELECT doc_id, "at", k, max(lhs) AS lhs, max(rhs) AS rhs FROM k GROUP BY 1, 2, 3""",
)
def w10(spark, d):
    return i.compact_gaps(i.fill_gaps(_pairs(spark, d), ["doc_id"]), ["doc_id"])


RUNS = LINES + ", rn AS (SELECT doc_id, line // 4 AS run, min(line) AS lhs_start, min(line) + 10 AS rhs_start, count(*) AS size FROM lines GROUP BY 1, 2), cut AS (SELECT doc_id, 'lhs' AS side, line FROM lines WHERE line % 3 = 2 UNION ALL SELECT doc_id, 'rhs', line + 10 FROM lines WHERE line % 5 = 2)"


@query(
    "t12_split_runs",
    f"""WITH {RUNS}, o AS (SELECT doc_id, run, 0 AS "offset" FROM rn UNION SELECT rn.doc_id, run, line - lhs_start FROM rn JOIN cut ON cut.doc_id = rn.doc_id AND side = 'lhs' AND line > lhs_start AND line < lhs_start + size
      UNION SELECT rn.doc_id, run, line - rhs_start FROM rn JOIN cut ON cut.doc_id = rn.doc_id AND side = 'rhs' AND line > rhs_start AND line < rhs_start + size)
    SELECT doc_id, run, row_number() OVER w - 1 AS piece, "offset", coalesce(lead("offset") OVER w, size) - "offset" AS size FROM o JOIN rn USING (doc_id, run) WINDOW w AS (PARTITION BY doc_id, run ORDER BY "offset")""",
)
def t12(spark, d):
    own = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"))
    rn = own.groupBy("doc_id", F.expr("line div 4").alias("run")).agg(F.min("line").alias("lhs_start"), (F.min("line") + 10).alias("rhs_start"), F.count(F.lit(1)).alias("size"))
    cuts = own.filter("line % 3 = 2").select("doc_id", F.lit("lhs").alias("side"), "line").unionByName(own.filter("line % 5 = 2").select("doc_id", F.lit("rhs").alias("side"), (F.col("line") + 10).alias("line")))
    return i.split_runs(rn, cuts, ["doc_id"])


ITEMS = LINES + ", items AS (SELECT doc_id, 'lhs' AS side, line AS pre, CASE WHEN line % 3 > 0 THEN line END AS pair_key FROM lines UNION ALL SELECT doc_id, 'rhs', line, CASE WHEN line % 4 > 0 THEN line END FROM lines)"


def _items(spark, d):
    own = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("pre"))
    side = lambda s, k: own.select("doc_id", F.lit(s).alias("side"), "pre", F.when(F.col("pre") % k > 0, F.col("pre")).alias("pair_key"))
    return side("lhs", 3).unionByName(side("rhs", 4))


@query(
    "t13_region_ids",
    f"""WITH {ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY side, pre) AS id FROM items),
    f AS (SELECT *, CASE WHEN pair_key IS NOT NULL THEN min(id) OVER (PARTITION BY doc_id, pair_key) ELSE id END AS first FROM a)
    SELECT doc_id, side, pre, pair_key, id, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS alignment_id FROM f""",
)
def t13(spark, d):
    return i.region_ids(_items(spark, d), ["doc_id"])


@query(
    "m15_row_zip",
    f"""WITH {ITEMS}, it AS (SELECT doc_id, side, pre, coalesce('p' || pair_key, side || pre) AS key FROM items),
    j AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.key, r.key) AS key, l.pre AS lhs, r.pre AS rhs FROM (FROM it WHERE side = 'lhs') l FULL OUTER JOIN (FROM it WHERE side = 'rhs') r ON l.doc_id = r.doc_id AND l.key = r.key),
    b AS (SELECT *, (SELECT min(k.lhs) FROM j k WHERE k.doc_id = j.doc_id AND k.lhs IS NOT NULL AND k.rhs IS NOT NULL AND CASE WHEN j.lhs IS NOT NULL THEN k.lhs >= j.lhs ELSE k.rhs > j.rhs END) AS block FROM j)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block NULLS LAST, CASE WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN 2 WHEN lhs IS NOT NULL THEN 0 ELSE 1 END, coalesce(lhs, rhs)) AS "row", key, lhs, rhs FROM b""",
)
def m15(spark, d):
    key = F.coalesce(F.concat(F.lit("p"), F.col("pair_key").cast("string")), F.concat("side", F.col("pre").cast("string")))
    return i.row_zip(_items(spark, d).select("doc_id", "side", F.col("pre").alias("pos"), key.alias("key")), ["doc_id"])


@query("m17_paired_ids", f"WITH {ITEMS} SELECT a.doc_id, a.side, a.pre FROM items a WHERE EXISTS (SELECT 1 FROM items b WHERE b.doc_id = a.doc_id AND b.pair_key = a.pair_key AND b.side <> a.side)")
def m17(spark, d):
    a = _items(spark, d)
    b = a.select("doc_id", F.when(F.col("side") == "lhs", "rhs").otherwise("lhs").alias("side"), "pair_key")
    return a.join(b, ["doc_id", "side", "pair_key"], "left_semi").select("doc_id", "side", "pre")


@query("m18_paired_leaf", f"WITH {ITEMS} SELECT a.doc_id, a.pre AS lhs, b.pre AS rhs FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.pair_key = b.pair_key AND a.side = 'lhs' AND b.side = 'rhs'")
def m18(spark, d):
    a = _items(spark, d)
    side = lambda s: a.filter(F.col("side") == s).select("doc_id", "pair_key", F.col("pre").alias(s))
    return side("lhs").join(side("rhs"), ["doc_id", "pair_key"]).select("doc_id", "lhs", "rhs")


@query("m19_linked_regions", f"WITH {ITEMS} SELECT doc_id, pair_key, count(*) AS n, string_agg(side, ',' ORDER BY side) AS sides FROM items WHERE pair_key IS NOT NULL GROUP BY 1, 2")
def m19(spark, d):
    return _items(spark, d).filter("pair_key IS NOT NULL").groupBy("doc_id", "pair_key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("side")), ",").alias("sides"))


#: Nested spans of lines: by blocks of 8, of 4 and of 2.
SPANS = LINES + """, spans AS (SELECT doc_id, k * 1000 + line // k AS id, min(line) AS start, max(line) + 1 AS "end", k FROM lines, (VALUES (8), (4), (2)) v(k) GROUP BY doc_id, k, line // k)"""


def _spans(spark, d):
    own = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), F.explode(F.array(*map(F.lit, (8, 4, 2)))).alias("k"))
    return own.groupBy("doc_id", "k", F.expr("line div k").alias("b")).agg(F.min("line").alias("start"), (F.max("line") + 1).alias("end")).select("doc_id", (F.col("k") * 1000 + F.col("b")).alias("id"), "start", "end", "k")


@query(
    "t14_nest_intervals",
    f"""WITH {SPANS} SELECT s.doc_id, s.id, s.start, s."end", (SELECT p.id FROM spans p WHERE p.doc_id = s.doc_id AND p.id <> s.id AND p.start <= s.start AND p."end" >= s."end"
      AND (p.start < s.start OR p."end" > s."end" OR p.id < s.id) ORDER BY p."end" - p.start, p.id DESC LIMIT 1) AS parent_id FROM spans s""",
)
def t14(spark, d):
    return i.nest(_spans(spark, d).drop("k"), ["doc_id"])


@query(
    "t6_merge_folds",
    f"""WITH {SPANS} SELECT doc_id, start, "end", arg_max(id, (100 - k) * 100000 + id) AS id, array_to_string(list_sort(list_distinct(list('k' || k))), ',') AS tags FROM spans GROUP BY 1, 2, 3""",
)
def t6(spark, d):
    folds = _spans(spark, d).withColumns({"depth": 100 - F.col("k"), "tags": F.array(F.concat(F.lit("k"), F.col("k").cast("string")))})
    return i.merge_folds(folds, ["doc_id"]).withColumn("tags", F.array_join("tags", ","))


@query(
    "w5_syntax_spans",
    f"""WITH {SPANS}, pt AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, start AS p FROM spans UNION ALL SELECT doc_id, "end" FROM spans)),
    seg AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM pt),
    b AS (SELECT seg.doc_id, p, q, arg_min('c' || (k % 3), ("end" - start) * 10 + k % 3) AS capture FROM seg JOIN spans s ON s.doc_id = seg.doc_id AND start <= p AND "end" >= q WHERE q IS NOT NULL GROUP BY 1, 2, 3),
    n AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(capture) OVER w = capture THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n)
    SELECT doc_id, capture, min(p) AS start, max(q) AS "end" FROM r GROUP BY doc_id, run, capture""",
)
def w5(spark, d):
    return i.paint(_spans(spark, d).select("doc_id", "start", "end", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")).alias("capture")), ["doc_id"])


@query(
    "t15_changed_spans",
    f"""WITH {LINES}, tok AS (SELECT doc_id, line, 4 * g AS start, 4 * g + 4 AS "end", (line + g) % 3 <> 0 OR line % 5 = 0 AS novel FROM lines, unnest(generate_series(0, 3)) AS u(g)),
    f AS (SELECT doc_id, line, bool_and(novel) AS all_novel, max("end") AS e FROM tok GROUP BY 1, 2),
    n AS (SELECT tok.*, start <> lag("end", 1, -1) OVER (PARTITION BY doc_id, line ORDER BY start) AS new FROM tok JOIN f USING (doc_id, line) WHERE novel AND NOT all_novel),
    r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, line ORDER BY start) AS island FROM n)
    SELECT doc_id, line, 0 AS start, e AS "end" FROM f WHERE all_novel UNION ALL SELECT doc_id, line, min(start), max("end") FROM r GROUP BY doc_id, line, island""",
)
def t15(spark, d):
    own = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))
    tok = own.select("doc_id", "line", (4 * F.col("g")).alias("start"), (4 * F.col("g") + 4).alias("end"), (((F.col("line") + F.col("g")) % 3 != 0) | (F.col("line") % 5 == 0)).alias("novel"))
    return i.changed_spans(tok, ["doc_id"])


NODES = LINES + """, nodes AS (SELECT doc_id AS file, 'lhs' AS side, line AS id, CASE WHEN line = 0 THEN NULL WHEN line % 4 = 0 THEN 0 ELSE line - line % 4 END AS parent_id, line AS ord, line AS pre,
  CASE WHEN line = 0 THEN max(line) OVER (PARTITION BY doc_id) WHEN line % 4 = 0 THEN least(line + 3, max(line) OVER (PARTITION BY doc_id)) ELSE line END AS last, line % 7 = 4 AS collapsed, text AS content_id FROM lines)"""


def _nodes(spark, d):
    from pyspark.sql import Window

    top = F.max("line").over(Window.partitionBy("doc_id"))
    own = lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), "text")
    n = F.col("line")
    return own.select(
        F.col("doc_id").alias("file"), F.lit("lhs").alias("side"), n.alias("id"), F.when(n == 0, None).when(n % 4 == 0, 0).otherwise(n - n % 4).alias("parent_id"), n.alias("ord"), n.alias("pre"),
        F.when(n == 0, top).when(n % 4 == 0, F.least(n + 3, top)).otherwise(n).alias("last"), (n % 7 == 4).alias("collapsed"), F.col("text").alias("content_id"),
    )


@query("w1_sibling_links", f"WITH {NODES} SELECT file, id, lag(id) OVER s AS prev_sibling, lead(id) OVER s AS next_sibling, lag(id) OVER p AS prev FROM nodes WINDOW s AS (PARTITION BY file, side, parent_id ORDER BY ord), p AS (PARTITION BY file, side ORDER BY pre)")
def w1(spark, d):
    return t.sibling_links(_nodes(spark, d)).select("file", "id", "prev_sibling", "next_sibling", "prev")


@query("a9_subtree_counts", f"WITH {NODES} SELECT file, id, last - pre AS num_descendants, (SELECT count(*) FROM nodes a WHERE a.file = n.file AND a.pre < n.pre AND a.last >= n.pre) AS num_ancestors FROM nodes n")
def a9(spark, d):
    return t.subtree_counts(_nodes(spark, d)).drop("side")


@query("f12_visibility", f"WITH {NODES} SELECT file, id, EXISTS (SELECT 1 FROM nodes a WHERE a.file = n.file AND a.collapsed AND a.pre <= n.pre AND a.last >= n.pre) AS hidden FROM nodes n")
def f12(spark, d):
    return t.hidden(_nodes(spark, d)).select("file", "id", "hidden")


@query("a8_unique_content", f"WITH {NODES} SELECT file, id, count(*) OVER (PARTITION BY file, content_id) = 1 AS unique_on_side FROM nodes")
def a8(spark, d):
    return t.unique_content(_nodes(spark, d)).select("file", "id", "unique_on_side")


@query("a10_content_ids", f"WITH {LINES} SELECT doc_id, line, dense_rank() OVER (PARTITION BY doc_id ORDER BY encode(text)) AS content_id FROM lines")
def a10(spark, d):
    from pyspark.sql import Window

    own = lines(spark, d)
    return own.select("doc_id", F.col("line").cast("long").alias("line"), F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")).cast("long").alias("content_id"))


@query("e12_line_sets", 'SELECT doc_id, l AS line FROM documents, unnest(generate_series(doc_id % 5, doc_id % 5 + doc_id % 3 - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)) AS u(l)')
def e12(spark, d):
    s = F.col("doc_id") % 5
    return documents(spark, d).select("doc_id", F.explode(i.line_set(s, s + F.col("doc_id") % 3, F.col("doc_id") % 2)).alias("line"))


@query("t28_visible_rows", f"WITH {NODES}, h AS (SELECT *, EXISTS (SELECT 1 FROM nodes a WHERE a.file = n.file AND a.collapsed AND a.pre < n.pre AND a.last >= n.pre) AS below FROM nodes n) SELECT file, id, CASE WHEN collapsed THEN 'fold' ELSE 'line' END AS kind FROM h WHERE NOT below")
def t28(spark, d):
    from gemello.operators.regions import visible_items

    return visible_items(_nodes(spark, d))


@query("t20_link_states", "SELECT lang, min(doc_id) AS state, bool_or(doc_id % 50 = 0) AS collapsed FROM documents GROUP BY lang")
def t20(spark, d):
    from gemello.operators.regions import link_states

    regions = documents(spark, d).select("lang", F.col("doc_id").alias("fold_state_id"), (F.col("doc_id") % 50 == 0).alias("collapsed"))
    return link_states(regions, ["lang"]).groupBy("lang").agg(F.min("fold_state_id").alias("state"), F.bool_or("collapsed").alias("collapsed"))


LINKS = [(1, 2), (2, 3), (5, 6), (6, 7), (9, 9), (7, 5)]


@query("m24_connected_links", "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5)) t(node, state)")
def m24(spark, d):
    from gemello.operators.regions import shared_states

    return shared_states(values(spark, LINKS, "a long, b long"))


@query("p3_deleted_bodies", f"WITH {SPANS} SELECT doc_id, id, (\"end\" - start) || ' lines removed' AS label FROM spans WHERE k = 8 AND \"end\" - start >= 6 AND doc_id % 2 = 0")
def p3(spark, d):
    from gemello.operators.regions import deleted_bodies

    folds = _spans(spark, d).filter("k = 8").withColumns({"side": F.lit("lhs"), "tags": F.array(F.lit("function")), "one_sided": F.col("doc_id") % 2 == 0})
    return deleted_bodies(folds, 6).select("doc_id", "id", "label")


@query("p4_removed_runs", f"WITH {SPANS} SELECT doc_id, id, start + 1 AS start, \"end\" - 1 AS \"end\", (\"end\" - start - 2) || ' lines removed' AS label FROM spans WHERE k = 8 AND \"end\" - start >= 5")
def p4(spark, d):
    from gemello.operators.regions import removed_runs

    leaves = _spans(spark, d).filter("k = 8").withColumns({"side": F.lit("lhs"), "one_sided": F.lit(True), "holder_one_sided": F.lit(True)})
    return removed_runs(leaves, 5).select("doc_id", "id", "start", "end", "label")


@query("p5_test_bodies", f"WITH {SPANS} SELECT doc_id, id FROM spans WHERE k = 4 AND \"end\" - start >= 3 AND doc_id % 3 <> 0")
def p5(spark, d):
    from gemello.operators.regions import test_bodies

    folds = _spans(spark, d).filter("k = 4").withColumns({"tags": F.array(F.lit("test")), "file_tags": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("e2e"))).otherwise(F.array().cast("array<string>"))})
    return test_bodies(folds, 3).select("doc_id", "id")


@query("f16_one_sided", f"WITH {NODES} SELECT file, id, NOT EXISTS (SELECT 1 FROM nodes l WHERE l.file = n.file AND l.pre BETWEEN n.pre AND n.last AND l.id % 3 = 0) AS one_sided FROM nodes n")
def f16(spark, d):
    from gemello.operators.regions import one_sided

    nodes = _nodes(spark, d).withColumn("paired", F.col("id") % 3 == 0)
    return one_sided(nodes).select("file", "id", "one_sided")


@query("f17_leaves_in_window", f"WITH {SPANS} SELECT doc_id, id FROM spans WHERE start < 9 AND \"end\" > 5")
def f17(spark, d):
    from gemello.operators.regions import in_window

    return in_window(_spans(spark, d), 5, 9).select("doc_id", "id")


@query("a3_coverage", f"WITH {SPANS}, c AS (SELECT doc_id, CASE WHEN k = 2 THEN start END AS a, CASE WHEN k = 2 THEN \"end\" END AS b, id % 5 = 0 AS hidden FROM spans WHERE k = 2 AND id % 3 = 0) SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS total, CAST(coalesce(sum(b - a) FILTER (NOT hidden), 0) AS BIGINT) AS visible FROM c GROUP BY doc_id")
def a3(spark, d):
    from gemello.operators.regions import coverage

    leaves = _spans(spark, d).filter("k = 2 AND id % 3 = 0").select("doc_id", F.lit(False).alias("paired"), "start", "end", F.array().cast("array<struct<line:bigint>>").alias("changed"), (F.col("id") % 5 == 0).alias("hidden"))
    return coverage(leaves, ["doc_id"])
