"""Queries of folds, fold states, coloured lines and the steps of a layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gemello.operators import folds as f
from gemello.operators import intervals as i
from gemello.queries.carriers import LINES, documents, lines
from gemello.queries.layout import ITEMS, NODES, SPANS, _items, _nodes, _spans
from gemello.registry import query

#: Spans of three lines that start on every second line, and so cross.
CROSSING = LINES + ', crossing AS (SELECT doc_id, line AS id, line AS start, line + 1 + line % 5 AS "end" FROM lines WHERE line % 2 = 0 OR line % 3 = 0)'


def _lines(spark, d):
    return lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query(
    "t8_strict_nesting",
    f"""WITH {CROSSING}, c AS (SELECT a.doc_id, a.id, a.start, least(a."end", coalesce(min(b.start), a."end")) AS "end"
      FROM crossing a LEFT JOIN crossing b ON a.doc_id = b.doc_id AND b.start > a.start AND b.start < a."end" AND b."end" > a."end" GROUP BY a.doc_id, a.id, a.start, a."end")
    SELECT doc_id, id, start, "end" FROM c WHERE start < "end" """,
)
def t8(spark, d):
    n = F.col("line")
    return f.strict_nesting(_lines(spark, d).filter("line % 2 = 0 OR line % 3 = 0").select("doc_id", n.alias("id"), n.alias("start"), (n + 1 + n % 5).alias("end")), ["doc_id"])


@query(
    "t9_fold_range",
    f"""WITH {LINES}, n AS (SELECT doc_id, line, length(text) AS size FROM lines),
    r AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN line WHEN line % 3 = 1 THEN line ELSE 7 END AS sl, CASE WHEN line % 3 = 0 THEN 1 WHEN line % 3 = 1 THEN 2 ELSE 0 END AS sc,
      CASE WHEN line % 3 = 0 THEN line + size % 2 WHEN line % 3 = 1 THEN line + size % 3 ELSE 7 + size % 2 END AS el, CASE WHEN line % 3 = 0 THEN 1 WHEN line % 3 = 1 THEN size ELSE 0 END AS ec FROM n)
    SELECT doc_id, line, CASE WHEN (sl, sc) < (el, ec) THEN sl || ':' || sc || '-' || el || ':' || ec END AS "range" FROM r""",
)
def t9(spark, d):
    """By turns a list between its delimiters, an atom from its first to its last piece, and a range given in their place."""
    n, size, zero = F.col("line"), F.length("text").cast("long"), F.lit(0).cast("long")
    span = lambda line, start, end: F.struct(line.alias("line"), start.alias("start"), end.alias("end"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    opens = F.when(n % 3 == 0, F.array(span(n, zero, one)))
    closes = F.when(n % 3 == 0, F.array(span(n + size % 2, one, two)))
    pieces = F.when(n % 3 == 1, F.array(span(n, two, size), span(n + size % 3, zero, size)))
    override = F.when(n % 3 == 2, F.struct(F.lit(7).cast("long").alias("start_line"), zero.alias("start_col"), (7 + size % 2).alias("end_line"), zero.alias("end_col")))
    r = f.fold_range(override, opens, closes, pieces)
    text = F.concat(r["start_line"].cast("string"), F.lit(":"), r["start_col"].cast("string"), F.lit("-"), r["end_line"].cast("string"), F.lit(":"), r["end_col"].cast("string"))
    return _lines(spark, d).select("doc_id", "line", text.alias("range"))


@query("o3_fold_order", f'WITH {SPANS} SELECT doc_id, id, 1 + (SELECT count(*) FROM spans b WHERE b.doc_id = a.doc_id AND (b.start, -b."end", -b.k, b.id) < (a.start, -a."end", -a.k, a.id)) AS ord FROM spans a')
def o3(spark, d):
    return f.fold_order(_spans(spark, d).withColumn("depth", -F.col("k")), ["doc_id"]).select("doc_id", "id", F.col("ord").cast("long").alias("ord"))


@query(
    "m16_leaf_zip",
    f"""WITH {ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY side, pre) AS id FROM items),
    x AS (SELECT *, CASE WHEN pair_key IS NOT NULL THEN min(id) OVER (PARTITION BY doc_id, pair_key) ELSE id END AS leaf FROM a),
    l AS (SELECT doc_id, leaf, pre FROM x WHERE side = 'lhs'), r AS (SELECT doc_id, leaf, pre FROM x WHERE side = 'rhs')
    SELECT doc_id, l.pre AS lhs, r.pre AS rhs, coalesce(l.pre, (SELECT min(l2.pre) FROM l l2 JOIN r r2 ON l2.doc_id = r2.doc_id AND l2.leaf = r2.leaf WHERE l2.doc_id = r.doc_id AND r2.pre > r.pre), -1) AS before_lhs
    FROM l FULL OUTER JOIN r USING (doc_id, leaf)""",
)
def m16(spark, d):
    """Leaves by alignment id on their rows; a lone right leaf stands before the next left leaf that has a partner."""
    ids = i.region_ids(_items(spark, d), ["doc_id"])
    rows = i.row_zip(ids.select("doc_id", "side", F.col("pre").alias("pos"), F.col("alignment_id").alias("key")), ["doc_id"])
    ahead = Window.partitionBy("doc_id").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    partner = F.first(F.when(F.col("rhs").isNotNull(), F.col("lhs")), ignorenulls=True).over(ahead)
    return rows.select("doc_id", "lhs", "rhs", F.coalesce("lhs", partner, F.lit(-1).cast("long")).alias("before_lhs"))


REGIONS = NODES + """, regions AS (SELECT file, side, pre, last, parent_id AS parent_pre, last = pre AS is_leaf, id % 5 = 1 AS foldable_leaf, id % 4 = 0 AS collapsed, id % 12 = 8 AS tagged, id % 9 <> 7 AS paired,
  id % 11 = 3 AS changed, id AS alignment_id, CASE WHEN id % 8 = 4 THEN id - 4 ELSE id END AS fold_state_id FROM nodes)"""


def _regions(spark, d):
    n = F.col("id")
    return _nodes(spark, d).select(
        "file", "side", "pre", "last", F.col("parent_id").alias("parent_pre"), (F.col("last") == F.col("pre")).alias("is_leaf"), (n % 5 == 1).alias("foldable_leaf"), (n % 4 == 0).alias("collapsed"),
        (n % 12 == 8).alias("tagged"), (n % 9 != 7).alias("paired"), (n % 11 == 3).alias("changed"), n.alias("alignment_id"), F.when(n % 8 == 4, n - 4).otherwise(n).alias("fold_state_id"),
    )


@query("t27_fold_sets", f"WITH {REGIONS} SELECT file, fold_state_id, max(NOT is_leaf OR foldable_leaf) AS foldable, max(collapsed) AS start_collapsed FROM regions GROUP BY 1, 2")
def t27(spark, d):
    return f.fold_sets(_regions(spark, d), ["file"])


@query(
    "t27_gap_states",
    f"""WITH {REGIONS} SELECT DISTINCT file, fold_state_id FROM regions r WHERE collapsed AND NOT tagged AND paired
      AND NOT EXISTS (SELECT 1 FROM regions c WHERE c.file = r.file AND c.is_leaf AND c.pre >= r.pre AND c.pre <= r.last AND (c.changed OR NOT c.paired))""",
)
def t27_gaps(spark, d):
    return f.gap_states(_regions(spark, d), ["file"])


@query(
    "t27_nested_states",
    f"""WITH {REGIONS} SELECT DISTINCT a.file, a.fold_state_id, b.fold_state_id AS nested FROM regions a JOIN regions b ON a.file = b.file AND b.pre > a.pre AND b.pre <= a.last
      AND NOT a.is_leaf AND NOT b.is_leaf AND a.fold_state_id <> b.fold_state_id""",
)
def t27_nested(spark, d):
    return f.nested_states(_regions(spark, d), ["file"])


@query(
    "e10_placeholder_rows",
    """SELECT doc_id AS file_index, doc_id || ':load' AS key, 'Load diff' AS label, TRUE AS load FROM documents
    UNION ALL SELECT doc_id, doc_id || ':why', CASE WHEN coalesce(source, '') = '' OR doc_id % 4 = 0 THEN 'Hidden by default' ELSE source END, FALSE FROM documents""",
)
def e10(spark, d):
    label = F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 4 != 0, F.col("source"))
    return f.placeholder_rows(documents(spark, d).select(F.col("doc_id").alias("file_index"), label.alias("label")))


@query(
    "w6_line_segments",
    f"""WITH {LINES}, z AS (SELECT doc_id, line, octet_length(encode(text)) AS size FROM lines),
    sp AS (SELECT doc_id, line, 0 AS start, size // 2 AS "end", 'a' AS capture, 0 AS i FROM z UNION ALL SELECT doc_id, line, size // 4, size, 'b', 1 FROM z UNION ALL SELECT doc_id, line, size // 8, size // 3, 'c', 2 FROM z),
    ch AS (SELECT doc_id, line, size // 5 AS start, size // 2 + 1 AS "end" FROM z WHERE line % 2 = 0 AND size > 1),
    b AS (SELECT doc_id, line, 0 AS p FROM z UNION SELECT doc_id, line, size FROM z UNION SELECT doc_id, line, start FROM sp UNION SELECT doc_id, line, "end" FROM sp UNION SELECT doc_id, line, start FROM ch UNION SELECT doc_id, line, "end" FROM ch),
    s AS (SELECT doc_id, line, p AS start, lead(p) OVER (PARTITION BY doc_id, line ORDER BY p) AS "end" FROM b),
    c AS (SELECT s.doc_id, s.line, s.start, s."end", arg_min(capture, (sp."end" - sp.start) * 10 + i) AS capture FROM s LEFT JOIN sp ON sp.doc_id = s.doc_id AND sp.line = s.line AND sp.start <= s.start AND sp."end" >= s."end" WHERE s."end" IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT c.doc_id, c.line, c.start, c."end", capture, EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = c.doc_id AND ch.line = c.line AND ch.start <= c.start AND ch."end" >= c."end") AS emphasized FROM c""",
)
def w6(spark, d):
    size = F.octet_length("text").cast("long")
    cut = lambda k: F.floor(size / k).cast("long")
    span = lambda start, end, capture: F.struct(start.alias("start"), end.alias("end"), F.lit(capture).alias("capture"))
    syntax = F.array(span(F.lit(0).cast("long"), cut(2), "a"), span(cut(4), size, "b"), span(cut(8), cut(3), "c"))
    changed = F.when((F.col("line") % 2 == 0) & (size > 1), F.array(F.struct(cut(5).alias("start"), (cut(2) + 1).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return _lines(spark, d).select("doc_id", "line", F.explode(f.line_segments(size, syntax, changed)).alias("s")).select("doc_id", "line", "s.*")


TOKENS = LINES + """, tokens AS (SELECT doc_id, line // 4 AS node, line AS ord, line // 3 AS line, line % 3 * 1000 AS start, line % 3 * 1000 + length(text) % 1000 AS "end" FROM lines)"""


def _edges(spark, d):
    n = F.col("line")
    tokens = _lines(spark, d).select("doc_id", F.expr("line div 4").alias("node"), n.alias("ord"), F.expr("line div 3").alias("line"), (n % 3 * 1000).alias("start"), (n % 3 * 1000 + F.length("text") % 1000).alias("end"))
    return f.edge_spans(tokens, ["doc_id", "node"])


@query(
    "e17_edge_spans",
    f"""WITH {TOKENS} SELECT a.doc_id, a.node, a.line AS first_line, a.start AS first_start, b.line AS last_line, b."end" AS last_end FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.node = b.node
      WHERE a.ord % 4 = 0 AND b.ord = (SELECT max(t.ord) FROM tokens t WHERE t.doc_id = b.doc_id AND t.node = b.node)""",
)
def e17(spark, d):
    return _edges(spark, d).select("doc_id", "node", F.col("first.line").alias("first_line"), F.col("first.start").alias("first_start"), F.col("last.line").alias("last_line"), F.col("last.end").alias("last_end"))


@query(
    "e16_node_gap",
    f"""WITH {TOKENS} SELECT a.doc_id, a.node, CAST(coalesce(b.line - a.line, 0) AS BIGINT) AS lines, CAST(CASE WHEN b.line = a.line THEN b.start - a."end" ELSE 0 END AS BIGINT) AS columns
      FROM tokens a LEFT JOIN tokens b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 WHERE a.ord = (SELECT max(t.ord) FROM tokens t WHERE t.doc_id = a.doc_id AND t.node = a.node)""",
)
def e16(spark, d):
    after = F.lead("first").over(Window.partitionBy("doc_id").orderBy("node"))
    return _edges(spark, d).withColumn("after", after).select("doc_id", "node", f.node_gap(F.col("last"), F.col("after")).alias("g")).select("doc_id", "node", "g.*")


@query(
    "f20_common_words",
    f"""WITH {LINES}, w AS (SELECT doc_id, line, string_split(text, ' ') AS w FROM lines)
    SELECT doc_id, line, len(list_filter(w, lambda x: length(x) % 3 > 0 AND x <> '')) > 2 AND 2 * len(list_filter(w, lambda x: length(x) % 3 > 0)) >= len(list_filter(w, lambda x: length(x) % 3 = 0)) AS common FROM w""",
)
def f20(spark, d):
    """Words of a line whose length isn't a multiple of three stand for those of both sides."""
    parts = F.transform(F.split("text", " "), lambda x: F.struct(F.when(F.length(x) % 3 > 0, "both").otherwise("left").alias("kind"), x.alias("word")))
    return _lines(spark, d).select("doc_id", "line", f.common_words(parts).alias("common"))


POSITIONS = LINES + ", positions AS (SELECT doc_id, line AS lhs, (line * 7) % 23 + line AS rhs FROM lines)"
PAIRS = POSITIONS + ", pairs AS (SELECT doc_id, lhs, rhs FROM (SELECT *, max(rhs) OVER (PARTITION BY doc_id ORDER BY lhs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM positions) WHERE before IS NULL OR rhs > before)"


def _increasing(spark, d):
    n = F.col("line")
    return f.increasing_pairs(_lines(spark, d).select("doc_id", n.alias("seq"), n.alias("lhs"), (n * 7 % 23 + n).alias("rhs")), ["doc_id"])


@query("m22_increasing_pairs", f"WITH {PAIRS} SELECT doc_id, lhs, rhs FROM pairs")
def m22(spark, d):
    return _increasing(spark, d)


@query(
    "m21_blank_pairs",
    f"""WITH {LINES}, p AS (SELECT doc_id, line AS lhs, line + 2 AS rhs FROM lines WHERE line % 6 = 5)
    SELECT DISTINCT p.doc_id, p.lhs - k AS lhs, p.rhs - k AS rhs FROM p, (VALUES (0), (1), (2), (3), (4), (5)) v(k)
    WHERE k <= 5 AND (SELECT count(*) FROM lines l WHERE l.doc_id = p.doc_id AND l.line >= p.lhs - k AND l.line < p.lhs AND l.text = '') = k""",
)
def m21(spark, d):
    own = _lines(spark, d)
    side = lambda s, by: own.select("doc_id", F.lit(s).alias("side"), (F.col("line") + by).alias("line"), "text")
    head = documents(spark, d).select("doc_id", F.lit("rhs").alias("side"), F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 1)))).alias("line"), F.lit("a new line").alias("text"))
    pairs = own.filter("line % 6 = 5").select("doc_id", F.col("line").alias("lhs"), (F.col("line") + 2).alias("rhs"))
    return f.blank_pairs(pairs, side("lhs", 0).unionByName(side("rhs", 2)).unionByName(head), ["doc_id"])


@query(
    "m23_opposite_lines",
    f"""WITH {PAIRS}, lone AS (SELECT doc_id, line AS rhs FROM lines l WHERE line % 2 = 0 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = l.doc_id AND p.rhs = l.line)),
    u AS (SELECT doc_id, lhs, rhs FROM pairs UNION ALL SELECT doc_id, NULL, rhs FROM lone) SELECT doc_id, lhs, rhs, (SELECT count(*) FROM u b WHERE b.doc_id = u.doc_id AND b.rhs <= u.rhs) AS "row" FROM u""",
)
def m23(spark, d):
    return f.with_opposite_lines(_increasing(spark, d), _lines(spark, d).filter("line % 2 = 0").select("doc_id", F.col("line").alias("rhs")), ["doc_id"])
