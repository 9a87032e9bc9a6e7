"""Trees of the pages' HTML and of JSON made from the events, tree patterns, and what is derived from both."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemello.operators import assembly, edits, parse, propagate, regions, siblings
from gemello.operators.parse import GRAMMARS, Grammar
from gemello.operators.tree import hidden, partners
from gemello.operators.twigs import Twig, matches, tagged
from gemello.queries.carriers import spread, table
from gemello.registry import query
from gemello.session import written

#: SQL of the texts that are parsed: file and text.
PAGES = "texts AS (SELECT page_id AS file, html AS text FROM pages)"
EVENTS = """texts AS (
  SELECT user_id AS file, '[' || string_agg(chr(10) || '  {"id": ' || event_id || ', "type": "' || event_type || '", "props": ' || props || ', "path": [' || event_id % 7 || ', ' || event_id % 3 || ',]}', ',' ORDER BY event_id) || chr(10) || ']' AS text
  FROM events GROUP BY user_id
)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): a JSON array of each user's events, one on a line, with a comma at the end of each inner array."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    row = F.concat(F.lit('\n  {"id": '), n.cast("string"), F.lit(', "type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "path": ['), (n % 7).cast("string"), F.lit(", "), (n % 3).cast("string"), F.lit(",]}"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(n, row.alias("row")))), lambda r: r["row"])
    return e.groupBy(F.col("user_id").alias("file")).agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("\n]")).alias("text"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(g: Grammar) -> str:
    """SQL of the tokens of texts, to be put after these."""
    full = lambda p: f"regexp_full_match(token, {sql_text(p)})"
    if g.name:
        found = f"lower(regexp_extract(token, {sql_text(g.name)}, 1))"
        raw = f"WHEN {found} IN ({', '.join(map(sql_text, g.raw))}) AND regexp_matches(token, '^<[A-Za-z]') AND regexp_matches(token, '</[A-Za-z]+\\s*>$') THEN 'string'"
        name = f"CASE WHEN {found} <> '' THEN {found} ELSE token END"
    else:
        raw = ""
        name = "CASE token " + " ".join(f"WHEN '{c}' THEN '{o}'" for o, c in parse.BRACKETS.items()) + " ELSE token END"
    words = f"WHEN lower(token) IN ({', '.join(map(sql_text, g.keywords))}) THEN 'keyword'" if g.keywords else ""
    return f"""cut AS (SELECT file, regexp_extract_all(text, {sql_text(g.tokens + "|[\\s\\S]")}) AS t FROM texts),
    each AS (SELECT file, i - 1 AS seq, t[i] AS token FROM cut, unnest(generate_series(1, len(t))) AS u(i)),
    tokens AS (
      SELECT file, seq, token, sum(length(token)) OVER w - length(token) AS start, sum(length(token)) OVER w AS stop, {name} AS name,
        sum(length(token) - length(replace(token, chr(10), ''))) OVER w AS stop_line, sum(length(token) - length(replace(token, chr(10), ''))) OVER w - length(token) + length(replace(token, chr(10), '')) AS line,
        CASE WHEN {full(g.skip)} THEN 'skip' {raw} WHEN {full(g.comment)} THEN 'comment' WHEN {full(g.open)} THEN 'open' WHEN {full(g.close)} THEN 'close' WHEN {full(g.string)} THEN 'string' {words} ELSE 'other' END AS type
      FROM each WINDOW w AS (PARTITION BY file ORDER BY seq)
    )"""


def tree_sql(g: Grammar) -> str:
    """SQL of the trees of texts: pairs by the first place where the sum of a name falls below an opening token's."""
    trailing = f"content IN ({', '.join(map(sql_text, g.trailing))}) AND" if g.trailing else "FALSE AND"
    return (
        tokens_sql(g)
        + f""",
    sums AS (SELECT *, sum(CASE type WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY file, name ORDER BY seq) AS s FROM tokens),
    own AS (SELECT o.file, o.seq AS a, min(c.seq) AS b FROM sums o JOIN sums c ON c.file = o.file AND c.name = o.name AND c.type = 'close' AND c.seq > o.seq AND c.s = o.s - 1 WHERE o.type = 'open' GROUP BY ALL),
    ends AS (SELECT file, a AS seq, 1 AS step FROM own UNION ALL SELECT file, b, -1 FROM own),
    all_sums AS (SELECT *, sum(step) OVER (PARTITION BY file ORDER BY seq) AS s FROM ends),
    by_depth AS (SELECT o.file, o.seq AS a, min(c.seq) AS b FROM all_sums o JOIN all_sums c ON c.file = o.file AND c.step = -1 AND c.seq > o.seq AND c.s = o.s - 1 WHERE o.step = 1 GROUP BY ALL),
    pairs AS (SELECT * FROM own JOIN by_depth USING (file, a, b)),
    kept AS (SELECT t.*, p.b, row_number() OVER (PARTITION BY t.file ORDER BY t.seq) - 1 AS id FROM tokens t LEFT JOIN pairs p ON p.file = t.file AND p.a = t.seq
      WHERE type <> 'skip' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file = t.file AND q.b = t.seq)),
    around AS (SELECT k.file, k.id, max(p.id) AS parent_id, count(p.id) AS level FROM kept k LEFT JOIN kept p ON p.file = k.file AND p.seq < k.seq AND p.b > k.seq GROUP BY ALL),
    within AS (SELECT k.file, k.id, max(x.id) AS last FROM kept k JOIN kept x ON x.file = k.file AND x.seq >= k.seq AND x.seq <= coalesce(k.b, k.seq) GROUP BY ALL),
    plain AS (
      SELECT k.file, k.id, parent_id, row_number() OVER (PARTITION BY k.file, parent_id ORDER BY k.id) - 1 AS ord, last, level, k.b IS NOT NULL AS is_list, k.name,
        CASE WHEN k.b IS NOT NULL THEN k.token END AS open, e.token AS close, CASE WHEN k.b IS NULL THEN k.token END AS content,
        CASE WHEN k.b IS NOT NULL THEN 'list' WHEN k.type = 'close' THEN 'error' ELSE k.type END AS kind, k.start, coalesce(e.stop, k.stop) AS stop, k.line, coalesce(e.stop_line, k.stop_line) AS end_line
      FROM kept k JOIN around USING (file, id) JOIN within USING (file, id) LEFT JOIN tokens e ON e.file = k.file AND e.seq = k.b
    ),
    tree AS (
      SELECT file, id, parent_id, ord, id AS pre, last, level, is_list, name, open, close, content,
        CASE WHEN {trailing} parent_id IS NOT NULL AND ord > 0 AND lead(id) OVER (PARTITION BY file, parent_id ORDER BY id) IS NULL THEN 'can_ignore' ELSE kind END AS kind, start, stop, line, end_line
      FROM plain
    )"""
    )


def page_tree(spark: SparkSession, d: str) -> DataFrame:
    return parse.tree(pages(spark, d), GRAMMARS["html"], ["file"])


def event_tree(spark: SparkSession, d: str) -> DataFrame:
    return parse.tree(events(spark, d), GRAMMARS["json"], ["file"])


@query("t1_page_tokens", f'WITH {PAGES}, {tokens_sql(GRAMMARS["html"])} SELECT file, seq, token, start, stop AS "end", line, type, name FROM tokens')
def t1_pages(spark, d):
    return parse.tokens(pages(spark, d), GRAMMARS["html"], ["file"])


@query("t2_page_tree", f'WITH {PAGES}, {tree_sql(GRAMMARS["html"])} SELECT * EXCLUDE (stop), stop AS "end" FROM tree')
def t2_pages(spark, d):
    return page_tree(spark, d)


@query("t2_json_tree", f'WITH {EVENTS}, {tree_sql(GRAMMARS["json"])} SELECT * EXCLUDE (stop), stop AS "end" FROM tree')
def t2_json(spark, d):
    return event_tree(spark, d)


#: Patterns with the SQL of their matches, over pages or events.
TWIGS = {
    # an article with its title and all paragraphs anywhere in it
    "p11_articles": (
        "pages", Twig("article", (Twig("h1", capture="title"), Twig("p", kind="list", deep=True, capture="body")), capture="item"),
        """roots AS (SELECT file, id, last FROM tree r WHERE name = 'article' AND is_list AND EXISTS (SELECT 1 FROM tree x WHERE x.file = r.file AND x.parent_id = r.id AND x.name = 'h1')
             AND EXISTS (SELECT 1 FROM tree x WHERE x.file = r.file AND x.id > r.id AND x.id <= r.last AND x.name = 'p' AND x.kind = 'list'))
           SELECT file, id AS root, 'item' AS capture, id FROM roots UNION ALL
           SELECT r.file, r.id, 'title', x.id FROM roots r JOIN tree x ON x.file = r.file AND x.parent_id = r.id AND x.name = 'h1' UNION ALL
           SELECT r.file, r.id, 'body', x.id FROM roots r JOIN tree x ON x.file = r.file AND x.id > r.id AND x.id <= r.last AND x.name = 'p' AND x.kind = 'list'
             AND NOT EXISTS (SELECT 1 FROM roots i WHERE i.file = r.file AND i.id > r.id AND i.id < x.id AND i.last >= x.id)""",
    ),
    # the links of a menu, with their texts
    "p11_menu_links": (
        "pages", Twig("nav", (Twig("ul", (Twig("li", (Twig("a", (Twig(kind="string", capture="text"),), pattern="href=\"/", capture="link"),)),)),), capture="menu"),
        """hits AS (SELECT n.file, n.id AS root, a.id AS link, t.id AS txt FROM tree n JOIN tree u ON u.file = n.file AND u.parent_id = n.id AND u.name = 'ul' JOIN tree l ON l.file = n.file AND l.parent_id = u.id AND l.name = 'li'
             JOIN tree a ON a.file = n.file AND a.parent_id = l.id AND a.name = 'a' AND regexp_matches(a.open, 'href="/') JOIN tree t ON t.file = n.file AND t.parent_id = a.id AND t.kind = 'string' WHERE n.name = 'nav')
           SELECT DISTINCT file, root, 'menu' AS capture, root AS id FROM hits UNION SELECT file, root, 'link', link FROM hits UNION SELECT file, root, 'text', txt FROM hits""",
    ),
    # paragraphs with no tag inside, and their texts
    "p11_plain_paragraphs": (
        "pages", Twig("p", (Twig(kind="list", deep=True, absent=True), Twig(kind="open", deep=True, absent=True), Twig(kind="string", capture="text")), kind="list", capture="paragraph"),
        """roots AS (SELECT file, id FROM tree p WHERE name = 'p' AND is_list AND EXISTS (SELECT 1 FROM tree x WHERE x.file = p.file AND x.parent_id = p.id AND x.kind = 'string')
             AND NOT EXISTS (SELECT 1 FROM tree x WHERE x.file = p.file AND x.id > p.id AND x.id <= p.last AND x.kind IN ('list', 'open')))
           SELECT file, id AS root, 'paragraph' AS capture, id FROM roots UNION ALL SELECT r.file, r.id, 'text', x.id FROM roots r JOIN tree x ON x.file = r.file AND x.parent_id = r.id AND x.kind = 'string'""",
    ),
    # any element around an advert or a script, the nearest one
    "p11_around_notices": (
        "pages", Twig(kind="list", below=(Twig(pattern="^<div class=\"ad|^<script", deep=True, capture="notice"),), capture="around"),
        """hits AS (SELECT x.file, x.id AS notice, r.id AS root FROM tree x JOIN tree r ON r.file = x.file AND r.kind = 'list' AND r.id < x.id AND r.last >= x.id WHERE regexp_matches(coalesce(x.open, x.content), '^<div class="ad|^<script'))
           SELECT DISTINCT file, root, 'around' AS capture, root AS id FROM hits UNION SELECT file, max(root), 'notice', notice FROM hits GROUP BY file, notice""",
    ),
    # objects of a list that hold an object, with its keys and the last commas of inner lists
    "p11_json_records": (
        "events", Twig("[", (Twig("{", (Twig("{", (Twig(kind="string", capture="key"),)), Twig("[", (Twig(kind="can_ignore", capture="comma"),))), capture="record"),), capture="list"),
        """recs AS (SELECT r.file, r.id, r.parent_id AS root FROM tree r JOIN tree l ON l.file = r.file AND l.id = r.parent_id AND l.name = '[' AND l.is_list WHERE r.name = '{' AND r.is_list
             AND EXISTS (SELECT 1 FROM tree o JOIN tree k ON k.file = o.file AND k.parent_id = o.id AND k.kind = 'string' WHERE o.file = r.file AND o.parent_id = r.id AND o.name = '{')
             AND EXISTS (SELECT 1 FROM tree o JOIN tree k ON k.file = o.file AND k.parent_id = o.id AND k.kind = 'can_ignore' WHERE o.file = r.file AND o.parent_id = r.id AND o.name = '['))
           SELECT DISTINCT file, root, 'list' AS capture, root AS id FROM recs UNION SELECT file, root, 'record', id FROM recs
           UNION SELECT r.file, r.root, 'key', k.id FROM recs r JOIN tree o ON o.file = r.file AND o.parent_id = r.id AND o.name = '{' JOIN tree k ON k.file = r.file AND k.parent_id = o.id AND k.kind = 'string'
           UNION SELECT r.file, r.root, 'comma', k.id FROM recs r JOIN tree o ON o.file = r.file AND o.parent_id = r.id AND o.name = '[' JOIN tree k ON k.file = r.file AND k.parent_id = o.id AND k.kind = 'can_ignore'""",
    ),
}


def _twig_query(name: str, of: str, twig: Twig, sql: str) -> None:
    texts, grammar = (PAGES, "html") if of == "pages" else (EVENTS, "json")

    @query(name, f"WITH {texts}, {tree_sql(GRAMMARS[grammar])}, {sql}")
    def run(spark, d):
        return matches(page_tree(spark, d) if of == "pages" else event_tree(spark, d), ["file"], twig)


for _name, _of in TWIGS.items():
    _twig_query(_name, *_of)


#: SQL of two sides of each conversation as JSON, file = 2 * conv_id + (1 on the right): turns left out, roles changed, last commas left out on the right.
TALKS = """talk AS (
  SELECT 2 * conv_id + s AS file, turn, chr(10) || ' {' || chr(10) || '  "turn": ' || turn || ',' || chr(10) || '  "role": "' || CASE WHEN s = 1 AND conv_id % 3 = 0 AND turn = 0 THEN 'person' ELSE role END || '",' || chr(10) || '  "lines": ['
    || array_to_string(list_transform(string_split(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10)), lambda l: chr(10) || '   "' || l || '"'), ',')
    || CASE WHEN s = 1 AND conv_id % 2 = 0 THEN '' ELSE ',' END || chr(10) || '  ]' || chr(10) || ' }' AS record
  FROM conversations, (SELECT unnest([0, 1]) AS s) WHERE NOT (s = 1 AND (conv_id + turn) % 4 = 1)
), texts AS (SELECT file, '[' || string_agg(record, ',' ORDER BY turn) || chr(10) || ']' AS text FROM talk GROUP BY file)"""


def talks(spark: SparkSession, d: str) -> DataFrame:
    """(file, side, text): two sides of each conversation as JSON, an object of several lines for each turn; on the right turns are left out, roles
    changed and the last commas of lists left out."""
    c = table(spark, d, "conversations").withColumn("side", F.explode(F.array(F.lit("lhs"), F.lit("rhs"))))
    right, conv, turn = F.col("side") == "rhs", F.col("conv_id"), F.col("turn")
    c = c.filter(~(right & ((conv + turn) % 4 == 1)))
    role = F.when(right & (conv % 3 == 0) & (turn == 0), "person").otherwise(F.col("role"))
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rows = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit('\n   "'), x, F.lit('"'))), ",")
    comma = F.when(right & (conv % 2 == 0), "").otherwise(",")
    record = F.concat(F.lit('\n {\n  "turn": '), turn.cast("string"), F.lit(',\n  "role": "'), role, F.lit('",\n  "lines": ['), rows, comma, F.lit("\n  ]\n }"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("record")))), lambda r: r["record"])
    return c.groupBy(conv.alias("file"), "side").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("\n]")).alias("text"))


def talk_tree(spark: SparkSession, d: str) -> DataFrame:
    return parse.tree(talks(spark, d), GRAMMARS["json"], ["file", "side"])


def talk_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, changes) of the two sides of the conversations."""
    nodes = written(parse.with_content_id(written(talk_tree(spark, d), "tree"), ["file", "side"]), "nodes")
    return nodes, propagate.deep_changes(nodes, propagate.equal_subtrees(nodes))


#: SQL of the same changes, by comparing subtrees as texts and placing each node among those of its subtree; to be put after TALKS.
CHANGES = (
    tree_sql(GRAMMARS["json"])
    + """,
    piece AS (SELECT file, id AS owner, id AS pos, 0 AS role, 0 AS up, coalesce(open, content) AS piece FROM tree WHERE kind <> 'can_ignore' UNION ALL SELECT file, id, last, 1, -level, close FROM tree WHERE close IS NOT NULL),
    content AS (SELECT n.file, n.id, n.last, string_agg(piece, chr(31) ORDER BY pos, role, up) AS content FROM tree n JOIN piece p ON p.file = n.file AND p.owner BETWEEN n.id AND n.last WHERE n.kind <> 'can_ignore' GROUP BY ALL),
    once AS (SELECT c.*, file // 2 AS conv, file % 2 AS s FROM content c WHERE (SELECT count(*) FROM content x WHERE x.file = c.file AND x.content = c.content) = 1),
    same AS (SELECT l.conv, l.id AS a, l.last AS a_last, r.id AS b, r.last AS b_last FROM once l JOIN once r ON r.conv = l.conv AND r.content = l.content AND l.s = 0 AND r.s = 1),
    anchors AS (SELECT * FROM same x WHERE NOT EXISTS (SELECT 1 FROM same y WHERE y.conv = x.conv AND y.a < x.a AND y.a_last >= x.a)),
    parts AS (
      SELECT conv, a AS anchor, 'lhs' AS side, id, kind, level - min(level) OVER w AS deep, sum(CASE WHEN kind = 'can_ignore' THEN 0 ELSE 1 END) OVER (PARTITION BY conv, a ORDER BY id) AS core
        FROM anchors JOIN tree ON file = 2 * conv AND id BETWEEN a AND a_last WINDOW w AS (PARTITION BY conv, a) UNION ALL
      SELECT conv, a, 'rhs', id, kind, level - min(level) OVER w, sum(CASE WHEN kind = 'can_ignore' THEN 0 ELSE 1 END) OVER (PARTITION BY conv, a ORDER BY id)
        FROM anchors JOIN tree ON file = 2 * conv + 1 AND id BETWEEN b AND b_last WINDOW w AS (PARTITION BY conv, a)
    ),
    below AS (
      SELECT p.conv AS file, p.side, p.id, CASE WHEN q.id IS NOT NULL THEN 'unchanged' ELSE 'ignored_punctuation' END AS kind, q.id AS opposite_id
      FROM parts p LEFT JOIN parts q ON q.conv = p.conv AND q.anchor = p.anchor AND q.side <> p.side AND q.core = p.core AND q.deep = p.deep AND (q.kind = 'can_ignore') = (p.kind = 'can_ignore')
    ),
    nodes AS (SELECT file // 2 AS file, CASE file % 2 WHEN 0 THEN 'lhs' ELSE 'rhs' END AS side, * EXCLUDE (file) FROM tree),
    changes AS (SELECT n.file, n.side, n.id, coalesce(b.kind, 'novel') AS kind, opposite_id FROM nodes n LEFT JOIN below b USING (file, side, id))"""
)


@query("m11_deep_changes", f"WITH {TALKS}, {CHANGES} SELECT * FROM changes")
def m11(spark, d):
    return talk_changes(spark, d)[1]


@query("m12_tree_partners", f"WITH {TALKS}, {CHANGES} SELECT file, id AS lhs_id, opposite_id AS rhs_id FROM changes WHERE side = 'lhs' AND opposite_id IS NOT NULL")
def m12(spark, d):
    return partners(talk_changes(spark, d)[1])


#: The tags of folds: what a record with a role is taken for. Records of the first turn stand for integration tests.
TAGS = {
    "function": Twig("{", (Twig(kind="string", pattern='^"user"$'),), capture="fold"),
    "test": Twig("{", (Twig(kind="string", pattern='^"assistant"$'),), capture="fold"),
    "integration": Twig("{", (Twig(pattern="^1$"),), capture="fold"),
}

FOLDS = f"""{CHANGES},
    folds AS (
      SELECT n.*, n.line::BIGINT AS l0, n.end_line::BIGINT + 1 AS l1, NOT EXISTS (SELECT 1 FROM nodes x JOIN changes c USING (file, side, id) WHERE x.file = n.file AND x.side = n.side AND x.id BETWEEN n.id AND n.last AND c.opposite_id IS NOT NULL) AS one_sided,
        n.name = '{{' AND EXISTS (SELECT 1 FROM nodes x WHERE x.file = n.file AND x.side = n.side AND x.parent_id = n.id AND x.content = '"user"') AS function,
        n.name = '{{' AND EXISTS (SELECT 1 FROM nodes x WHERE x.file = n.file AND x.side = n.side AND x.parent_id = n.id AND x.content = '"assistant"') AS test,
        n.name = '{{' AND EXISTS (SELECT 1 FROM nodes x WHERE x.file = n.file AND x.side = n.side AND x.parent_id = n.id AND x.content = '1') AS integration
      FROM nodes n WHERE n.is_list
    )"""


def talk_folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, folds): all nodes with one_sided and their change, and the lists among them with their lines and tags."""
    nodes, changes = talk_changes(spark, d)
    paired = changes.select("file", "side", "id", F.col("kind").alias("change"), F.col("opposite_id").isNotNull().alias("paired"))
    all_ = regions.one_sided(nodes.join(paired, ["file", "side", "id"])).withColumns({"first": F.col("line"), "stop": F.col("end_line") + 1}).drop("upto", "upto_last")
    tags = tagged(nodes, ["file", "side"], TAGS)
    lists = all_.filter("is_list").drop("start", "end").withColumnsRenamed({"first": "start", "stop": "end"}).join(tags, ["file", "side", "id"], "left")
    return all_, lists.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


@query("p3_deleted_records", f"WITH {TALKS}, {FOLDS} SELECT file, id, l1 - l0 || ' lines removed' AS label FROM folds WHERE side = 'lhs' AND function AND one_sided AND l1 - l0 >= 7")
def p3(spark, d):
    return regions.deleted_bodies(talk_folds(spark, d)[1], 7).select("file", "id", "label")


@query("p5_test_records", f"WITH {TALKS}, {FOLDS} SELECT file, side, id FROM folds WHERE test AND NOT integration AND l1 - l0 >= 3 AND file % 4 <> 0")
def p5(spark, d):
    folds = talk_folds(spark, d)[1].withColumn("file_tags", F.when(F.col("file") % 4 == 0, F.array(F.lit("e2e"))).otherwise(F.array().cast("array<string>")))
    return regions.test_bodies(folds, 3).select("file", "side", "id")


@query(
    "p4_removed_lines",
    f"""WITH {TALKS}, {FOLDS}, leaves AS (SELECT a.file, a.parent_id AS id, min(a.line) AS first, max(a.end_line) + 1 AS stop FROM nodes a JOIN folds f ON f.file = a.file AND f.side = a.side AND f.id = a.parent_id AND f.one_sided
      JOIN folds h ON h.file = a.file AND h.side = a.side AND h.id = f.parent_id AND h.one_sided WHERE a.side = 'lhs' AND f.name = '[' GROUP BY 1, 2)
    SELECT file, id, first + 1 AS "start", stop - 1 AS "end", CAST(stop - first - 2 AS BIGINT) || ' lines removed' AS label FROM leaves WHERE stop - first >= 5""",
)
def p4(spark, d):
    nodes, _ = talk_folds(spark, d)
    held = parse.with_parent(nodes, ["file", "side"], F.struct("one_sided", "name"), "list")
    held = parse.with_parent(held, ["file", "side"], F.col("list.one_sided"), "holder_one_sided")
    atoms = held.filter("list.name = '['").groupBy("file", "side", F.col("parent_id").alias("id")).agg(F.min("first").alias("start"), F.max("stop").alias("end"), F.bool_and("list.one_sided").alias("one_sided"), F.bool_and("holder_one_sided").alias("holder_one_sided"))
    return regions.removed_runs(atoms, 5).select("file", "id", "start", "end", "label")


@query(
    "a3_tree_coverage",
    f"""WITH {TALKS}, {FOLDS}, shut AS (SELECT * FROM folds WHERE side = 'lhs' AND function AND one_sided AND l1 - l0 >= 7),
    l AS (SELECT n.file, n.side, unnest(range(n.line::BIGINT, n.end_line::BIGINT + 1)) AS line, EXISTS (SELECT 1 FROM shut s WHERE s.file = n.file AND s.side = n.side AND n.id BETWEEN s.id AND s.last) AS hidden
      FROM nodes n JOIN changes c USING (file, side, id) WHERE NOT n.is_list AND c.kind = 'novel')
    SELECT file, side, count(DISTINCT line) AS total, count(DISTINCT line) FILTER (NOT hidden) AS visible FROM l GROUP BY 1, 2""",
)
def a3(spark, d):
    nodes, folds = talk_folds(spark, d)
    shut = regions.deleted_bodies(folds, 7).select("file", "side", "id", F.lit(True).alias("collapsed"))
    seen = hidden(nodes.join(shut, ["file", "side", "id"], "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(False))))
    leaves = seen.filter("NOT is_list").select("file", "side", "hidden", F.col("first").alias("start"), F.col("stop").alias("end"), (F.col("change") != "novel").alias("paired"), F.array().cast("array<struct<line:bigint>>").alias("changed"))
    return regions.coverage(leaves, ["file", "side"])


def lists_and_twos(nodes: pa.Table) -> pa.Table:
    """Runs of all children of each list, and of each two siblings."""
    lists = nodes.filter(nodes["parent_id"].is_valid()).group_by(["file", "side", "parent_id"], use_threads=False).aggregate([("id", "min"), ("id", "count")])
    order = nodes.sort_by([(c, "ascending") for c in ("file", "side", "parent_id", "ord")])
    ahead, behind = order.slice(0, max(0, nodes.num_rows - 1)), order.slice(1)
    next_ = pc.and_(pc.and_(pc.equal(ahead["file"], behind["file"]), pc.equal(ahead["side"], behind["side"])), pc.equal(pc.fill_null(ahead["parent_id"], -1), pc.fill_null(behind["parent_id"], -1)))
    two = ahead.filter(next_).select(["file", "side", "id"])
    whole = lists.select(["file", "side", "id_min", "id_count"]).rename_columns(["file", "side", "id", "n"])
    return pa.concat_tables([whole, two.append_column("n", pa.array([2] * two.num_rows, pa.int64()))])


@query(
    "m20_matching_siblings",
    f"""WITH {PAGES.replace("texts AS", "original AS")}, texts AS (SELECT 2 * file AS file, text FROM original UNION ALL SELECT 2 * file + 1, replace(replace(text, '<br>', ''), '</ul>', '<li>More</li></ul>') FROM original), {tree_sql(GRAMMARS["html"])},
    kids AS (SELECT file, parent_id, coalesce(parent_id, -1) AS parent_pre, list(coalesce(open, content) ORDER BY id) AS keys, list(id ORDER BY id) AS ids FROM tree GROUP BY ALL),
    asked AS (SELECT file, keys, ids, 0 AS pos, len(ids) AS n FROM kids WHERE parent_id IS NOT NULL UNION SELECT file, keys, ids, pos, 2 FROM (SELECT *, unnest(range(len(ids) - 1)) AS pos FROM kids)),
    run AS (SELECT file, ids[pos + 1] AS id, n, list_slice(keys, pos + 1, pos + n) AS keys FROM asked),
    windows AS (SELECT DISTINCT r.file, r.id, r.n, k.parent_pre, w, k.ids, r.keys = list_slice(k.keys, w + 1, w + r.n) AS same
      FROM run r JOIN (SELECT *, unnest(range(len(ids))) AS w FROM kids) k ON k.file = CASE r.file % 2 WHEN 0 THEN r.file + 1 ELSE r.file - 1 END AND k.keys[w + 1] = r.keys[1] AND w + r.n <= len(k.ids)),
    best AS (SELECT file, id, n, arg_min(list_slice(ids, w + 1, w + n), parent_pre * 1000000 + w) AS ids FROM windows WHERE same GROUP BY ALL),
    met AS (SELECT DISTINCT r.file, r.id, r.n FROM (SELECT file, id, n, unnest(keys) AS key FROM run) r JOIN tree t ON t.file = CASE r.file % 2 WHEN 0 THEN r.file + 1 ELSE r.file - 1 END AND coalesce(t.open, t.content) = r.key)
    SELECT r.file // 2 AS file, CASE r.file % 2 WHEN 0 THEN 'lhs' ELSE 'rhs' END AS side, r.id, r.n, CASE WHEN b.ids IS NOT NULL THEN array_to_string(b.ids, ' ') WHEN m.file IS NULL THEN '' END AS ids
    FROM (SELECT DISTINCT file, id, n FROM run) r LEFT JOIN best b USING (file, id, n) LEFT JOIN met m USING (file, id, n)""",
)
def m20(spark, d):
    """All children of each list, and each two siblings, looked for on the other side of the pages."""
    own = spread(pages(spark, d), "file")
    edited = F.replace(F.replace("text", F.lit("<br>"), F.lit("")), F.lit("</ul>"), F.lit("<li>More</li></ul>"))
    sides = own.select("file", F.explode(F.array(F.struct(F.lit("lhs").alias("side"), "text"), F.struct(F.lit("rhs").alias("side"), edited.alias("text")))).alias("t")).select("file", "t.*")
    nodes = parse.tree(sides, GRAMMARS["html"], ["file", "side"]).withColumn("key", F.coalesce("open", "content"))
    found = siblings.matching_siblings_in_place(nodes, lists_and_twos)
    return found.select("file", "side", "id", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


#: SQL of what imports what: customers their nation, nations their region; each market segment begins with its customers.
IMPORTS = """
roots AS (SELECT c_mktsegment AS language, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS ord, 'customer/' || c_custkey AS source FROM customer),
imports AS (SELECT 'customer/' || c_custkey AS source, 1 AS ord, 'nation/' || c_nationkey AS target FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 1, 'region/' || n_regionkey FROM nation)"""


def imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    # the order of customers within a segment is that of their keys; places need not be dense
    roots = c.select(F.col("c_mktsegment").alias("language"), F.col("c_custkey").alias("ord"), name("customer", "c_custkey").alias("source"))
    of = c.select(name("customer", "c_custkey").alias("source"), F.lit(1).alias("ord"), name("nation", "c_nationkey").alias("target"))
    return roots, of.unionByName(n.select(name("nation", "n_nationkey").alias("source"), F.lit(1).alias("ord"), name("region", "n_regionkey").alias("target")))


@query(
    "p10_assembly",
    f"""WITH RECURSIVE {IMPORTS}, way(language, path, source) AS (
      SELECT language, [ord], source FROM roots UNION ALL SELECT w.language, list_append(w.path, i.ord), i.target FROM way w JOIN imports i ON i.source = w.source
    ), first AS (SELECT language, source, min(path) AS path FROM way GROUP BY ALL)
    SELECT language, row_number() OVER (PARTITION BY language ORDER BY list_append(path, 2147483647)) AS place, source FROM first""",
)
def p10(spark, d):
    return assembly.assembled(assembly.first_ways(*imports(spark, d)))


#: SQL of which event follows which for a user: what follows is imported, in alphabetical order.
FOLLOWS = """
steps AS (SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events),
many AS (SELECT user_id % 7 AS grp, source, target, count(*) AS n FROM steps WHERE target IS NOT NULL AND target <> source GROUP BY ALL),
imports AS (SELECT grp || '/' || source AS source, row_number() OVER (PARTITION BY grp, source ORDER BY target) AS ord, grp || '/' || target AS target FROM many WHERE n % 2 = 1),
roots AS (SELECT CAST(grp AS VARCHAR) AS language, 1 AS ord, grp || '/click' AS source FROM (SELECT DISTINCT user_id % 7 AS grp FROM events))"""


@query(
    "p10_cycles",
    f"""WITH RECURSIVE {FOLLOWS}, way(language, sources, cyclic) AS (
      SELECT language, [source], FALSE FROM roots UNION ALL SELECT w.language, list_append(w.sources, i.target), list_contains(w.sources, i.target) FROM way w JOIN imports i ON i.source = w.sources[-1] WHERE NOT w.cyclic
    ) SELECT DISTINCT language, array_to_string(list_slice(sources, list_position(sources, sources[-1]), len(sources)), ' -> ') AS cycle FROM way WHERE cyclic""",
)
def p10_cycles(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("grp"), F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    many = e.filter("target <> source").groupBy("grp", "source", "target").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    name = lambda c: F.concat_ws("/", "grp", c)
    follows = many.select(name("source").alias("source"), F.row_number().over(Window.partitionBy("grp", "source").orderBy("target")).alias("ord"), name("target").alias("target"))
    roots = e.select("grp").distinct().select(F.col("grp").alias("language"), F.lit(1).alias("ord"), F.concat("grp", F.lit("/click")).alias("source"))
    found = assembly.cycles(assembly.import_tree(roots, written(follows, "imports")))
    return found.select("language", F.array_join("cycle", " -> ").alias("cycle"))


@query(
    "a12_row_summaries",
    f"""WITH {PAGES}, {tree_sql(GRAMMARS["html"])}, r AS (SELECT file, id, last, NOT is_list AS is_leaf, CAST(length(coalesce(content, '')) % 5 AS BIGINT) AS lines, id % 6 = 4 AS collapsed FROM tree),
    items AS (SELECT x.file, x.id, i.id AS item, i.collapsed, CASE WHEN i.collapsed THEN 0 ELSE i.lines END AS lines FROM r x JOIN r i ON i.file = x.file AND i.id > x.id AND i.id <= x.last AND (i.is_leaf OR i.collapsed)
      WHERE NOT x.collapsed AND NOT EXISTS (SELECT 1 FROM r c WHERE c.file = x.file AND c.collapsed AND c.id > x.id AND c.id < i.id AND c.last >= i.id)),
    runs AS (SELECT *, sum(CAST(collapsed AS INT)) OVER (PARTITION BY file, id ORDER BY item) AS run FROM items),
    gaps AS (SELECT file, id, run, sum(lines) AS lines, count(*) FILTER (collapsed) AS n FROM runs GROUP BY ALL),
    s AS (SELECT file, id, sum(n) AS n, max(lines) AS longest, coalesce(sum(lines) FILTER (run = 0), 0) AS ahead, arg_max(lines, run) AS behind FROM gaps GROUP BY ALL)
    SELECT r.file, r.id, CAST(CASE WHEN collapsed THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS collapsed_rows,
      CAST(CASE WHEN collapsed THEN 0 WHEN is_leaf THEN r.lines ELSE coalesce(ahead, 0) END AS BIGINT) AS "leading", CAST(CASE WHEN collapsed THEN 0 WHEN is_leaf THEN r.lines ELSE coalesce(behind, 0) END AS BIGINT) AS "trailing",
      CAST(CASE WHEN collapsed THEN 0 WHEN is_leaf THEN r.lines ELSE coalesce(longest, 0) END AS BIGINT) AS longest_gap
    FROM r LEFT JOIN s USING (file, id)""",
)
def a12(spark, d):
    from gemello.operators.summaries import row_summaries

    nodes = page_tree(spark, d).select("file", "id", "pre", "last", "level", (~F.col("is_list")).alias("is_leaf"), (F.length(F.coalesce("content", F.lit(""))) % 5).cast("long").alias("lines"), (F.col("id") % 6 == 4).alias("collapsed"))
    return row_summaries(written(nodes, "regions"), ["file"])


def talk_edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(regions, requests) over the two sides of the conversations: every third left node cut at some character, the first three children of every left
    list joined together with what they are paired with."""
    nodes, changes = talk_changes(spark, d)
    n = nodes.join(changes.select("file", "side", "id", "opposite_id"), ["file", "side", "id"])
    right = (F.col("side") == "rhs").cast("int")
    region = 2 * F.col("id") + right
    leaf = ~F.col("is_list")
    name = F.col("file").cast("string")
    regs = n.select(
        name.alias("file"), "side", region.alias("id"), (2 * F.col("parent_id") + right).alias("parent_id"), "ord", "start", "end", leaf.alias("is_leaf"),
        F.when(leaf, F.when((F.col("side") == "rhs") & F.col("opposite_id").isNotNull(), 2 * F.col("opposite_id")).otherwise(region)).alias("alignment_id"), F.when(~leaf, region).alias("fold_state_id"),
    )
    left = n.filter("side = 'lhs'")
    cuts = left.filter("id % 3 = 0").select(name.alias("file"), F.col("id").alias("request"), F.lit("cut").alias("kind"), F.array(2 * F.col("id")).alias("ids"), (F.col("id") % 5).alias("offset"))
    three = left.filter("parent_id IS NOT NULL AND ord < 3").select(name.alias("file"), "parent_id", F.explode(F.array_compact(F.array(2 * F.col("id"), 2 * F.col("opposite_id") + 1))).alias("id"))
    joins = three.groupBy("file", "parent_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("file", (100_000 + F.col("parent_id")).alias("request"), F.lit("join").alias("kind"), "ids", F.lit(None).cast("long").alias("offset"))
    return written(regs, "regions"), cuts.unionByName(joins)


@query(
    "t22_edit_refusals",
    f"""WITH {TALKS}, {CHANGES}, n AS (SELECT * FROM nodes JOIN changes c USING (file, side, id)),
    cuts AS (SELECT l.file, l.id AS request, CASE WHEN l.is_list THEN 'not_a_leaf' WHEN NOT (l.id % 5 > 0 AND l.id % 5 < l.stop - l.start) THEN 'out_of_range' WHEN r.stop - r.start <> l.stop - l.start THEN 'uneven_sides' END AS reason
      FROM n l LEFT JOIN n r ON r.file = l.file AND r.side = 'rhs' AND NOT r.is_list AND r.opposite_id = l.id WHERE l.side = 'lhs' AND l.id % 3 = 0),
    kids AS (SELECT l.file, l.parent_id AS list, l.id, l.opposite_id, r.parent_id AS r_parent, r.ord AS r_ord FROM n l LEFT JOIN n r ON r.file = l.file AND r.side = 'rhs' AND r.id = l.opposite_id WHERE l.side = 'lhs' AND l.parent_id IS NOT NULL AND l.ord < 3),
    joins AS (SELECT file, 100000 + list AS request, CASE WHEN count(*) + count(opposite_id) < 2 THEN 'too_few' WHEN count(*) = 1 OR count(opposite_id) = 1 THEN 'one_sided'
        WHEN count(DISTINCT r_parent) > 1 OR max(r_ord) - min(r_ord) + 1 <> count(opposite_id) THEN 'not_siblings' END AS reason FROM kids GROUP BY file, list)
    SELECT CAST(file AS VARCHAR) AS file, request, reason FROM (SELECT * FROM cuts UNION ALL SELECT * FROM joins)""",
)
def t22(spark, d):
    return edits.judged(*talk_edits(spark, d)).select("file", "request", "reason")


@query("t18_t19_bulk_edits")
def t18_t19(spark, d):
    """The regions after those cuts and joins that were taken; tests hold them against the same edits one after another."""
    return edits.edited(*talk_edits(spark, d))[0]
