"""Syntax trees of texts as node tables.

A grammar cuts a text into tokens that tile it. Opening and closing tokens of one name are matched, each closing one with the nearest opening one that
is not closed yet. What has no partner is an atom, or an error if it closes nothing. Pairs of different
names that cross are errors too; what remains nests. A token's level is the number of pairs open around it, its parent the pair opened last on the
level above.

Trees are made where their texts stand, in Arrow batches and with two stacks for the tokens that open and close: a file's text is in one row, no
file meets another, and nothing is shuffled or sorted. tokens() and paired() give the same steps as window functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Grammar:
    """What tokens a language has. Patterns are regular expressions over code points and have no groups that capture."""

    tokens: str  # alternatives, the first that matches counts; anything else is a token of one character
    comment: str  # whole tokens that are comments, as the following ones
    string: str
    open: str
    close: str
    name: str = ""  # the part of an opening or closing token that must agree, by its first group; none: brackets
    skip: str = r"\s+"  # tokens between nodes
    trailing: tuple[str, ...] = ()  # atoms that may be left out at the end of a list
    keywords: tuple[str, ...] = ()
    raw: tuple[str, ...] = field(default=())  # names whose content is one token


#: What closes what opens, where a grammar has no names.
BRACKETS = {"{": "}", "[": "]", "(": ")"}

_C_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
_WORDS = r"[A-Za-z0-9_$\x{80}-\x{10FFFF}]+"


def brackets(comment: str, strings: str, keywords: tuple[str, ...] = ()) -> Grammar:
    """A grammar of brackets, comments, strings and words."""
    return Grammar(rf"{comment}|{strings}|\s+|{_WORDS}", comment, strings, r"[\[({]", r"[\])}]", trailing=(",", ";"), keywords=keywords)


#: Grammars by the name of a language.
GRAMMARS = {
    "json": Grammar(r"\"(?:[^\"\\]|\\[\s\S])*\"|\s+|[-+.A-Za-z0-9]+", r"[^\s\S]", r"\"[\s\S]*", r"[\[{]", r"[\]}]", trailing=(",",), keywords=("true", "false", "null")),
    "c": brackets(r"//[^\n]*|/\*[\s\S]*?\*/", _C_STRING, ("if", "else", "for", "while", "return", "switch", "case", "break", "continue", "struct", "class", "function", "const")),
    "shell": brackets(r"#[^\n]*", _C_STRING, ("if", "then", "else", "fi", "for", "while", "do", "done", "case", "esac", "def", "class", "return", "import")),
    "lisp": brackets(r";[^\n]*", r"\"(?:[^\"\\]|\\[\s\S])*\"", ("define", "defun", "lambda", "let", "cond")),
    "sql": brackets(r"--[^\n]*|/\*[\s\S]*?\*/", r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", ("select", "from", "where", "join", "group", "order", "by", "with", "union", "insert", "update", "delete")),
    "html": Grammar(
        r"<!--[\s\S]*?-->|<[sS][cC][rR][iI][pP][tT][\s>][\s\S]*?</[sS][cC][rR][iI][pP][tT]\s*>|<[sS][tT][yY][lL][eE][\s>][\s\S]*?</[sS][tT][yY][lL][eE]\s*>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|[^<]+",
        r"<!--[\s\S]*", r"[^<\s][\s\S]*|\s+[^<\s][\s\S]*", r"<[A-Za-z][\s\S]*[^/]>|<[A-Za-z]>", r"</[A-Za-z][\s\S]*", name=r"^</?([A-Za-z][A-Za-z0-9:-]*)", raw=("script", "style"),
    ),
}


def whole(token: Column, pattern: str) -> Column:
    return token.rlike(rf"\A(?:{pattern})\z")


def breaks(token: Column) -> Column:
    """How many line feeds a token has."""
    return F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))


def tokens(texts: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """(keys, seq, token, start, end, line, type, name) of texts (keys, text): tokens from 0 in order, with their places in characters and first lines.

    type is open, close, comment, string, keyword, skip or other; name is that of an opening or closing token, or the token itself. A null text has none.
    """
    found = texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(rf"{grammar.tokens}|[\s\S]"), F.lit(0))).alias("seq", "token"))
    order = Window.partitionBy(*keys).orderBy("seq")
    t = F.col("token")
    raw = F.lit(False)
    if grammar.name:
        name = F.lower(F.regexp_extract(t, grammar.name, 1))
        raw = name.isin(*grammar.raw) & t.rlike(r"\A<[A-Za-z]") & t.rlike(r"</[A-Za-z]+\s*>\z")
        name = F.when(name != "", name)
    else:
        name = F.create_map(*[F.lit(x) for o, c in BRACKETS.items() for x in (c, o)])
        name = F.coalesce(name[t], t)
    kind = F.when(whole(t, grammar.skip), "skip").when(raw, "string").when(whole(t, grammar.comment), "comment").when(whole(t, grammar.open), "open").when(whole(t, grammar.close), "close")
    kind = kind.when(whole(t, grammar.string), "string")
    if grammar.keywords:
        kind = kind.when(F.lower(t).isin(*grammar.keywords), "keyword")
    found = found.withColumns({"end": F.sum(F.length("token")).over(order), "line": F.sum(breaks(t)).over(order) - breaks(t)})
    return found.select(*keys, "seq", "token", (F.col("end") - F.length("token")).alias("start"), "end", "line", kind.otherwise("other").alias("type"), F.coalesce(name, t).alias("name"))


def paired(found: DataFrame, keys: list[str]) -> DataFrame:
    """tokens with partner, the seq of the opening or closing token that each one is matched with; null for all others.

    Partners have one name and nest: a pair that crosses another is none, and both its tokens are without partner.
    """
    step = F.when(F.col("type") == "open", 1).when(F.col("type") == "close", -1).otherwise(0)
    order = Window.partitionBy(*keys, "name").orderBy("seq")
    least = F.least(F.lit(0), F.min("_sum").over(order))
    # a closing token that brings a new minimum closes nothing; counted from the minimum, its depth is 0
    depth = F.col("_sum") - least + F.when(F.col("type") == "close", 1).otherwise(0)
    level = Window.partitionBy(*keys, "name", "_depth").orderBy("seq")
    out = found.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(order)).withColumn("_depth", F.when(F.col("_step") != 0, depth))
    new = (F.col("_step") == -1) & (F.col("_sum") < F.least(F.lit(0), F.coalesce(F.min("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    out = out.withColumn("_depth", F.when(new, -1).otherwise(F.col("_depth")))
    nxt, before = F.lead(F.struct("seq", "_step")).over(level), F.lag(F.struct("seq", "_step")).over(level)
    own = F.when((F.col("_step") == 1) & (nxt["_step"] == -1), nxt["seq"]).when((F.col("_step") == -1) & (F.col("_depth") > 0) & (before["_step"] == 1), before["seq"])
    out = out.withColumn("_own", own)
    # over all names: the pairs that are also each other's by depth are those that nest
    step = F.when(F.col("_own").isNull(), 0).otherwise(F.col("_step"))
    every = Window.partitionBy(*keys).orderBy("seq")
    out = out.withColumn("_step", step).withColumn("_depth", F.sum("_step").over(every) + F.when(F.col("_step") == -1, 1).otherwise(0))
    level = Window.partitionBy(*keys, "_depth", F.col("_step") != 0).orderBy("seq")
    out = out.withColumn("_by", F.when(F.col("_step") == 1, F.lead("seq").over(level)).when(F.col("_step") == -1, F.lag("seq").over(level)))
    return out.withColumn("partner", F.when(F.col("_by") == F.col("_own"), F.col("_own"))).drop("_step", "_sum", "_depth", "_own", "_by")


def tree(texts: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """The node table of texts (keys, text): (keys, id, parent_id, ord, pre, last, level, is_list, name, open, close, content, kind, start, end,
    line, end_line).

    A pair of tokens is a list, any other token but white space an atom. id and pre number nodes from 0 in pre-order, last is the greatest of a
    node's subtree, ord its place among its siblings. kind is list, comment, string, keyword, other, can_ignore (a comma or the like that ends
    a list) or error (a closing token without partner); an opening one without partner is an atom of kind open.
    """
    own = texts.select(*keys, "text")
    schema = StructType([*own.select(*keys).schema.fields, *StructType.fromDDL(_NODE).fields])
    return own.mapInArrow(_parser(grammar, len(keys)), schema)


#: The columns of a node table beside its keys.
_NODE = (
    "id long, parent_id long, ord int, pre long, last long, level long, is_list boolean, name string, open string, close string, content string, kind string, start long, end long, line long, end_line long"
)
#: Characters of texts that are parsed at once, unless one alone is longer.
CHARS = 1 << 18
_KINDS = ["skip", "open", "close", "comment", "string", "keyword", "other", "list", "error", "can_ignore"]


def _parser(grammar: Grammar, n_keys: int):
    """A function from Arrow batches of texts (keys, text) to those of their nodes."""
    import numpy as np
    import pyarrow as pa

    kinds = {k: i for i, k in enumerate(_KINDS)}
    columns = [f.split()[0] for f in _NODE.split(", ")]

    def pattern(p: str, whole: bool = False) -> re.Pattern:
        p = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", p)
        return re.compile(rf"(?:{p})\Z" if whole else p, re.ASCII)

    token = pattern(rf"{grammar.tokens}|[\s\S]")
    skip, comment, open_, close, string = (pattern(p, True) for p in (grammar.skip, grammar.comment, grammar.open, grammar.close, grammar.string))
    name_of, back = pattern(grammar.name), {c: o for o, c in BRACKETS.items()}
    raw_start, raw_end = pattern(r"<[A-Za-z]"), pattern(r"</[A-Za-z]+\s*>\Z")

    def classify(t: str) -> tuple[str, str]:
        """The type and name of a token."""
        name = back.get(t, t)
        if grammar.name:
            found = name_of.search(t)
            name = found[1].lower() if found and found[1] else t
        if skip.match(t):
            return "skip", name
        if grammar.name and name in grammar.raw and raw_start.match(t) and raw_end.search(t):
            return "string", name
        for kind, p in (("comment", comment), ("open", open_), ("close", close), ("string", string)):
            if p.match(t):
                return kind, name
        return "keyword" if t.lower() in grammar.keywords else "other", name

    def partners(own: list[tuple[int, int, int]]) -> dict[int, int]:
        """Of opening and closing tokens (place, +1 or -1, name): the closing one of each opening one that it nests with."""
        stacks: dict[int, list[int]] = {}
        ends = {}
        for k, step, name in own:
            stack = stacks.setdefault(name, [])
            if step > 0:
                stack.append(k)
            elif stack:
                ends[stack.pop()] = k
        starts, stack, out = {b: a for a, b in ends.items()}, [], {}
        for k, _, _ in own:
            if k in ends:
                stack.append(k)
            elif k in starts:
                a = stack.pop()
                if ends[a] == k:
                    out[a] = k
        return out

    def nodes(texts: list[str]) -> tuple | None:
        """The places of the texts of all nodes, and their columns."""
        cut = [token.findall(t) for t in texts]
        file = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        if not len(file):
            return None
        coded = pa.array([t for c in cut for t in c], pa.string()).dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        seen = words.to_pylist()
        types, names = zip(*map(classify, seen), strict=True)
        number: dict[str, int] = {}
        name_code = np.array([number.setdefault(n, len(number)) for n in names])
        kind = np.array([kinds[t] for t in types])[code]
        length, feeds = (np.array([f(w) for w in seen])[code] for f in (len, lambda w: w.count("\n")))
        first = np.searchsorted(file, np.arange(len(cut)))[file]  # each token's first one of its text

        def upto(x):
            total = np.concatenate([[0], np.cumsum(x)])
            return total[1:] - total[first]

        end, end_line = upto(length), upto(feeds)
        marks = np.flatnonzero((kind == kinds["open"]) | (kind == kinds["close"]))
        # a name has its own stack in each text
        stack_of = file[marks] * len(number) + name_code[code[marks]]
        pairs = partners(list(zip(marks.tolist(), np.where(kind[marks] == kinds["open"], 1, -1).tolist(), stack_of.tolist(), strict=True)))
        a, b = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        step = np.zeros(len(file), np.int64)
        step[a], step[b] = 1, -1
        is_node = (step >= 0) & (kind != kinds["skip"])
        ids = upto(is_node) - 1
        partner = np.full(len(file), -1)
        partner[a] = b
        # what is open behind each token that opens or closes
        turns, inside, stack = np.flatnonzero(step), [-1], [-1]
        for k, s in zip(turns.tolist(), step[turns].tolist(), strict=True):
            stack.append(k) if s > 0 else stack.pop()
            inside.append(stack[-1])
        at = np.flatnonzero(is_node)
        parent = np.array(inside)[np.searchsorted(turns, at)]
        level = np.cumsum(step)[at] - (step[at] > 0)
        group = np.where(parent < 0, -1 - file[at], parent)
        order = np.argsort(group, kind="stable")
        new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        ord_ = np.empty(len(at), np.int64)
        ord_[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        last_one = np.empty(len(at), bool)
        last_one[order] = np.concatenate([new[1:], [True]])
        is_list = partner[at] >= 0
        stop = np.where(is_list, partner[at], at)
        out_kind = np.where(is_list, kinds["list"], np.where(kind[at] == kinds["close"], kinds["error"], kind[at]))
        if grammar.trailing:
            ends = np.array([w in grammar.trailing for w in seen])[code[at]]
            out_kind[ends & ~is_list & (parent >= 0) & last_one & (ord_ > 0)] = kinds["can_ignore"]
        text = lambda k, there: words.take(pa.array(code[k], mask=~there))
        long = lambda x, mask=None: pa.array(x, pa.int64(), mask=mask)
        made = [
            long(ids[at]), long(ids[parent], parent < 0), pa.array(ord_, pa.int32()), long(ids[at]), long(np.where(is_list, ids[stop], ids[at])), long(level), pa.array(is_list),
            pa.array(names, pa.string()).take(pa.array(code[at])), text(at, is_list), text(stop, is_list), text(at, ~is_list), pa.array(_KINDS).take(pa.array(out_kind)),
            long(end[at] - length[at]), long(end[stop]), long(end_line[at] - feeds[at]), long(end_line[stop]),
        ]
        return file[at], made

    def run(batches):
        for b in batches:
            texts = b.columns[-1]
            size = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) if b.num_rows else [])
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, "right")))
                made = nodes([t or "" for t in texts.slice(at, stop - at).to_pylist()])
                if made is not None:
                    keys = [c.take(pa.array(made[0] + at)) for c in b.columns[:n_keys]]
                    yield pa.RecordBatch.from_arrays([*keys, *made[1]], [*b.schema.names[:n_keys], *columns])
                at = stop

    return run


def with_content_id(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with content_id, equal for subtrees of equal tokens: a digest of them in order, without white space and nodes of kind can_ignore.

    A file's tokens become one text, of which each subtree is a slice between running lengths.
    """
    core = F.col("kind") != "can_ignore"
    piece = lambda c: F.when(core & F.col(c).isNotNull(), F.concat(F.col(c), F.lit("\x1f"))).otherwise("")
    first = F.coalesce("open", "content")
    rows = _rows(
        nodes.select(*keys, "id", "pre", "last", "level", "kind", first.alias("first"), "close"),
        F.struct(F.col("pre").alias("_at"), F.lit(0).alias("_role"), F.lit(0).cast("long").alias("_up"), piece("first").alias("_piece")),
        F.when(F.col("close").isNotNull(), F.struct(F.col("last").alias("_at"), F.lit(1).alias("_role"), (-F.col("level")).alias("_up"), piece("close").alias("_piece"))),
    )
    order = Window.partitionBy(*keys).orderBy("_at", "_role", "_up")
    rows = rows.withColumn("_upto", F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = Window.partitionBy(*keys, "id").orderBy("_role")
    spans = rows.withColumn("_stop", F.coalesce(F.lead("_upto").over(ends), F.col("_upto"))).filter("_role = 0").select(*keys, "id", (F.col("_upto") - F.length("_piece")).alias("_from"), "_stop")
    whole_text = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_role", "_up", "_piece"))), lambda r: r["_piece"]), "").alias("_text"))
    text = F.substring("_text", (F.col("_from") + 1).cast("int"), (F.col("_stop") - F.col("_from")).cast("int"))
    digests = spans.join(whole_text, keys).select(*keys, "id", F.sha2(text, 256).alias("content_id"))
    return nodes.join(digests, [*keys, "id"])


def _rows(nodes: DataFrame, *rows: Column) -> DataFrame:
    """Each node once for each of rows (structs), null ones left out, without a second reading of nodes."""
    return nodes.select("*", F.explode(F.array_compact(F.array(*rows))).alias("_r")).select("*", "_r.*").drop("_r")


def with_parent(nodes: DataFrame, keys: list[str], value: Column, name: str, opening: Column | None = None) -> DataFrame:
    """nodes (keys, pre, level) with the value that their parent has, null without parent: each node opens the level below it, and a
    child's parent is the node that did so last. Where only nodes that are opening count, the value is that of the last of them, parent or not."""
    opens = F.struct((F.col("level") + 1).alias("_level"), F.lit(True).alias("_opens"))
    rows = _rows(nodes.withColumn("_value", F.struct(value.alias("v"))), F.struct(F.col("level").alias("_level"), F.lit(False).alias("_opens")), opens if opening is None else F.when(opening, opens))
    w = Window.partitionBy(*keys, "_level").orderBy("pre")
    return rows.withColumn("_value", F.last(F.when(F.col("_opens"), F.col("_value")), ignorenulls=True).over(w)).filter("NOT _opens").withColumn(name, F.col("_value.v")).drop("_value", "_level", "_opens")


def with_nearest(nodes: DataFrame, keys: list[str], marked: Column, value: Column, name: str) -> DataFrame:
    """nodes (keys, pre, last) with the value of the nearest marked node above them, null without one.

    Marked nodes open and close along the pre-order; as many as are open at a node, so deep it stands among them, and the one that opened that
    depth last is the nearest.
    """
    at = lambda c, closes: F.struct(F.col(c).alias("_at"), F.lit(closes).alias("_closes"))
    own = nodes.withColumns({"_marked": F.coalesce(marked, F.lit(False)), "_value": F.struct(value.alias("v"))})
    rows = _rows(own, at("pre", False), F.when(F.col("_marked"), at("last", True)))
    before = Window.partitionBy(*keys).orderBy("_at", "_closes").rowsBetween(Window.unboundedPreceding, -1)
    deep = F.coalesce(F.sum(F.when(F.col("_marked"), F.when(F.col("_closes"), -1).otherwise(1)).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("_deep", deep).filter("NOT _closes").drop("_at", "_closes")
    rows = _rows(rows, F.struct(F.col("_deep").alias("_level"), F.lit(False).alias("_opens")), F.when(F.col("_marked"), F.struct((F.col("_deep") + 1).alias("_level"), F.lit(True).alias("_opens"))))
    w = Window.partitionBy(*keys, "_level").orderBy("pre")
    return rows.withColumn("_value", F.last(F.when(F.col("_opens"), F.col("_value")), ignorenulls=True).over(w)).filter("NOT _opens").withColumn(name, F.col("_value.v")).drop("_value", "_level", "_opens", "_marked", "_deep")


def with_children(nodes: DataFrame, keys: list[str], marked: dict[str, Column], asked: Column | None = None) -> DataFrame:
    """nodes (keys, pre, last, level) with the number of marked children under each name: a running count of the marked on a level, between the
    places where a node opens and closes that level. The number is right for nodes that are asked for."""
    at = lambda level, c, role: F.struct(level.alias("_level"), F.col(c).alias("_at"), F.lit(role).alias("_role"))
    own = nodes.withColumns({f"_m_{k}": F.coalesce(c, F.lit(False)) for k, c in marked.items()})
    counted, end = at(F.col("level"), "pre", 0), at(F.col("level") + 1, "last", 2)
    any_marked = F.greatest(F.lit(False), *[F.col(f"_m_{k}") for k in marked])
    rows = _rows(own, F.when(any_marked, counted), at(F.col("level") + 1, "pre", 1), end if asked is None else F.when(asked, end))
    upto = Window.partitionBy(*keys, "_level").orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_n_{k}": F.sum(F.when((F.col("_role") == 0) & F.col(f"_m_{k}"), 1).otherwise(0)).over(upto) for k in marked}).filter("_role > 0")
    ends = Window.partitionBy(*keys, "_level").orderBy("_at", "_role")
    rows = rows.withColumns({k: F.lead(f"_n_{k}").over(ends) - F.col(f"_n_{k}") for k in marked}).filter("_role = 1")
    return rows.drop("_level", "_at", "_role", *[f"_{x}_{k}" for k in marked for x in "mn"])


def with_descendants(nodes: DataFrame, keys: list[str], marked: dict[str, Column], asked: Column | None = None) -> DataFrame:
    """nodes (keys, pre, last, level) with the number of marked nodes below each, by running counts at a node's first and last place. The number is right
    for nodes that are asked for."""
    at = lambda c, role: F.struct(F.col(c).alias("_at"), F.lit(role).alias("_role"))
    own = nodes.withColumns({f"_m_{k}": F.coalesce(c, F.lit(False)) for k, c in marked.items()})
    rows = _rows(own, at("pre", 1), at("last", 2) if asked is None else F.when(asked, at("last", 2)))
    upto = Window.partitionBy(*keys).orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_n_{k}": F.sum(F.when((F.col("_role") == 1) & F.col(f"_m_{k}"), 1).otherwise(0)).over(upto) for k in marked})
    ends = Window.partitionBy(*keys, "level").orderBy("_at", "_role")
    rows = rows.withColumns({k: F.lead(f"_n_{k}").over(ends) - F.col(f"_n_{k}") for k in marked}).filter("_role = 1")
    return rows.drop("_at", "_role", *[f"_{x}_{k}" for k in marked for x in "mn"])
