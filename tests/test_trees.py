"""Trees and tree patterns against a stack and a recursive search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gemello.operators import parse
from gemello.operators.twigs import Twig, matches

OPENS = parse.BRACKETS


def by_stack(text):
    """(start, kind, parent start, name) of the nodes of a bracket text, by closing the nearest open one of the same kind."""
    toks = [(m.start(), m[0]) for m in re.finditer(r"[\[\]{}()]|[a-z,;]", text)]
    back = {c: o for o, c in OPENS.items()}
    own, open_ = {}, {o: [] for o in OPENS}
    for k, (_, t) in enumerate(toks):
        if t in OPENS:
            open_[t].append(k)
        elif t in back and open_[back[t]]:
            a = open_[back[t]].pop()
            own[a] = k
            own[k] = a
    stack, by_depth = [], {}
    for k in sorted(own):
        if own[k] > k:
            stack.append(k)
        else:
            a = stack.pop()
            by_depth[a] = k
            by_depth[k] = a
    pairs = {a: b for a, b in own.items() if by_depth[a] == b}
    out, stack = [], []
    for k, (at, t) in enumerate(toks):
        if pairs.get(k, k) < k:
            stack.pop()
            continue
        kind = "list" if k in pairs else "open" if t in OPENS else "error" if t in back else "other"
        out.append([at, kind, stack[-1] if stack else None])
        if k in pairs:
            stack.append(at)
    for i, (_, kind, parent) in enumerate(out):
        later = [x for x in out[i + 1 :] if x[2] == parent]
        first = next(x for x in out if x[2] == parent)
        if parent is not None and kind == "other" and text[out[i][0]] in ",;" and not later and first is not out[i]:
            out[i][1] = "can_ignore"
    return [tuple(x) for x in out]


def test_trees_of_random_brackets(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("[]{}()ab,; ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["[" * 200 + "]" * 200, "", "((((", "))))"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(9999, None, "x")]
    nodes = parse.tree(spark.createDataFrame(rows, "file int, text string, level string"), parse.GRAMMARS["c"], ["file"]).collect()
    got = {}
    for r in nodes:
        got.setdefault(r.file, {})[r.id] = r
    for i, t in enumerate(texts):
        # letters that touch are one word for the grammar
        t2 = re.sub("[a-z]+", lambda m: m[0][0] + " " * (len(m[0]) - 1), t)
        own = got.get(i, {})
        assert [(own[k].start, own[k].kind, own[own[k].parent_id].start if own[k].parent_id is not None else None) for k in sorted(own)] == by_stack(t2), t
        for r in own.values():
            below = {x.id for x in own.values() if above(own, x, r)}
            assert r.last == max(below | {r.id}) and r.level == sum(above(own, r, x) for x in own.values()) and r.pre == r.id
    assert 9999 not in got


def above(nodes, x, a):
    while x.parent_id is not None:
        x = nodes[x.parent_id]
        if x is a:
            return True
    return False


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("c", 'if (x) { f("a)b", \'}\'); } // end }', ["keyword", "list", "other", "list", "other", "list", "string", "other", "string", "can_ignore", "comment"]),
        ("shell", "f() { echo '(' # )\n}", ["other", "list", "list", "other", "string", "comment"]),
        ("lisp", '(define (f x) "a(" ; (\n x)', ["list", "keyword", "list", "other", "other", "string", "comment", "other"]),
        ("sql", "SELECT 'it''s (' FROM (t) -- (", ["keyword", "string", "keyword", "list", "other", "comment"]),
        ("json", '{"a\\"}": [1, true,]}', ["list", "string", "other", "list", "other", "other", "keyword", "can_ignore"]),
        ("html", "<p a='>'>x<br/><script>if (a<b) '</p>'</script><!-- <b> --></P></i>", ["list", "string", "other", "string", "comment", "error"]),
    ],
)
def test_grammars(spark, language, text, want):
    got = parse.tree(spark.createDataFrame([(1, text)], "file int, text string"), parse.GRAMMARS[language], ["file"]).orderBy("pre").collect()
    # a semicolon is the last of its list only if nothing follows
    kinds = [r.kind for r in got]
    assert kinds == want, [(r.kind, r.open or r.content) for r in got]


def test_tokens_tile_the_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("<>/pb'\"!- é\nscript ") for _ in range(60)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    for g in parse.GRAMMARS.values():
        got = {}
        for r in parse.tokens(df, g, ["file"]).orderBy("file", "seq").collect():
            at = got.setdefault(r.file, [])
            assert texts[r.file][r.start : r.end] == r.token and r.start == sum(map(len, at))
            at.append(r.token)
        assert all("".join(got.get(i, [])) == t for i, t in enumerate(texts))


def random_tree(rng, file, n):
    rows, open_ = [], []
    for i in range(n):
        while open_ and rng.random() < 0.4:
            open_.pop()
        rows.append([file, i, open_[-1] if open_ else None, i, len(open_), rng.choice("abc"), "list", "x" * rng.randrange(3), None])
        open_.append(i)
    last = list(range(n))
    for i in reversed(range(n)):
        if rows[i][2] is not None:
            last[rows[i][2]] = max(last[rows[i][2]], last[i])
    return [(*r[:4], last[i], *r[4:]) for i, r in enumerate(rows)]


SCHEMA = "file int, id long, parent_id long, pre long, last long, level long, name string, kind string, open string, content string"


def search(rows, twig):
    """The matches by definition: (file, root, capture, id)."""
    files = {}
    for r in rows:
        files.setdefault(r[0], []).append(r)
    out = set()
    for file, nodes in files.items():
        under = lambda a, deep: [x for x in nodes if (a[3] < x[3] <= a[4] if deep else x[2] == a[1])]  # noqa: E731, B023

        def ok(x, t):
            return (not t.name or x[6] == t.name) and (not t.pattern or re.search(t.pattern, x[8])) and all(any(ok(y, b) for y in under(x, b.deep)) != b.absent for b in t.below)  # noqa: B023

        def down(t, held, deep_from):
            if t.capture:
                out.update((file, root, t.capture, i) for i, root in held.items())  # noqa: B023
            for b in t.below:
                if b.absent:
                    continue
                nxt = {}
                for x in nodes:  # noqa: B023
                    if ok(x, b):
                        up = [a for a in nodes if a[1] in held and x in under(a, b.deep)]  # noqa: B023
                        if up:
                            nxt[x[1]] = held[max(up, key=lambda a: a[3])[1]]
                down(b, nxt, b.deep)

        down(twig, {x[1]: x[1] for x in nodes if ok(x, twig)}, False)
    return out


@pytest.mark.parametrize(
    "twig",
    [
        Twig("a", capture="all"),
        Twig("a", (Twig("b", capture="y"),), capture="x"),
        Twig("a", (Twig("b", (Twig("c", capture="z", deep=True),), deep=True, capture="y"), Twig("a", absent=True)), capture="x"),
        Twig(pattern="xx", below=(Twig("b", deep=True, absent=True), Twig(below=(Twig("c", capture="c"),), deep=True)), capture="r"),
        Twig("a", (Twig("a", (Twig("a", capture="in", deep=True),), deep=True),)),
    ],
)
def test_twigs_against_a_search(spark, twig):
    rng = random.Random(7)
    rows = [r for f in range(40) for r in random_tree(rng, f, rng.randrange(1, 25))]
    got = {tuple(r) for r in matches(spark.createDataFrame(rows, SCHEMA), ["file"], twig).collect()}
    assert got == search(rows, twig) and got


def test_axes_on_random_trees(spark):
    rng = random.Random(1)
    rows = [r for f in range(20) for r in random_tree(rng, f, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    b = F.col("name") == "b"
    out = parse.with_nearest(parse.with_parent(parse.with_descendants(parse.with_children(df, ["file"], {"kids": b}), ["file"], {"all": b}), ["file"], F.col("name"), "of"), ["file"], b, F.col("id"), "near")
    by = {(r[0], r[1]): r for r in rows}
    for r in out.collect():
        below = [x for x in rows if x[0] == r.file and r.pre < x[3] <= r.last]
        up = [x for x in rows if x[0] == r.file and x[3] < r.pre <= x[4] and x[6] == "b"]
        assert r["all"] == sum(x[6] == "b" for x in below) and r.kids == sum(x[6] == "b" and x[2] == r.id for x in below)
        assert r.of == (by[r.file, r.parent_id][6] if r.parent_id is not None else None) and r.near == (max(up, key=lambda x: x[3])[1] if up else None)


def test_what_is_absent_has_no_capture(spark):
    with pytest.raises(ValueError):
        matches(spark.createDataFrame([], SCHEMA), ["file"], Twig("a", (Twig("b", absent=True, capture="x"),)))


def test_trees_of_whole_texts_need_no_shuffle(spark):
    """Texts by the thousand and one of a long token in one batch: each is parsed where it stands."""
    rows = [(i, f'[{i}, {{"a": [{i},]}}]') for i in range(20_000)] + [(20_000, '["' + "é" * 300_000 + '"]'), (20_001, None)]
    nodes = parse.tree(spark.createDataFrame(rows, "file int, text string").coalesce(1), parse.GRAMMARS["json"], ["file"])
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert nodes.count() == 20_000 * 9 + 2
    assert [(r.kind, r.start, r.end, r.parent_id) for r in nodes.filter("file = 20000").orderBy("id").collect()] == [("list", 0, 300_004, None), ("string", 1, 300_003, 0)]
