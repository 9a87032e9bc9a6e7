"""Alignment, rows and tree matching: what must hold for any two texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from gemello.operators import alignment as a
from gemello.operators import syntax, treematch
from gemello.plans.compare import Options, diff_text

ITEMS = st.lists(st.sampled_from("abcd"), max_size=14)
TEXT = st.lists(st.sampled_from(["a\n", "b c\n", "\n", "x", "d, e é\n", "b c"]), max_size=9).map("".join)
S = st.recursive(st.sampled_from(["a", "bb", '"s"', '"st"', "1"]), lambda x: st.lists(x, max_size=4).map(lambda c: "(" + " ".join(c) + ")"), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(x=ITEMS, y=ITEMS)
def test_slices_rebuild_both_sides(x, y):
    s = a.slices(x, y)
    assert [i for _, i, _ in s if i is not None] == list(range(len(x))) and [j for _, _, j in s if j is not None] == list(range(len(y)))
    assert all(x[i] == y[j] for k, i, j in s if k == a.BOTH)


def test_slices_of_equal_and_of_different():
    assert a.slices(list("ab"), list("ab")) == [("both", 0, 0), ("both", 1, 1)]
    assert a.slices(list("ab"), list("cd")) == [("left", 0, None), ("left", 1, None), ("right", None, 0), ("right", None, 1)]


def test_frequent_items_still_match():
    x, y = ["x"] * 100 + ["a"] + ["x"] * 100, ["x"] * 90 + ["b"] + ["x"] * 120
    assert sum(k == "both" for k, *_ in a.slices(x, y)) >= 180


@settings(max_examples=300, deadline=None)
@given(x=TEXT, y=TEXT)
def test_rows_hold_every_line_once(x, y):
    rows = a.rows(x, y)
    assert [i for i, _ in rows if i is not None] == list(range(len(a.keep_lines(x))))
    assert [j for _, j in rows if j is not None] == list(range(len(a.keep_lines(y))))


@settings(max_examples=200, deadline=None)
@given(x=TEXT, y=TEXT)
def test_positions_lie_in_their_lines(x, y):
    for text, own in zip((x, y), a.line_positions(x, y), strict=True):
        lines = text.split("\n")
        for line, start, end, kind, _ in own:
            assert 0 <= start <= end <= len(lines[line].encode()) and (start < end or kind != "unchanged_part" or end == start)


def test_words_and_lines():
    assert a.words("foo_1 bar-é\n👍") == ["foo_1", " ", "bar", "-", "é", "\n", "👍"]
    assert a.keep_lines("") == [] and a.keep_lines("a\n") == ["a\n"] and a.keep_lines("a\n\nb") == ["a\n", "\n", "b"]


def test_a_changed_word_alone_is_novel():
    left, right = a.line_positions("one two three\n", "one 2 three\n")
    assert [p[:3] for p in left if p[3] == "novel_word"] == [(0, 4, 7)] and [p[:3] for p in right if p[3] == "novel_word"] == [(0, 4, 5)]


def test_long_hunks_are_novel_as_lines():
    x = " ".join(f"a{k}" for k in range(900)) + "\n"
    left, _ = a.line_positions(x, "other\n")
    assert [p for p in left if p[3] == "novel_word"] == [(0, 0, len(x) - 1, "novel_word", None)]


def test_missing_final_line_feed_is_a_change():
    left, right = a.line_positions("a\nb", "a\nb\n")
    assert [p[3] for p in left if p[0] == 0] == ["unchanged"] and {p[3] for p in left if p[0] == 1} == {"unchanged_part"}


@settings(max_examples=150, deadline=None)
@given(x=st.lists(S, max_size=3).map(" ".join), y=st.lists(S, max_size=3).map(" ".join))
def test_every_node_gets_a_change_that_both_sides_agree_on(x, y):
    l, r, changes = treematch.structural(x, y, "Scheme")
    left, right = {n.id: n for n in syntax.number(l)}, {n.id: n for n in syntax.number(r)}
    assert {k for s, k in changes.of if s == "lhs"} == set(left) and {k for s, k in changes.of if s == "rhs"} == set(right)
    for (side, node), (kind, other) in changes.of.items():
        if kind != "novel":
            assert changes.of["rhs" if side == "lhs" else "lhs", other] == (kind, node)
            p, q = (left[node], right[other]) if side == "lhs" else (right[node], left[other])
            assert kind != "unchanged" or (p.open, p.close, p.content) == (q.open, q.close, q.content)
    if x == y:
        assert all(k == "unchanged" for k, _ in changes.of.values())


def novel(x, y, language):
    l, r, changes = treematch.structural(x, y, language)
    out = []
    for text, tree, other, side in ((x, l, r, "lhs"), (y, r, l, "rhs")):
        own = treematch.tree_positions(tree, side, changes, {n.id: n for n in syntax.number(other)})
        out.append([text.split("\n")[p[0]].encode()[p[1] : p[2]].decode() for p in own if p[3] in a.NOVEL])
    return out


def test_structural_changes():
    assert novel('{"a": 1}', '{"a": 2}', "JSON") == [["1"], ["2"]]
    assert novel("f(x); g();", "if (y) { f(x); } g();", "Rust") == [[], ["if", "(", "y", ")", "{", "}"]]
    assert novel("(f x)", "(g (f x))", "Scheme") == [[], ["g", "(", ")"]]  # one list each: their delimiters are paired first
    assert novel("# a comment here\nx", "# a comment there\nx", "Python") == [["# a comment here"], ["# a comment there"]]


def test_wrapping_changes_only_the_wrapper():
    assert novel("a(b, c)", "a((b, c))", "C")[0] == []


def test_fallbacks():
    opt = Options(graph_limit=0)
    assert diff_text('{"a": 1}', '{"b": 2}', "JSON", "structural", opt)[0] == "too_complex"
    assert diff_text("{", "{}", "JSON", "structural", Options())[0] == "parse_error"
    assert diff_text("a", "a", "JSON", "structural", Options()) == ("structural", 0, 0, [("unchanged", 0, 0)])
    assert diff_text("(" * 500, "", "Scheme", "structural", Options())[0] == "parse_error"


def test_ignored_comments_are_no_changes():
    rows = diff_text("x # one\n", "x # two\n", "Python", "structural", Options(ignore_comments=True))[3]
    assert rows == [("unchanged", 0, 0)]


def test_a_long_line_of_html_takes_time_in_proportion():
    import time

    from gemello.operators import syntax

    text = "<p>" + "é wörd " * 60_000 + "</p>"
    began = time.process_time()
    root = syntax.parse(text, "HTML")
    assert time.process_time() - began < 10  # a column counted from the line's start: some 60 s
    leaf = root.children[0].children[-1]
    assert leaf.content == "wörd" and leaf.spans == [(0, len(text[: -len(" </p>") - 4].encode()), len(text[: -len(" </p>")].encode()))]


def test_only_lists_with_novel_nodes_beside_others_are_looked_at():
    from gemello.operators import sliders, syntax, treematch

    a, b, changes = treematch.structural("<ul><li>x</li></ul><p>one two</p>", "<ul><li>x</li></ul><p>one more two</p><b>n w</b>", "HTML")
    lists = sliders._Side("rhs", b, syntax.preorder(a), changes).lists()
    assert [[n.content or n.open for n in own] for own in lists] == [["one", "more", "two"], ["<ul>", "<p>", "<b>"]]


def test_pages_in_one_file_are_compared_by_many_tasks(spark, tmp_path):
    from gemello import registry

    spark.createDataFrame([(k, f"<h1>{k}</h1>") for k in range(64)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("m9_tree_diff_html", "m20_matching_siblings"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and got.count() >= 64
