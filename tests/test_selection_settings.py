"""Revision arguments, settings, dumps, languages inside others and the layout's grouped steps."""

import pytest

from gemello.functions import settings as s
from gemello.operators import dump, folds, syntax
from gemello.sources import revisions as r

REVISIONS = {"a", "b", "both", "a..b", "a...b", "..b", "a.."}
PATHS = {"x", "both", "dir/y"}


def chosen(*items, **options):
    return r.select(items, REVISIONS.__contains__, PATHS.__contains__, **options)


def test_revision_grammar():
    assert (chosen().before, chosen().after) == (r.INDEX, r.WORKING_TREE)
    assert (chosen(cached=True).before, chosen(cached=True).after) == ("HEAD", r.INDEX)
    assert chosen(cached=True, unborn=True).before == r.EMPTY
    assert (chosen("a").before, chosen("a").after) == ("a", r.WORKING_TREE)
    assert chosen("a", cached=True).after == r.INDEX
    for items in (("a", "b"), ("a..b",)):
        assert (chosen(*items).before, chosen(*items).after) == ("a", "b")
    assert chosen("..b").before == "HEAD" and chosen("a..").after == "HEAD"
    assert (chosen("a", "b", reverse=True).before, chosen("a", "b", reverse=True).after) == ("b", "a")


def test_merge_bases():
    base = lambda a, b: f"{a}^{b}"
    assert chosen("a...b").based(base) == r.Selection("a^b", "b")
    assert chosen("a", merge_base=True).based(base).before == "a^HEAD"
    assert chosen("a", "b", merge_base=True, reverse=True).based(base) == r.Selection("b", "a^b")
    assert chosen("a", "b").based(base) == r.Selection("a", "b")


def test_paths_after_revisions():
    assert chosen("a", "x", prefix="dir").paths == ("dir/x",)
    assert chosen("x", paths=["../z"], prefix="dir").paths == ("dir/x", "z")
    assert chosen("both", separated=True).before == "both"


@pytest.mark.parametrize(
    ("items", "options"),
    [(("both",), {}), (("x", "a"), {}), (("nothing",), {}), (("a", "b", "a"), {}), (("a", "b"), {"cached": True}), (("a..b",), {"cached": True}), ((), {"merge_base": True}), (("a..b",), {"merge_base": True})],
)
def test_arguments_that_mean_nothing(items, options):
    with pytest.raises(r.SelectionError):
        chosen(*items, **options)


SCHEMA = {
    "$defs": {"Size": {"type": "integer", "title": "Size", "x-group": "Limits", "default": 3}},
    "properties": {
        "limits": {"properties": {"size": {"$ref": "#/$defs/Size", "title": "Own size"}, "most": {"anyOf": [{"type": "number"}, {"type": "null"}], "title": "Most", "x-group": "Limits", "default": None}}},
        "file_only": {"type": "array", "x-settings": False},
        "theme": {"enum": ["dark", "light"], "title": "Theme", "x-group": "Looks", "description": "How it looks", "default": "dark"},
    },
}


def test_schema_rows():
    rows = s.flatten(SCHEMA, {"limits": {"size": 9}, "theme": "light"})
    assert [(x["key"], x["title"], x["type"], x["value"]) for x in rows] == [("limits.size", "Own size", "integer", 9), ("limits.most", "Most", "number", None), ("theme", "Theme", "enum", "light")]
    assert rows[0]["default"] == 3 and rows[2]["options"] == ["dark", "light"] and rows[2]["description"] == "How it looks"
    assert [x["value"] for x in s.flatten(SCHEMA)] == [None, None, None]


@pytest.mark.parametrize("bad", [{"type": "array"}, {"type": "string"}, {"$ref": "#/$defs/None"}, {"anyOf": [{"type": "string"}, {"type": "number"}]}])
def test_schema_errors(bad):
    with pytest.raises(s.SchemaError):
        s.flatten({"properties": {"x": bad}})


def test_defaults_follow_each_other():
    options = {"c": {"x-default-by": {"key": "b", "values": {"y": "z"}}}, "b": {"x-default-by": {"key": "a", "values": {"x": "y"}}}, "a": {"default": "x"}, "d": {"x-default-by": {"key": "d", "values": {}}}}
    assert s.with_defaults(options, {}) == {"a": "x", "b": "y", "c": "z"}
    assert s.with_defaults(options, {"b": "other"}) == {"a": "x", "b": "other"}
    assert s.with_defaults(options, {"a": 1, "c": None}) == {"a": 1, "c": None}


def test_pruned_documents():
    assert s.pruned({"a": 1, "b": {"c": 2, "d": 3}, "e": {"f": 4}}, {"a": 1, "b": {"c": 2, "d": 9}, "e": {"f": 4}}) == {"b": {"d": 3}}
    assert s.pruned({"a": True}, {"a": 1}) == {"a": True}


def test_dumps(spark):
    root = syntax.parse('(a "b")', "Scheme")
    assert dump.listing(root) == 'list "(" ")" 1:0\n  normal "a" 1:1\n  string "\\"b\\"" 1:3'
    assert dump.graph(root).split("\n")[1:3] == ['  id1[label="( )"];', '  id2[label="a"];'] and "  id1 -> id3;" in dump.graph(root)
    assert dump.graph(syntax.Node()) == "digraph {\n}"
    rows = {x.language: x for x in dump.languages(spark).collect()}
    assert rows["Ada"].globs == ["*.ada", "*.adb", "*.ads"] and rows["JSON"].structural and not rows["Ada"].structural


def atoms(root):
    return [(n.content, n.kind, n.spans[0]) for n in syntax.number(root) if not n.is_list]


def test_languages_inside_html():
    root = syntax.parse("<p>x</p>\n<script>f(1); // y</script>\n<style>a { b: c }</style>", "HTML")
    script, style = root.children[1], root.children[2]
    assert [(n.open, n.content) for n in script.children] == [("", "f"), ("(", None), ("", ";"), ("", "// y")]
    assert atoms(script)[3] == ("// y", "comment", (1, 14, 18)) and [n.open for n in style.children] == ["", "{"]
    broken = syntax.parse("<script>f(</script>", "HTML")
    assert [n.content for n in broken.children[0].children] == ["f", "("]
    assert [n.content for n in syntax.parse("<script>  </script>", "HTML").children[0].children] == []
    less = syntax.parse("<script>if (a < b && c) { d(); }</script>", "HTML")
    assert [n.open for n in less.children[0].children] == ["", "(", "{"]


def test_xml_knows_no_void_elements():
    root = syntax.parse("<link>x<b>y</b></link>", "XML")
    assert [n.content or n.open for n in root.children[0].children] == ["x", "<b>"]
    assert syntax.parse("<Link>x</Link>", "XML").children[0].open != syntax.parse("<link>x</link>", "XML").children[0].open


def test_empty_atoms_and_lone_children():
    x, empty = syntax.Node("x"), syntax.Node("")
    assert syntax.flattened(syntax.Node(children=[empty, x])) is x
    bracket = syntax.Node(open="(", close=")", children=[x])
    assert syntax.flattened(bracket) is bracket and syntax.without_empty([empty, bracket]) == [bracket]


def test_pairs_that_increase_take_the_first_of_a_line(spark):
    rows = [("f", 0, 0, 5), ("f", 1, 1, 4), ("f", 2, 1, 6), ("f", 3, 1, 9), ("f", 4, 2, 7), ("f", 5, 3, None), ("g", 0, 3, 0)]
    df = spark.createDataFrame(rows, "file string, seq long, lhs long, rhs long")
    assert sorted(map(tuple, folds.increasing_pairs(df, ["file"]).collect())) == [("f", 0, 5), ("f", 1, 6), ("f", 2, 7), ("g", 3, 0)]
    assert folds.increasing_pairs(df.limit(0), ["file"]).count() == 0


def test_crossing_folds(spark):
    rows = [("f", 1, 0, 10), ("f", 2, 1, 4), ("f", 3, 3, 8), ("f", 4, 5, 5), ("f", 5, 6, 12), ("g", 1, 2, 3)]
    df = spark.createDataFrame(rows, "file string, id long, start long, end long")
    assert sorted(map(tuple, folds.strict_nesting(df, ["file"]).collect())) == [("f", 1, 0, 6), ("f", 2, 1, 3), ("f", 3, 3, 6), ("f", 5, 6, 12), ("g", 1, 2, 3)]
    assert folds.strict_nesting(df.limit(0), ["file"]).count() == 0
