"""Text functions, languages and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.functions import classify as c
from gemello.functions import languages as g
from gemello.functions import strings as x
from gemello.queries.carriers import LINES, documents, lines, sql_values, values
from gemello.queries.diffs import turn_pairs
from gemello.registry import query


def _docs(name, sql, f):
    """A query of one expression over documents: doc_id and value."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, d: documents(spark, d).select("doc_id", f(F.col("text")).alias("value")))


_docs("x1_split_newlines", "array_to_string(list_transform(string_split(replace(text, chr(10), chr(13) || chr(10)), chr(10)), lambda p: regexp_replace(p, '\\r$', '')), '|')",
      lambda t: F.array_join(x.split_on_newlines(F.regexp_replace(t, "\n", "\r\n")), "|"))
_docs("x2_split_keep", "len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'))", lambda t: F.size(x.split_lines_keep(t)).cast("long"))
_docs("x3_split_terminator", "len(string_split(text || chr(10), chr(10))) - 1", lambda t: F.size(x.split_terminator(F.concat(t, F.lit("\n")))).cast("long"))
_docs("x4_split_words", "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]'))", lambda t: F.size(x.split_words(t)).cast("long"))
_docs("x5_split_words_numbers", "len(regexp_extract_all(text, '[0-9]+|[\\p{L}_]+|[^\\p{L}\\p{N}_]'))", lambda t: F.size(x.split_words_and_numbers(t)).cast("long"))
_docs("x7_comment_form", "CASE WHEN contains(text, chr(10)) THEN array_to_string(list_transform(string_split(replace(text, chr(10), chr(10) || '  '), chr(10)), lambda p: regexp_replace(p, '^\\s+', '')), chr(10)) ELSE text END",
      lambda t: x.comment_form(F.regexp_replace(t, "\n", "\n  ")))
_docs("x8_line_bytes", "octet_length(encode(text))", lambda t: x.line_bytes(F.concat(t, F.lit("\n"))).cast("long"))
_docs("x10_capitalized", "upper(left(lower(text), 1)) || substr(lower(text), 2)", lambda t: x.capitalized(x.simple_lower(t)))
_docs("x11_numbered", "array_to_string(list_transform(string_split(text, chr(10)), lambda p, i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || p), chr(10))", x.numbered)
_docs("x13_separators_whole", "replace(text, chr(10), '\\u2028\\u0085\\u2029') || '\\u2029'",
      lambda t: __import__("gemello.sinks", fromlist=["x"]).escape_separators(F.concat(F.replace(t, F.lit("\n"), F.lit("\u2028\u0085\u2029")), F.lit("\u2029"))))
_docs("x14_human_size", "CASE WHEN length(text) < 1024 THEN length(text) || ' B' ELSE CAST(round(length(text) * 10 / 1024) AS BIGINT) // 10 || '.' || CAST(round(length(text) * 10 / 1024) AS BIGINT) % 10 || ' KiB' END",
      lambda t: x.human_size(F.length(t)))
_docs("x18_terminal_safe_whole", "replace(text, chr(10), '[0m' || chr(9) || chr(10)) || '[0m'",
      lambda t: x.without_controls(F.concat(F.replace(t, F.lit("\n"), F.lit("\x1b[0m\x07\t\u009b\n")), F.lit("\x1b[0m\x7f"))))
_docs("x19_short_revision", "left(sha1(encode(text)), 7)", lambda t: x.short_revision(F.sha1(F.encode(t, "UTF-8"))))
_docs("x20_head_label", "string_split(text, chr(10))[1] || ' … ' || len(string_split(text, chr(10))) || ' lines'", lambda t: x.head_label(t, F.size(F.split(t, "\n"))))
_docs("f2_normal_path", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'a/c/' || lang END", lambda t: x.normal_path(F.when(F.col("doc_id") % 3 == 0, F.lit("../x")).otherwise(F.concat(F.lit("./a/b/../c//"), F.col("lang")))))
_docs("f9_empty_ends", "CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END",
      lambda t: F.size(x.drop_empty_ends(F.array(*[F.struct(F.lit(a).alias("start"), e.alias("end")) for a, e in ((0, F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)), (5, F.lit(5)), (6, F.lit(9)), (9, F.lit(9)))]))).cast("int"))
_docs("f11_atom_text", "text", lambda t: x.atom_text(F.concat(t, F.lit("\n\r"))))
_docs("f19_punctuation", "right(text, 1) IN (',', ';', '.')", lambda t: x.is_punctuation(F.right(t, F.lit(1))))
_docs("f21_worth_keeping", "3 * length(regexp_replace(left(text, 900), '\\s', '', 'g')) <= 2 * length(regexp_replace(text, '\\s', '', 'g'))", lambda t: x.worth_keeping(F.left(t, F.lit(900)), t))
_docs("f22_is_tag", "regexp_full_match(lower(left(text, 4)), '[a-z0-9][a-z0-9_-]*')", lambda t: x.is_tag(F.lower(F.left(t, F.lit(4)))))
_docs("f23_all_whitespace", "doc_id % 4 = 0", lambda t: x.all_whitespace(F.when(F.col("doc_id") % 4 == 0, " \t　\n").otherwise(t)))
_docs("a14_block_bar", "CASE WHEN doc_id % 5 = 0 THEN '5+0' WHEN doc_id % 5 = 1 THEN '1+4' WHEN doc_id % 5 = 2 THEN '2+2' WHEN doc_id % 5 = 3 THEN '0+0' ELSE '3+1' END",
      lambda t: (lambda k: F.concat_ws("+", *[v.cast("string") for v in x.block_bar(F.element_at(F.array(*map(F.lit, (7, 1, 2, 0, 7))), k), F.element_at(F.array(*map(F.lit, (0, 99, 2, 0, 3))), k))]))((F.col("doc_id") % 5 + 1).cast("int")))


@query("x6_similarity_turns")
def similarity_turns(spark, d):
    """Whole texts of consecutive turns. No SQL: DuckDB's edit distance counts bytes, which differ from characters beyond ASCII."""
    return turn_pairs(spark, d).select("file_key", x.similarity_percent(F.col("lhs"), F.col("rhs")).alias("value"))


@query("f11_line_anchor_lengths", f"WITH {LINES} SELECT doc_id, line, octet_length(encode(text)) AS bytes FROM lines")
def line_lengths(spark, d):
    return lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), x.line_bytes(F.col("text")).cast("long").alias("bytes"))


#: (path, text, language, generated by path, test, kind by path, documentation, extension)
PATHS = [
    ("src/main.rs", "fn main() {}", "Rust", False, False, None, False, ".rs"),
    ("tests/api.rs", "#[test]", "Rust", False, True, "integration", False, ".rs"),
    ("src/tests/api.rs", "", "Rust", False, True, None, False, ".rs"),
    ("web/e2e/login.spec.ts", "", "TypeScript", False, True, "e2e", False, ".ts"),
    ("app/foo.integration.test.js", "", "JavaScript", False, True, "integration", False, ".js"),
    ("pkg/a_test.go", "", "Go", False, True, None, False, ".go"),
    ("Cargo.lock", "", "TOML", True, False, None, False, ".lock"),
    ("node_modules/x/y.js", "", "JavaScript", True, False, None, False, ".js"),
    ("a/.idea/x.xml", "", "XML", True, False, None, False, ".xml"),
    ("docs/intro.md", "", None, False, False, None, True, ".md"),
    ("README.md", "", None, False, False, None, True, ".md"),
    ("bin/run", "#!/usr/bin/env python3\nprint()", "Python", False, False, None, False, ""),
    ("bin/tool", "#! /bin/bash", "Bash", False, False, None, False, ""),
    ("x.unknown", "; -*- mode: emacs-lisp -*-", "Emacs Lisp", False, False, None, False, ".unknown"),
    ("y.txt", "// -*- C++ -*-", "C++", False, False, None, False, ".txt"),
    ("z.php", "<?hh", None, False, False, None, False, ".php"),
    ("z2.php", "<?php", "PHP", False, False, None, False, ".php"),
    ("view.h", "#import <x.h>", "Objective-C", False, False, None, False, ".h"),
    ("view2.h", "#include <x.h>", "C++", False, False, None, False, ".h"),
    ("feed", "<?xml version='1'?>", "XML", False, False, None, False, ""),
    ("Makefile.in", "", "Make", False, False, None, False, ".in"),
    ("Dockerfile.dev", "", "Dockerfile", False, False, None, False, ".dev"),
    (".profile", "", "Bash", False, False, None, False, ""),
    ("a/Form1.Designer.cs", "", "C#", True, False, None, False, ".cs"),
    ("vendor/github.com/x/y.go", "", "Go", True, False, None, False, ".go"),
    ("conftest.py", "", "Python", False, True, None, False, ".py"),
    ("test_a.py", "", "Python", False, True, None, False, ".py"),
]
SCHEMA = "path string, text string, language string, generated boolean, test boolean, kind string, docs boolean, ext string"


def _paths(name, column, f):
    """A query of one expression over the path list, whose SQL is the expected column."""
    query(name, f"SELECT path, {column} AS value FROM ({sql_values(PATHS)}) t(path, text, language, generated, test, kind, docs, ext)")(
        lambda spark, d: values(spark, PATHS, SCHEMA).select("path", f(F.col("path"), F.col("text")).alias("value"))
    )


_paths("l1_guess_language", "language", lambda p, t: g.guess(p, t))
_paths("l8_is_test", "test", lambda p, t: c.is_test(p))
_paths("l9_test_kind_path", "kind", lambda p, t: F.when(c.is_test(p), c.test_kind_by_path(p)))
_paths("l11_generated_path", "generated", lambda p, t: c.generated_by_path(p))
_paths("l14_documentation", "docs", lambda p, t: c.is_documentation(p))
_paths("x9_extname", "ext", lambda p, t: x.extname(p))

OVERRIDES = [("*.rs", "text"), ("*.h", "C")]
_paths("l6_overrides", "CASE WHEN path LIKE '%.rs' THEN NULL WHEN path LIKE '%.h' THEN 'C' ELSE language END", lambda p, t: g.guess(p, t, OVERRIDES))

MODES = [("; -*- mode: ruby; tab-width: 2 -*-", "Ruby"), ("#!x\n# -*- sh -*-", "Bash"), ("x\ny\n# -*- sh -*-", None), ("-*- nothing -*-", None), ("/* -*- Mode: C -*- */", None), ("/* -*- C -*- */", "C")]


@query("l2_mode_line", f"SELECT * FROM ({sql_values(MODES)}) t(text, value)")
def l2(spark, d):
    return values(spark, MODES, "text string, value string").select("text", g.by_mode(F.col("text")).alias("value"))


SHEBANGS = [("#!/bin/sh", "Bash"), ("#!/usr/bin/env node\nx", "JavaScript"), ("#! /usr/local/bin/Rscript --x", "R"), ("# no", None), ("#!/usr/bin/what", None), ("#!/usr/bin/env deno run", "TypeScript")]


@query("l3_shebang", f"SELECT * FROM ({sql_values(SHEBANGS)}) t(text, value)")
def l3(spark, d):
    return values(spark, SHEBANGS, "text string, value string").select("text", g.by_shebang(F.col("text")).alias("value"))


GLOB_NAMES = [("a.tsx", "TypeScript TSX"), ("yarn.lock", "YAML"), ("b.tar.gz", None), ("x.cmake.in", "CMake"), ("Makefile", "Make"), ("q.sql", "SQL"), ("PKGBUILD", "Bash"), ("A.S", "Assembly")]


@query("l4_name_globs", f"SELECT * FROM ({sql_values(GLOB_NAMES)}) t(name, value)")
def l4(spark, d):
    return values(spark, GLOB_NAMES, "name string, value string").select("name", g.by_name(F.col("name")).alias("value"))


@query("l5_objc_header", "SELECT doc_id, doc_id % 3 = 0 AS value FROM documents")
def l5(spark, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit("\n@interface X"))).when(k == 1, F.concat(F.repeat(F.lit("\n"), F.lit(100)), F.lit("#import x"))).otherwise("int x;")
    head = F.when(k == 0, F.concat(F.lit("@protocol\n"), text)).otherwise(text)
    return documents(spark, d).select("doc_id", g.looks_like_objc(F.lit("a/b.h"), head).alias("value"))


@query("l7_languages", f"SELECT * FROM ({sql_values([(k, name) for k, name in enumerate(g.GLOBS)])}) t(ord, language)")
def l7(spark, d):
    return values(spark, list(enumerate(g.GLOBS)), "ord int, language string")


KINDS = [("import { test } from '@playwright/test'", "e2e"), ("//go:build integration && linux\npackage x", "integration"), ("x\n  pytestmark = pytest.mark.e2e", "e2e"), ("# integration", None), ("//go:build linux", None)]


@query("l10_test_kind_content", f"SELECT * FROM ({sql_values(KINDS)}) t(text, value)")
def l10(spark, d):
    return values(spark, KINDS, "text string, value string").select("text", c.test_kind_by_content(F.col("text")).alias("value"))


LONG = "x" * 300
GENERATED = [
    ("a.js", LONG, True), ("a.JS", LONG, True), ("a.py", LONG, False), ("a.css", "b{}\n/*# sourceMappingURL=a.map", True), ("b.MAP", '{"version":3,"x":1}', True),
    ("c.js", "// Generated by CoffeeScript 1.0", True), ("d.go", "package x\n// Code generated by z. DO NOT EDIT.", True), ("d2.go", "// Code generated by z", False), ("e_pb2.py", "#\n# Generated by the protocol buffer compiler.  DO NOT EDIT!", True),
    ("f.h", "/* DO NOT EDIT THIS FILE - it is machine generated */\n#include <jni.h>\n", True), ("g.yml", "a: 1\nb: 2\nrecorded_with: VCR 2\n", True), ("h.html", "<html>\n<head><meta name=\"generator\" content=\"Org mode\"></head>", True),
    ("h2.html", "<html>\n<head><meta name=\"generator\" content=\"hand\"></head>", False), ("i.xml", "<?xml?>\n<doc>\n<assembly>\nx\n</doc>\n", True), ("j.rb", "#\n#\n# This file is automatically generated by Racc 1", True), ("k.ps", "%!PS\n%%Creator: inkscape", True),
    ("l.java", "// This file is generated by jOOQ.", True), ("m.dart", "// GENERATED CODE - DO NOT MODIFY BY HAND\nx", True), ("n.js", "(function() {\n  var _i, _len, _ref;\n}).call(this);\n", True), ("o.txt", "Generated by Haxe", False),
]


@query("l12_generated_content", f"SELECT path, value FROM ({sql_values(GENERATED)}) t(path, text, value)")
def l12(spark, d):
    return values(spark, GENERATED, "path string, text string, value boolean").select("path", c.generated_by_content(F.col("path"), F.col("text")).alias("value"))


NEEDS = [(p, p not in ("o.txt",)) for p, _, _ in GENERATED] + [("x.rs", False), ("y.ppport.h", True), ("z.md", False)]


@query("l13_needs_content", f"SELECT * FROM ({sql_values(NEEDS)}) t(path, value)")
def l13(spark, d):
    return values(spark, NEEDS, "path string, value boolean").select("path", c.needs_content(F.col("path")).alias("value"))


FLAGS = [("unspecified", None), (None, None), ("unset", False), ("false", False), ("set", True), ("x", True)]


@query("l15_attribute_flag", f"SELECT * FROM ({sql_values(FLAGS)}) t(attr, value)")
def l15(spark, d):
    return values(spark, FLAGS, "attr string, value boolean").select("attr", c.attribute_flag(F.col("attr")).alias("value"))


@query("l16_attribute_tags", "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE 'a1,' || lang END AS value FROM documents")
def l16(spark, d):
    tags = c.attribute_tags(F.when(F.col("lang") != "en", F.concat("lang", F.lit(", a1,"), "lang")))
    return documents(spark, d).select("doc_id", F.array_join(tags, ",").alias("value"))


@query("l17_outer_sliders", "SELECT * FROM (VALUES ('JSON', TRUE), ('Rust', FALSE), ('Scheme', TRUE), ('SQL', TRUE)) t(language, value)")
def l17(spark, d):
    return values(spark, [("JSON",), ("Rust",), ("Scheme",), ("SQL",)], "language string").select("language", g.prefers_outer(F.col("language")).alias("value"))


CAPTURES = [("comment.line", "comment"), ("string.special", "string"), ("keyword.return", "keyword"), ("type.builtin", "type"), ("variable", "normal")]


@query("l18_atom_kind", f"SELECT * FROM ({sql_values(CAPTURES)}) t(capture, value)")
def l18(spark, d):
    return values(spark, CAPTURES, "capture string, value string").select("capture", g.atom_kind(F.col("capture")).alias("value"))


@query(
    "p2_classify",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'generated,vendored' WHEN doc_id % 4 = 1 THEN 'integration,test' WHEN doc_id % 4 = 2 THEN 'docs' ELSE '' END AS tags FROM documents",
)
def p2(spark, d):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, "node_modules/a.py").when(k == 1, "x/tests/integration/b.py").when(k == 2, "docs/a.md").otherwise("src/c.py")
    return documents(spark, d).select("doc_id", F.array_join(c.tags_of(path, F.col("text")), ",").alias("tags"))


@query("u5_attribute_overrides", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docs,generated' WHEN doc_id % 3 = 1 THEN 'generated' ELSE 'docs,generated,vendored' END AS tags FROM documents")
def u5(spark, d):
    k = F.col("doc_id") % 3
    base = F.array(F.lit("docs"), F.lit("generated"))
    flags = {"docs": F.when(k == 1, False), "vendored": F.when(k == 2, True)}
    return documents(spark, d).select("doc_id", F.array_join(c.resolve_flags(base, flags), ",").alias("tags"))


@query("a11_tag_union", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS tags FROM documents GROUP BY source")
def a11(spark, d):
    return documents(spark, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("tags"))


@query(
    "f14_hidden_reason",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Deleted file · hidden by default' WHEN doc_id % 4 = 1 THEN 'Vendored file · hidden by default' WHEN doc_id % 4 = 2 THEN 'Generated file · hidden by default' END AS reason FROM documents",
)
def f14(spark, d):
    k = F.col("doc_id") % 4
    tags = F.when(k == 2, F.array(F.lit("generated"), F.lit("vendored"))).when(k == 1, F.array(F.lit("vendored"))).otherwise(F.array(F.lit("docs")))
    return documents(spark, d).select("doc_id", c.hidden_reason(F.when(k == 0, "deleted").otherwise("added"), tags, ["generated", "vendored"], True).alias("reason"))


RENAMES = [("a/b/c.txt", "a/b/d.txt", "a/b/{c.txt => d.txt}"), ("x.txt", "y/x.txt", "x.txt => y/x.txt"), ("a/x/c", "a/y/c", "a/{x/c => y/c}")]


@query("x12_rename_display", f"SELECT * FROM ({sql_values(RENAMES)}) t(old, new, value)")
def x12(spark, d):
    return values(spark, RENAMES, "old string, new string, value string").select("old", "new", x.rename_display(F.col("old"), F.col("new")).alias("value"))


@query("x15_fuzzy", f"SELECT * FROM ({sql_values([('ctx menu', 8), ('text', None), ('c-tx', 7), ('acctx', 5)])}) t(text, value)")
def x15(spark, d):
    return values(spark, [("ctx menu",), ("text",), ("c-tx",), ("acctx",)], "text string").select("text", x.fuzzy_score("ctx", F.col("text")).alias("value"))


@query("o6_fuzzy_top", "SELECT * FROM (VALUES ('ctx menu', 'a', 8, 8), ('c-tx', 'b', 7, 7), ('acctx', 'a', 5, 8)) t(text, grp, score, best)")
def o6(spark, d):
    from gemello.operators.intervals import ranked_groups

    rows = values(spark, [("ctx menu", "a"), ("c-tx", "b"), ("acctx", "a"), ("none", "b")], "text string, grp string")
    return ranked_groups(rows.withColumn("score", x.fuzzy_score("ctx", F.col("text"))).filter("score is not null"))


@query("e8_scope_lookup", "SELECT * FROM (VALUES ('keyword.control.if', 'keyword.control'), ('string.x', 'string'), ('none', NULL)) t(capture, scope)")
def e8(spark, d):
    from gemello.operators.intervals import longest_scope

    return longest_scope(values(spark, [("keyword.control.if",), ("string.x",), ("none",)], "capture string"), values(spark, [("keyword",), ("keyword.control",), ("string",)], "scope string"))


@query("e14_adjacent_groups", "SELECT * FROM (VALUES (0, 'a', 2), (2, 'b', 1), (3, 'a', 1)) t(first_ord, language, n)")
def e14(spark, d):
    from gemello.operators.intervals import adjacent_groups

    return adjacent_groups(values(spark, [(0, "a"), (1, "a"), (2, "b"), (3, "a")], "ord int, language string"))
