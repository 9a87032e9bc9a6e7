"""Rules about paths, names and texts, over all documents: each document takes one of the cases by its id, in a folder of its own and with its own text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gemello.functions import classify as c
from gemello.functions import languages as g
from gemello.functions import strings as x
from gemello.queries import text as t
from gemello.queries.carriers import documents
from gemello.registry import query


def lit(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def _carried(name: str, cases: list[tuple[tuple[str, ...], object]], f) -> None:
    """A query of f over the columns that a document's case has, whose SQL gives the case's value."""
    n = len(cases)
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, (_, v) in enumerate(cases))

    @query(name, f"SELECT doc_id, CASE doc_id % {n} {whens} END AS value FROM documents")
    def run(spark, d):
        at = lambda j: F.get(F.array(*[F.lit(parts[j]) for parts, _ in cases]), (F.col("doc_id") % n).cast("int"))
        return documents(spark, d).select("doc_id", f(*[at(j) for j in range(len(cases[0][0]))]).alias("value"))


def folder(path: Column) -> Column:
    """The path below a folder of the document; a leading slash says that it has to stay at the top."""
    own = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"), path)
    return F.when(F.startswith(path, F.lit("/")), F.substring(path, 2, 1 << 20)).otherwise(own)


def with_text(head: Column) -> Column:
    """A text that goes on with the document's."""
    return F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))


#: Paths whose rules look at the top of a tree.
TOP = ("tests/api.rs", "docs/intro.md")


def _of(column: int) -> list[tuple[tuple[str, str], object]]:
    return [(("/" + p[0] if p[0] in TOP else p[0], p[1]), p[column]) for p in t.PATHS]


_carried("l1_guess_language_documents", _of(2), lambda p, s: g.guess(folder(p), with_text(s)))
_carried("l8_is_test_documents", _of(4), lambda p, s: c.is_test(folder(p)))
_carried("l9_test_kind_path_documents", _of(5), lambda p, s: F.when(c.is_test(folder(p)), c.test_kind_by_path(folder(p))))
_carried("l11_generated_path_documents", _of(3), lambda p, s: c.generated_by_path(folder(p)))
_carried("l14_documentation_documents", _of(6), lambda p, s: c.is_documentation(folder(p)))
_carried("x9_extname_documents", _of(7), lambda p, s: x.extname(folder(p)))
_carried("l6_overrides_documents", [(case, None if case[0].endswith(".rs") else "C" if case[0].endswith(".h") else v) for case, v in _of(2)], lambda p, s: g.guess(folder(p), with_text(s), t.OVERRIDES))
_carried("l2_mode_line_documents", [((s,), v) for s, v in t.MODES], lambda s: g.by_mode(with_text(s)))
_carried("l3_shebang_documents", [((s,), v) for s, v in t.SHEBANGS], lambda s: g.by_shebang(with_text(s)))
#: Names that are patterns get the document's id before them, the others are whole names.
_carried(
    "l4_name_globs_documents",
    [((n, "" if n in ("yarn.lock", "Makefile", "PKGBUILD") else "id"), v) for n, v in t.GLOB_NAMES],
    lambda n, own: g.by_name(F.when(own == "id", F.concat(F.col("doc_id").cast("string"), n)).otherwise(n)),
)
_carried("l10_test_kind_content_documents", [((s,), v) for s, v in t.KINDS], lambda s: c.test_kind_by_content(with_text(s)))
_carried("l12_generated_content_documents", [((p, s), v) for p, s, v in t.GENERATED], lambda p, s: c.generated_by_content(folder(p), s))
_carried("l13_needs_content_documents", [((p,), v) for p, v in t.NEEDS], lambda p: c.needs_content(folder(p)))
_carried("l15_attribute_flag_documents", [((a,), v) for a, v in t.FLAGS], c.attribute_flag)
_carried("l17_outer_sliders_documents", [(("JSON",), True), (("Rust",), False), (("Scheme",), True), (("SQL",), True)], g.prefers_outer)
_carried("l18_atom_kind_documents", [((s,), v) for s, v in t.CAPTURES], lambda s: g.atom_kind(F.concat_ws(".", s, "source")))
