"""Text functions as column expressions: they stay in the JVM and take part in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_on_newlines(s: Column) -> Column:
    """Parts between line feeds, each without one trailing carriage return; "" gives one part, a trailing line feed an empty last one."""
    return F.transform(F.split(s, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))


def split_lines_keep(s: Column) -> Column:
    """Lines with their line feeds and no empty last one; "" gives none."""
    return F.regexp_extract_all(s, F.lit("[^\n]*\n|[^\n]+"), 0)


def split_terminator(s: Column) -> Column:
    """Parts between line feeds without one empty last part."""
    parts = F.split(s, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_words(s: Column) -> Column:
    """Runs of letters, numbers and underscores; every other character alone."""
    return F.regexp_extract_all(s, F.lit(r"(?s)[\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_]"), 0)


def split_words_and_numbers(s: Column) -> Column:
    """As split_words, and apart between ASCII digits and what isn't one."""
    return F.regexp_extract_all(s, F.lit(r"(?s)[0-9]+|[\p{IsAlphabetic}\p{N}_&&[^0-9]]+|[^\p{IsAlphabetic}\p{N}_]"), 0)


def similarity_percent(a: Column, b: Column) -> Column:
    """100 less the edit distance as a share of the longer text, rounded; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100).otherwise(F.round(100 * (1 - F.levenshtein(a, b) / longest))).cast("int")


def comment_form(s: Column) -> Column:
    """A comment for comparison: of more than one line, each without leading white space."""
    lines = split_on_newlines(s)
    return F.when(F.size(lines) > 1, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^(?U)\s+", "")), "\n")).otherwise(s)


def line_bytes(s: Column) -> Column:
    """Bytes of a line without its line feed."""
    return F.octet_length(F.regexp_replace(s, "\n$", ""))


def extname(path: Column) -> Column:
    """From the last dot of the base name; leading dots don't count."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]*)$", 1)


#: Characters whose upper case is one character by the simple mapping and several by the full one. All others of that kind have none but themselves.
_ONE = {"ß": "ẞ", **{chr(c): chr(c + 8) for r in (0x1F80, 0x1F90, 0x1FA0) for c in range(r, r + 8)}, **{c: chr(ord(c) + 9) for c in "ᾳῃῳ"}}


def simple_lower(s: Column) -> Column:
    """Lower case by characters: a sigma at a word's end is as any other, and a dotted capital I has no dot left over."""
    return F.lower(F.replace(F.replace(s, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def simple_upper(c: Column) -> Column:
    """The upper case of one character, itself one character (ẞ for ß, where the full mapping has SS)."""
    full = F.upper(c)
    return F.when(F.length(full) <= 1, full).otherwise(F.translate(c, "".join(_ONE), "".join(_ONE.values())))


def capitalized(s: Column) -> Column:
    """s with its first character in upper case, by the simple mapping."""
    return F.concat(simple_upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def numbered(s: Column) -> Column:
    """Lines with right-aligned numbers of five places."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit(" | "), x)), "\n")


def rename_display(old: Column, new: Column) -> Column:
    """The two paths with their common leading directories once: prefix/{old => new}."""
    a, b = F.split(old, "/"), F.split(new, "/")
    most = F.least(F.size(a), F.size(b)) - 1
    same = F.filter(F.sequence(F.lit(0), most), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k))
    n = F.array_max(same)
    rest = lambda x: F.array_join(F.slice(x, n + 1, F.size(x)), "/")
    return F.when(n == 0, F.concat(old, F.lit(" => "), new)).otherwise(F.concat(F.array_join(F.slice(a, 1, n), "/"), F.lit("/{"), rest(a), F.lit(" => "), rest(b), F.lit("}")))


def human_size(n: Column) -> Column:
    """Bytes in binary units with one decimal."""
    tenths = lambda d: F.concat(F.floor(F.round(n * 10 / d) / 10).cast("string"), F.lit("."), (F.round(n * 10 / d).cast("long") % 10).cast("string"))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(tenths(1024), F.lit(" KiB")))
        .when(n < 1024**3, F.concat(tenths(1024**2), F.lit(" MiB")))
        .otherwise(F.concat(tenths(1024**3), F.lit(" GiB")))
    )


def fuzzy_score(query: str, text: Column) -> Column:
    """Of a subsequence match from left to right: 3 for a character right after the last, 2 at the start of a word, else 1; null without one."""
    low = F.lower(text)
    at, score = F.lit(0), F.lit(0)
    for c in query.lower():
        p = F.call_function("locate", F.lit(c), low, at + 1)
        before = F.substr(low, p - 1, F.lit(1))
        gain = F.when((p == at + 1) & (at > 0), 3).when((p == 1) | before.rlike("^[^a-z0-9]$"), 2).otherwise(1)
        score = F.when(p > 0, score + gain)
        at = F.when(p > 0, p)
    return score


def without_controls(s: Column) -> Column:
    """Text safe for a terminal: no control characters but tabs and line feeds."""
    return F.regexp_replace(s, r"[\p{Cc}&&[^\t\n]]", "")


def short_revision(rev: Column) -> Column:
    """Seven digits of a full revision, anything else as it is."""
    return F.when(rev.rlike("^[0-9a-f]{40}$"), F.left(rev, F.lit(7))).otherwise(rev)


def head_label(text: Column, n: Column) -> Column:
    """First line and number of lines."""
    return F.concat(F.regexp_extract(text, "^([^\n]*)", 1), F.lit(" … "), n.cast("string"), F.lit(" lines"))


def is_tag(s: Column) -> Column:
    return s.rlike("^[a-z0-9][a-z0-9_-]*$")


def all_whitespace(s: Column) -> Column:
    return s.rlike(r"^(?U)\s*$")


def worth_keeping(pseudo: Column, body: Column) -> Column:
    """Whether a summary is at most two thirds of what it stands for, white space not counted."""
    size = lambda c: F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return 3 * size(pseudo) <= 2 * size(body)


def drop_empty_ends(spans: Column) -> Column:
    """Spans (start, end) without zero-width ones at the first and last place."""
    return F.filter(spans, lambda x, i: (x["start"] != x["end"]) | ((i != 0) & (i != F.size(spans) - 1)))


def atom_text(s: Column) -> Column:
    """An atom's content without one trailing carriage return, then without one line feed."""
    return F.regexp_replace(F.regexp_replace(s, "\r$", ""), "\n$", "")


def is_punctuation(s: Column) -> Column:
    return s.isin(",", ";", ".")


def block_bar(added: Column, removed: Column) -> tuple[Column, Column]:
    """Of five blocks, those of each side: whole shares, at least one for what isn't zero, the larger trimmed to fit."""
    total = F.greatest(added + removed, F.lit(1))
    share = lambda x: F.when(x > 0, F.greatest(F.floor(5 * x / total), F.lit(1))).otherwise(0)
    a, r = share(added), share(removed)
    over = F.greatest(a + r - 5, F.lit(0))
    return F.when(a >= r, a - over).otherwise(a), F.when(a >= r, r).otherwise(r - over)


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when(out.isNull(), out).when(p != "..", F.concat(out, F.array(p))).when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1)).otherwise(F.lit(None).cast("array<string>")),
    )
    return F.when(walked.isNotNull(), F.array_join(walked, "/"))
