"""Syntax trees of texts by small built-in providers: nested lists with delimiters, and atoms.

Providers cover families of languages by their lexical shape: comments, strings, brackets and words. A language without a provider
is compared by lines. More providers can be registered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

#: Depth that a tree may have; a deeper text counts as not parsed.
MAX_DEPTH = 400


class ParseError(ValueError):
    """A text that its provider can't parse; line is where, from 0."""

    def __init__(self, line: int, what: str):
        super().__init__(f"line {line + 1}: {what}")
        self.line = line


@dataclass(slots=True)
class Node:
    """A list (content is None) or an atom. Spans are (line, start, end) in bytes, one for each line an atom has."""

    content: str | None = None
    kind: str = "normal"
    open: str = ""
    close: str = ""
    children: list[Node] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)
    open_span: list[tuple[int, int, int]] = field(default_factory=list)
    close_span: list[tuple[int, int, int]] = field(default_factory=list)
    id: int = 0
    parent: Node | None = None
    depth: int = 0
    size: int = 0  # nodes below
    content_id: int = 0

    @property
    def is_list(self) -> bool:
        return self.content is None


@dataclass(frozen=True)
class Lexis:
    """How a family of languages is written."""

    comment: str
    string: str
    pairs: str = "()[]{}"
    word: str = r"[\w$@]+"
    operator: str = r"[^\w\s]"


C_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
FAMILIES = {
    "braces": Lexis(r"//[^\n]*|/\*.*?\*/", C_STRING + r"|`(?:\\.|[^`\\])*`", operator=r"[-+*/%=<>!&|^~?:]+|[^\w\s]"),
    "hash": Lexis(r"#[^\n]*", r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|' + C_STRING, operator=r"[-+*/%=<>!&|^~:]+|[^\w\s]"),
    "sexp": Lexis(r";[^\n]*", r'"(?:\\.|[^"\\])*"', word=r"[^\s()\[\]{}\";']+", operator=r"[^\w\s]"),
    "json": Lexis(r"(?!)", r'"(?:\\.|[^"\\\n])*"', word=r"[\w.+-]+", pairs="[]{}"),
    "sql": Lexis(r"--[^\n]*|/\*.*?\*/", r"'(?:''|[^'])*'|\"[^\"]*\"", pairs="()", operator=r"[-+*/%=<>!|]+|[^\w\s]"),
}
# The family of each language that has a provider.
PROVIDERS = {
    **dict.fromkeys("C C++ C# Java JavaScript TypeScript Rust Go Kotlin Swift Scala Dart CSS PHP Proto Solidity Zig".split(), "braces"),
    **dict.fromkeys("Python Ruby Bash YAML TOML R Perl Elixir Julia Make Nix HCL".split(), "hash"),
    **dict.fromkeys(["Clojure", "Common Lisp", "Emacs Lisp", "Scheme", "Racket", "Janet"], "sexp"),
    "JSON": "json",
    "SQL": "sql",
    "HTML": "html",
    "XML": "html",
}


class _Places:
    """Bytes columns of character offsets."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0]
        for m in re.finditer("\n", text):
            self.starts.append(m.end())
        # where each character begins, in bytes: a line may be as long as the text
        raw = np.frombuffer(b"" if text.isascii() else text.encode(), np.uint8)
        self.bytes = [*np.flatnonzero((raw & 0xC0) != 0x80).tolist(), len(raw)] if len(raw) else None

    def spans(self, start: int, end: int) -> list[tuple[int, int, int]]:
        out, k, at = [], bisect_right(self.starts, start) - 1, self.bytes
        while True:
            base = self.starts[k]
            stop = self.starts[k + 1] - 1 if k + 1 < len(self.starts) else len(self.text)
            a, b = max(start, base), min(end, stop)
            out.append((k, a - base, b - base) if at is None else (k, at[a] - at[base], at[b] - at[base]))
            if end <= stop or k + 1 >= len(self.starts):
                return out
            k += 1


def parse(text: str, language: str) -> Node:
    """The tree of a text; raises ParseError, or KeyError for a language without a provider."""
    family = PROVIDERS[language]
    root = _parse_html(text, language == "XML") if family == "html" else _parse_lexis(_Places(text), FAMILIES[family])
    number(root)
    return root


def without_empty(children: list[Node]) -> list[Node]:
    """Nodes without atoms that hold nothing."""
    return [n for n in children if n.is_list or n.content]


def flattened(n: Node) -> Node:
    """A list without delimiters and with one child that says something is that child."""
    n.children = without_empty(n.children)
    return n.children[0] if n.is_list and len(n.children) == 1 and not n.open and not n.close else n


def _parse_lexis(places: _Places, lexis: Lexis, at: int = 0, stop: int | None = None) -> Node:
    """The tree of a text, or of a part of it."""
    text, stop = places.text, len(places.text) if stop is None else stop
    opens = dict(zip(lexis.pairs[::2], lexis.pairs[1::2], strict=True))
    token = re.compile(rf"(?P<comment>{lexis.comment})|(?P<string>{lexis.string})|(?P<bracket>[{re.escape(lexis.pairs)}])|(?P<word>{lexis.word})|(?P<op>{lexis.operator})", re.S)
    root = Node()
    stack = [root]
    while at < stop:
        if text[at].isspace():
            at += 1
            continue
        m = token.match(text, at, stop)
        if not m:
            raise ParseError(places.spans(at, at)[0][0], f"unexpected {text[at]!r}")
        spans, value = places.spans(m.start(), m.end()), m.group()
        at = m.end()
        if m.lastgroup == "bracket":
            if value in opens:
                node = Node(open=value, close=opens[value], open_span=spans)
                stack[-1].children.append(node)
                stack.append(node)
                if len(stack) > MAX_DEPTH:
                    raise ParseError(spans[0][0], "nested too deeply")
            elif len(stack) > 1 and stack[-1].close == value:
                stack.pop().close_span = spans
            else:
                raise ParseError(spans[0][0], f"unmatched {value!r}")
        else:
            stack[-1].children.append(Node(value, {"comment": "comment", "string": "string"}.get(m.lastgroup, "normal"), spans=spans))
    if len(stack) > 1:
        raise ParseError(stack[-1].open_span[0][0], f"unclosed {stack[-1].open!r}")
    return root


_WORD = re.compile(r"[\w]+|[^\w\s]")


class _Tags(HTMLParser):
    # Elements without an end tag, and the languages inside others.
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    INSIDE = {"style": "CSS", "script": "JavaScript"}

    def __init__(self, text: str, xml: bool = False):
        super().__init__(convert_charrefs=False)
        if xml:  # no element is special there
            self.VOID, self.INSIDE, self.CDATA_CONTENT_ELEMENTS, self.RCDATA_CONTENT_ELEMENTS = frozenset(), {}, (), ()
        self.places, self.root = _Places(text), Node()
        self.stack = [self.root]

    def _at(self, size: int) -> list:
        line, col = self.getpos()
        start = self.places.starts[line - 1] + col
        return self.places.spans(start, start + size)

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text() or ""
        node = Node(open=raw, close="" if tag in self.VOID else f"</{tag}>", open_span=self._at(len(raw)))
        self.stack[-1].children.append(node)
        if tag not in self.VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        raw = self.get_starttag_text() or ""
        self.stack[-1].children.append(Node(open=raw, open_span=self._at(len(raw))))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].close == f"</{tag}>":
                self.stack[k].close_span = self._at(len(tag) + 3)
                del self.stack[k:]
                return

    def handle_data(self, data):
        line, col = self.getpos()
        start = self.places.starts[line - 1] + col
        inside = self.INSIDE.get(self.cdata_elem or "")
        if inside and data.strip():
            try:  # one layer deep; what can't be parsed is words
                tree = _parse_lexis(self.places, FAMILIES[PROVIDERS[inside]], start, start + len(data))
            except ParseError:
                pass
            else:
                own = flattened(tree)
                self.stack[-1].children += [own] if own is not tree else tree.children
                return
        own, at, starts = self.stack[-1].children, self.places.bytes, self.places.starts
        k = bisect_right(starts, start) - 1
        base, stop = starts[k], starts[k + 1] if k + 1 < len(starts) else len(self.places.text) + 1
        for m in _WORD.finditer(data):  # none goes over a line's end
            a, b = start + m.start(), start + m.end()
            while a >= stop:
                k += 1
                base, stop = starts[k], starts[k + 1] if k + 1 < len(starts) else len(self.places.text) + 1
            own.append(Node(m.group(), spans=[(k, a - base, b - base) if at is None else (k, at[a] - at[base], at[b] - at[base])]))

    def handle_entityref(self, name):
        self.stack[-1].children.append(Node(f"&{name};", spans=self._at(len(name) + 2)))

    def handle_charref(self, name):
        self.stack[-1].children.append(Node(f"&#{name};", spans=self._at(len(name) + 3)))

    def handle_comment(self, data):
        self.stack[-1].children.append(Node(f"<!--{data}-->", "comment", spans=self._at(len(data) + 7)))


def _parse_html(text: str, xml: bool = False) -> Node:
    parser = _Tags(text, xml)
    parser.feed(text)
    parser.close()
    return parser.root


def number(root: Node) -> list[Node]:
    """Ids in pre-order, parents, depths and sizes; the nodes in that order."""
    out, work = [], [root]
    while work:
        n = work.pop()
        n.id, n.size = len(out), 0
        out.append(n)
        if n.children:
            deeper = n.depth + 1
            for c in n.children:
                c.parent, c.depth = n, deeper
            work += reversed(n.children)
    for n in reversed(out[1:]):
        n.parent.size += n.size + 1
    return out


def preorder(root: Node) -> list[Node]:
    """The nodes of a tree that is numbered, in that order."""
    out, work = [], [root]
    while work:
        n = work.pop()
        out.append(n)
        if n.children:
            work += reversed(n.children)
    return out


def intern(nodes: list[Node], table: dict) -> None:
    """Content ids, shared by both sides through the table: equal subtrees have equal ids."""
    for n in reversed(nodes):
        key = ("l", n.open, n.close, tuple(c.content_id for c in n.children)) if n.is_list else ("a", _form(n), n.kind == "comment")
        n.content_id = table.setdefault(key, len(table))


def _form(n: Node) -> str:
    if n.kind == "comment" and "\n" in n.content:
        return "\n".join(x.lstrip() for x in n.content.split("\n"))
    return n.content
