"""Main text of web pages by text-to-tag ratios over streaming parser events.

1. The standard library's parser is fed a page in chunks that end between tags, and its events build lines: a line is the text of one block (a paragraph,
   heading, list item, cell and so on), with its count of tags, its link text and the element that holds it.
2. The text-to-tag ratio of a line is its characters outside links over its tags. Ratios are smoothed with a Gaussian; lines whose smoothed ratio is over a
   threshold, a share of the deviation of the ratios, form clusters of content, and the characters of an element's cluster lines are its mass.
3. Elements that by name or class look like menus, headers, footers, sidebars, notices, adverts, forms or comments are left out, unless the clusters say
   otherwise: one that holds most of the mass and the page's title or article is a wrapper. If nothing would be left, marks by class don't count.
4. The content region is the innermost article or main element with most of the mass, or else the innermost element of any name, widened while its parent adds
   a good part to the mass. An article or main is kept whole; in any other region lines that are mostly links stay only if they are in a cluster,
   and where the region is the whole page only what lies between its first and last cluster, with headings before and short blocks after.

A null or empty page has an empty text. Repeated rows are rows of their own. An empty table gives no rows. Of elements with equal mass the innermost
wins, of siblings the later. A page of any length is read once: a tag that isn't well formed counts without its attributes up to the next ">", and what follows
an unclosed tag, comment or script is left out. Only page_id, url and html are read, so that other columns may have any name.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gemello.llm.batches import slices

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head that has no end tag; anything else ends it.
HEAD = frozenset("head title style script noscript template base basefont bgsound link meta object".split())
SKIP = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
BOILER = frozenset("nav footer aside menu dialog".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main".split())
SHORT = frozenset("p li dd dt td th pre blockquote".split())
#: Elements that are a part of a text and no region.
LEAVES = HEADINGS | frozenset("p li dd dt pre blockquote".split())
#: A new one of these ends open ones of the second.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark adverts and the like, other things beside the article, and readers' comments.
ADVERTS = "ad|ads|adv|advert|adverts|advertisement|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|newsletter|subscribe|share|sharing|social"
BESIDE = (
    "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|header|masthead|notice|notices|alert|popup|modal|signup"
    "|related|recommended|pagination|pager|search|login|widget|toolbar|skip|complementary|contentinfo|dialog"
)
COMMENTS = "comment|comments|reply|replies|disqus|respond"
_KINDS = [(kind, re.compile(rf"(?:^|[_-])(?:{words})(?:$|[_-])", re.I)) for kind, words in enumerate((ADVERTS, BESIDE, COMMENTS), 1)]
ADVERT, ASIDE, COMMENT, HARD = 1, 2, 3, 4
#: Class words that speak of the article's own header, or of what a wrapper has.
OWN = re.compile(r"(?:article|post|entry|story|content|section|chapter)[_-]header$|(?:has|with|no|without|is)[_-]", re.I)
#: Characters fed to the parser at a time.
FEED = 65_536
SIGMA, RADIUS, THRESHOLD = 1.0, 2, 0.5
#: The least ratio of a line that its neighbours can lift over the threshold.
LEAST = 1
#: A parent with so many times the mass is the better region.
WIDER = 1.25
_TAG = re.compile(r"""<[A-Za-z][^\s"'<>/=]*+(?>(?:\s++|(?<=["']))[^\s"'<>/=]++(?>\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s"'=<>`]++))?)*+\s*+/?>""")
_NAME = re.compile(r"<([A-Za-z][A-Za-z0-9:_-]*)")
_RAW_END = {n: re.compile(rf"</\s*{n}\s*>", re.I) for n in ("script", "style")}


def well_formed(html: str) -> str:
    """html with every tag closed and readable, in one pass: tags that aren't well formed lose their attributes, unclosed ends are cut."""
    at = done = 0
    parts = []
    while (at := html.find("<", at)) >= 0:
        c = html[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            if m := _TAG.match(html, at):  # in time in proportion to the tag: whatever follows is read once more at most
                end = m.end()
            else:
                end = html.find(">", at) + 1
                name = _NAME.match(html, at)[1]
                parts += [html[done:at], f"<{name}>" if end else ""]
                done = end
                if not end:
                    return "".join(parts)
            if raw := _RAW_END.get(_NAME.match(html, at)[1].lower()):
                close = raw.search(html, end)
                if not close:
                    return "".join([*parts, html[done:at]] if done <= at else parts[:-1])
                end = close.end()
        elif c == "/" or c == "!" or c == "?":
            comment = html.startswith("<!--", at)
            end = html.find("-->" if comment else ">", at + (2 if comment else 0)) + 1
            if not end:
                return "".join([*parts, html[done:at]])
            if c == "/" and "<" in html[at + 1 : end]:  # cut off by the next tag
                parts += [html[done:at]]
                done = end = html.find("<", at + 1)
            elif c != "/":  # neither comments nor declarations have text
                end += 2 if comment else 0
                parts += [html[done:at]]
                done = end
        else:
            end = at + 1
        at = end
    return "".join([*parts, html[done:]]) if parts else html


def mark_of(tag: str, attrs: list, inside: bool) -> int:
    """What an element looks like by its name and attributes; inside tells whether an article or main is open."""
    if tag in BOILER or (tag == "header" and not inside):
        return HARD
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return 0
    kind = ASIDE if tag in FORMS else 0
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true"):
            return HARD
        if k in ("class", "id", "role") and v:
            words = [w for w in v.split() if not OWN.match(w)]
            for n, pattern in _KINDS:
                if n > kind and (tag in BLOCK or n == ADVERT) and any(map(pattern.search, words)):
                    kind = n
    return kind


class _Lines(HTMLParser):
    """Lines of a page and the tree of its block elements, all in order of their start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, link characters, number of the innermost element
        self.names, self.parents, self.marks = ["body"], [0], [0]
        self.stack: list[tuple[str, int, list[str], dict[str, int], bool]] = [("", 0, [], {}, False)]  # name, number, open inline elements, their counts, left out
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = self.links = self.anchors = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.links, self.stack[-1][1]))
        self.text, self.tags, self.links = [], 0, 0

    def _pop(self) -> None:
        name, _, inline, _, _ = self.stack.pop()
        self.open[name] -= 1
        self._close(inline, len(inline))

    def _close(self, inline: list[str], n: int) -> None:
        for name in inline[len(inline) - n :]:
            self.anchors -= name == "a"
            self.hidden -= name[0] == "-"
        del inline[len(inline) - n :]

    def _end_head(self, tag: str) -> None:
        """A head without end tag ends where what can't be in it begins, at the body in any case."""
        _, _, inline, counts, _ = self.stack[-1]
        if counts.get("head") and tag not in HEAD and (tag == "body" or inline[-1] == "-head"):
            n = len(inline) - inline.index("-head")
            for name in inline[len(inline) - n :]:
                counts[name.removeprefix("-")] -= 1
            self._close(inline, n)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self._end_head(tag)
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            elif tag == "hr":
                self.flush()
            return
        inside = bool(self.open.get("article") or self.open.get("main"))
        if tag not in BLOCK:
            _, _, inline, counts, _ = self.stack[-1]
            out = tag in SKIP or mark_of(tag, attrs, inside) in (ADVERT, HARD)
            name = f"-{tag}" if out else tag
            inline.append(name)
            counts[tag] = counts.get(tag, 0) + 1
            self.anchors += name == "a"
            self.hidden += out
            return
        self.flush()
        if tag in ENDS:
            while self.stack[-1][0] in ENDS[tag]:
                self._pop()
        elif self.stack[-1][0] == "p":
            self._pop()
        if tag in ("html", "body"):
            return
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(self.stack[-1][1])
        self.marks.append(mark_of(tag, attrs, inside))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, number, [], {}, False))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if self.open.get(tag):
                while self.stack[-1][0] != tag:
                    self._pop()
                self._pop()
            return
        _, _, inline, counts, _ = self.stack[-1]
        if counts.get(tag):
            n = next(k for k, name in enumerate(reversed(inline), 1) if name in (tag, f"-{tag}"))
            for name in inline[len(inline) - n :]:
                counts[name.removeprefix("-")] -= 1
            self._close(inline, n)

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.anchors:
            self.links += len(data)


def lines_of(html: str) -> _Lines:
    """Feed a page to the parser in chunks that end before a tag."""
    parser, html, at = _Lines(), well_formed(html), 0
    while at < len(html):
        end = html.rfind("<", at + 1, at + FEED) if at + FEED < len(html) else len(html)
        end = end if end > 0 else html.find("<", at + FEED)
        end = end if end > 0 else len(html)
        parser.feed(html[at:end])
        at = end
    parser.close()
    parser.flush()
    return parser


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel is cut and made to sum to one."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    full = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return full(ratios) / full(np.ones_like(ratios))


def clusters(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Whether each line is content by its smoothed text-to-tag ratio."""
    own = np.asarray([max(0, len(text) - links) / (tags + 1) for text, tags, links, _ in lines], float)
    smoothed = smooth(own)
    return (smoothed > THRESHOLD * smoothed.std()) & (own >= LEAST)


def main_text(html: str | None) -> str:
    """The main text of a page: its content lines joined by blank lines."""
    if not html:
        return ""
    page = lines_of(html)
    lines, parents = page.lines, page.parents
    if not lines:
        return ""
    content = clusters(lines).tolist()
    size = [len(text) for text, _, _, _ in lines]

    def mass(keep: list[bool]) -> list[int]:
        """Of each element, the characters of the lines to keep; numbers of children are over their parents'."""
        out = [0] * len(parents)
        for (_, _, _, n), chars, k in zip(lines, size, keep, strict=True):
            if k:
                out[n] += chars
        for n in range(len(out) - 1, 0, -1):
            out[parents[n]] += out[n]
        return out

    whole = mass(content)
    title, article = [False] * len(parents), [False] * len(parents)
    for n in range(len(parents) - 1, 0, -1):
        title[n] |= page.names[n] == "h1"
        article[n] |= title[n] or page.names[n] in REGIONS
        title[parents[n]] |= title[n]
        article[parents[n]] |= article[n]
    # marks count unless an element is a wrapper by its mass; a second time only those by name and for comments
    for strict in (True, False):
        out = [False] * len(parents)
        for n in range(1, len(parents)):
            mark = page.marks[n]
            wrapper = mark != HARD and whole[n] * 2 > whole[0] and (title[n] if mark == COMMENT else article[n])
            out[n] = out[parents[n]] or (bool(mark) and not wrapper and (strict or mark in (HARD, COMMENT)))
        kept = [c and not out[n] for c, (_, _, _, n) in zip(content, lines, strict=True)]
        if any(kept):
            break
    else:
        return ""
    held = mass(kept)
    most = [n for n in range(len(held)) if held[n] * 2 > held[0] and page.names[n] not in LEAVES]
    named = [n for n in most if page.names[n] in REGIONS]
    region = max(named or most)
    while not named and region and held[parents[region]] >= WIDER * held[region]:
        region = parents[region]
    inside = [False] * len(parents)
    for n in range(len(parents)):
        inside[n] = n == region or (n > region and inside[parents[n]])
    chosen = [inside[n] and not out[n] for _, _, _, n in lines]
    if not named:
        chosen = [c and (kept[k] or lines[k][2] * 2 <= size[k]) for k, c in enumerate(chosen)]
    if not region:
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        while first > 0 and chosen[first - 1] and page.names[lines[first - 1][3]] in HEADINGS:
            first -= 1
        while last + 1 < len(kept) and chosen[last + 1] and page.names[lines[last + 1][3]] in SHORT:
            last += 1
        chosen = [c and first <= k <= last for k, c in enumerate(chosen)]
    return "\n\n".join(line[0] for line, c in zip(lines, chosen, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches):
        for b in slices(batches):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
