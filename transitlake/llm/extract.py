"""Main text of web pages, from the events of the standard library's streaming parser.

1. Events. Comments, declarations and the contents of scripts and the like are skipped ahead of the parser, by tags with
   quotes respected; what lies between goes to html.parser piece by piece. Its events become lines: a block's text is a
   line, with the number of tags that came with it. Lines under menus, headers, footers, sidebars, notices, adverts,
   forms and reader comments (by element, role, or word of class or id) count as lines without text.
2. Ratios. A line's ratio is its characters for each tag; ratios are smoothed over neighbouring lines by a Gaussian
   kernel. Lines at or above the standard deviation of the smoothed ratios form the content clusters.
3. Region. Where a page declares articles (or else a main element), only lines in these are clustered, and each one that
   holds a cluster is content as a whole. Elsewhere the content is the smallest container that holds most of the
   clusters' text, short of parting it from its heading; outside of clusters, lines that are mostly links go.

Blocks come in page order, parted by one line feed; white space within a block is one space (so is <br>), character
references are decoded.

Defined results: null and empty pages, and pages without content, give an empty text. Rows are independent: repeated and
tied rows, and null ids, each give their own row. Time and memory are linear in the length of a page; a page is held by
one task. Pages that end within a tag, a comment or a script end before it. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.markup import constructs

# Elements and the words that mark them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: Their contents are never parsed.
RAW = frozenset("iframe noembed noframes script style textarea title".split())
LEFT_OUT = frozenset("aside audio button canvas dialog fieldset footer form head header menu nav noscript object search select svg template video".split())
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adsense adv advert advertisement advertising adverts banner breadcrumb breadcrumbs colophon consent cookie cookies copyright footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation navigator newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion recommended related respond share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment commentary commentlist comments disqus replies".split())
#: A word behind one of these says what is not there.
ABSENT = frozenset("has no with without".split())
HEADINGS = frozenset(("h1", "h2"))
# What an element's start ends, unless one of the second kind was opened in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

#: Width of the kernel in lines.
SIGMA, REACH = 1.0, 2
_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)

_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+|[0-9]+")


def pieces(html: str):
    """The page without comments, declarations and raw contents; what follows an unfinished one is left out."""
    at = 0
    for start, end, name in constructs(html, RAW):
        if not name:
            yield html[at:start]
            at = end
    yield html[at:]


def _words(value: str) -> list[str]:
    """Words of a class or id, in order: parted by marks, digits and capitals."""
    return [w.lower() for w in _WORDS.findall(value)]


def _marked(values: list[str], kinds: frozenset) -> bool:
    for value in values:
        for name in value.split():
            words = _words(name)
            if any(w in kinds and (i == 0 or words[i - 1] not in ABSENT) for i, w in enumerate(words)):
                return True
    return False


class Lines(HTMLParser):
    """Collects a page's lines and the elements that they lie in. Element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # What is left out, and of that what is so even where it holds an article.
        self.parent, self.tag, self.out, self.comments = [-1], ["html"], [False], [False]
        # The open elements: name, element number (-1 for inline ones); where each name, and blocks, stand among them.
        self.open: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.nodes = [0]
        self.data: list[str] = []
        self.tags = self.linked = 0
        #: element, text, tags, share of characters in links
        self.lines: list[tuple[int, str, int, float]] = []

    def _end_line(self):
        text = " ".join("".join(self.data).split())
        if text:
            self.lines.append((self.nodes[-1], text, self.tags, self.linked / len(text)))
            self.tags = 0
        self.data, self.linked = [], 0

    def _close(self, size: int):
        """Closes open elements until ``size`` are left."""
        while len(self.open) > size:
            name, node = self.open.pop()
            self.at[name].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self._end_line()
                self.blocks.pop()
            if node >= 0:
                self.nodes.pop()

    def _inside(self, *names: str) -> bool:
        return any(self.at.get(n) for n in names)

    def _left_out(self, tag: str, attrs) -> tuple[bool, bool]:
        """Whether an element is left out, and whether it holds comments."""
        named = [v for k, v in attrs if k in ("class", "id") and v]
        comments = tag not in ("html", "body", "main") and _marked(named, COMMENT_WORDS)
        return comments or self._aside(tag, attrs, named), comments

    def _aside(self, tag: str, attrs, named: list[str]) -> bool:
        if tag in ("html", "body", "main", "article", "h1"):
            return False
        roles = {w for k, v in attrs if k == "role" and v for w in v.lower().split()}
        if self._inside("article", "main") and (tag == "header" or _marked(named, frozenset(("header",)))):
            return False  # of the article, not of the page
        return tag in LEFT_OUT or bool(roles & LEFT_OUT_ROLES) or _marked(named, LEFT_OUT_WORDS)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self._end_line()
            if self.blocks and self.open[self.blocks[-1]][0] == "p":
                self._close(self.blocks[-1])
            if tag in ENDS:
                ends, walls = ENDS[tag]
                wall = max((self.at[n][-1] for n in walls if self.at.get(n)), default=-1)
                last = [i for n in ends for i in self.at.get(n, ())[-2:] if i > wall]
                if last:
                    self._close(min(last))
        if tag in VOID:
            if tag == "br":
                self.data.append(" ")
            return
        left_out, comments = self._left_out(tag, attrs)
        node = -1
        if block or left_out:
            if not block:
                self._end_line()
            node = len(self.parent)
            self.parent.append(self.nodes[-1])
            self.tag.append(tag)
            self.out.append(left_out)
            self.comments.append(comments)
            self.nodes.append(node)
        if node >= 0:
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        places = self.at.get(tag)
        if not places or tag in ("html", "body"):
            return
        # An inline element ends within its block.
        if self.open[places[-1]][1] >= 0 or not self.blocks or places[-1] > self.blocks[-1]:
            self._close(places[-1])

    def handle_data(self, data):
        self.data.append(data)
        if self.at.get("a"):
            self.linked += len(data)

    def of(self, html: str) -> Lines:
        for piece in pieces(html):
            self.feed(piece)
        self.close()
        self._end_line()
        return self


def ratios(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Smoothed characters for each tag of consecutive lines."""
    if not len(chars):
        return np.empty(0)
    raw = chars / np.maximum(tags, 1)
    # What lies beyond the ends has no weight.
    return np.convolve(raw, _KERNEL)[REACH:-REACH] / np.convolve(np.ones(len(raw)), _KERNEL)[REACH:-REACH]


def clusters(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines reach the standard deviation of the smoothed ratios."""
    smooth = ratios(chars, tags)
    return (smooth >= smooth.std()) & (chars > 0) if len(smooth) else np.empty(0, bool)


def _below(parent: list[int], marked: list[bool]) -> list[bool]:
    """Whether each element is marked or lies in a marked one; parents come first."""
    out = list(marked)
    for i in range(1, len(parent)):
        out[i] = out[i] or out[parent[i]]
    return out


def _container(page: Lines, left_out: list[bool], picked: np.ndarray, chars: np.ndarray) -> int:
    """The smallest container with most of the picked lines' text; one with a heading of its own is not entered further."""
    mass = [0] * len(page.parent)
    for i in np.flatnonzero(picked).tolist():
        mass[page.lines[i][0]] += int(chars[i])
    for node in range(len(mass) - 1, 0, -1):
        mass[page.parent[node]] += mass[node]
    here = 0
    for node in range(1, len(mass)):
        if page.parent[node] != here or left_out[node]:
            continue
        if page.tag[node] in HEADINGS:
            break
        if 2 * mass[node] > mass[here] and page.tag[node] in CONTAINERS:
            here = node
    return here


def main_text(html: str | None) -> str:
    """The page's article, its blocks parted by line feeds."""
    page = Lines().of(html or "")
    if not page.lines:
        return ""
    parent, tag = page.parent, page.tag
    # What is left out by itself, and holds the article, is a wrapper of the page.
    holds = [t in ("article", "main") and not o for t, o in zip(tag, page.out, strict=True)]
    for node in range(len(parent) - 1, 0, -1):
        holds[node] = holds[node] and not page.comments[node]
        holds[parent[node]] = holds[parent[node]] or holds[node]
    left_out = _below(parent, [o and not h for o, h in zip(page.out, holds, strict=True)])
    node = [n for n, *_ in page.lines]
    out = np.array([left_out[n] for n in node])
    if out.all():
        # A form around the whole page.
        left_out = _below(parent, [o and t != "form" for o, t in zip(page.out, tag, strict=True)])
        out = np.array([left_out[n] for n in node])
    chars = np.where(out, 0, [len(text) for _, text, _, _ in page.lines])
    tags = np.array([t for _, _, t, _ in page.lines])
    for name in ("article", "main"):
        nearest = [-1] * len(parent)
        for i in range(len(parent)):
            nearest[i] = i if tag[i] == name and not left_out[i] else nearest[parent[i]] if i else -1
        declared = np.array([nearest[n] >= 0 for n in node])
        if (chars[declared] > 0).any():
            candidates = np.flatnonzero(declared)
            picked = candidates[clusters(chars[candidates], tags[candidates])]
            regions = {nearest[node[i]] for i in picked.tolist()}
            keep = [i for i in np.flatnonzero(declared & ~out).tolist() if nearest[node[i]] in regions]
            return "\n".join(page.lines[i][1] for i in keep)
    picked = clusters(chars, tags)
    region = _container(page, left_out, picked, chars)
    inside = _below(parent, [i == region for i in range(len(parent))])
    keep = [i for i, (n, _, _, linked) in enumerate(page.lines) if inside[n] and not out[i] and (picked[i] or linked <= 0.5)]
    return "\n".join(page.lines[i][1] for i in keep)


def extracted(html: Column) -> Column:
    """main_text of a column of pages; never null."""
    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        raw = pages.cast(pa.large_binary())
        # One page at a time is text, and its events are let go before the next.
        return pa.array([main_text(x.as_py().decode("utf-8", "replace")) if x.is_valid else "" for x in raw], pa.string())

    return of(html)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    found = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))
