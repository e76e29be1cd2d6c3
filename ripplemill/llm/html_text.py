"""Main text of web pages: flat blocks, features of a block and its neighbours, a small decision tree.

A page is cut at block tags into flat blocks of text. A block's features are its words,
the share of them inside links, the same two of the blocks before and after it, whether
the tags around it (or their class, id or role) say menu, advert, comments and the like,
and whether it lies in an article. A tree trained on the table below says which stay:
whatever is inside an article and not marked as something else; on pages without an
article, what word counts and link shares of a block and its neighbours say.

An article is an ``article`` element, or on pages without one the ``main`` element. A class or id counts by its whole
names: ``sidebar``, ``left-sidebar`` and ``sidebar-box`` say sidebar, but ``no-sidebar``,
``has-header`` and ``notice-period`` say nothing.

Null and empty pages give an empty text. Broken markup is read as far as it goes: tags cut
off by the page's end are dropped, missing end tags end with what encloses them (scripts and
other raw elements without one go on to the page's end, as in browsers). Very long pages
are read whole. Repeated rows give equal rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of
from .words import in_pieces

# Names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr img br".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form fieldset ul ol dl table figure blockquote details dialog menu center button select address search".split())
BOILER_TAGS = frozenset("nav header footer aside form fieldset dialog menu button select address search".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice alert newsletter subscribe signup popup modal overlay comment comments reply replies disqus share sharing social related recommended widget toolbar pagination pager".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# Names that join with those above to one that means the same ("comment-list"), and those that turn them round ("no-sidebar").
PART_NAMES = frozenset("area bar block body bottom box center container content group inner item items left link links list main module outer panel primary right row secondary section site slot thread top unit wrap wrapper zone".split())
TURNING = frozenset("no not has have with without hide is non after before below above".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    # without an end tag these stand for their tag only
    r"|<(svg|template)\b(?:[^>\"'/]++|/(?!>)|\"[^\"]*\"|'[^']*')*+>.*?</\2\s*>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z0-9]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article")
#: Blocks by words and share in links, and neighbours by words and share before, words and share after.
BLOCKS = [(1, 0.0), (2, 1.0), (6, 0.3), (15, 0.0), (15, 0.9), (40, 0.6), (60, 0.05), (200, 0.0)]
NEIGHBOURS = [(0, 0.0, 0, 0.0), (1, 1.0, 1, 1.0), (5, 1.0, 90, 0.0), (70, 0.0, 4, 1.0), (60, 0.0, 60, 0.0), (12, 0.2, 30, 0.7)]
#: What the page says about a block that way: inside an article and not marked (main text), marked, outside the article.
TOLD = [(0, 1.0, 1), (1, 1.0, 0), (1, 0.5, 0), (1, 0.0, 0), (0, 0.0, 0)]
#: Blocks of pages without an article: the features in their order (shares of words in links from 0 to 1), and 1 for main text.
UNTOLD = [
    # long blocks with few links, and short ones between such
    (80, 0.0, 5, 0.0, 60, 0.0, 1), (45, 0.05, 70, 0.0, 4, 1.0, 1), (25, 0.1, 3, 1.0, 90, 0.0, 1), (200, 0.1, 1, 1.0, 2, 1.0, 1),
    (20, 0.0, 40, 0.0, 35, 0.0, 1), (8, 0.0, 60, 0.0, 70, 0.0, 1), (3, 0.0, 50, 0.0, 40, 0.0, 1), (60, 0.3, 60, 0.0, 60, 0.1, 1),
    (120, 0.2, 0, 0.0, 0, 0.0, 1), (6, 0.0, 2, 1.0, 80, 0.0, 1), (18, 0.0, 25, 0.0, 2, 0.5, 1), (30, 0.0, 0, 0.0, 0, 0.0, 1),
    (50, 0.0, 4, 0.0, 6, 1.0, 1), (10, 0.0, 30, 0.0, 25, 0.0, 1), (35, 0.2, 8, 0.0, 80, 0.0, 1), (16, 0.0, 90, 0.0, 0, 0.0, 1),
    # menus, lines of links, short lines among such
    (2, 1.0, 2, 1.0, 2, 1.0, 0), (1, 1.0, 3, 0.0, 40, 0.0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0), (1, 0.0, 0, 0.0, 1, 1.0, 0),
    (12, 0.9, 10, 0.8, 12, 0.9, 0), (30, 0.8, 60, 0.0, 5, 1.0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0), (6, 0.9, 90, 0.0, 70, 0.0, 0),
    (5, 0.2, 6, 0.5, 4, 0.0, 0), (40, 0.7, 40, 0.6, 40, 0.8, 0), (8, 0.0, 3, 1.0, 3, 1.0, 0), (5, 0.0, 90, 0.0, 2, 1.0, 0),
]


def labelled() -> np.ndarray:
    """The small table that the tree is trained on: one row a block, the features and the label."""
    told = [(*block, *around, marked, article, main) for block in BLOCKS for around in NEIGHBOURS for marked, article, main in TOLD]
    return np.array(told + [(*row[:-1], 0, 0.5, row[-1]) for row in UNTOLD], dtype=np.float64)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree of (feature, threshold, at most, above) by least Gini impurity; a leaf is the share of ones."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[:-1] + v[1:]) / 2:
            low = x[:, f] <= t
            score = sum(k.sum() * y[k].mean() * (1 - y[k].mean()) for k in (low, ~low))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(t), low)
    if best is None:
        return float(y.mean())
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained_tree():
    table = labelled()
    return grow(table[:, :-1], table[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, classify(low, x), classify(high, x))


def says_boiler(name: str) -> bool:
    """Whether one class or id name stands for a menu, an advert, comments and the like."""
    words = NAME.findall(name)
    if not words or words[0] in TURNING:
        return False
    at = [w in BOILER_WORDS for w in words]
    return any(at) and (at[-1] or all(known or w in PART_NAMES or w.isdigit() for known, w in zip(at, words)))


def _hinted(name: str, attributes: str) -> bool:
    if name in BOILER_TAGS:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in HINT.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        if any(x in BOILER_ROLES for x in names) if m[1].lower() == "role" else any(map(says_boiler, names)):
            return True
    return False


class _Page:
    """Reads a page's tags in order and gathers its blocks."""

    def __init__(self):
        #: (text, words, words in links, marked as boiler, in an article element, in a main element)
        self.blocks: list[tuple[str, int, int, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.boiler = self.article = self.main = 0
        self.seen: set[str] = set()  # whether the page has an article, or main, even an empty one
        self.own = self.in_link = False  # own: a hint on the block itself, such as a paragraph's class

    def text(self, piece: str) -> None:
        piece = html.unescape(piece)
        self.parts.append(piece)
        if self.in_link:
            self.linked.append(piece)

    def end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            n = text.count(" ") + 1
            self.blocks.append((text, n, min(len(" ".join(self.linked).split()), n), bool(self.boiler or self.own), self.article > 0, self.main > 0))
        self.parts.clear()
        self.linked.clear()
        self.own = False

    def opened(self, name: str, hint: bool, by: int = 1) -> None:
        self.boiler += by * hint
        # a marked article is none: a reader's comment, say
        self.article += by * (name == "article" and not hint)
        self.main += by * (name == "main")
        if name == "main" or name == "article" and not hint:
            self.seen.add(name)

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "a":
            self.in_link = not closing
        elif name in ("br", "img"):
            self.parts.append(" ")
        is_open = closing and any(x[0] == name for x in self.stack)
        if name in INLINE and (closing and not is_open or not closing and not _hinted(name, attributes)):
            return
        self.end()
        if is_open:
            while True:
                last, hint = self.stack.pop()
                self.opened(last, hint, -1)
                if last == name:
                    break
        elif closing:
            return
        elif name in CONTAINERS or name in INLINE:
            if not attributes.rstrip().endswith("/") and name not in ("br", "img", "wbr"):
                hint = _hinted(name, attributes)
                self.stack.append((name, hint))
                self.opened(name, hint)
        else:
            self.own = _hinted(name, attributes)


def blocks(page: str) -> tuple[list[tuple[str, int, int, bool, bool, bool]], set[str]]:
    """(text, words, words in links, boiler, in an article, in main) of each flat block with text; which of the two the page has."""
    reader, at = _Page(), 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m[4] is not None:  # scripts and the like are not there at all
            reader.tag(m[4].lower(), bool(m[3]), m[5] or "")
    if at < len(page):
        reader.text(page[at:])
    reader.end()
    return reader.blocks, reader.seen


def features(found: list[tuple], seen: set[str]) -> np.ndarray:
    words, links = np.array([b[1] for b in found], float), np.array([b[2] for b in found], float)
    share = links / words
    around = [np.concatenate((([0.0], v[:-1]))) for v in (words, share)] + [np.concatenate((v[1:], [0.0])) for v in (words, share)]
    # the article elements where there are any, else main, else unknown
    told = 4 if "article" in seen else 5 if "main" in seen else None
    article = np.full(len(found), 0.5) if told is None else np.array([float(b[told]) for b in found])
    return np.stack((words, share, *around, np.array([float(b[3]) for b in found]), article), axis=1)


def main_text(page: str | None, tree) -> str:
    found, seen = blocks(page) if page else ([], set())
    return "\n".join(b[0] for b, keep in zip(found, classify(tree, features(found, seen))) if keep) if found else ""


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "html"):
            texts = [main_text(p, tree) for p in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): page_id, url, text, n_chars for each row."""
    batches_of(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(trained_tree()), "page_id long, url string, text string, n_chars long")
