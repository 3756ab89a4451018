"""Operator 8: main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags.  A block has the features of the
shallow-text method: its words and link density and those of its neighbours, with
the kind of element around it.  A decision tree, grown here on the labelled blocks
below, says which blocks are main text; these are joined in page order.

Work is per page and shuffles nothing; the tree is a few dozen numbers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.arrow import slices
from fieldlake.llm.staging import bounded_batches

# Element names of the HTML standard, by what they do to text.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = set("applet audio canvas embed head iframe math noembed noframes noscript object script style svg template textarea title video".split())
RAW_TAGS = set("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = set("nav header footer aside form menu dialog button select fieldset".split())
MAIN_TAGS = {"article", "main"}
# Words in class, id and role attributes that announce other things than the article.
CHROME_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+(?:["'][^<>]*)?)>|<[!?][^>]*>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+")


@dataclass
class Block:
    """Text between two block boundaries, with what surrounds it."""

    text: str
    linked: int
    chrome: bool
    main: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """The visible text blocks of a page, in page order; white space inside is one blank."""
    out: list[Block] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # name, chrome, hidden
    names: Counter[str] = Counter()  # of open elements
    links = linked = 0
    at, hidden, chrome, main = 0, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            parts.append(raw)
            if links:
                linked += len(raw.split())

    def close() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(parts)).split())
        if joined:
            heading = any(names[f"h{k}"] for k in range(1, 7))
            out.append(Block(joined, linked, chrome > 0, main > 0, heading))
        parts.clear()
        linked = 0

    def leave(count: int) -> None:
        nonlocal hidden, chrome, main, links
        for _ in range(count):
            name, is_chrome, is_hidden = open_.pop()
            names[name] -= 1
            hidden, chrome, main, links = hidden - is_hidden, chrome - is_chrome, main - (name in MAIN_TAGS), links - (name == "a")

    while found := TAG.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCK_TAGS:
            close()
        elif name == "br":
            text(" ")
        if found[1]:
            if names[name]:
                leave(next(k for k, (n, _, _) in enumerate(reversed(open_), start=1) if n == name))
            continue
        if name in VOID_TAGS:
            continue
        if name == "p":  # a paragraph ends an open one
            depth = next((k for k, (n, _, _) in enumerate(reversed(open_), start=1) if n in BLOCK_TAGS), 0)
            if depth and open_[-depth][0] == "p":
                leave(depth)
        is_chrome = name in CHROME_TAGS and not (name == "header" and main) or any(w in CHROME_WORDS for m in ATTRIBUTE.finditer(found[3]) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower()))
        is_hidden = name in HIDDEN_TAGS
        if name in ("body", "html"):
            is_chrome = False
        if is_hidden and found[3].endswith("/") and name in ("svg", "math"):
            continue
        open_.append((name, is_chrome, is_hidden))
        names[name] += 1
        hidden, chrome, main, links = hidden + is_hidden, chrome + is_chrome, main + (name in MAIN_TAGS), links + (name == "a")
        if name in RAW_TAGS:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    text(page[at:])
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "chrome", "main", "heading")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([len(b.text.split()) for b in found], dtype=np.float64)
    density = np.minimum(1.0, np.array([b.linked for b in found]) / np.maximum(words, 1))
    shift = lambda x, by: np.concatenate(([0.0], x[:-1])) if by > 0 else np.concatenate((x[1:], [0.0]))
    flags = np.array([[b.chrome, b.main, b.heading] for b in found], dtype=np.float64)
    return np.column_stack([words, density, shift(words, 1), shift(density, 1), shift(words, -1), shift(density, -1), flags])


_LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
_SHORT, _LINE = "A few words", "A single line of eight words or so"
_MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>Contact us today</a></li></ul>"
# The labelled table: pages as (1 main text or 0 other, markup); a label holds for all blocks of its markup.
LABELLED = [
    [(0, f"<nav>{_MENU}</nav>"), (0, f"<div class='ad'>{_LINE}</div>"), (1, f"<article><h1>{_SHORT}</h1><p>{_LONG}</p><p>Yes.</p><p>{_LINE}</p></article>"), (0, f"<footer>&copy; site &middot; {_LINE}</footer>")],
    [(0, f"<header><h1>Site</h1>{_MENU}</header>"), (1, f"<main><h2>{_SHORT}</h2><p>{_LONG}</p><ul><li>{_SHORT}</li><li>{_LINE}</li></ul><p>{_LONG}</p></main>"), (0, f"<aside><h3>More</h3><p>{_LONG}</p></aside>")],
    [(0, f"<div id='menu'>{_MENU}</div>"), (1, f"<div><h1>{_SHORT}</h1><p>{_LONG}</p><p>{_LINE} {_LINE}</p><p>{_LONG}</p></div>"), (0, f"<div class='comments'><p>{_LONG}</p><p>{_LINE}</p></div>"), (0, f"<form><p>{_LINE}</p><label>Name</label></form>")],
    [(0, _MENU), (1, f"<div><h1>{_SHORT}</h1></div><div><p>{_LONG}</p><p>{_LONG}<a href='/x'>a link</a></p></div>"), (0, "<div><a href='/y'>Next page here</a></div>"), (0, "<p>Terms</p>")],
    [(0, f"<div class='cookie notice'><p>{_LONG}</p></div>"), (1, f"<article><p>{_SHORT}</p><blockquote><p>{_LINE}</p></blockquote><p><a href='/z'>{_LINE}</a></p><p>{_LONG}</p></article>"), (0, f"<section class='related'><h3>{_SHORT}</h3><p><a href='/q'>{_LINE}</a></p></section>")],
    [(1, f"<article><h1>{_SHORT}</h1><p>{_LONG}</p>"), (0, f"<aside><p>{_LINE}</p></aside><div class='share'><p>{_SHORT}</p></div><div class='newsletter'><p>{_LONG}</p></div>"), (1, f"<p>{_LONG}</p><h2>{_SHORT}</h2><p>No.</p>"), (0, f"<section id='comments'><p>{_LONG}</p></section></article>")],
    [(0, f"<div>{_MENU}</div>"), (1, f"<article><h1>{_SHORT}</h1><p>{_LONG}</p><p>{_LINE}</p><p>End.</p></article>")],
    [(1, f"<article><p>{_LONG}</p></article>")],
    [(1, f"<main><h1>{_SHORT}</h1><p>End.</p></main>")],
    [(0, f"<p><a href='/h'>Home</a></p><p>{_SHORT}</p>"), (1, f"<div><p>{_LONG}</p><p>{_LONG}</p></div>")],
    [(0, f"<div>{_MENU}</div><div><a href='/l'>Log in</a> <a href='/s'>Sign up</a></div>"), (1, f"<p>{_LONG}</p><p>{_LONG}</p>"), (0, "<div><a href='/1'>One</a> | <a href='/2'>Two</a> | <a href='/3'>Three</a></div>")],
]


@dataclass
class Node:
    """A split, or a leaf if ``below`` is missing."""

    share: float
    feature: int = -1
    limit: float = 0.0
    below: Node | None = None
    above: Node | None = None


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by Gini impurity; the first of equal splits, so it is the same everywhere."""
    node = Node(float(labels.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    gini = lambda y: len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0
    best = gini(labels) - 1e-9
    for feature in (6, 7, 1, 0, 3, 5, 2, 4, 8):  # structure first, then links, then lengths
        values = np.unique(rows[:, feature])
        for limit in (values[:-1] + values[1:]) / 2:
            left = rows[:, feature] <= limit
            cost = gini(labels[left]) + gini(labels[~left])
            if cost < best - 1e-12:
                best, node.feature, node.limit = cost, feature, float(limit)
    if node.feature >= 0:
        left = rows[:, node.feature] <= node.limit
        node.below, node.above = grow(rows[left], labels[left], depth - 1), grow(rows[~left], labels[~left], depth - 1)
    return node


def apply_tree(node: Node, rows: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    if node.below is None:
        return np.full(len(rows), node.share >= 0.5)
    left = rows[:, node.feature] <= node.limit
    out = np.empty(len(rows), dtype=bool)
    out[left], out[~left] = apply_tree(node.below, rows[left]), apply_tree(node.above, rows[~left])
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of ``LABELLED``."""
    rows, labels = [], []
    for page in LABELLED:
        markup, marks = "", []
        for label, part in page:
            markup += part
            marks += [label] * (len(blocks(markup)) - len(marks))
        rows.append(features(blocks(markup)))
        labels += marks
    return np.concatenate(rows), np.array(labels, dtype=np.float64)


@cache
def tree() -> Node:
    return grow(*labelled_table())


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, apply_tree(tree(), features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id long, url string, text string, n_chars long``, a row per page.

    A null page counts as empty; the text is empty if no block is main text.
    Nothing is capped.  Null ids and urls and repeated rows are kept as they are;
    an empty table gives no rows; other columns are not looked at.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
