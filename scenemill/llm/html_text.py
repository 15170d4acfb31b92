"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its number of words and
its link density, those of the two blocks before and after it, its tag, which kinds of elements it
stands in (one yes or no each, by tag or class), and how large a share of the page's words the nearest
of the doubtful ones holds. A small decision tree, trained on the labelled table of html_samples, says
which are main text; no rule overrules it. Comments, scripts, styles and other text that is not shown
never becomes part of a block. Time is linear in the page, however deep its elements nest.

Cases: null and empty pages have no blocks and an empty text. Broken markup is read as far as it goes:
an end tag without a start is ignored, an unclosed tag at the end is dropped, unclosed scripts run to
the end; other hidden elements without an end tag run to the end of their container or to the next
article, main, p or h1. Formulas (math) are text, without their annotations. Character references without an end are decoded as browsers do. Repeated rows give a row each.
An empty table gives no rows. Other columns are passed through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, shared_value
from .html_samples import LABELLED

# Fixed values of HTML: elements whose content is no text, containers, and leaves that break a block.
HIDDEN = frozenset("script style title textarea noscript template svg annotation annotation-xml iframe object canvas audio video select button".split())
#: Hidden elements in which another of the name may stand; one of the others ends where the next begins.
NESTED = frozenset("template svg annotation-xml object audio video".split())
RAW = frozenset("script style title textarea iframe".split())
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form fieldset ul ol dl menu table thead tbody tfoot tr figure blockquote details dialog center address hgroup".split()
)
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre figcaption summary legend label hr caption option".split())
#: Leaves that hold others, with the containers in which one of their kind ends the one before.
CELLS = {**dict.fromkeys(("td", "th"), ("tr", "table")), "li": ("ul", "ol", "menu"), **dict.fromkeys(("dt", "dd"), ("dl",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in classes, ids and roles that tell of something other than the article, and of the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription"
    " sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social related recommended pagination pager toolbar login signup search copyright legal disclaimer skip".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
ARTICLE_WORDS = frozenset("article content post entry story".split())

_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: Attributes: a quote delimits a value only behind "=", however long the value; one without an end is read as a name.
_ATTRIBUTES = r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+)*+)"
#: A tag, or where its quotes leave no ">", one up to the next ">"; comments; other markup; a cut-off tag.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|{_NAME}{_ATTRIBUTES}>|{_NAME}([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}

_HIDING = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b.*?(?:</\1\b|\Z)|<(/?)({'|'.join(sorted(HIDDEN - RAW, key=len, reverse=True))})(?![^\s/>])[^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE
)
#: Where these begin, a hidden element that has no end tag is over.
TEXT_STARTS = frozenset("article main p h1".split())

#: Kinds of elements that a block stands in. The first four are doubtful.
NAVIGATION, FORM, ASIDE, COMMENT, ARTICLE, CONTENT = (1 << k for k in range(6))
KINDS = (NAVIGATION, FORM, ASIDE, COMMENT, ARTICLE, CONTENT)
DOUBTFUL = NAVIGATION | FORM | ASIDE | COMMENT
#: Around a block: kinds, whether the nearest element of a kind is an article's, number of the nearest doubtful element.
Around = tuple[int, bool, int]
OUTERMOST: Around = (0, False, 0)


def kinds_of(tag: str, attributes: str, around: int) -> int:
    """The kinds of an element by its tag and the words of its class, id and role."""
    hints = set()
    if attributes and tag not in ("html", "body"):
        hints = {w.lower() for m in _HINTS.finditer(attributes) for w in _PART.findall(m[1] or m[2] or m[3] or "")}
    if tag in HEADINGS:  # a header there is the article's or the section's own
        hints -= {"header", "masthead"}
    found = 0
    if hints & COMMENT_WORDS:
        found |= COMMENT
    if tag in ("nav", "aside", "footer", "dialog") or (tag == "header" and not around & (ARTICLE | CONTENT)):
        found |= NAVIGATION
    if tag == "form":
        found |= FORM
    if hints & ASIDE_WORDS and tag not in ("article", "main"):
        found |= ASIDE
    if tag in ("article", "main"):
        found |= ARTICLE
    if hints & ARTICLE_WORDS and not found & DOUBTFUL and (tag not in LEAVES or tag == "td"):
        found |= CONTENT
    return found


def entered(around: Around, tag: str, attributes: str, number: int) -> Around:
    """What is around the content of an element that has ``around`` around itself."""
    found = kinds_of(tag, attributes, around[0])
    if not found:
        return around
    return around[0] | found, not found & DOUBTFUL, number if found & DOUBTFUL else around[2]


class Open:
    """Open elements, innermost last, found by name without a search."""

    def __init__(self):
        self.items: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *rest) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        self.items.append((name, *rest))

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def first(self, *names: str) -> int:
        return min((self.places[n][0] for n in names if self.places.get(n)), default=len(self.items))

    def cut(self, k: int) -> None:
        while len(self.items) > k:
            self.places[self.items.pop()[0]].pop()


def unclosed_hidden(page: str) -> set[int]:
    """Where the start tags of hidden elements lie that have no end tag of their own."""
    held: dict[str, list[int]] = {}
    lone = set()
    for m in _HIDING.finditer(page):
        if not m[3]:
            continue
        name = m[3].lower()
        starts = held.setdefault(name, [])
        if m[2]:
            if starts:
                starts.pop()
        elif not m[0].endswith("/>"):
            if name not in NESTED:
                lone.update(starts)
                starts.clear()
            starts.append(m.start())
    return lone.union(*held.values())


class Block(tuple):
    """leaf tag, words, linked words, text, kinds around, whether the nearest is an article's, number of the nearest doubtful element."""

    __slots__ = ()


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    if not page:
        return []
    found, stack, text, linked, around = [], Open(), [], 0, OUTERMOST
    lone, within, hidden = None, Open(), Open()  # hidden elements without an end tag; containers that began in a hidden one
    leaf, in_link, own, at = "", False, OUTERMOST, 0

    def close() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                found.append(Block((leaf, len(words), min(linked, len(words)), " ".join(words), *own)))
            text.clear()
        linked = 0

    def inside() -> Around:
        return stack.items[-1][1] if stack.items else OUTERMOST

    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not hidden.items:
            text.append(piece)
            if in_link:
                linked += len(html.unescape(piece).split())
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if hidden.items:
            if name in CONTAINERS and ends:
                if (k := within.last(name)) >= 0:
                    within.cut(k)
                elif stack.last(name) >= 0:  # the container around the hidden element ends, and so it does
                    hidden.cut(0)
            elif name in TEXT_STARTS and not ends:
                if lone is None:
                    lone = unclosed_hidden(page)
                    hidden.places["lone"] = [k for k, (_, start) in enumerate(hidden.items) if start in lone]
                if hidden.places["lone"]:
                    k = hidden.places["lone"][0]
                    hidden.places["lone"].clear()
                    hidden.cut(k)
            if not hidden.items:
                within.cut(0)
            elif name in CONTAINERS and not ends:
                within.push(name)
        if name in RAW and not ends:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
        elif name in HIDDEN:
            if not ends and not attributes.endswith("/"):
                if lone is not None and m.start() in lone:
                    hidden.places["lone"].append(len(hidden.items))
                hidden.push(name, m.start())
            elif ends and (k := hidden.last(name)) >= 0:
                hidden.cut(k)
                if lone is not None:
                    while hidden.places["lone"] and hidden.places["lone"][-1] >= k:
                        hidden.places["lone"].pop()
                if not hidden.items:
                    within.cut(0)
        elif hidden.items:
            continue
        elif name == "a":
            in_link = not ends
        elif name == "br":
            text.append(" ")
        elif name in CONTAINERS:
            close()
            leaf, in_link = name, in_link and ends
            if not ends:
                # menus and the like that were never closed end where the article begins
                if name in ("main", "article"):
                    stack.cut(stack.first("nav", "header", "footer", "form"))
                stack.push(name, entered(inside(), name, attributes, at))
            elif (k := stack.last(name)) >= 0:
                stack.cut(k)
            own = around = inside()
        elif name in LEAVES:
            close()
            leaf = "" if ends else name
            if name in CELLS:
                kin = [n for n, holders in CELLS.items() if holders == CELLS[name]]
                if (k := stack.last(*kin)) > stack.last(*CELLS[name]):
                    stack.cut(k)
                if attributes and not ends:
                    stack.push(name, entered(inside(), name, attributes, at))
                around = inside()
            # a leaf says more than its containers only by its class, id or role
            own = entered(around, name, attributes, at) if attributes and not ends and name not in CELLS else around
    close()
    return found


FEATURE_NAMES = (
    ["words", "links", "heading", "paragraph", "item", "cell"]
    + [f"{what} {k:+d}" for k in (-2, -1, 1, 2) for what in ("words", "links")]
    + ["in navigation", "in form", "in aside", "in comments", "in article", "in content", "article nearest", "share", "page has article"]
)


def described(blocks: list[tuple]) -> np.ndarray:
    """blocks x FEATURE_NAMES, from (leaf, words, linked words, kinds, article nearest, doubtful element).

    ``share`` is the part of the page's unlinked words, but for comments, that the nearest doubtful element
    holds: a sidebar has few, a wrapper most. It is 1 where there is none.
    """
    count = np.array([float(b[1]) for b in blocks])
    words = np.minimum(count, 200)
    links = np.array([b[2] / b[1] for b in blocks])
    leaf = np.array([b[0] for b in blocks])
    kinds = np.array([b[3] for b in blocks], np.int64)
    element = np.unique([b[5] for b in blocks], return_inverse=True)[1]
    plain = np.where(kinds & COMMENT, 0.0, count * (1 - links))
    share = np.where(kinds & DOUBTFUL, np.bincount(element, plain)[element] / max(plain.sum(), 1.0), 1.0)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x))
        if by < 0:
            out[-by:] = x[:by]
        else:
            out[:-by] = x[by:]
        return out

    around = [shifted(x, k) for k in (-2, -1, 1, 2) for x in (words, links)]
    tags = [np.isin(leaf, names) for names in (list(HEADINGS), ["p"], ["li", "dt", "dd"], ["td", "th"])]
    flags = [(kinds & k) > 0 for k in KINDS]
    nearest = np.array([float(b[4]) for b in blocks])
    article = np.full(len(blocks), float(((kinds & ARTICLE) > 0).any()))
    return np.column_stack([words, links, *tags, *around, *flags, nearest, share, article]).astype(float)


#: Blocks that a leaf of the tree is learnt from, at least.
LEAST = 3


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = LEAST):
        self.least = least
        self.feature, self.limit, self.low, self.high, self.share = [], [], [], [], []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        k = len(self.feature)
        for column, value in ((self.feature, -1), (self.limit, 0.0), (self.low, 0), (self.high, 0), (self.share, float(y.mean()))):
            column.append(value)
        if depth == 0 or y.min() == y.max():
            return k
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= limit
                if min(low.sum(), (~low).sum()) < self.least:
                    continue
                worth = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
                if worth < best[0] - 1e-9:
                    best = worth, f, limit
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.feature[k], self.limit[k] = best[1], float(best[2])
            self.low[k] = self._grow(x[low], y[low], depth - 1)
            self.high[k] = self._grow(x[~low], y[~low], depth - 1)
        return k

    def shares(self, x: np.ndarray) -> np.ndarray:
        feature, limit, low, high, share = map(np.array, (self.feature, self.limit, self.low, self.high, self.share))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            step = np.where(x[np.arange(len(x)), f] <= limit[at], low[at], high[at])
            at = np.where(inner, step, at)
        return share[at]


def labelled_pages(table: str = LABELLED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the blocks of a labelled table, by page."""
    pages = []
    for page in table.strip().split("\n\n"):
        blocks, labels, numbers = [], [], {}
        for line in page.splitlines():
            path, leaf, words, linked, label, *times = line.split()
            leaf, *own = leaf.split(".")
            around, steps = OUTERMOST, path.split("/")
            for k, step in enumerate(steps):  # elements of one path are one
                tag, *hint = re.split(r"[.#]", step)
                around = entered(around, tag, f'class="{hint[0]}"' if hint else "", numbers.setdefault("/".join(steps[: k + 1]), len(numbers) + 1))
            for _ in range(int(times[0][1:]) if times else 1):
                numbers[len(numbers)] = number = len(numbers) + 1  # a leaf that counts for itself
                blocks.append((leaf, int(words), int(linked), *(entered(around, leaf, f'class="{own[0]}"', number) if own else around)))
                labels.append(int(label))
        pages.append((described(blocks), np.array(labels)))
    return pages


def labelled_blocks(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    x, y = zip(*labelled_pages(table))
    return np.concatenate(x), np.concatenate(y)


def trained() -> Tree:
    return Tree(*labelled_blocks())


BLOCK = T.StructType(
    [T.StructField(n, t) for n, t in (("tag", T.StringType()), ("words", T.IntegerType()), ("linked", T.IntegerType()), ("text", T.StringType()), ("kinds", T.IntegerType()), ("main", T.BooleanType()))]
)
SLICE = 64


def text_blocks(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """The rows of ``pages`` with ``blocks``, an array of BLOCK, in the place of the html column."""
    others = [c for c in pages.columns if c not in (html_col, "blocks")]
    read = pages.select(*others, F.col(html_col).alias("__html"))
    schema = T.StructType([*(read.schema[c] for c in others), T.StructField("blocks", T.ArrayType(BLOCK))])
    shared = shared_value(pages.sparkSession, tree or trained())
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(BLOCK))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = []
                for page in part.column(part.num_columns - 1).to_pylist():
                    found = blocks_of(page)
                    main = shared.value.shares(described([(*b[:3], *b[4:]) for b in found])) >= 0.5 if found else []
                    out.append([dict(zip(BLOCK.names, (*b[:5], bool(m)))) for b, m in zip(found, main)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, kind)], schema.names)

    return mapped(read, cut, schema)


def main_text(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """The rows of ``pages`` with ``text``, the main text, in the place of the html column."""
    rest = [c for c in pages.columns if c not in (html_col, "blocks", "text")]
    kept = F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["text"])
    return text_blocks(pages.select(*rest, html_col), html_col, tree).select(*rest, F.array_join(kept, "\n").alias("text"))
