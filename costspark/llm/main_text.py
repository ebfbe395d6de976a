"""The main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.llm.sample import first_by_rank

# What HTML calls blocks, elements without an end, and elements that hold no text.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head title script style noscript template iframe object svg math canvas audio video textarea".split())
# What the names of elements, classes and ids say about the text inside.
AWAY_TAGS = set("nav footer aside form button select menu dialog fieldset".split())
HOME_TAGS = set("article main".split())
AWAY_WORDS = set(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar side footer foot header masthead topbar comment comments disqus reply replies "
    "respond cookie cookies consent notice alert popup modal overlay share sharing social follow subscribe newsletter "
    "signup login related recommended widget pagination pager toolbar copyright skip search complementary contentinfo".split()
)
HOME_WORDS = set("article content post entry story main maincontent body text".split())
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LIKE_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
FEATURES = ["length", "links", "stops", "texty", "listy"]


class Block:
    __slots__ = ("text", "hint", "parent", "chars", "linked", "tag")

    def __init__(self, text: str, hint: int, parent: int, linked: int, tag: str):
        self.text, self.hint, self.parent, self.linked, self.tag = text, hint, parent, linked, tag
        self.chars = len(text)


def _hint(tag: str, attrs: list[tuple[str, str | None]], inherited: int) -> int:
    """1 inside an article, -1 inside what isn't main text, 0 unknown; the nearest element that says so counts."""
    if tag in AWAY_TAGS:
        return -1
    names: set[str] = set()
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            names.update(w.lower() for w in NAME.findall(v))
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and HIDDEN.search(v):
            return -1
    if inherited == 1:
        names.discard("header")  # of the article
    if names & AWAY_WORDS and tag not in ("html", "body"):
        return -1
    if tag == "header":
        return 1 if inherited == 1 else -1
    if tag in HOME_TAGS or (names & HOME_WORDS and inherited == 0 and tag not in ("html", "body")):
        return 1 if inherited >= 0 else inherited
    return inherited


class _Blocks(HTMLParser):
    """Cuts a page into blocks of text with what stands around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, hint, number
        self.number = self.silent = self.link = self.linked = 0
        self.parts: list[str] = []

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, hint, parent = "", self.stack[-1][1], 0
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k][0] in BLOCKS:
                        tag, parent = self.stack[k][0], self.stack[k - 1][2]
                        break
                self.blocks.append(Block(text, hint, parent, self.linked, tag))
            self.parts, self.linked = [], 0

    def _pop(self, keep: int) -> None:
        for tag, _, _ in self.stack[keep:]:
            self.silent -= tag in SILENT
            self.link -= tag == "a"
        del self.stack[keep:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append("\n")
            return
        if tag in BLOCKS:
            self._end_block()
            closes = ("p", tag) if tag in ("li", "tr", "td", "th", "dt", "dd", "option") else ("p",)
            for k in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[k][0]
                if open_tag in closes:
                    self._pop(k)
                    break
                if open_tag in BLOCKS:
                    break
            if tag == "body":  # an unclosed head ends here
                for k, (open_tag, _, _) in enumerate(self.stack):
                    if open_tag == "head":
                        self._pop(k)
                        break
        if tag in VOID:
            return
        self.number += 1
        self.stack.append((tag, _hint(tag, attrs, self.stack[-1][1]), self.number))
        self.silent += tag in SILENT
        self.link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.blocks


def features(block: Block) -> list[float]:
    n = max(1, block.chars)
    return [
        min(np.log1p(block.chars) / 5, 1.5),
        min(1.0, block.linked / n),
        min(1.0, 10 * sum(map(block.text.count, ".,;!?")) / n),
        float(block.tag in LIKE_TEXT),
        float(block.tag in ("li", "td", "th", "dt", "option")),
    ]


# The classifier without pages to learn from: weights of FEATURES and the constant.
PRIOR = [1.5, -4.0, 1.0, 1.5, -1.5, -1.0]


def learn_weights(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.5, pull: float = 0.02) -> list[float]:
    """Logistic regression, drawn toward ``PRIOR``; both classes weigh the same."""
    prior = np.array(PRIOR)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (weight * (p - y)) + pull * (w - prior))
    return w.tolist()


def cut(content: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: node i costs max(0, -content[i]) as content and max(0, content[i])
    as boilerplate, and each edge its weight if its ends differ.  True is content.

    Maximum flow by shortest augmenting paths; content is what the source still reaches.
    """
    n = len(content)
    supply = [max(0.0, c) for c in content]
    demand = [max(0.0, -c) for c in content]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            room[i][j] = room[i].get(j, 0.0) + w
            room[j][i] = room[j].get(i, 0.0) + w
    while True:
        came = {i: -1 for i in range(n) if supply[i] > 1e-9}
        queue, end = deque(came), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    if demand[j] > 1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(demand[end], supply[path[-1]], *(room[b][a] for a, b in zip(path, path[1:])))
        demand[end] -= flow
        supply[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


def label(blocks: list[Block], weights: list[float], named: float = 8.0, beside: float = 0.5, near: float = 1.0) -> list[bool]:
    """Content or not for each block of a page.

    The classifier's log-odds and ``named`` for a telling element around the block are the
    capacities to source and sink.  Blocks that follow each other are tied by ``beside``, blocks
    of the same parent element by ``near``.
    """
    w, constant = weights[:-1], weights[-1]
    cost = [sum(a * b for a, b in zip(w, features(b_))) + constant + named * b_.hint for b_ in blocks]
    edges = [(i, i + 1, beside) for i in range(len(blocks) - 1)]
    seen: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in seen:
            edges.append((seen[b.parent], i, near))
        seen[b.parent] = i
    return cut(cost, edges)


def main_text(html: str, weights: list[float] = PRIOR) -> str:
    """Content blocks of a page, one a line."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights)) if keep)


def fit_weights(pages: DataFrame, id_col: str, html_col: str, sample_pages: int, sample_blocks: int = 50_000) -> list[float]:
    """Learn the classifier from ``sample_pages`` pages (all, if there are no more), chosen by a hash
    of id and html: blocks inside article elements are examples of content, blocks inside nav,
    footer and their like are not.  Of these blocks at most ``sample_blocks``, chosen by a hash of
    page and place, come to the driver."""
    rank = F.xxhash64("id", "html", F.lit(7))

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, at, *features(b), float(b.hint > 0))
                for page, html in zip(batch["page"].tolist(), batch["html"])
                for at, b in enumerate(blocks_of(html))
                if b.hint
            ]
            out = pd.DataFrame(rows, columns=["page", "at", *FEATURES, "content"])
            yield out.astype({"page": "int64", "at": "int64"} | dict.fromkeys([*FEATURES, "content"], "float64"))

    every = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = first_by_rank(every, rank, sample_pages).select(rank.alias("page"), "html")
    rows = own.mapInPandas(examples, "page long, at long, " + ", ".join(f"{c} double" for c in [*FEATURES, "content"]))
    rows = rows.orderBy(F.xxhash64("page", "at"), "page", "at").limit(sample_blocks).select(*FEATURES, "content")
    found = np.array(sorted(map(tuple, rows.collect())), dtype=float).reshape(-1, len(FEATURES) + 1)
    return learn_weights(found[:, :-1], found[:, -1])


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    sample_pages: int = 500,
    weights: list[float] | None = None,
) -> DataFrame:
    """``pages`` with the column ``text``, the main text (replaced if it is there); null or empty html gives an empty text."""
    weights = weights or fit_weights(pages, id_col, html_col, sample_pages)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, weights) for h in html], dtype=object)

    return pages.withColumn("text", text(F.coalesce(F.col(html_col), F.lit(""))))
