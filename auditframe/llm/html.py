"""Main text of web pages: flat blocks, their neighbours, and a small learned decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block is described by its
words, the share of them inside links, the same of the blocks before and after, and by where it
stands: in a part of the page that its tag or class names as something else (menu, footer, advert,
comments ...), in the article, or outside the article of a page that has one. A decision tree, grown
from the labelled rows of ``LABELLED``, tells text from the rest.

Defined cases: null and empty pages, and pages of markup alone, have empty text; unclosed tags,
comments, scripts and a page that breaks off are read as far as they go; blocks without words vanish.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditframe.llm.common import map_arrow
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

#: Elements whose content is never text of the page.
SILENT = "script|style|title|textarea|noscript|template|svg|math|iframe|object|select|button|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*>|<[a-z/!?][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset(("article", "main"))
# Words in class, id and role that name a part of a page which is not its text.
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead banner sidebar aside widget related recommended ad ads adv advert "
    "adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "login search share sharing social comment comments commentlist reply replies disqus respond pagination pager copyright toolbar skip".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main maintext".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "article", "page_has_article")
# words, share in links, the same of the block before and after, in a named other part, in the article,
# page has an article; last: 1 if the block is main text.
LABELLED = """
6 1.0 0 0.0 6 1.0 1 0 1 0
5 1.0 6 1.0 12 0.0 1 0 1 0
1 1.0 1 1.0 1 1.0 1 0 1 0
12 0.0 5 1.0 9 0.0 1 0 1 0
40 0.0 5 1.0 9 0.0 1 0 1 0
90 0.0 30 0.0 20 0.0 1 0 1 0
15 0.1 60 0.0 0 0.0 1 0 1 0
25 0.0 60 0.0 30 0.0 1 1 1 0
80 0.0 25 0.0 30 0.0 1 1 1 0
3 0.0 80 0.0 25 0.0 1 1 1 0
4 1.0 70 0.0 4 1.0 1 1 1 0
9 0.0 12 0.0 60 0.0 0 1 1 1
60 0.0 9 0.0 45 0.0 0 1 1 1
45 0.1 60 0.0 1 0.0 0 1 1 1
1 0.0 45 0.0 50 0.0 0 1 1 1
2 0.0 1 0.0 3 0.0 0 1 1 1
3 0.0 6 1.0 8 0.0 0 1 1 1
7 1.0 50 0.0 40 0.0 0 1 1 1
2 1.0 12 0.0 15 0.0 0 1 1 1
20 0.6 40 0.0 2 1.0 0 1 1 1
120 0.0 8 0.0 14 0.2 0 1 1 1
200 0.0 0 0.0 0 0.0 0 1 1 1
4 0.0 0 0.0 6 1.0 0 0 1 0
8 0.0 6 1.0 70 0.0 0 0 1 0
30 0.0 90 0.0 10 0.0 0 0 1 0
60 0.0 4 0.0 9 0.0 0 0 1 0
3 1.0 4 1.0 20 0.0 0 0 1 0
15 0.3 20 0.0 0 0.0 0 0 1 0
70 0.0 8 0.0 55 0.0 0 0 0 1
55 0.1 70 0.0 80 0.0 0 0 0 1
25 0.0 40 0.0 60 0.0 0 0 0 1
18 0.2 35 0.1 0 0.0 0 0 0 1
120 0.0 0 0.0 0 0.0 0 0 0 1
35 0.0 3 1.0 4 1.0 0 0 0 1
8 0.0 5 1.0 70 0.0 0 0 0 1
5 0.0 60 0.0 45 0.0 0 0 0 1
2 0.0 50 0.0 30 0.0 0 0 0 1
7 0.0 2 1.0 35 0.1 0 0 0 1
6 0.0 70 0.0 4 1.0 0 0 0 0
4 0.0 3 1.0 2 1.0 0 0 0 0
3 0.0 0 0.0 4 1.0 0 0 0 0
5 0.0 4 0.0 3 0.0 0 0 0 0
9 0.1 6 0.9 0 0.0 0 0 0 0
2 1.0 3 1.0 2 1.0 0 0 0 0
12 0.8 8 0.9 30 0.0 0 0 0 0
30 0.9 10 1.0 60 0.0 0 0 0 0
25 0.7 50 0.0 5 1.0 0 0 0 0
10 0.6 40 0.0 50 0.0 0 0 0 0
4 1.0 60 0.0 70 0.0 0 0 0 0
1 1.0 2 1.0 8 0.0 0 0 0 0
"""


def page_blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words in links, outside, article) of every block with words, in page order."""
    out: list[tuple[str, int, int, int]] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, whether outside, whether in an article
    links = 0

    def state() -> tuple[bool, bool]:
        return stack[-1][1:] if stack else (False, False)

    def flush() -> None:
        if pieces:
            outside, article = state()
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(len(t.split()) for t, in_link in pieces if in_link)
                out.append((text, linked, int(outside), int(article)))
            pieces.clear()

    def read(text: str) -> None:
        if text:
            pieces.append((entities.unescape(text), links > 0))

    at = 0
    for token in TOKEN.finditer(page):
        read(page[at:token.start()])
        at = token.end()
        tag = (token.group(3) or "").lower()
        if not tag:
            continue  # a comment, a declaration or a silent element
        closing = bool(token.group(2))
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE and not (tag == "span" or tag == "label"):
            continue
        if tag in ("span", "label"):
            if not closing and not _marked(token.group(4) or "", tag, state()[1])[0]:
                stack.append((tag, *state()))
                continue
            if closing and not any(s[0] == tag for s in stack):
                continue
            if closing and stack[-1][0] == tag and stack[-1][1:] == (stack[-2][1:] if len(stack) > 1 else (False, False)):
                stack.pop()
                continue
        flush()
        if tag in VOID:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            links = 0
            continue
        if (token.group(4) or "").endswith("/"):
            continue
        if stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == tag or stack[-1][0] == "p"):
            stack.pop()  # a new block ends an unclosed paragraph, a new item an unclosed item
        links = 0
        outside, article = state()
        marked, text_part = _marked(token.group(4) or "", tag, article)
        stack.append((tag, outside or marked, article or text_part))
    read(page[at:])
    flush()
    return out


def _marked(attributes: str, tag: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is a named other part of the page, and whether it is the article."""
    outside = tag in OUTSIDE_TAGS or (tag in ("header", "head") and not in_article)
    article = tag in ARTICLE_TAGS
    if attributes.strip(" /"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            words = set(re.split(r"[^a-z]+", value))
            if name == "style":
                outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name == "hidden" or name == "aria-hidden":
                outside |= value != "false"
            elif tag not in ("html", "body"):
                outside |= bool(words & OUTSIDE_WORDS) and tag not in ARTICLE_TAGS
                article |= bool(words & ARTICLE_WORDS) and not words & OUTSIDE_WORDS and tag in ("div", "section", "td")
    return outside, article and not outside


def block_features(blocks: list[tuple[str, int, int, int]]) -> np.ndarray:
    words = np.array([len(b[0].split()) for b in blocks], dtype=np.float64)
    links = np.array([b[1] for b in blocks]) / np.maximum(words, 1)
    outside, article = (np.array([b[i] for b in blocks], dtype=np.float64) for i in (2, 3))
    has = np.full(len(blocks), float(np.any((article == 1) & (outside == 0))))

    def before(x):
        return np.concatenate([[0], x[:-1]])

    def after(x):
        return np.concatenate([x[1:], [0]])

    return np.stack([words, links, before(words), before(links), after(words), after(links), outside, article, has], axis=1)


def grow(rows: np.ndarray, kinds: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, threshold, low side, high side), or the class of a leaf.

    Of equal splits the first feature from the last (position on the page) to the first is taken.
    """
    share = kinds.mean()
    if share in (0, 1) or not depth:
        return int(share >= 0.5)
    best = None
    for feature in range(rows.shape[1] - 1, -1, -1):
        values = np.unique(rows[:, feature])
        for low, high in zip(values, values[1:]):
            side = rows[:, feature] <= (low + high) / 2
            impurity = sum(s.sum() * kinds[s].mean() * (1 - kinds[s].mean()) for s in (side, ~side))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, (low + high) / 2, side)
    if best is None:
        return int(share >= 0.5)
    _, feature, threshold, side = best
    return feature, float(threshold), grow(rows[side], kinds[side], depth - 1), grow(rows[~side], kinds[~side], depth - 1)


def trained_tree():
    table = np.array([[float(x) for x in line.split()] for line in LABELLED.split("\n") if line.strip()])
    return grow(table[:, :-1], table[:, -1])


def classify(tree, rows: np.ndarray) -> np.ndarray:
    """The class of every row, side by side down the tree."""
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    feature, threshold, low, high = tree
    side = rows[:, feature] <= threshold
    out = np.empty(len(rows), dtype=np.int64)
    out[side], out[~side] = classify(low, rows[side]), classify(high, rows[~side])
    return out


def main_text(page: str | None, tree) -> str:
    blocks = page_blocks(page or "")
    if not blocks:
        return ""
    kept = classify(tree, block_features(blocks))
    return " ".join(b[0] for b, k in zip(blocks, kept.tolist()) if k)


def extract(df: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from its whole markup."""
    tree = trained_tree()

    def step(batch):
        texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
        return {id_column: batch.column(0), url: batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

    kinds = dict(df.dtypes)
    return map_arrow(df.select(id_column, url, page), step, f"`{id_column}` {kinds[id_column]}, `{url}` {kinds[url]}, text string, n_chars bigint")
