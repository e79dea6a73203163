"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block log-odds to be content, which are its terminal capacity:
to the content side if positive, to the boilerplate side if negative. The weights of what a block's text looks like (words,
link share, final punctuation, kind) are fitted: blocks that the markup itself places inside or outside the article, on a
bounded sample of pages, are the labelled rows of a logistic regression, which is drawn towards the weights given here where
they say little. What the markup says of a block comes on top. Neighbouring blocks, and blocks that follow each other under
the same parent element, are tied by smoothness edges. A maximum flow separates the two sides at least cost; blocks on the
content side are the main text.

Defined cases: null html is empty; a page without content blocks has empty text; a page of any length is read whole, in time
linear in its length but for the cut; repeated pages and ids are separate rows with equal texts; broken markup never fails
(unclosed paragraphs and rows end where the next begins, stray end tags are ignored, an unfinished tag is text, an element
that is not shown and has no end tag is passed over, but scripts, styles, text areas and titles take the rest of the page as
in a browser); other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

def _token(attributes: str) -> re.Pattern:
    return re.compile(rf"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)({attributes})>|</([a-zA-Z][^\s>]*+)[^>]*+>|<[!?/][^>]*+>|[^<]++|<""", re.S)


#: The pieces of a page. Once a quote is not closed before the end, quotes mean nothing from there on, so no search is repeated.
TOKEN = _token(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
LOOSE_TOKEN = _token(r"[^>]*+")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")

# Kinds of elements and words of class, id and role attributes.
#: Their text is never shown as prose.
SKIPPED = set("script style noscript template iframe object svg math canvas audio video select option textarea button title head datalist map".split())
#: Of these, without an end tag all the rest of a page is theirs; others without one are passed over.
RAW = set("script style textarea title".split())
#: They hold something beside the article.
BESIDE = set("nav footer aside form menu dialog".split())
ARTICLE = set("article main".split())
#: They begin and end a block.
BLOCK = set(
    "html body address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
ENDED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "option": {"option"}}
#: What may stand between the two without stopping the search.
FENCE = set("table ul ol dl div section article main body aside nav footer header form blockquote figure".split())
BESIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright dialog disclaimer discuss discussion disqus "
    "foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager paging pagination popup privacy promo promoted promotion recommend recommended recommendations related replies "
    "reply respond response responses search share sharing sidebar sidebars side signin signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toc toolbar topbar widget widgets complementary alert signup".split()
)
ARTICLE_WORDS = set("article articlebody post entry story main content body text prose".split())

#: Weights of the block score: those of a text's looks, to which fitted ones are drawn, and those of its surroundings.
LOOKS = {"base": -1.0, "log_words": 0.9, "sentence": 1.0, "links": -6.0, "prose_tag": 1.0}
PLACE = {"in_article": 3.0, "out_of_article": -3.0, "beside": -20.0}
#: Capacities of the smoothness edges, most that a text's looks count for, and most that a block's score is.
NEXT, SIBLING, MOST_LOOKS, MOST = 1.0, 0.75, 4.0, 8.0
#: Pages that a fit reads at most (those with the smallest hash), and blocks that it looks at.
MAX_PAGES, MAX_BLOCKS = 2_000, 50_000


def blocks(page: str) -> list[dict]:
    """The text blocks of a page in order: text, parent element, tag, linked characters, surroundings."""
    out: list[dict] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, number, beside, article
    buffer: list[str] = []
    linked = inside_link = number = 0
    has_article = False

    def flush() -> None:
        nonlocal linked
        raw = "".join(buffer)
        text = " ".join(entities.unescape(raw).split()) if "&" in raw else " ".join(raw.split())
        if text:
            tag, parent, beside, article = stack[-1]
            out.append({"text": text, "tag": tag, "parent": stack[-2][1] if tag in ("p", "li", "dt", "dd") or tag[:1] == "h" and tag[1:].isdigit() else parent, "linked": min(1.0, linked / max(1, len(raw.strip()))), "beside": beside, "article": article})
        buffer.clear()
        linked = 0

    at, end, last, token, unclosed = 0, len(page), page.rfind(">"), TOKEN, set()

    def after(tag: str) -> int:
        """Where the next end tag of a kind is, or -1; what isn't there is looked for once."""
        found = None if tag in unclosed else re.compile(f"</{tag}(?![a-z0-9-])", re.I | re.A).search(page, at)
        if found is None:
            unclosed.add(tag)
        return found.start() if found else -1

    while at < end:
        if at > last:  # no tag ends any more, and an unfinished one is text
            buffer.append(page[at:].partition("<!--")[0])
            break
        m = token.match(page, at)
        if len(m[0]) == 1 and m[0] == "<" and token is TOKEN and page[at + 1 : at + 2].isalpha():
            token = LOOSE_TOKEN
            m = token.match(page, at)
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in SKIPPED:
                if tag in ("head", "object", "map") or m[2].endswith("/"):
                    continue
                stop = after(tag)
                if stop >= 0 or tag in RAW:
                    at = end if stop < 0 else stop
                continue
            beside = article = False
            hidden = False
            words: set[str] = set()
            if m[2] and "=" in m[2] or "hidden" in m[2]:
                for a in ATTRIBUTE.finditer(m[2]):
                    name, value = (a[1] or a[3]).lower(), (a[2] or "").strip("\"'").lower()
                    if name in ("class", "id", "role"):
                        words.update(re.findall(r"[a-z]+", value))
                    elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                        hidden = True
            if tag == "a":  # an open link ends where the next begins
                inside_link = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "a":
                        flush()
                        del stack[k:]
                        break
                    if stack[k][0] in FENCE:
                        break
            if tag in BLOCK or words & BESIDE_WORDS or hidden:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if tag in ENDED_BY.get(stack[k][0], ()):
                        del stack[k:]
                        break
                    if stack[k][0] in FENCE:
                        break
                if tag in VOID:
                    continue
                _, _, above_beside, above_article = stack[-1]
                article = above_article or tag in ARTICLE
                has_article |= tag in ARTICLE
                beside = above_beside or hidden or tag in BESIDE or tag == "header" and not above_article or bool(words & BESIDE_WORDS) and tag not in ("html", "body", "article", "main") and not (words & {"article", "articlebody"})
                number += 1
                stack.append((tag, number, beside, article))
            elif tag == "a":
                inside_link += 1
        elif m[3]:
            tag = m[3].lower()
            if tag == "a" and inside_link:
                inside_link -= 1
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        flush()
                        del stack[k:]
                        inside_link = 0
                        break
                else:
                    if tag in BLOCK:
                        flush()
        elif m[0][0] != "<" or len(m[0]) == 1:
            buffer.append(m[0])
            if inside_link:
                linked += len(m[0].strip())
    flush()
    for b in out:
        b["has_article"] = has_article
    return out


def looks(b: dict) -> tuple[float, float, float, float]:
    """What a block's text looks like: log of its words, ends like a sentence, share of links, kind of prose element."""
    prose = b["tag"] in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
    return math.log1p(b["text"].count(" ") + 1), float(b["text"][-1] in ".!?…:;\"'»”)"), b["linked"], float(prose)


def placed(b: dict) -> int | None:
    """What the markup alone says of a block: content 1, beside the article 0, nothing None."""
    if b["beside"]:
        return 0
    return int(b["article"]) if b["has_article"] else None


def score(b: dict, weights: dict[str, float] = LOOKS) -> float:
    """Log-odds that a block is content, within plus and minus ``MOST``."""
    s = weights["base"] + sum(weights[k] * x for k, x in zip(("log_words", "sentence", "links", "prose_tag"), looks(b)))
    s = max(-MOST_LOOKS, min(MOST_LOOKS, s))
    if b["has_article"]:
        s += PLACE["in_article" if b["article"] else "out_of_article"]
    s += PLACE["beside"] * b["beside"]
    return max(-MOST, min(MOST, s))


def fitted(x: np.ndarray, y: np.ndarray, most: float = 100.0, doubt: float = 10.0) -> dict[str, float]:
    """Weights of a logistic regression in which both labels count alike, drawn towards ``LOOKS``.

    All blocks together count for ``most`` of them: pages of one make are alike, and their looks need not be those of others.
    """
    if not 0 < y.mean() < 1:
        return dict(LOOKS)
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * min(1.0, most / len(y))
    start = np.array(list(LOOKS.values()))
    beta = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (each * (y - p)) - doubt * (beta - start)
        beta += np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + doubt * np.eye(len(beta)), gradient)
    return dict(zip(LOOKS, map(float, beta)))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(*looks(b), y) for page in batch["html"] for b in blocks(page or "") if (y := placed(b)) is not None]
        yield pd.DataFrame(rows, columns=["x1", "x2", "x3", "x4", "y"])


def fit(pages: DataFrame, html: str = "html", max_pages: int = MAX_PAGES, max_blocks: int = MAX_BLOCKS) -> dict[str, float]:
    """Weights of a block's looks, from the blocks that the markup places, in at most so many pages and blocks."""
    hashed = pages.select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    highest = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").limit(max_pages).agg(F.max("h").alias("h")).first()["h"]
    if highest is None:
        return dict(LOOKS)
    sample = hashed.where(F.col("h") <= highest).select("html").mapInPandas(_measured, "x1 double, x2 double, x3 double, x4 double, y int")
    names = ["x1", "x2", "x3", "x4", "y"]
    rows = sample.orderBy(F.xxhash64(*names), *names).limit(max_blocks).toPandas()  # numbers only; repeated pages are bounded here
    return fitted(rows[names[:4]].to_numpy(float), rows["y"].to_numpy(float)) if len(rows) else dict(LOOKS)


def min_cut(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    ``own`` is each node's net terminal capacity: from the source if positive, to the sink if negative. Flow is sent along
    shortest paths from nodes with something left to nodes that still take something.
    """
    left = list(own)
    if all(x > 0 for x in left) or all(x <= 0 for x in left):
        return [x > 0 for x in left]
    near: list[dict[int, float]] = [{} for _ in left]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    for start in range(len(left)):
        while left[start] > 1e-9:
            came, todo, end = {start: start}, deque([start]), -1
            while todo and end < 0:
                x = todo.popleft()
                for y, c in near[x].items():
                    if c > 1e-9 and y not in came:
                        came[y] = x
                        if left[y] < -1e-9:
                            end = y
                            break
                        todo.append(y)
            if end < 0:
                break
            flow, y = min(left[start], -left[end]), end
            while y != start:
                flow, y = min(flow, near[came[y]][y]), came[y]
            left[start] -= flow
            left[end] += flow
            y = end
            while y != start:
                x = came[y]
                near[x][y] -= flow
                near[y][x] += flow
                y = x
    side = [x > 1e-9 for x in left]
    todo = deque(i for i, s in enumerate(side) if s)
    while todo:
        x = todo.popleft()
        for y, c in near[x].items():
            if c > 1e-9 and not side[y]:
                side[y] = True
                todo.append(y)
    return side


def main_text(page: str | None, weights: dict[str, float] = LOOKS) -> str:
    """The content blocks of a page, joined by single spaces.

    Neighbours of one parent that lean to the same side are one node, so a long page has few.
    """
    found = blocks(page or "")
    nodes: list[tuple[int, float]] = []
    of_block = []
    for b in found:
        s = score(b, weights)
        if nodes and nodes[-1][0] == b["parent"] and (nodes[-1][1] > 0) == (s > 0):
            nodes[-1] = (b["parent"], nodes[-1][1] + s)
        else:
            nodes.append((b["parent"], s))
        of_block.append(len(nodes) - 1)
    edges, last = [], {}
    for i, (parent, _) in enumerate(nodes):
        if i:
            edges.append((i - 1, i, NEXT))
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    kept = min_cut([s for _, s in nodes], edges)
    return " ".join(b["text"] for b, i in zip(found, of_block) if kept[i])


def extract(html: Column, weights: dict[str, float] = LOOKS) -> Column:
    """Main text of an html column."""

    @F.pandas_udf(T.StringType())
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return texts(html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_page_text``: the main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", "url", extract(F.col("html"), fit(pages)).alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
