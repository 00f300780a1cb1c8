"""HTML extraction: minimum-cut labelling of a page's text blocks.

A page is read once into blocks (runs of text between block-level tags), each with its place in the tree, its containers'
kind and its text's shape. A logistic classifier, trained here on blocks of seeded made-up layouts, gives each block the
log-odds of being content; they become terminal capacities. Neighbours in page order and consecutive blocks of one parent
are joined by smoothness edges that weaken with tree distance. The minimum cut separates content from boilerplate. Blocks
whose own capacity outweighs all their edges are settled first, which is exact; max-flow (Dinic) decides what is left.

Defined cases: a null or empty html, or one without text, has empty text; whole pages are read, whatever their length;
``<br>`` and tags between words of one block are white space or nothing as in browsers; unclosed elements end with their
parents; scripts, styles, comments, titles and what stands in a template, iframe or textarea that is closed are never
text, an unclosed script or style runs to the page's end; a quote that never closes is none, and a tag without an end is
text; any page takes time in proportion to its length; a null page_id or url and repeated rows stay; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
RAW = frozenset("script style template iframe textarea title".split())
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK = frozenset("html head body p div section article main aside nav header footer ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend label button select option h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hr address details summary dialog menu center".split())
VOID = frozenset("hr br img input meta link base col source wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu button select option dialog fieldset label head".split())
CONTENT_WORDS = frozenset("article content main post entry story text body articlebody maincontent blog page".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar foot footer header masthead banner sidebar side aside complementary contentinfo ad ads advert adverts advertisement sponsor sponsored promo promoted cookie cookies consent gdpr notice notices alert comment comments "
    "commentlist disqus reply replies respond discussion share sharing social related recommended widget breadcrumb breadcrumbs popup modal dialog newsletter subscribe subscription signup login search copyright legal toolbar pagination pager tags skip".split()
)
#: Smoothness of neighbours at tree distance 0.
SMOOTH = 1.5


@cache
def _words(value: str) -> frozenset:
    return frozenset(x.lower() for x in PART.findall(value))


def kind(tag: str, attributes: str) -> int:
    """1: a container of content, -1: of boilerplate, 0: of anything."""
    if tag in CONTENT_TAGS:
        found = 1
    elif tag in BOILER_TAGS:
        return -1
    else:
        found = 0
    if attributes and "=" in attributes and tag not in ("body", "html"):
        words = frozenset().union(*(_words(a or b or c) for a, b, c in ATTRIBUTE.findall(attributes)))
        if words & BOILER_WORDS:
            return -1
        if words & CONTENT_WORDS:
            return 1
    if tag == "header" and not found:
        return -2  # boilerplate unless in an article
    return found


class Place:
    """An element in the tree: its parent, and how deep it lies."""

    __slots__ = ("depth", "parent")

    def __init__(self, parent: Place | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("inside", "linked", "outside", "place", "tag", "text", "within")

    def __init__(self, text: str, linked: int, tag: str, place: Place, within: bool, inside: bool, outside: bool):
        self.text, self.linked, self.tag, self.place, self.within, self.inside, self.outside = text, linked, tag, place, within, inside, outside


def tokens(page: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """The page's markup in order: start, end, "/" of a closing tag, the tag's name (None for what is no tag or is dropped with
    its content), its attributes. One pass: what a search has found missing is not searched for again."""
    at, n = 0, len(page)
    ends: dict[str, re.Pattern] = {}
    missing: set[str] = set()  # raw elements without an end from here on
    lost: set[int] = set()  # marks outside quotes from which no tag ends
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!--", "<![CDATA["), at):
            end = page.find(*(("-->", at + 4) if page[at + 2] == "-" else ("]]>", at + 9)))
            yield at, n if end < 0 else end + 3, "", None, ""
            at = n if end < 0 else end + 3
            continue
        name, close = NAME.match(page, at), page.find(">", at)
        if close < 0:  # nothing ends any more; an open script or style goes on to the page's end
            return
        if not name:
            if page.startswith(("<!", "<?"), at):
                yield at, close + 1, "", None, ""
                at = close
            at += 1
            continue
        tag = name[2].lower()
        if tag in RAW and not name[1] and name.end() < n and not (page[name.end()].isalnum() or page[name.end()] == "_"):
            end = close + 1
            if page[close - 1] != "/":
                found = None if tag in missing else ends.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(page, end)
                if found:
                    end = found.end()
                else:
                    missing.add(tag)
                    end = n if tag in ("script", "style") else -1
            if end >= 0:
                yield at, end, "", None, ""
                at = end
                continue
        # the first > outside quotes; a quote that never closes makes the next > the end
        mark, seen = MARK.search(page, name.end()), []
        while mark and mark[0] != ">" and mark.start() not in lost:
            seen.append(mark.start())
            quote = page.find(mark[0], mark.end())
            mark = MARK.search(page, quote + 1) if quote >= 0 else None
        if mark and mark[0] == ">":
            close = mark.start()
        else:
            lost.update(seen)
        yield at, close + 1, name[1], tag, page[name.end() : close].rstrip("/")
        at = close + 1


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks, decoded and with single spaces."""
    found: list[Block] = []
    # open block elements: tag, place, in content, boilerplate since the innermost content, boilerplate around it
    stack: list[tuple[str, Place, bool, bool, bool]] = [("", Place(None), False, False, False)]
    count: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def close(i: int) -> None:
        count.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                found.append(Block(text, linked, top[0], top[1], top[2], top[3], top[4]))
            parts.clear()
        linked = 0

    for start, stop, closing, tag, attributes in tokens(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = stop
        if tag is None:
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        end()
        if closing:
            if count[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in VOID:
            continue
        # an unclosed paragraph or item ends where its next begins, and a paragraph at any block
        if stack[-1][0] == "p" or stack[-1][0] in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1][0] == tag:
            close(len(stack) - 1)
        elif tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "select", "menu", "div", "nav") or tag in ("td", "th") and stack[i][0] == "tr":
                    break
        top, k = stack[-1], kind(tag, attributes)
        within, inside, outside = top[2:]
        if k == -2:
            k = 0 if within else -1
        if k > 0 and not inside:
            within, outside, inside = True, outside or inside, False
        elif k < 0:
            inside = True
        stack.append((tag, Place(top[1]), within, inside, outside))
        count[tag] += 1
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    end()
    return found


FEATURES = ("one", "within", "inside", "outside", "linked", "length", "sentences", "heading", "paragraph", "item", "legal")
#: A notice of rights, in a block of at most so many characters.
LEGAL, LEGAL_CHARS = re.compile(r"\u00a9|\(c\) ?(?:19|20)\d\d|\bcopyright\b|\ball rights reserved\b", re.I), 300
ENDS = re.compile(r"[.!?](?:\s|$)")


def shape(block: Block) -> list[float]:
    n = len(block.text)
    return [
        1.0, block.within, block.inside, block.outside and not block.within, min(1.0, block.linked / n), min(6.0, np.log1p(n)) / 6, sum(1 for _ in islice(ENDS.finditer(block.text), 3)) / 3,
        block.tag in HEADING, block.tag in ("p", "blockquote", "pre"), block.tag in ("li", "td", "th", "dt", "dd"), n <= LEGAL_CHARS and bool(LEGAL.search(block.text)),
    ]


def made_up(seed: int, pages: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of seeded layouts: the words CONTENT and BOILER in a block tell its label."""
    rnd = random.Random(seed)
    xs, ys = [], []

    def text(word: str, low: int, high: int) -> str:
        words = [rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet,", "magna.", "aliqua!"]) for _ in range(rnd.randint(low, high))]
        return " ".join([word, *words]) + rnd.choice([".", ".", ""])

    def boiler() -> str:
        inner = rnd.choice([lambda: "".join(f"<li><a href=x>{text('BOILER', 0, 4)}</a></li>" for _ in range(rnd.randint(2, 8))), lambda: f"<p>{text('BOILER', 1, 40)}</p>", lambda: text("BOILER", 1, 25), lambda: f"<p>{rnd.choice(['\u00a9 2021', 'Copyright 2020', '(c) 2019'])} {text('BOILER', 0, 6)}</p>", lambda: f"<h3>{text('BOILER', 0, 4)}</h3><p>{text('BOILER', 4, 60)}</p>"])()
        tag, name = rnd.choice([("nav", ""), ("footer", ""), ("aside", ""), ("header", ""), ("form", ""), *[("div", w) for w in ("ad", "sidebar", "comments", "cookie-notice", "share", "related-posts", "menu")], ("div", "bottom"), ("div", "x7"), ("div", ""), ("ul", "")])
        return f"<{tag}{f' class={name}' if name else ''}>{inner}</{tag}>" if (tag, name) != ("div", "") else f"<div><a href=x>{text('BOILER', 1, 6)}</a></div>"

    def article() -> str:
        inner = [f"<h1>{text('CONTENT', 1, 10)}</h1>"]
        for _ in range(rnd.randint(1, 9)):
            inner.append(rnd.choice([f"<p>{text('CONTENT', 0, 120)}</p>"] * 6 + [f"<h2>{text('CONTENT', 0, 6)}</h2>", f"<ul><li>{text('CONTENT', 0, 12)}</li></ul>", f"<blockquote>{text('CONTENT', 3, 30)}</blockquote>", f"<p><a href=x>{text('CONTENT', 1, 5)}</a> {text('', 3, 30)}</p>"]))
            if rnd.random() < 0.12:
                inner.append(rnd.choice(["<div class=ad>%s</div>", "<aside>%s</aside>", "<div class=comments><p>%s</p></div>", "<footer>%s</footer>"]) % text("BOILER", 2, 50))
        before, after = rnd.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post-content>", "</div>"), ("<div class=k2>", "</div>"), ("<div>", "</div>")])
        return before + "".join(inner) + after

    for _ in range(pages):
        page = "".join(boiler() for _ in range(rnd.randint(0, 4))) + article() + "".join(boiler() for _ in range(rnd.randint(0, 4)))
        if rnd.random() < 0.15:  # a wrapper of the whole page that is called like content
            page = f"<div class={rnd.choice(['page-wrapper', 'main', 'site-content'])}>{page}</div>"
        for block in blocks(page):
            xs.append(shape(block))
            ys.append("CONTENT" in block.text)
    return np.array(xs, float), np.array(ys, float)


@cache
def weights(seed: int = 3) -> tuple[float, ...]:
    """The classifier: logistic regression by Newton's method with a small ridge."""
    x, y = made_up(seed)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    return tuple(w.tolist())


def distance(a: Place, b: Place) -> int:
    """Steps between two blocks' elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and consecutive blocks below one parent that aren't neighbours."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, smooth / (1 + distance(found[i - 1].place, block.place))))
        parent = block.place.parent
        before = last.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, smooth / (1 + distance(found[before].place, block.place))))
        last[parent] = i
    return out


def minimum_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side: the labelling of least cost, unary[i] being paid when a positive node is cut off
    from the source (a negative one from the sink) and each link's weight when its ends differ. Ties go to the sink."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    pull = list(unary)
    rest = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # a node that outweighs its open edges is settled, and pulls its neighbours
        i = queue.popleft()
        if label[i] is not None or (abs(pull[i]) < rest[i] if pull[i] > 0 else -pull[i] < rest[i]) or pull[i] == 0 and rest[i] > 0:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                pull[j] += w if label[i] else -w
                rest[j] -= w
                queue.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        side = _max_flow(open_, pull, near, label)
        for i in open_:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(open_: list[int], pull: list[float], near: list[dict[int, float]], label: list[bool | None]) -> set[int]:
    """Dinic on the open nodes; returns those reachable from the source in the residual graph."""
    place = {i: k for k, i in enumerate(open_)}
    source, sink = len(open_), len(open_) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(open_) + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in open_:
        if pull[i] > 0:
            add(source, place[i], pull[i], 0.0)
        elif pull[i] < 0:
            add(place[i], sink, -pull[i], 0.0)
        for j, w in near[i].items():
            if i < j and label[j] is None:
                add(place[i], place[j], w, w)
    least = 1e-12
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {i for i in open_ if level[place[i]] >= 0}
        turn = [0] * len(out)
        path: list[int] = []
        a = source
        while True:  # blocking flow by walking forward and stepping back
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def extract(page: str | None, model: tuple[float, ...] | None = None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    if not found:
        return ""
    unary = (np.array([shape(b) for b in found], float) @ np.array(model or weights())).tolist()
    keep = minimum_cut(unary, edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    model = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
