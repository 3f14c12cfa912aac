"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from paywright.llm.common import arrow_batches

#: Markup of a page: comments, declarations and tags. Quoted attribute values may hold a ">"; a quote without a partner is
#: a character like others. The loop over a tag gives nothing back, so a page is scanned once, or once in vain to its end.
_OTHERS = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
MARKUP = re.compile(_OTHERS + "|" + _NAME + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
#: The same where quotes do not close before the page ends: a tag then ends at the next ">".
BROKEN_MARKUP = re.compile(_OTHERS + "|" + _NAME + r"([^>]*+)>", re.S)
TAG_START = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")

#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are never part of an article.
DROPPED = {
    "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "template", "svg", "canvas",
    "audio", "video", "object", "datalist", "fieldset",
} | RAW
#: Elements that start and end a block of text.
BLOCKS = {
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
    "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "hr",
    "address", "center", "details", "summary",
} | DROPPED
#: Roles of elements around an article.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of class and id values that name what is around an article, and words that only say what shape it has.
AROUND = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner "
    "banners cookie cookies consent gdpr notice notices popup popups modal modals overlay overlays sidebar sidebars widget widgets related "
    "recommended recommendations comment comments commentlist disqus replies respond share sharing social newsletter subscribe subscription "
    "signup breadcrumb breadcrumbs pagination pager nav navs navbar navigation menu menus topbar toolbar masthead footer footers header headers "
    "outbrain taboola".split()
)
SHAPES = set("area bar block bottom box buttons container content entry inner items left links list panel posts right section site slot stories top unit wrap wrapper".split())
WORDS = re.compile(r"[\s_-]+")
#: What a container loses for a class or id that holds a word of ``AROUND`` among others.
DOUBT = -25.0
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An open element that a new one of these ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote"}
START = {"article": 30.0, "main": 30.0, "section": 3.0, "div": 2.0, "td": 1.0, "blockquote": 1.0, "pre": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
MIN_CHARS = 25
COMMAS = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "up", "out", "doubt", "link", "score", "chars", "linked", "article")

    def __init__(self, tag: str, up: Node | None, out: bool, link: bool, doubt: bool = False):
        self.tag, self.up = tag, up
        self.doubt = doubt
        #: The outermost article or main element around, or this one.
        self.article: Node | None = (up.article if up else None) or (self if tag in ("article", "main") else None)
        self.out = out
        self.link = link
        self.score: float | None = None
        self.chars = self.linked = 0


def _is_around(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is surely not part of an article, and whether its class or id makes that likely.

    Sure are the elements that are made for it, hidden ones, and classes that say nothing else: ``cookie-notice``, but
    not ``related-work`` or ``side-by-side``.
    """
    if tag in DROPPED:
        return True, True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    doubt = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id"):
            for token in value.lower().split():
                words = [w for w in WORDS.split(token) if w]
                if not AROUND.isdisjoint(words):
                    if all(w in AROUND or w in SHAPES or w.isdigit() for w in words):
                        return True, True
                    doubt = True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "style" and HIDDEN.search(value):
            return True, True
        elif name == "aria-hidden" and value.lower() == "true":
            return True, True
    return False, doubt


def blocks_of(page: str) -> list[tuple[Node, str]]:
    """Blocks of text in page order, each with the block element that holds it; what is around articles is left out."""
    root = Node("root", None, False, False)
    stack = [root]
    found: list[tuple[Node, str]] = []
    nodes: list[Node] = []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    markup = MARKUP

    def flush(holder: Node) -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                found.append((holder, whole))
                holder.chars += len(whole)
                holder.linked += min(linked, len(whole))
            text.clear()
        linked = 0

    def holder() -> Node:
        node = stack[-1]
        while node.up is not None and node.tag not in BLOCKS:
            node = node.up
        return node

    def close(depth: int) -> None:
        if any(n.tag in BLOCKS for n in stack[depth:]):
            flush(holder())
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not stack[-1].out:
            text.append(page[at:lt])
            if stack[-1].link:
                linked += lt - at
        if lt == size:
            break
        mark = markup.match(page, lt)
        if mark is None and TAG_START.match(page, lt):
            if page.find(">", lt) < 0:  # no tag ends any more
                if not stack[-1].out:
                    text.append(page[lt:])
                break
            markup = BROKEN_MARKUP
            mark = markup.match(page, lt)
        if mark is None:
            if not stack[-1].out:
                text.append("<")
            at = lt + 1
            continue
        at = mark.end()
        tag = mark[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "img" or tag == "hr" and mark[1]:
            text.append(" ")
            continue
        if mark[1]:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in FENCE and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            flush(holder())
            # A block ends the paragraph it starts in, with whatever inline elements are still open there.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ENDS[tag]:
                    close(depth)
                    break
                if stack[depth].tag in FENCE:
                    break
        top = stack[-1]
        out, doubt = _is_around(tag, mark[3])
        node = Node(tag, top, top.out or out, top.link or tag == "a", doubt)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 if end else size
            at = at or size
        elif tag not in VOID and not (mark[3].endswith("/") and tag not in BLOCKS):
            stack.append(node)
            nodes.append(node)
            open_tags[tag] += 1
    flush(holder())
    for node in reversed(nodes):  # children come behind their parents
        node.up.chars += node.chars
        node.up.linked += node.linked
    return found


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none.

    A paragraph of 25 characters or more gives 1 point, 1 for each comma and up to 3 for its length to its parent, half
    to the grandparent and a third of that for each step above. Scores count less the more of an element's text stands
    in links. The best element is kept, or the article or main element around it, with those siblings that score a
    fifth of it or are paragraphs by themselves. Without any scored element all blocks are kept.
    """
    if not page:
        return ""
    blocks = blocks_of(page)
    scored: list[Node] = []
    for node, text in blocks:
        if len(text) < MIN_CHARS:
            continue
        points = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
        up = node.up if node.tag not in ("div", "article", "main", "section", "body", "root") else node
        share = 1.0
        level = 0
        while up is not None and level < 6:
            if up.score is None:
                up.score = START.get(up.tag, 0.0) + (DOUBT if up.doubt else 0.0)
                scored.append(up)
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else share / 3
            up = up.up
    if not scored:
        inside = any(n.article is not None for n, _ in blocks)
        return "\n".join(t for n, t in blocks if not inside or n.article is not None)
    value = {id(n): n.score * (1 - n.linked / max(1, n.chars)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    top = best.article or best
    limit = max(10.0, 0.2 * value[id(best)])
    kept: dict[int, bool] = {}
    sides: dict[int, Node | None] = {}
    out = []
    for node, text in blocks:
        # The child of the best element's parent that holds the block, if there is one.
        side: Node | None = node
        passed = []
        while side is not None and side is not top and side.up is not top.up:
            if id(side) in sides:
                side = sides[id(side)]
                break
            passed.append(id(side))
            side = side.up
        sides.update(dict.fromkeys(passed, side))
        if side is None:
            continue
        if id(side) not in kept:
            density = side.linked / max(1, side.chars)
            kept[id(side)] = (
                side is top
                or (top.tag == "article" and side.tag == "article")
                or (top.tag not in ("article", "main") and (value.get(id(side), 0) >= limit or (side.tag == "p" and (side.chars > 80 and density < 0.25))))
            )
        if kept[id(side)]:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty pages, and pages without text, give the empty text. Broken markup is read as far as it makes sense:
    unclosed elements end with what holds them. Nothing is cut off. Repeated rows and null ids stay.
    """
    arrow_batches(pages.sparkSession, rows=500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch.pop("html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", pages["html"].cast("string")).mapInPandas(run, f"{kinds}, text string, n_chars long")
