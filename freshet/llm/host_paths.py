"""Main texts of web pages by the container paths that a host's pages agree on.

Each page scores its containers and votes for the path of the best one, tags
and classes without numbers.  Votes are added up by host, and every page is
extracted again from the containers at its host's winning paths; a page without
any of them falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.base import salted_join, shipped_by_value, stored

shipped_by_value(__name__)

#: A path wins if it has this share of its host's votes, so a host has at most ten.
LEAST_SHARE = 0.1
#: Winning paths of so many hosts, each under ``LONGEST`` characters, are broadcast; those of more are joined.
SENT_HOSTS = 10_000
#: What a text counts less for a container with every level between them.
DECAY = 0.8
#: Deepest nesting and longest path; elements beyond count as part of what holds them.
DEEPEST, LONGEST = 200, 300

# Element names of HTML by what they mean for a text.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("article body center div main section td".split())
SKIPPED = frozenset("""aside audio button canvas dialog footer form head header label math menu nav noscript object select svg
template video""".split())
#: An opening tag ends an open element of the first kinds, if none of the second stands between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
        "th": ("td th", "tr table"), "option": ("option", "select")}
# Words of classes, ids and roles.
NOISE = frozenset("""ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist
complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr header masthead menu modal nav navbar
navigation newsletter notice notices overlay pagination pager popup promo promos promotion promoted recommendation recommendations
recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe
subscription teaser teasers toc toolbar widget widgets""".split())
READERS = frozenset("comment comments commentlist discussion disqus related recommended replies reply respond sidebar teaser teasers".split())
CONTENT = frozenset("article body content entry main post story text".split())
STATES = frozenset("has no with without is".split())
#: Elements that a class can make noise; cells, rows and headings of an article are its own, whatever they are called.
NAMED = frozenset("article aside blockquote center dd details div dl dt fieldset figure footer form header li menu nav ol p section span table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}


class Element:
    """An element of the structure: where it stands, and what speaks against it.

    ``left_out`` elements have no text of the article.  ``doubtful`` ones are left
    out unless an article stands inside; a ``header`` of an article keeps its headings.
    """

    __slots__ = ("tag", "path", "parent", "left_out", "doubtful", "header", "holds_article", "in_article", "weight", "score", "chosen")

    def __init__(self, tag: str, parent: Element | None, path: str = ""):
        self.tag, self.parent, self.path = tag, parent, path
        self.left_out = self.doubtful = self.header = self.holds_article = self.chosen = False
        self.in_article = parent is not None and parent.in_article
        self.weight, self.score = 1.0, 0.0


def _opened(tag: str, attributes: str, parent: Element) -> Element:
    """The element of an opening tag."""
    element, name = Element(tag, parent), tag
    element.header = tag == "header"
    element.left_out = tag in SKIPPED and tag not in ("form", "header")
    element.doubtful = tag in ("form", "header")
    if tag in ("article", "main"):
        element.weight, element.in_article = 1.5, True
    elif tag == "body":
        element.weight = 0.7
    if attributes and not attributes.isspace():
        found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
            element.left_out = True
        for one in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split():
            words = [w.lower() for w in _WORD.findall(one)]
            if not words or words[0] in STATES:
                continue
            bad = {words[0], words[-1]} & NOISE
            if bad and tag in NAMED:
                if bad & READERS:
                    element.left_out = True
                element.doubtful = True
                element.header = element.header or "header" in bad
            if not CONTENT.isdisjoint(words):
                element.weight = max(element.weight, 1.2)
                element.in_article = element.in_article or "header" in bad
        kept = sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").split()} - {""})
        name = ".".join([tag, *kept])
    path = f"{parent.path}>{name}" if parent.path else name
    element.path = path if len(path) <= LONGEST else parent.path
    return element


def _end(stack: list[Element], tags, bounds) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in bounds:
            return


def parsed(page: str) -> tuple[list[tuple[str, float, Element]], list[Element]]:
    """The texts of a page in order, each with its share in links and its element, and the elements.

    Tags that only mark up a line are no part of the structure, so one left open
    takes nothing along.  Elements left open end with what holds them.
    """
    root = Element("", None)
    stack, elements, texts = [root], [root], []
    pieces, linked, in_link = [], 0, False

    def flush():
        nonlocal linked
        if pieces:
            whole = "".join(pieces)
            line = " ".join(entities.unescape(whole).split())
            if line:
                texts.append((line, linked / len(whole), stack[-1]))
            pieces.clear()
            linked = 0

    def say(text):
        nonlocal linked
        pieces.append(text)
        if in_link:
            linked += len(text)

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            if found.group().startswith("<![CDATA["):
                say(found.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not closing
        elif closing:
            if tag in BLOCKS or tag in SKIPPED or tag == "span":
                if any(e.tag == tag for e in stack):
                    flush()
                    _end(stack, {tag}, CONTAINERS if tag in ("p", "li", "span") else ())
                elif tag in ("p", "br"):
                    flush()
        elif tag in RAW:
            # Up to its own closing tag nothing in such an element is markup, and none of it is text.
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
        elif tag in BLOCKS or tag in SKIPPED:
            flush()
            if tag in VOID:
                continue
            if tag in ENDS:
                _end(stack, *(names.split() for names in ENDS[tag]))
            if tag in BLOCKS:
                _end(stack, {"p"} | HEADINGS if tag in HEADINGS else {"p"}, CONTAINERS | SKIPPED | {"li", "dd", "blockquote", "th"})
            if stack[-1].tag == "head" and tag not in ("noscript", "object", "template"):  # left open
                stack.pop()
            if len(stack) < DEEPEST and not (tag in SKIPPED and attributes.endswith("/")):
                stack.append(_opened(tag, attributes, stack[-1]))
                elements.append(stack[-1])
                if tag in ("article", "main"):
                    for above in stack[:-1]:
                        above.holds_article = True
        elif tag == "span" and attributes and len(stack) < DEEPEST:
            element = _opened(tag, attributes, stack[-1])
            if element.left_out or element.doubtful:
                flush()
                stack.append(element)
                elements.append(element)
    flush()
    for e in elements[1:]:
        e.left_out = e.left_out or e.parent.left_out or e.doubtful and not e.holds_article and not (e.header and e.in_article)
        e.header = (e.header and not e.holds_article) or e.parent.header
    return [t for t in texts if not t[2].left_out and (not t[2].header or t[2].tag in HEADINGS)], elements


def best_container(texts, elements: list[Element]) -> Element | None:
    """The container with the most text, less for text in links and for each level between; None without any text."""
    for line, share, element in texts:
        worth = len(line) * (1 - share)
        while element is not None:
            if element.tag in CONTAINERS or element.parent is None:
                element.score += worth
                worth *= DECAY
            element = element.parent
    best = max((e for e in elements if e.tag in CONTAINERS or e.parent is None), key=lambda e: e.score * e.weight)
    return best if best.score > 0 else None


def _said(texts, inside: list[Element], elements: list[Element], whole: bool) -> str:
    """The texts inside the chosen elements, in page order; of a whole page, lists that are links throughout are menus."""
    marked = {id(e) for e in inside}
    for e in elements:
        e.chosen = id(e) in marked or e.parent is not None and e.parent.chosen
    kept = [(line, share, e) for line, share, e in texts if e.chosen]
    if whole:
        lists = {}
        for line, share, e in kept:
            while e is not None and e.tag not in ("ul", "ol"):
                e = e.parent
            lists.setdefault(id(e) if e is not None else None, []).append(share)
        menus = {k for k, shares in lists.items() if k is not None and len(shares) > 1 and min(shares) > 0.9}

        def in_menu(e):
            while e is not None:
                if id(e) in menus:
                    return True
                e = e.parent
            return False
        kept = [t for t in kept if not in_menu(t[2])]
    return " ".join(line for line, _, _ in kept)


def vote(page: str | None) -> str | None:
    """The path of a page's best container."""
    best = best_container(*parsed(page or ""))
    return best.path if best is not None and best.path else None


def extract(page: str | None, winners: list[str]) -> str:
    """The text in the containers at the first of the winning paths that has any, else in the page's own best container."""
    texts, elements = parsed(page or "")
    there = False
    for path in winners:
        inside = [e for e in elements if e.path == path and e.tag and not e.left_out]
        there = there or bool(inside)
        if inside and (said := _said(texts, inside, elements, inside[0].tag == "body")):
            return said
    best = None if there else best_container(texts, elements)
    return "" if best is None else _said(texts, [best], elements, best.tag in ("", "body"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; NULL if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"host": batch["host"], "path": [vote(page) for page in batch["html"]]})


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [extract(page, [] if paths is None else list(paths)) for page, paths in zip(batch["html"], batch["paths"])]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): of each host the paths with ``LEAST_SHARE`` of its pages' votes, most first, ties by path."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host IS NOT NULL")
    votes = rows.mapInPandas(_votes, "host string, path string").filter("path IS NOT NULL")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "votes")
    enough = counts.join(counts.groupBy("host").agg((F.sum("n") * LEAST_SHARE).alias("least")), "host").filter("n >= least")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return enough.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page of (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one in page order; nothing else is dropped or cut.  A page
    without HTML (NULL or empty) or without text has an empty text.  Pages without
    a host agree with nobody and are extracted by their own best container.
    Repeated rows each give a row; further columns are left out.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    winners = stored(winning_paths(pages), "paths")
    if winners.count() <= SENT_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        joined = salted_join(rows, winners, ["host"], "page_id", "left")
    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "paths").mapInPandas(
        _extracted, f"page_id {kind}, url string, text string, n_chars long")
