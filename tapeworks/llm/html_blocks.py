"""Leaf blocks of a page, read once from start to end in time that grows with its length.

A leaf block is the text between two block boundaries. Its place is a node that it shares with other blocks: the innermost open
element, which knows of all its ancestors what a feature asks. Reading is forgiving: open paragraphs, list items and cells end where
the next one begins, a closing tag ends all that is open inside its element, one that closes nothing is passed over, and what
never closes ends with the page. A tag whose quotes don't pair up before the next ``<`` ends at its first ``>``, or there.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict

#: A tag with paired quotes. No part of it gives back what it took, so that a failed match reads on to the next ``<`` at most, or over one quoted text.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "textarea", "canvas", "math", "datalist"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
#: Elements that part blocks.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: What a new element ends, if it is the innermost open block.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
TAGS = "article main section nav header footer aside form ul ol li table td h1 h2 h3 p div a button label select figure blockquote pre details dl".split()
#: Kinds of words in class, id and role, by their first letters.
KINDS = {
    "advert": ("ad", "ads", "advert", "advertisement", "adv", "sponsor", "sponsored", "promo", "banner", "outbrain", "taboola"),
    "comments": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "thread", "responses"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "modal", "popup", "overlay", "privacy", "paywall", "toast"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommend", "recommended", "complementary", "trending", "popular", "recirc"),
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "tabs", "toolbar", "pagination", "pager", "toc", "skip"),
    "head": ("header", "masthead", "topbar", "logo", "branding"),
    "foot": ("footer", "foot", "copyright", "colophon", "legal", "contentinfo", "bottom"),
    "form": ("form", "login", "signup", "subscribe", "newsletter", "search", "contact"),
    "share": ("share", "social", "follow"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text", "prose"),
}
KIND_OF = {w: i for i, words in enumerate(KINDS.values()) for w in words}
MAIN = list(KINDS).index("main")
TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
#: Elements that hold runs of blocks.
CONTAINERS = set("article aside body center details dialog div fieldset footer form header main menu nav section td".split())
CORE, OFF = {"article", "main"}, {"nav", "footer", "aside", "form"}


@functools.lru_cache(maxsize=4096)
def kinds_of(attributes: str) -> tuple[int, bool]:
    """The kinds of words in an element's attributes, as bits, and whether it isn't shown."""
    bits, unseen = 0, False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "style" or name == "hidden":
            unseen |= name == "hidden" or bool(UNSEEN.search(value))
        else:
            for part in PART.findall(value):
                kind = KIND_OF.get(part.lower())
                bits |= 0 if kind is None else 1 << kind
    return bits, unseen


class Node:
    """An open element: what it and its ancestors are."""

    __slots__ = ("tag", "tags", "kinds", "nearest", "core", "off", "hides", "home")

    def __init__(self, tag: str, kinds: int, unseen: bool, above: Node | None):
        self.tag, self.hides = tag, unseen or tag in HIDDEN
        self.tags = TAG_BIT.get(tag, 0) | (above.tags if above else 0)
        self.kinds = kinds | (above.kinds if above else 0)
        #: Of the innermost ancestor that has any.
        self.nearest = kinds or (above.nearest if above else 0)
        #: Inside an article or main; inside a menu, footer, side column or form that stands in it, or where there is none.
        self.core = tag in CORE or bool(above and above.core)
        self.off = tag not in CORE and (tag in OFF or bool(kinds & ~(1 << MAIN)) or bool(above and above.off))
        self.home = self if above is None or tag in CONTAINERS else above.home


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """Leaf blocks as (text, innermost open element, characters inside links)."""
    found: list = []
    root = Node("", 0, False, None)
    stack, edges = [root], []  # open elements, and the places of those that part blocks
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
    pieces: list[str] = []
    linked = hidden = at = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((text, stack[-1], linked))
            pieces.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text and not hidden:
            pieces.append(text)
            if places["a"]:
                linked += len(text)

    def pop_to(place: int):
        nonlocal hidden
        while len(stack) > place:
            node = stack.pop()
            places[node.tag].pop()
            hidden -= node.hides
            if edges and edges[-1] == len(stack):
                edges.pop()

    while (here := page.find("<", at)) >= 0:
        add(page[at:here])
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), here):
            end = page.find(">", here)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG.match(page, here) or BROKEN.match(page, here)
        if not m:
            add("<")
            at = here + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            elif places[tag]:
                place = places[tag][-1]
                crossing = bool(edges) and edges[-1] > place
                if tag in BLOCKS or crossing:
                    if tag not in BLOCKS and tag != "a" and not stack[place].hides:
                        continue  # a mark-up of text around blocks ends with the block that it stands in
                    flush()
                pop_to(place)
            elif tag == "p":
                flush()
            continue
        if tag == "br" or tag == "wbr":
            add(" " * (tag == "br"))
            continue
        if tag in BLOCKS:
            flush()
            ends = ENDS.get(tag, {"p"})
            while edges and stack[edges[-1]].tag in ends:  # inline elements left open end with the block that they stand in
                pop_to(edges[-1])
        if tag == "body" and places["head"]:
            flush()
            pop_to(places["head"][0])
        own = m[3]
        if tag in VOID or (own.endswith("/") and (len(own) == 1 or own[-2] in " \t\r\n\"'")):
            continue
        node = Node(tag, *(kinds_of(own) if own and not own.isspace() else (0, False)), stack[-1])
        if tag in BLOCKS:
            edges.append(len(stack))
        places[tag].append(len(stack))
        stack.append(node)
        hidden += node.hides
        if tag in RAW:
            end = closing(tag).search(page, at)
            at = end.end() if end else len(page)
            pop_to(len(stack) - 1)
    add(page[at:])
    flush()
    return found


@functools.lru_cache(maxsize=16)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)
