"""Labelled pages to learn from: random layouts, with the texts of their main blocks.

A page is an article and a choice of other regions around and inside it. Every region is marked by its element, by a hint in its
class or id, or, for lists of links, not at all; the article stands in ``article`` or ``main``, in a hinted or a nameless ``div``, in
a table cell, or in the body itself. Words are random letters, so that no language is learnt. Some pages are foreign: no name of
theirs is a hint. Where the article has an element of its own, names outside it are left out at random, as its place tells all.
"""

from __future__ import annotations

import html
import random

LETTERS = "aaeeeiioourrtttnnsshhlldccmmfpgbvkywzéöñß"
NEUTRAL = ("box", "wrap", "row", "col", "inner", "outer", "container", "module", "layer", "panel", "unit", "c1", "x-2", "g12", "area", "cell", "grid", "left", "right", "clearfix")
HINTS = {
    "menu": ("menu", "navbar", "main-nav", "breadcrumbs", "site-navigation", "pager", "tabs"),
    "header": ("site-header", "masthead", "topbar", "branding", "page-header"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "page-bottom", "legal"),
    "side": ("sidebar", "widget", "related", "side-column", "trending", "popular-posts", "recommended"),
    "advert": ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot"),
    "notice": ("cookie-notice", "consent", "alert", "gdpr", "modal", "popup", "privacy-overlay", "paywall"),
    "form": ("search", "login", "newsletter", "subscribe", "contact-form", "signup"),
    "comments": ("comments", "discussion", "responses", "comment-list", "thread", "replies", "disqus"),
    "share": ("share", "social", "share-bar", "follow-us"),
    "main": ("content", "post-body", "article-content", "entry", "story", "main-text", "article-body", "prose"),
}


class Layout:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []
        self.longest = rng.choice((15, 25, 50, 90))  # words of a paragraph
        self.way = rng.random()
        self.core, self.inside = self.way < 0.5, False
        self.foreign = self.chance(0.25)
        self.style = rng.choice(("plain", "plain", "plain", "plain", "noisy", "shouting"))

    def pick(self, *options):
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    # text

    def word(self) -> str:
        return "".join(self.rng.choices(LETTERS, k=self.rng.choice((1, 2, 3, 3, 4, 4, 5, 6, 7, 9, 12))))

    def short(self, low=1, high=4) -> str:
        text = " ".join(self.word() for _ in range(self.rng.randint(low, high)))
        return self.pick(text, text.capitalize(), text.title())

    def prose(self, low=4, high=90) -> str:
        words, fresh = [], True
        for _ in range(self.rng.randint(low, high)):
            w = self.word()
            words.append(w.capitalize() if fresh else w)
            fresh = self.chance(0.1)
            words[-1] += "." if fresh else "," if self.chance(0.07) else ""
        text = " ".join(words)
        if self.style == "noisy":
            marks = self.rng.sample(("!!", "***", "###", "%%%", "~", "&&", "$$$", "=="), 3)
            text = " ".join(w + self.rng.choice(marks) * self.chance(0.7) for w in text.split())
        elif self.style == "shouting":
            text = text.upper()
        return text.rstrip(",.") + self.pick(".", ".", ".", ".", "!", "?", "", ":")

    def keep(self, text: str) -> str:
        """A text of the article, as it stands in the page."""
        self.main.append(" ".join(text.split()))
        return html.escape(text, quote=False) if "&" in text else text

    # regions

    def named(self, kind: str | None) -> str:
        unknown = self.foreign or (self.core and not self.inside and self.chance(0.35))
        names = self.rng.choice(NEUTRAL) if not kind else self.word() if unknown else self.rng.choice(HINTS[kind])
        if self.chance(0.4):
            names += " " + self.rng.choice(NEUTRAL)
        return self.pick(f' class="{names}"', f" class='{names}'", f' id="{names.split()[0]}"', f' data-x="{self.word()}" class="{names}"')

    def marked(self, kind: str, inner: str, tags: tuple = (), plain: bool = False) -> str:
        """The region in its own element, in one whose name hints at it, or both; ``plain`` ones may go unmarked."""
        way = self.rng.random()
        if tags and way < 0.45:
            tag = self.rng.choice(tags)
            return f"<{tag}{self.named(kind) if self.chance(0.3) else ''}>{inner}</{tag}>"
        if plain and way > 0.8:
            return f"<div{self.named(None) if self.chance(0.5) else ''}>{inner}</div>"
        tag = self.pick("div", "div", "div", "section", "ul" if inner.startswith("<li") else "div")
        inner = f"<div{self.named(None)}>{inner}</div>" if tag != "ul" and self.chance(0.2) else inner
        return f"<{tag}{self.named(kind)}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        made = [f'<a href="/{self.word()}">{self.short(1, 3)}</a>' for _ in range(n)]
        way = self.rng.random()
        if way < 0.6:
            close = self.pick("</li>", "</li>", "")
            return "<ul>" + "".join(f"<li>{a}{close}" for a in made) + "</ul>"
        return self.pick(" | ", " · ", " ").join(made) if way < 0.85 else "".join(f"<p>{a}</p>" for a in made)

    def menu(self) -> str:
        return self.marked("menu", self.links(self.rng.randint(3, 10)), ("nav", "nav", "menu"), plain=True)

    def header(self) -> str:
        if self.foreign and not self.core:
            return self.marked("header", self.pick(f"<a href='/'>{self.short()}</a>", f"<div>{self.short()}</div>{self.links(4)}"), ("header",))
        inner = self.pick(f"<a href='/'>{self.short()}</a>", f"<div>{self.short()}</div>{self.links(4)}", f"<h1>{self.short()}</h1><p>{self.prose(2, 12)}</p>", f"<p>{self.prose(2, 15)}</p>")
        return self.marked("header", inner, ("header",))

    def footer(self) -> str:
        if self.chance(0.3):  # a line in no element of its own
            return f"<p>{self.pick('&copy;', '©', '(c)', 'Copyright')} {self.rng.randint(1998, 2030)} {self.pick(self.short(), self.prose(2, 15))}</p>"
        mark = "" if self.foreign and self.chance(0.5) else self.pick("&copy; ", "© ", "Copyright ", "")
        inner = self.pick(f"{mark}2019 {self.short()} - {self.prose(3, 25)}", f"<p>{mark}{self.prose(3, 25)}</p>{self.links(3)}", f"<small>{mark}{self.short()}</small>", f"{mark}{self.short(2, 5)}, {self.short(1, 2)} {self.rng.randint(1, 99)}, {self.short(1, 1)}")
        return self.marked("footer", inner, ("footer", "footer", "footer"))

    def side(self) -> str:
        inner = f"<h3>{self.short()}</h3>" * self.chance(0.7) + self.pick(self.links(self.rng.randint(2, 7)), f"<p>{self.prose(4, 50)}</p>", f"<p>{self.prose(4, 30)}</p><p>{self.prose(4, 30)}</p>")
        return self.marked("side", inner, ("aside",))

    def advert(self) -> str:
        return self.marked("advert", self.pick(self.prose(2, 40), f"<p>{self.prose(2, 40)}</p>", f"<a href=//{self.word()}/>{self.prose(2, 15)}</a>"))

    def notice(self) -> str:
        return self.marked("notice", self.pick(f"<p>{self.prose(4, 35)}</p><button>{self.short(1, 2)}</button>", self.prose(4, 30), f"<p>{self.prose(4, 30)}</p>"))

    def form(self) -> str:
        fields = "".join(self.pick(f"<label>{self.short()}</label><input name=a>", f"<p>{self.prose(3, 25)}</p>", f"<label>{self.short()} <select><option>{self.short()}<option>{self.short()}</select></label>", f"<fieldset><legend>{self.short()}</legend><input></fieldset>", f"<textarea>{self.short()}</textarea>") for _ in range(self.rng.randint(1, 4)))
        return f"<form{self.named('form') if self.chance(0.4) else ''}>{fields}<button>{self.short(1, 2)}</button></form>"

    def comments(self) -> str:
        item = self.pick("li", "div", "div", "article" if self.chance(0.3) and not self.foreign and (self.inside or not self.core) else "div")
        name = self.pick(' class="comment"', " class=reply", "", f" class='{self.word()}'")
        one = lambda: f"<{item}{name}>{self.pick(f'<b>{self.short(1, 2)}</b>', f'<h4>{self.short(1, 2)}</h4>', '')}<p>{self.prose(3, 60)}</p></{item}>"
        inner = "".join(one() for _ in range(self.rng.randint(1, 5)))
        inner = self.pick(f"<ol>{inner}</ol>", f"<ul>{inner}</ul>") if item == "li" else inner
        head = f"<h3>{self.short()}</h3>" * self.chance(0.6)
        tag = self.pick("section", "div", "div", "details", "aside")
        return f"<{tag}{self.named('comments')}>{head}{inner}{self.form() if self.chance(0.3) else ''}</{tag}>"

    def share(self) -> str:
        return self.marked("share", self.links(self.rng.randint(2, 5)))

    # the article

    def paragraph(self) -> str:
        text, way = self.prose(4, self.longest), self.rng.random()
        if self.core and self.chance(0.08):  # what would be told by its text elsewhere
            text = self.pick(text, text, f"{self.pick('©', '(c)', 'Copyright')} 2019 {text}")
            return f"<p><a href='/{self.word()}'>{self.keep(text)}</a></p>" if text[0] not in "©(" else f"<p>{self.keep(text)}</p>"
        if way < 0.5:
            return f"<p>{self.keep(text)}{self.pick('</p>', '</p>', '</p>', '')}"
        if way < 0.6:
            open_, close = self.pick(("<b>", ""), ("<em>", "</em>"), ("<span>", "</span>"), ("<strong>", ""), ("<i>", "</i><br>"), ("<b>", "<br>"))
            return f"<p>{open_}{self.keep(text)}{close}"
        if way < 0.68:
            tag = self.pick("h2", "h3", "h4")
            return f"<{tag}>{self.keep(self.short(1, 8))}</{tag}>"
        if way < 0.75:
            tag = self.pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.prose(2, 30))}{self.pick('</li>', '')}" for _ in range(self.rng.randint(2, 5))) + f"</{tag}>"
        if way < 0.8:
            before, after = self.pick(("<blockquote>", "</blockquote>"), ("<blockquote><p>", "</p></blockquote>"), ("<pre>", "</pre>"))
            return before + self.keep(text) + after
        if way < 0.84:
            return f"<figure><img src=x><figcaption>{self.keep(self.prose(3, 15))}</figcaption></figure>"
        if way < 0.88:
            cells = self.rng.randint(1, 3)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.short(1, 6))}</td>" for _ in range(cells)) + "</tr>" for _ in range(self.rng.randint(1, 4))) + "</table>"
        if way < 0.94:
            return f"<div>{self.keep(text)}</div>"
        link = self.short()
        whole = self.keep(f"{text} {link} {text}")
        return f"<p>{whole.replace(link, f'<a href=/x/>{link}</a>', 1)}</p>"

    def article(self) -> str:
        self.inside = True
        made = self.article_of(self.rng.random())
        self.inside = False
        return made

    def article_of(self, way: float) -> str:
        parts = []
        if way < 0.8:
            title = f"<h1>{self.keep(self.prose(2, 14))}</h1>"
            parts.append(f"<header>{title}</header>" if way < 0.1 else title)
        for _ in range(self.rng.randint(1, 10)):
            parts.append(self.paragraph())
            if not self.foreign and self.chance(0.07):
                parts.append(self.pick(self.advert, self.side, self.form, self.notice, self.share)())
        body = "".join(parts)
        after = self.pick(self.comments, self.form, self.share, self.comments)() if not self.foreign and self.chance(0.3) else ""
        way = self.way
        if way < 0.35:
            return f"<article{self.named('main') if self.chance(0.3) else ''}>{body}{after}</article>"
        if way < 0.5:
            return self.pick(f"<main>{body}{after}</main>", f"<main><article>{body}</article>{after}</main>", f"<div role='main'>{body}{after}</div>")
        if way < 0.66:
            return f"<div{self.named('main')}>{body}{after}</div>"
        if way < 0.78:
            return f"<div{self.named(None) if self.chance(0.6) else ''}>{body}</div>{after}"
        if way < 0.86:
            beside = f"<td>{self.links(self.rng.randint(3, 8))}</td>" * self.chance(0.7)
            return f"<table><tr>{beside}<td>{body}</td></tr></table>{after}"
        return f"<section>{body}</section>{after}" if way < 0.9 else f"{body}{after}"


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page laid out at random, and the texts of its main blocks in order."""
    page = Layout(rng)
    written = rng.random() < 0.97
    page.core &= written
    # what only a name would tell apart from an article without an element of its own isn't on foreign pages
    told = (lambda *regions: regions) if page.core or not page.foreign else lambda *regions: [f for f in regions if f in (page.header, page.menu, page.form, page.share)]
    above = [f() for f in told(page.notice, page.header, page.menu, page.advert, page.form, page.side) if rng.random() < 0.45]
    rng.shuffle(above)
    core = page.article() if written else ""
    below = [f() for f in told(page.advert, page.comments, page.side, page.form, page.menu, page.share) if rng.random() < 0.2]
    rng.shuffle(below)
    head = f"<title>{page.short(2, 9)}</title>" + rng.choice(("", "<style>a > b {color: red}</style>", "<script>if (a<b) {document.write('<p>x')}</script>", "<noscript>no</noscript>"))
    body = "".join(above) + core + "".join(below) + (page.footer() if rng.random() < 0.6 else "")
    if rng.random() < 0.3:
        body = f"<div{page.named(None)}>{body}</div>"
    return f"<html><head>{head}</head><body>{body}" + rng.choice(("</body></html>", "</body></html>", "")), page.main
