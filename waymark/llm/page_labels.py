"""Labelled pages to train the extraction model on: layouts drawn from a fixed seed, each element marked as part of the
main text or not. The words are invented; only tags, attribute words, lengths and nesting matter."""

from __future__ import annotations

import random

from waymark.llm.dom import Page

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
ARTICLE_BOXES = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post-content"), ("div", "story main"), ("section", "article"), ("section", "content"), ("div", "main-content"), ("div", "text body"))
#: Layout parts that are not main text: tag, attribute words, kind of filling.
CHROME = (
    ("nav", "", "menu"), ("nav", "navbar", "menu"), ("div", "menu", "menu"), ("ul", "nav", "items"), ("div", "breadcrumb", "menu"), ("div", "navigation", "menu"), ("ol", "breadcrumbs", "items"),
    ("header", "", "top"), ("header", "site-header", "top"), ("div", "header", "top"), ("div", "banner", "short"), ("div", "masthead logo", "short"),
    ("footer", "", "foot"), ("footer", "site-footer", "foot"), ("div", "footer", "foot"), ("div", "copyright", "short"), ("div", "legal", "foot"),
    ("aside", "", "prose"), ("aside", "sidebar", "boxes"), ("div", "sidebar", "boxes"), ("div", "widget", "boxes"), ("section", "sidebar", "boxes"), ("div", "related", "boxes"), ("section", "related-posts", "boxes"), ("div", "recommended", "menu"), ("aside", "related", "menu"),
    ("div", "ad", "prose"), ("div", "ads", "short"), ("div", "advert", "prose"), ("div", "advertisement", "prose"), ("div", "sponsored", "prose"), ("section", "promo", "prose"), ("aside", "ad", "prose"), ("div", "ad-slot", "short"), ("div", "sponsor", "short"), ("section", "ad", "prose"),
    ("div", "cookie", "prose"), ("div", "cookie-notice", "prose"), ("div", "notice", "prose"), ("div", "consent banner", "prose"), ("div", "gdpr", "prose"), ("div", "alert", "short"), ("section", "notice", "prose"), ("aside", "notice", "prose"), ("div", "popup modal", "prose"), ("div", "subscribe", "form"), ("div", "newsletter", "form"), ("div", "paywall", "prose"),
    ("form", "", "form"), ("form", "search", "form"), ("form", "login", "form"), ("form", "comment-form", "form"),
    ("div", "share", "menu"), ("div", "social", "menu"), ("ul", "social-links", "items"), ("div", "tags", "menu"), ("div", "meta byline", "short"), ("div", "pagination", "menu"), ("div", "toolbar", "menu"),
    ("div", "comments", "comments"), ("section", "comments", "comments"), ("div", "comment-list", "comments"), ("ol", "commentlist", "listed"), ("ul", "comments", "listed"), ("div", "discussion", "comments"), ("div", "replies", "comments"), ("div", "disqus thread", "comments"), ("section", "reader-comments", "comments"), ("div", "responses", "comments"), ("div", "reviews", "comments"),
)


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n)).capitalize()

    def element(self, tag: str, words: str, good: int, inner: str) -> str:
        names = f' {self.r.choice(("class", "class", "id"))}="{words}"' if words else ""
        return f'<{tag}{names} data-good="{good}">{inner}</{tag}>'

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(self.r.randint(1, 4))}</a>'

    def prose(self, good: int, n: int) -> str:
        return "".join(self.element("p", "", good, self.words(self.r.choice((4, 12, 30, 60, 90))) + ".") for _ in range(n))

    def items(self, good: int, links: bool) -> str:
        return "".join(self.element("li", "", good, self.link() if links else self.words(self.r.randint(4, 30)) + ".") for _ in range(self.r.randint(2, 9)))

    def filling(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.element("ul", "", 0, self.items(0, True)) if r.random() < 0.7 else " ".join(self.link() for _ in range(r.randint(2, 8)))
        if kind == "items":
            return self.items(0, True)
        if kind == "top":
            inner = self.element(r.choice(("h1", "div", "p")), "", 0, self.words(3)) + (self.element("nav", "", 0, self.filling("menu")) if r.random() < 0.5 else "")
            return inner if r.random() < 0.7 else self.words(r.randint(2, 12))
        if kind == "foot":
            return r.choice((self.words(r.randint(4, 30)) + ".", self.element("p", "", 0, "&copy; " + self.words(8)), self.filling("menu")))
        if kind == "short":
            return self.words(r.randint(1, 8))
        if kind == "boxes":
            return "".join(self.element("div", r.choice(("", "widget", "box", "card")), 0, self.element(r.choice(("h2", "h3", "h4")), "", 0, self.words(3)) + r.choice((self.filling("menu"), self.prose(0, 1)))) for _ in range(r.randint(1, 3)))
        if kind == "form":
            return self.element(r.choice(("p", "div", "fieldset")), "", 0, f"<label>{self.words(2)}</label><input><button>{self.words(1)}</button>") + (self.prose(0, 1) if r.random() < 0.5 else "") + (self.words(3) if r.random() < 0.3 else "")
        if kind == "comments":
            said = "".join(self.element(r.choice(("div", "div", "div", "article", "section")), r.choice(("comment", "comment", "reply", "comment-body", "response")), 0, self.prose(0, r.randint(1, 2)) if r.random() < 0.7 else self.words(20) + ".") for _ in range(r.randint(1, 5)))
            return (self.element(r.choice(("h2", "h3")), "", 0, self.words(2)) if r.random() < 0.6 else "") + (said if r.random() < 0.8 else self.prose(0, 3))
        if kind == "listed":
            return "".join(self.element("li", r.choice(("", "comment")), 0, self.prose(0, 1) if r.random() < 0.5 else self.words(20) + ".") for _ in range(r.randint(1, 5)))
        return self.prose(0, r.randint(1, 2)) if r.random() < 0.6 else self.words(r.randint(5, 40)) + "."

    def chrome(self) -> str:
        tag, words, kind = self.r.choice(CHROME)
        return self.element(tag, words, 0, self.filling(kind))

    def article(self) -> str:
        r = self.r
        title = self.element(r.choice(("h1", "h1", "h2")), r.choice(("", "", "title", "headline")), 1, self.words(r.randint(3, 12)))
        if r.random() < 0.25:
            title = self.element("header", r.choice(("", "entry-header")), 1, title)
        parts = []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.68:
                parts.append(self.prose(1, 1))
            elif x < 0.76:
                parts.append(self.element(r.choice(("h2", "h3", "h4")), "", 1, self.words(4)))
            elif x < 0.82:
                parts.append(self.element(r.choice(("ul", "ol")), "", 1, self.items(1, False)))
            elif x < 0.86:
                parts.append(self.element("blockquote", "", 1, self.prose(1, 1) if r.random() < 0.5 else self.words(20) + "."))
            elif x < 0.89:
                parts.append(self.element("table", "", 1, "".join(self.element("tr", "", 1, "".join(self.element("td", "", 1, self.words(3)) for _ in range(3))) for _ in range(3))))
            elif x < 0.92:
                parts.append(self.element(r.choice(("div", "section")), "", 1, self.prose(1, 2) if r.random() < 0.6 else self.words(40) + "."))
            elif x < 0.94:
                parts.append(self.element("figure", "", 1, "<img>" + self.element("figcaption", "", 1, self.words(8))))
            elif x < 0.96:
                parts.append(self.element("pre", "", 1, self.words(15)))
            else:
                parts.append(self.chrome())
        tag, words = r.choice(ARTICLE_BOXES) if r.random() < 0.9 else ("div", "")
        outer = r.random() < 0.25
        inner = title + "".join(parts)
        if r.random() < 0.2:
            inner = self.element(r.choice(("div", "section")), r.choice(("", "text", "body", "content")), 1, inner)
        if outer:
            return self.element("main", r.choice(("", "main", "content")), 1, self.element(r.choice(("article", "article", "div", "section")), r.choice(("", "post", "article", "entry")), 1, inner) + (self.chrome() if r.random() < 0.4 else ""))
        return self.element(tag, words, 1, inner)

    def page(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.05:
            return "<body>" + self.prose(1, r.randint(1, 6)) + "</body>"
        if kind < 0.07:
            return self.words(r.randint(5, 60)) + "."
        before, after = "".join(self.chrome() for _ in range(r.randint(0, 4))), "".join(self.chrome() for _ in range(r.randint(0, 4)))
        middle = self.article() if kind < 0.95 else self.element("h1", "", 1, self.words(5)) + self.prose(1, r.randint(2, 6))
        if r.random() < 0.3:
            middle = self.element("div", r.choice(("", "wrapper", "container", "page", "row")), 1, before + middle + after)
            before = after = ""
        return "<html><head></head><body>" + before + middle + after + "</body></html>"


def labelled_pages(count: int, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Parsed pages with a label for each element, the document included (its own label is that of bare text)."""
    import re

    out, maker = [], Maker(seed)
    for _ in range(count):
        source = maker.page()
        page = Page(source)
        labels = [int(x) for x in re.findall(r'data-good="(\d)"', source)]
        out.append((page, [1, *labels]))
        assert len(labels) + 1 == len(page.tags)
    return out
