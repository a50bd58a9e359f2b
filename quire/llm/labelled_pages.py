"""Labelled training pages for the HTML extractor, written by a seeded generator.

A page is a list of (html, label) pieces: label 1 is article text, 0 is any other text,
None is markup without text. Layouts, tags and names of classes vary from page to page.
"""

from __future__ import annotations

import random

#: Names that pages give to what is not their article, by kind.
NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "main-menu", "tabs", "pagination"],
    "header": ["header", "masthead", "branding", "site-title", "logo", "top", "page-header", "tagline"],
    "footer": ["footer", "copyright", "legal", "colophon", "site-info", "bottom", "site-footer", "imprint"],
    "side": ["sidebar", "aside", "widget", "related", "popular", "trending", "recommended", "side", "rail", "more", "secondary"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie-banner", "paywall", "message", "overlay", "warning"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adbox", "promotion", "commercial"],
    "form": ["form", "search", "login", "signup", "newsletter", "subscribe", "contact", "feedback", "search-box"],
    "comment": ["comment", "comments", "replies", "discussion", "respond", "comment-list", "reader-comments", "disqus", "reviews", "reply"],
    "share": ["share", "social", "toolbar", "tags", "meta", "byline", "author-info", "follow"],
}
CONTENT_NAMES = ["content", "article", "post", "entry", "story", "body", "text", "main", "article-body", "entry-content", "post-content", "prose"]
NEUTRAL_NAMES = ["wrap", "row", "col", "container", "box", "inner", "block", "section", "grid", "left", "right", "page"]
LETTERS = "etaoinshrdlucmfwypvbgk"


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[tuple[str, int | None]] = []

    def put(self, html: str, label: int | None = None) -> None:
        self.out.append((html, label))

    def word(self) -> str:
        return "".join(self.r.choices(LETTERS, k=self.r.randint(1, 10)))

    def words(self, low: int, high: int, stop: bool = True) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        for i in range(len(words)):
            if self.r.random() < 0.08:
                words[i] += self.r.choice(",.;:")
            if self.r.random() < 0.03:
                words[i] = self.r.choice(["12", "2024", "%s&amp;" % words[i], words[i].upper()])
        return " ".join(words).capitalize() + ("." if stop and self.r.random() < 0.9 else "")

    def named(self, kind: str | None) -> str:
        """Attributes with a name of the kind, or none at all."""
        r = self.r
        names = NEUTRAL_NAMES if kind is None else CONTENT_NAMES if kind == "content" else NAMES[kind]
        name = r.choice(names)
        if r.random() < 0.2:
            name += " " + r.choice(NEUTRAL_NAMES)
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"' if r.random() < 0.9 or kind not in (None, "content") else ""

    def box(self, kind: str, tag: str | None) -> tuple[str, str]:
        """The tags around a part: an element that says what it is, or a division with a name."""
        if tag and self.r.random() < 0.6:
            return f"<{tag}{self.named(kind) if self.r.random() < 0.4 else ''}>", f"</{tag}>"
        t = self.r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return f"<{t}{self.named(kind)}>", f"</{t}>"

    def links(self, low: int, high: int) -> None:
        r = self.r
        kind = r.choice(["li", "a", "p", "span"])
        for _ in range(r.randint(low, high)):
            link = f'<a href="/{self.word()}">{self.words(1, 4, False)}</a>'
            self.put({"li": f"<li>{link}</li>", "a": link + " ", "p": f"<p>{link}</p>", "span": f"<span>{link}</span> "}[kind], 0)

    def part(self, kind: str) -> None:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        begin, end = self.box(kind, tag)
        self.put(begin)
        if kind == "nav":
            self.links(2, 9)
        elif kind == "header":
            self.put(f"<{(t := r.choice(['h1', 'div', 'p', 'span']))}>{self.words(1, 6, False)}</{t}>", 0)
        elif kind == "footer":
            self.put(r.choice(["&copy; ", "Copyright ", "", "2024 "]) + self.words(2, 25), 0)
            if r.random() < 0.4:
                self.links(1, 5)
        elif kind == "side":
            if r.random() < 0.5:
                self.put(f"<h3>{self.words(1, 4, False)}</h3>", 0)
            self.links(2, 6) if r.random() < 0.6 else self.put(f"<p>{self.words(5, 50)}</p>", 0)
        elif kind == "form":
            self.put(f"<label>{self.words(1, 5, False)}</label><input name=q><button>{self.word()}</button>", 0)
            if r.random() < 0.4:
                self.put(f"<p>{self.words(5, 25)}</p>", 0)
        elif kind == "comment":
            if r.random() < 0.5:
                self.put(f"<h3>{self.words(1, 4, False)}</h3>", 0)
            for _ in range(r.randint(1, 5)):
                inner = r.random() < 0.6
                self.put(f"<div{self.named('comment')}>" if inner else "")
                self.put(f"<p>{self.words(3, 70)}</p>" if r.random() < 0.7 else self.words(3, 70) + "<hr>", 0)
                self.put("</div>" if inner else "")
        else:
            text = self.words(2, 40 if kind in ("ad", "notice") else 12)
            self.put(text if r.random() < 0.5 else f"<p>{text}</p>", 0)
            if kind == "notice" and r.random() < 0.3:
                self.put("<button>OK</button>", 0)
        self.put(end)

    def article(self) -> None:
        r = self.r
        boxes = []
        if r.random() < 0.3:
            boxes.append(self.box("content", "main"))
        if r.random() < 0.8:
            boxes.append(self.box("content", "article"))
        if r.random() < 0.25:
            boxes.append((f"<div{self.named(r.choice(['content', None]))}>", "</div>"))
        for begin, _ in boxes:
            self.put(begin)
        if r.random() < 0.85:
            inside = r.random() < 0.25  # a header of the article holds its title, and often a line about it
            self.put("<header>" if inside else "")
            self.put(f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{self.words(2, 14, False)}</{t}>", 1)
            if inside and r.random() < 0.4:
                self.part("share")
            self.put("</header>" if inside else "")
        if r.random() < 0.2:
            self.part("share")
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.72:
                text = self.words(1, r.choice([4, 20, 60, 150]))
                if r.random() < 0.2:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f'{text} <a href="/{self.word()}">{self.words(1, 3, False)}</a> {self.words(2, 20)}'
                self.put(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""), 1)
            elif k < 0.78:
                self.put(f"<h2>{self.words(1, 7, False)}</h2>", 1)
            elif k < 0.83:
                self.put("<ul>" + "".join(f"<li>{self.words(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", 1)
            elif k < 0.86:
                self.put(f"<blockquote>{self.words(5, 40)}</blockquote>", 1)
            elif k < 0.89:
                self.put(f"<pre>{self.words(3, 30)}</pre>", 1)
            elif k < 0.91:
                self.put("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>", 1)
            elif k < 0.93:
                self.put(f"<div>{self.words(10, 60)}</div>", 1)
            else:
                self.part(r.choice(["ad", "side", "share", "form", "notice"]))
        if r.random() < 0.15:
            self.part("comment")
        for _, end in reversed(boxes):
            self.put(end)

    def build(self) -> list[tuple[str, int | None]]:
        r = self.r
        if r.random() < 0.06:  # bare text, with or without paragraphs
            tag = r.choice(["<p>", "<div>", "", "<body><p>"])
            for _ in range(r.randint(1, 6) if tag else 1):
                self.put(tag + self.words(1, r.choice([3, 30, 120])), 1)
            return self.out
        self.put("<!DOCTYPE html><html><head><title>t</title></head><body>")
        wrap = r.random() < 0.4
        self.put(f"<div{self.named(None)}>" if wrap else "")
        for kind, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("form", 0.2), ("ad", 0.5), ("side", 0.2)):
            if r.random() < p:
                self.part(kind)
        self.article()
        for kind, p in (("share", 0.2), ("ad", 0.2), ("comment", 0.4), ("side", 0.3), ("form", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.15)):
            if r.random() < p:
                self.part(kind)
        self.put(("</div>" if wrap else "") + "</body></html>")
        return self.out
