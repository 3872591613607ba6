"""Labelled pages made by rule, on which the tree model of html_text is trained: no labelled pages are given.

Every page mixes one of several layouts for the article with notices, menus, adverts, forms, sidebars and comments in
varying tags, class names, lengths and orders; what belongs to the article is known because it is written here.
Article text carries the letter of its label in a parallel list, never in the page.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ter an do re su vel or in ta pe ru na sto li men ga bo".split()
_CLUTTER = ("nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "related", "share")
_NAMES = {
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumb", "site-nav", "topnav", "navigation", "pagination"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon", "legal"],
    "aside": ["sidebar", "aside", "widget", "widget-area", "right-column", "rail", "side"],
    "ad": ["ad", "ads", "advert", "banner-ad", "sponsored", "promo", "advertisement", "ad-slot"],
    "notice": ["cookie-notice", "consent", "notice", "cookie-banner", "alert", "popup", "gdpr", "notification", "modal"],
    "form": ["newsletter", "subscribe", "signup", "search-form", "login", "contact-form"],
    "comments": ["comments", "comment-list", "discussion", "reader-comments", "responses", "disqus", "replies"],
    "related": ["related", "related-posts", "recommended", "more-stories", "trending", "read-more", "see-also"],
    "share": ["share", "social", "share-buttons", "sharing", "follow-us", "social-links"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "section", "aside", "ins"], "notice": ["div", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "related": ["section", "div", "aside"], "share": ["div", "ul"]}
_ARTICLE = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("section", "story"), ("div", "main-text"), ("div", ""), ("section", ""), ("div", "page-body"), ("article", "entry")]


class Page:
    """One page: its html, and the text runs of the article in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.kept: list[str] = []
        self.build()
        self.html = "".join(self.out)

    def words(self, low: int, high: int, end: str = ".") -> str:
        r = self.r
        said = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) + (r.choice(",,.") if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        mark = r.choice(["", "", "", "", " |", "###", "!!", "%%%"]) if high > 3 else ""
        text = f"{mark} ".join(said)
        return (text.upper() if mark == "!!" else text.capitalize()) + r.choice([end, end, end, ""])

    def name(self, kind: str) -> str:
        if self.r.random() < 0.15:
            return ""
        n = self.r.choice(_NAMES[kind])
        n = n if self.r.random() < 0.8 else f"{self.r.choice(['l', 'box', 'c12', 'js', 'block'])}-{n}"
        return f' {self.r.choice(["class", "class", "class", "id"])}="{n}"'

    def links(self, low: int, high: int, size: int) -> str:
        item = lambda: f'<a href="/{self.r.choice(_SYLLABLES)}">{self.words(1, size, "")}</a>'
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", "&middot;"]).join(item() for _ in range(n))

    def clutter(self, kind: str) -> None:
        r, tag = self.r, self.r.choice(_TAGS[kind])
        named = self.name(kind)
        if not named and tag in ("div", "section", "p", "ul", "ol", "aside") and kind in ("ad", "notice", "comments", "related", "share", "header", "aside"):
            named = f' class="{r.choice(_NAMES[kind])}"'
        inner = {
            "nav": lambda: self.links(2, 9, 3),
            "header": lambda: f"<h1>{self.words(1, 4, '')}</h1>" * (r.random() < 0.5) + f"<p>{self.words(2, 8)}</p>" + self.links(0, 6, 2) * (r.random() < 0.5),
            "footer": lambda: r.choice(["", "<p>"]) + f"&copy; {self.words(2, 30)}" + self.links(1, 6, 2) * (r.random() < 0.5),
            "aside": lambda: f"<h3>{self.words(1, 4, '')}</h3>" + r.choice([self.links(2, 8, 6), f"<p>{self.words(6, 50)}</p>"]),
            "ad": lambda: r.choice([self.words(3, 40), f"<p>{self.words(3, 40)}</p>", f'<a href="/b">{self.words(2, 12)}</a>']),
            "notice": lambda: r.choice([self.words(5, 50), f"<p>{self.words(5, 50)}</p><button>{self.words(1, 2, '')}</button>"]),
            "form": lambda: f"<p>{self.words(3, 16)}</p><label>{self.words(1, 3, '')}</label><input><button>{self.words(1, 2, '')}</button>",
            "comments": lambda: f"<h3>{self.words(1, 3, '')}</h3>" + "".join(f'<{t}{c}><p>{self.words(4, 60)}</p></{t}>' for t, c in [r.choice([("div", ' class="comment"'), ("div", ""), ("li", ""), ("article", ' class="comment"')])] for _ in range(r.randint(1, 5))),
            "related": lambda: f"<h3>{self.words(1, 4, '')}</h3>" + self.links(2, 7, 9),
            "share": lambda: self.links(2, 6, 2),
        }[kind]()
        self.out.append(f"<{tag}{named}>{inner}</{tag}>")

    def run(self, tag: str, low: int, high: int) -> None:
        text = self.words(low, high)
        shown = text
        if self.r.random() < 0.2:
            a, _, b = text.partition(" ")
            shown = f"<{(t := self.r.choice(['b', 'em', 'strong', 'span', 'i']))}>{a}</{t}> {b}"
        if self.r.random() < 0.12 and len(text) > 80:
            shown += f' <a href="/x">{self.words(1, 4, "")}</a>'
        self.kept.append(text[:24])
        self.out.append(f"<{tag}>{shown}</{tag}>" if tag else shown)

    def article(self) -> None:
        r = self.r
        tag, named = r.choice(_ARTICLE)
        self.out.append(f'<{tag} class="{named}">' if named else f"<{tag}>")
        wrap = r.random() < 0.15
        if r.random() < 0.8:
            self.out.append("<header>" * wrap)
            self.run("h1", 2, 12)
            self.out.append("</header>" * wrap)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.72:
                self.run("p", 1, r.choice([6, 12, 90, 90, 90]))
            elif x < 0.8:
                self.run(r.choice(["h2", "h3"]), 2, 8)
            elif x < 0.86:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.run("li", 2, 20)
                self.out.append("</ul>")
            elif x < 0.9:
                self.run("blockquote", 5, 40)
            elif x < 0.94:
                self.run("div", 5, 60)
            else:
                self.out.append("<table><tr>")
                self.run("td", 1, 6)
                self.run("td", 1, 6)
                self.out.append("</tr></table>")
            if r.random() < 0.06:
                self.clutter(r.choice(["ad", "related", "share", "form", "aside"]))
        if r.random() < 0.12:
            self.clutter(r.choice(["comments", "share", "related", "footer"]))
        self.out.append(f"</{tag}>")

    def build(self) -> None:
        r = self.r
        deep = r.choice([0, 0, 1, 2])
        self.out.append("<html><body>" + "<div>" * deep)
        before = r.sample(["nav", "header", "notice", "ad", "form"], r.randint(0, 4))
        after = r.sample(["comments", "related", "aside", "footer", "notice", "share", "ad", "form"], r.randint(0, 5))
        if r.random() < 0.6 and "footer" not in after:
            after.append("footer")
        for kind in before:
            self.clutter(kind)
        self.article()
        for kind in after:
            self.clutter(kind)
        self.out.append("</div>" * deep + "</body></html>")
