"""Labelled pages, made by rule: a page's parts carry ``data-label="main"`` or ``"other"``.

Each number gives one page.  Layout, element names, class names, order and lengths vary, so that
no single one of them decides; long comments and short paragraphs both occur.
"""

from __future__ import annotations

import random

# Names that pages use for their parts.
WRAPPERS = "wrapper container page site row col grid inner outer layout wrap shell app root columns".split()
MAIN = "article content post entry story main body text single blog news prose page-content post-body entry-content article-body story-text".split()
OTHER: dict[str, tuple[str, str]] = {
    "menu": ("nav div ul header", "nav navbar menu navigation breadcrumb breadcrumbs topbar main-menu site-nav skip-links toc pagination pager tabs"),
    "header": ("header div section", "header masthead site-header page-header logo branding banner-top top"),
    "footer": ("footer div section", "footer site-footer page-footer copyright legal bottom colophon credits"),
    "sidebar": ("aside div section", "sidebar side widget rail related recommended popular trending tags secondary side-bar more-stories"),
    "notice": ("div section aside dialog", "cookie consent notice cookie-notice gdpr alert popup modal newsletter subscribe privacy-notice disclaimer message overlay paywall"),
    "advert": ("div ins section aside", "ad ads advert advertisement sponsor sponsored promo ad-slot ad-banner adsbygoogle promotion banner"),
    "form": ("form div section", "form search login signup search-form contact-form register feedback subscribe-form comment-form respond"),
    "comments": ("section div ol aside", "comments comment replies discussion disqus responses thread comment-list user-comments reader-comments reviews"),
    "share": ("div ul span", "share social toolbar share-buttons follow like actions tools meta-links"),
}
PLACES = {"menu": "before", "header": "before", "notice": "any", "advert": "any", "share": "any", "form": "any", "sidebar": "after", "comments": "after", "footer": "after"}


class _Maker:
    def __init__(self, number: int):
        self.rng = random.Random(number)

    def words(self, n: int) -> str:
        pick = self.rng
        return " ".join("".join(pick.choice("aeioustrnlmdkp") for _ in range(pick.randint(1, 9))) for _ in range(n))

    def sentences(self, n: int) -> str:
        made = [self.words(self.rng.randint(1, 24)).capitalize() + self.rng.choice(("...", ".", ".", ".", "?", "!")[1:]) for _ in range(n)]
        return " ".join(made)

    def tag(self, tag: str, inside: str, names: str = "", label: str = "") -> str:
        key = self.rng.choice(("class", "class", "class", "id"))
        names = f' {key}="{names}"' if names else ""
        return f"<{tag}{names}" + (f' data-label="{label}"' if label else "") + f">{inside}</{tag}>"

    def links(self, n: int) -> str:
        made = [f'<a href="/{i}">{self.words(self.rng.randint(1, 4))}</a>' for i in range(n)]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(made)

    def main_part(self) -> str:
        roll = self.rng.random()
        if roll < 0.68:
            inside = self.sentences(self.rng.choice((1, 1, 2, 3, 5, 9)))
            if self.rng.random() < 0.25:
                inside = f"<b>{inside}<br>" if self.rng.random() < 0.5 else f'{inside} <a href="/x">{self.words(3)}</a> {self.sentences(1)}'
            return f"<p>{inside}</p>"
        if roll < 0.76:
            return f"<h2>{self.words(self.rng.randint(1, 8))}</h2>"
        if roll < 0.84:
            items = "".join(f"<li>{self.rng.choice((self.words, self.sentences))(self.rng.randint(1, 5))}</li>" for _ in range(self.rng.randint(2, 6)))
            return f"<ul>{items}</ul>" if self.rng.random() < 0.6 else f"<ol>{items}</ol>"
        if roll < 0.9:
            return f"<blockquote><p>{self.sentences(2)}</p></blockquote>"
        if roll < 0.94:
            return f"<pre>{self.words(12)}</pre>"
        if roll < 0.97:
            rows = "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(3))
            return f"<table>{rows}</table>"
        return f"<figure><figcaption>{self.words(6)}</figcaption></figure>"

    def other(self, kind: str) -> str:
        tags, names = (x.split() for x in OTHER[kind])
        tag, name = self.rng.choice(tags), self.rng.choice(names)
        if self.rng.random() < 0.25:
            name = f"{name} {self.rng.choice(names)}"
        if tag in ("nav", "footer", "form", "header", "aside") and self.rng.random() < 0.5:
            name = ""
        if kind in ("menu", "share"):
            inside = self.links(self.rng.randint(2, 9))
        elif kind == "header":
            title = f"<{self.rng.choice(('h1', 'h2', 'div', 'span'))}>"
            inside = title + self.words(self.rng.randint(1, 5)) + title.replace("<", "</")
            inside += self.rng.choice(("", f"<p>{self.words(5)}</p>", self.links(3), f"<nav>{self.links(4)}</nav>"))
        elif kind == "form":
            inside = f"<label>{self.words(2)}</label><input name=q><p>{self.words(4)}</p>"
        elif kind == "comments":
            one = lambda: self.tag(self.rng.choice(("div", "li", "article")), f"<p>{self.sentences(self.rng.randint(1, 6))}</p>", self.rng.choice(("comment", "reply", "comment-body", "")))
            inside = f"<h3>{self.words(2)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5)))
        elif kind == "sidebar":
            inside = f"<h3>{self.words(2)}</h3>" + (self.links(5) if self.rng.random() < 0.6 else f"<p>{self.sentences(2)}</p>")
        elif kind == "footer":
            inside = f"&copy; {self.words(3)} &middot; {self.sentences(1)}" if self.rng.random() < 0.5 else f"<p>{self.words(5)}</p>" + self.links(4)
        else:
            inside = self.sentences(self.rng.randint(1, 3)) if self.rng.random() < 0.6 else f"<p>{self.sentences(self.rng.randint(1, 3))}</p>"
        return self.tag(tag, inside, name, "other")

    def page(self) -> str:
        pick = self.rng
        parts = [f"<h1>{self.words(pick.randint(1, 10))}</h1>"] if pick.random() < 0.8 else []
        parts += [self.main_part() for _ in range(pick.choice((1, 1, 2, 4, 8, 14)))]
        for kind in ("advert", "share", "comments", "notice", "sidebar", "form"):
            if pick.random() < 0.12:
                at = len(parts) if kind in ("comments", "form") else pick.randint(0, len(parts))
                parts.insert(at, self.other(kind))
        tag = pick.choice(("article", "article", "main", "section", "div", "div"))
        name = pick.choice(MAIN) if tag in ("section", "div") or pick.random() < 0.4 else ""
        body = self.tag(tag, "".join(parts), name, "main")
        if pick.random() < 0.08:
            body = f'<div data-label="main">{"".join(parts)}</div>'
        if pick.random() < 0.3:
            body = self.tag(pick.choice(("main", "div", "section")), body, pick.choice(("", *MAIN)))
        kinds = [k for k in OTHER if pick.random() < (0.7 if k in ("menu", "footer") else 0.35)]
        before = [self.other(k) for k in kinds if PLACES[k] == "before" or (PLACES[k] == "any" and pick.random() < 0.5)]
        after = [self.other(k) for k in kinds if PLACES[k] == "after" or (PLACES[k] == "any" and pick.random() < 0.5)]
        inside = "".join(before) + body + "".join(after)
        for _ in range(pick.choice((0, 0, 1, 2))):
            inside = self.tag("div", inside, pick.choice(WRAPPERS))
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title></head><body>{inside}</body></html>"


def labelled_page(number: int) -> str:
    """The labelled page of a number; the same each time."""
    return _Maker(number).page()
