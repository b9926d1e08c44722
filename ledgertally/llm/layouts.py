"""Pages to learn from: the text of real pages in layouts drawn at random, with the main text marked.

A page that marks its article itself says which of its blocks are main text. Those blocks, and words of the rest of the page, are laid out anew: with or without tags that say what
a part is for, with or without classes that do, with menus, sidebars, notices, adverts, forms and comments before, behind and inside the article.
"""

from __future__ import annotations

import random
from html import escape

from ledgertally.llm.dom import TAGS, Tree

#: Stands before every main text of a page laid out anew.
MARK = "\ue000"
_BIT = {name: 1 << k for k, name in enumerate(TAGS)}
_MAIN = _BIT["article"]
_NOT_MAIN = _BIT["nav"] | _BIT["header"] | _BIT["footer"] | _BIT["aside"] | _BIT["form"] | _BIT["dialog"]


def marked(tree: Tree) -> list[bool] | None:
    """Which leaves of a page are main text by its own tags, or None if it has no such tag."""
    main = [bool(above & _MAIN) and not above & _NOT_MAIN for above in tree.above]
    return [bool(m and text) for m, text in zip(main, tree.text)] if any(bits & _MAIN for bits in tree.own) else None


class Layout:
    """One page in a layout of its own. With `tags` parts are told by tags, with `classes` by classes; one of both at least."""

    def __init__(self, seed: int, blocks: list[tuple[bool, str]], words: list[str]):
        self.rng = random.Random(seed)
        self.blocks, self.words = blocks, words or ["word"]
        self.tags = self.rng.random() < 0.65
        self.classes = self.rng.random() < 0.65 or not self.tags

    def some(self, low: int, high: int) -> str:
        return escape(" ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))))

    def links(self, count: int, low: int = 1, high: int = 3) -> list[str]:
        return [f'<a href="/{k}">{self.some(low, high)}</a>' for k in range(count)]

    def wrap(self, tag: str, names: str, inside: str) -> str:
        """A part: with its own tag, or a division; with one of some classes, or without."""
        rng = self.rng
        tag = tag if self.tags and rng.random() < 0.9 or not tag else "div"
        mark = ""
        if self.classes and names and rng.random() < 0.95 or tag == "div" and names:
            mark = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names.split())}"'
        return f"<{tag}{mark}>{inside}</{tag}>"

    def menu(self) -> str:
        links = self.links(self.rng.randint(3, 12))
        inside = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.rng.random() < 0.6 else self.rng.choice([" ", " | ", ""]).join(links)
        return self.wrap("nav", "menu nav navbar main-menu navigation breadcrumbs site-nav", inside)

    def top(self) -> str:
        inside = self.rng.choice([f"<h1>{self.some(1, 4)}</h1>", f"<p>{self.some(1, 5)}</p>", f"<div>{self.some(1, 3)}</div>", self.some(1, 4)])
        return self.wrap("header", "header masthead site-header topbar banner", inside + (self.menu() if self.rng.random() < 0.5 else "") + (f"<p>{self.some(2, 10)}</p>" if self.rng.random() < 0.4 else ""))

    def bottom(self) -> str:
        inside = self.rng.choice([f"&copy; {self.some(1, 12)}", f"<p>&copy; {self.some(3, 25)}</p>", "".join(f"<p>{x}</p>" for x in self.links(4)) + f"<small>{self.some(2, 15)}</small>"])
        return self.wrap("footer", "footer site-footer colophon page-footer copyright", inside + (self.menu() if self.rng.random() < 0.3 else ""))

    def side(self) -> str:
        rng = self.rng
        parts = [f"<{rng.choice(['h2', 'h3', 'h4', 'p'])}>{self.some(1, 4)}</{'h3'}>" for _ in range(rng.randint(0, 1))]
        parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in self.links(rng.randint(2, 8), 2, 9)) + "</ul>" if rng.random() < 0.7 else "".join(f"<p>{self.some(5, 40)}</p>" for _ in range(rng.randint(1, 3))))
        return self.wrap("aside", "sidebar widget related right-rail aside trending recommended", "".join(parts))

    def notice(self) -> str:
        inside = f"<p>{self.some(6, 40)}</p><button>{self.some(1, 2)}</button>" if self.rng.random() < 0.7 else self.some(5, 30)
        return self.wrap(self.rng.choice(["dialog", "div", "section", "aside"]), "cookie cookie-banner consent notice alert popup gdpr newsletter modal", inside)

    def advert(self) -> str:
        inside = self.rng.choice([self.some(3, 30), f"<p>{self.some(3, 30)}</p>", f'<a href="/x">{self.some(3, 20)}</a>'])
        return self.wrap(self.rng.choice(["div", "div", "aside"]), "ad ads advert ad-slot sponsored promo banner-ad advertisement", inside)

    def form(self) -> str:
        inside = f"<label>{self.some(1, 5)}</label><input name=q><button>{self.some(1, 2)}</button>" + (f"<p>{self.some(2, 20)}</p>" if self.rng.random() < 0.5 else "")
        return f'<form action="/q">{inside}</form>' if self.rng.random() < 0.8 else self.wrap("", "search subscribe login signup newsletter contact", inside) if self.classes else f"<form>{inside}</form>"

    def comments(self) -> str:
        rng, each = self.rng, []
        for _ in range(rng.randint(1, 8)):
            said = f"<p>{self.some(3, 60)}</p>" if rng.random() < 0.8 else self.some(3, 40)
            each.append(rng.choice(['<li class="comment">{}</li>', '<div class="comment">{}</div>', '<article class="comment">{}</article>', '<div class="reply"><b>x</b> {}</div>']).format(said))
        inside = (f"<h{rng.randint(2, 4)}>{self.some(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(each)
        return f'<{(tag := rng.choice(["section", "div", "div", "aside"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "discussion", "comments-area", "replies", "commentlist"])}">{inside}</{tag}>'

    def share(self) -> str:
        return self.wrap("", "share social sharing follow share-buttons", " ".join(self.links(self.rng.randint(2, 5), 1, 1)))

    def article(self) -> str:
        rng, out = self.rng, []
        plain = rng.random() < 0.15  # paragraphs as divisions
        interrupted = rng.random() < 0.5
        for heading, text in self.blocks:
            text = MARK + escape(text)
            if rng.random() < 0.3 and " " in text:
                first, rest = text.split(" ", 1)
                text = f"{first} <{(tag := rng.choice(['b', 'em', 'a', 'span']))}>{rest}</{tag}>" if len(rest) < 60 else f"<b>{first}</b> {rest}"
            kind = rng.random()
            if heading:
                out.append(f"<h{(k := rng.choice([1, 1, 1, 2, 3]))}>{text}</h{k}>")
            elif plain:
                out.append(f"<div>{text}</div>")
            elif kind < 0.05:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.1:
                out.append(f"<ul><li>{text}</li></ul>")
            elif kind < 0.15:
                out.append(f"<h2>{text[:60]}</h2>")
            elif kind < 0.2:
                out.append(f"<p>{text}")
            else:
                out.append(f"<p>{text}</p>")
            if interrupted and rng.random() < 0.12:
                out.append(rng.choice([self.advert, self.side, self.share, self.notice])())
        if rng.random() < 0.2:
            out.append(self.share())
        inside = "".join(out)
        tag, names = rng.choice([("article", "post entry article"), ("main", "content main"), ("section", "content story"), ("div", "content article-body post-content entry main story")])
        if rng.random() < 0.1 and not plain:
            return f"<table><tr><td>{inside}</td></tr></table>" if rng.random() < 0.5 else f"<div>{inside}</div>"
        if tag in ("article", "main") and not self.classes:
            return f"<{tag}>{inside}</{tag}>"
        body = self.wrap(tag, names, inside)
        return f"<main>{body}</main>" if self.tags and rng.random() < 0.2 else body

    def page(self) -> str:
        rng = self.rng
        maybe = lambda odds, part: part() if rng.random() < odds else ""
        before = [maybe(0.4, self.notice), maybe(0.5, self.top), maybe(0.6, self.menu), maybe(0.3, self.form), maybe(0.4, self.advert), maybe(0.2, self.side)]
        behind = [maybe(0.3, self.share), maybe(0.4, self.comments), maybe(0.4, self.side), maybe(0.3, self.advert), maybe(0.2, self.form), maybe(0.2, self.notice), maybe(0.2, self.menu)]
        rng.shuffle(before)
        rng.shuffle(behind)
        whole = "".join(before) + self.article() + "".join(behind)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            whole = f'<div{rng.choice(["", " class=wrapper", " id=page", " class=container"])}>{whole}</div>'
        return f"<html><head><title>{self.some(1, 5)}</title></head><body>{whole}{maybe(0.75, self.bottom)}{maybe(0.2, self.notice)}</body></html>"
