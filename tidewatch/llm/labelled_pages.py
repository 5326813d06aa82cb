"""Labelled pages to train the extraction on, made by rule from seeds.

Blocks of main text bear ``data-content="1"``. A page has the kinds of parts that sites
have around and inside an article, under many names, in changing order and with changing markup.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni ro su ta ve lin mor tan ser ko pre al en or ist ung tion".split()
# Names sites give to the parts of a page: fixed values.
_MAIN = "article content post entry story main text body page blog single news".split()
_MENU = "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager links tabs".split()
_HEAD = "header masthead top banner branding logo site".split()
_FOOT = "footer bottom copyright legal colophon foot".split()
_SIDE = "sidebar aside rail related recommended widget trending popular secondary more archive tags".split()
_NOTICE = "cookie consent notice alert gdpr privacy modal popup overlay warning message paywall subscribe".split()
_ADS = "ad ads advert advertisement sponsor sponsored promo promotion adsense banner commercial dfp".split()
_FORM = "form login signup search newsletter register contact".split()
_SHARE = "share social sharing follow buttons".split()
_COMMENTS = "comment comments reply replies respond response responses discussion disqus thread feedback commentlist".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 16).capitalize() + self.r.choice(("." * 6) + "!?") for _ in range(self.r.randint(low, high)))

    def name(self, names: list[str]) -> str:
        name = self.r.choice(names)
        extra = self.r.choice(("", "", "wrapper", "box", "container", "area", "block", "list", "item"))
        joined = self.r.choice("-_ ").join(x for x in (name, extra) if x)
        return self.r.choice(('class="%s"', 'id="%s"')) % joined

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def part(self, tags: tuple[str, ...], names: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        plain = tag not in ("div", "section", "ul") and self.r.random() < 0.5
        return f"<{tag}{'' if plain else ' ' + self.name(names)}>{inner}</{tag}>"

    def links(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 9))) + "</ul>"

    def menu(self) -> str:
        return self.part(("nav", "div", "nav"), _MENU, self.r.choice((self.links(), " ".join(self.link() for _ in range(6)))))

    def head(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 6)}</p>", self.link()))
        return self.part(("header", "div", "header"), _HEAD, inner + self.r.choice(("", self.links())))

    def foot(self) -> str:
        line = self.r.choice((f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 3)}</p>"))
        return self.part(("footer", "div", "footer"), _FOOT, line + self.r.choice(("", self.links())))

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice((self.links(), f"<p>{self.sentences(1, 3)}</p>"))
        return self.part(("aside", "div", "section", "aside"), _SIDE, inner)

    def notice(self) -> str:
        return self.part(("div", "section"), _NOTICE, self.r.choice(("", "<p>")) + self.sentences(1, 4) + self.r.choice(("", "<button>OK</button>")))

    def advert(self) -> str:
        return self.part(("div", "section", "div", "aside"), _ADS, self.r.choice((self.sentences(1, 3), self.link(), f"<p>{self.sentences(1, 2)}</p>")))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input><p>{self.sentences(1, 2)}</p><button>{self.word()}</button>"
        return f"<form {self.name(_FORM)}>{inner}</form>" if self.r.random() < 0.6 else f"<form>{inner}</form>"

    def share(self) -> str:
        return self.part(("div", "ul"), _SHARE, " ".join(self.link() for _ in range(3)))

    def comments(self) -> str:
        each = [f"<{t} {self.name(_COMMENTS)}><b>{self.word()}</b><p>{self.sentences(1, 5)}</p></{t}>" for t in ("div", "article", "li")]
        inner = "".join(self.r.choice(each) for _ in range(self.r.randint(1, 5)))
        return self.part(("section", "div"), _COMMENTS, f"<h3>{self.words(1, 2)}</h3>" + inner)

    def main(self) -> str:
        mark = ' data-content="1"'
        few = self.r.random()
        if few < 0.12:
            # Nothing but one block, without a heading and often without a name around it.
            tag = self.r.choice(("p", "p", "p", "div"))
            inner = f"<{tag}{mark}>{self.sentences(2, 12)}</{tag}>"
            around = self.r.choice(("article", "main", "div", "section", "body"))
            if around == "body":
                return inner
            return f"<{around}{self.r.choice(('', ' ' + self.name(_MAIN)))}>{inner}</{around}>"
        heading = self.word()[0].upper() if few < 0.16 else self.words(1, 12)
        blocks = [] if few > 0.92 else [f"<h1{mark}>{heading}</h1>"]
        if blocks and self.r.random() < 0.2:
            blocks = [f"<header>{blocks[0]}</header>"]
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = self.r.random()
            if kind < 0.12:
                blocks.append(f"<h2{mark}>{self.words(1, 6)}</h2>")
            elif kind < 0.2:
                blocks.append("<ul>" + "".join(f"<li{mark}>{self.sentences(1, 2)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.25:
                blocks.append(f"<blockquote{mark}>{self.sentences(1, 3)}</blockquote>")
            elif kind < 0.29:
                cells = "".join(f"<tr><td{mark}>{self.words(1, 3)}</td><td{mark}>{self.words(1, 3)}</td></tr>" for _ in range(3))
                blocks.append(f"<table>{cells}</table>")
            elif kind < 0.32:
                blocks.append(f"<pre{mark}>{self.words(3, 20)}</pre>")
            elif kind < 0.38:
                blocks.append(f"<p{mark}>{self.words(1, 2).capitalize()}{self.r.choice(('.', ''))}</p>")
            elif kind < 0.44:
                blocks.append(f"<p{mark}>{self.words(2, 120)}</p>")
            elif kind < 0.5:
                blocks.append(f"<p{mark}>{self.sentences(1, 3)} {self.link()} {self.sentences(1, 2)}</p>")
            elif kind < 0.56:
                blocks.append(f"<div{mark}>{self.sentences(1, 6)}</div>")
            else:
                blocks.append(f"<p{mark}>{self.sentences(1, 9)}</p>")
        for part in (self.advert, self.share, self.side, self.notice, self.form):
            if self.r.random() < 0.12:
                blocks.insert(self.r.randint(1, len(blocks)), part())
        inner = "".join(blocks)
        if self.r.random() < 0.3:
            inner = f"<div {self.name(_MAIN)}>{inner}</div>"
        made = self.part(("article", "main", "div", "section", "article"), _MAIN, inner)
        return f"<main>{made}</main>" if self.r.random() < 0.2 else made

    def page(self) -> str:
        before = [p() for p in (self.head, self.menu, self.notice, self.advert, self.form) if self.r.random() < 0.5]
        after = [p() for p in (self.share, self.comments, self.side, self.advert, self.notice, self.form, self.foot) if self.r.random() < 0.5]
        self.r.shuffle(before)
        inner = "".join(before) + self.main() + "".join(after)
        if self.r.random() < 0.3:
            inner = f'<div id="{self.r.choice(("page", "wrapper", "container", "root"))}">{inner}</div>'
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{inner}</body></html>"


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    return [_Maker(seed * 100_003 + i).page() for i in range(count)]
