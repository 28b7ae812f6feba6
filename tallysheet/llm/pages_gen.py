"""Made-up pages with known main text, on which the extraction model is trained.

Every page is drawn from a seed: how its parts are marked up, in what order
they come and what they hold. Main text begins with :data:`MARK`.
"""

from __future__ import annotations

import random

MARK = "\x01"
#: Names that pages commonly give to their parts. Fixed values.
MAIN_NAMES = "content post entry article story text body main page single blog news prose post-content entry-content article-body main-content".split()
PARTS = {
    "menu": ("nav", "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager links toc".split()),
    "head": ("header", "header site-header masthead topbar branding logo top banner hero".split()),
    "foot": ("footer", "footer site-footer bottom copyright legal colophon credits foot".split()),
    "side": ("aside", "sidebar side widget widgets related recommended popular trending recent tags archive secondary rail more".split()),
    "note": ("div", "notice cookie cookies consent gdpr alert message warning popup modal overlay newsletter paywall announcement privacy".split()),
    "advert": ("div", "ad ads advert advertisement adsense banner-ad sponsor sponsored promo promotion promoted commercial adbox adslot".split()),
    "form": ("form", "form search searchform login signup subscribe contact newsletter-form".split()),
    "talk": ("section", "comments comment comment-list discussion replies responses disqus reviews respond feedback thread".split()),
    "share": ("div", "share social sharing toolbar buttons follow meta-links byline-links".split()),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = "ka lo mi ter an ing ber sch que el os tra ne vi du po re ti on en st ou é ü ñ".split()
        #: Some pages name no part by its role, as generated style sheets do.
        self.blurred = self.r.random() < 0.12
        self.words = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(300)]

    def say(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.r.choice(self.words) + ("." if self.r.random() < 0.1 else "," if self.r.random() < 0.06 else "") for _ in range(n)]
        return (" ".join(out)).capitalize() + ("." if self.r.random() < 0.8 else "")

    def links(self) -> str:
        n, form = self.r.randint(2, 9), self.r.random()
        each = [f'<a href="/{k}">{self.say(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>" if form < 0.6 else self.r.choice([" | ", " ", " &middot; "]).join(each)

    def wrap(self, kind: str, inner: str) -> str:
        tag, names = PARTS[kind]
        named = self.r.random()
        name = self.named(names, self.r.choice([1, 1, 1, 2]))
        if self.r.random() < 0.45:
            tag = self.r.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"])
            named = 1.0
        attribute = f' {self.r.choice(["class", "class", "id"])}="{name}"' if named > 0.4 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def named(self, names: list[str], n: int) -> str:
        """Some of the names, or names that tell nothing."""
        return " ".join(f"{self.r.choice(['css', 'sc', 'x', 'jsx'])}-{self.r.randrange(16**5):x}" for _ in range(n)) if self.blurred else " ".join(self.r.sample(names, n))

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            inner = self.links()
        elif kind == "head":
            inner = (f"<h1>{self.say(1, 4)}</h1>" if r.random() < 0.3 else f"<div>{self.say(1, 6)}</div>") + (self.links() if r.random() < 0.5 else f"<p>{self.say(2, 10)}</p>")
        elif kind == "foot":
            inner = r.choice([f"&copy; {self.say(1, 8)} &middot; {self.say(2, 14)}", f"<p>{self.say(3, 25)}</p>", self.links() + f"<p>&copy; {self.say(1, 6)}</p>"])
        elif kind == "side":
            inner = f"<h3>{self.say(1, 3)}</h3>" * (r.random() < 0.6) + (self.links() if r.random() < 0.5 else "".join(f"<p>{self.say(4, 40)}</p>" for _ in range(r.randint(1, 4))))
        elif kind in ("note", "advert"):
            inner = r.choice([self.say(4, 30), f"<p>{self.say(4, 40)}</p>", f"<p>{self.say(4, 20)} <a href='#'>{self.say(1, 3)}</a></p><button>{self.say(1, 2)}</button>"])
        elif kind == "form":
            inner = f"<label>{self.say(1, 3)}</label><input name='q'>" + r.choice(["", f"<p>{self.say(3, 20)}</p>", f"<select><option>{self.say(1, 2)}</option></select>", f"<fieldset><legend>{self.say(1, 3)}</legend>{self.say(2, 9)}</fieldset>"]) + f"<button>{self.say(1, 2)}</button>"
        elif kind == "talk":
            one = lambda: f'<div class="comment">{f"<b>{self.say(1, 2)}</b>" if r.random() < 0.4 else f"<h4>{self.say(1, 2)}</h4>"}<p>{self.say(3, 70)}</p></div>' if r.random() < 0.6 else f"<{(t := r.choice(['p', 'li', 'div', 'article']))}>{self.say(3, 60)}</{t}>"
            inner = f"<h3>{self.say(1, 3)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice([self.links(), f"<span>{self.say(1, 4)}</span> <a href='#'>{self.say(1, 2)}</a>"])
        return self.wrap(kind, inner)

    def body(self) -> str:
        """The main text, block by block, now and then with a foreign part inside."""
        r, out, more = self.r, [], MARK
        out.append(f"<h1>{more}{self.say(2, 9)}</h1>" if r.random() < 0.7 else f"<header><h1>{more}{self.say(2, 9)}</h1></header>" if r.random() < 0.4 else "")
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            long = r.choice([(1, 3), (5, 30), (20, 120), (60, 300)])
            p = f"{more}{self.say(*long)}"
            if kind < 0.55:
                out.append(f"<p>{p}</p>")
            elif kind < 0.62:
                out.append(f"<p><b>{p}<br>")
            elif kind < 0.68:
                out.append(f"<p>{p} <a href='/x'>{self.say(1, 4)}</a> {self.say(3, 20)}</p>")
            elif kind < 0.74:
                out.append(f"<h2>{more}{self.say(1, 6)}</h2>")
            elif kind < 0.80:
                out.append("<ul>" + "".join(f"<li>{more}{self.say(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{p}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{p}</blockquote>")
            elif kind < 0.88:
                out.append(f"<table><tr><td>{more}{self.say(1, 8)}</td><td>{more}{self.say(1, 8)}</td></tr></table>")
            elif kind < 0.91:
                out.append(f"<figure><img src='i'><figcaption>{more}{self.say(2, 12)}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<section><h3>{more}{self.say(1, 5)}</h3><p>{p}</p></section>" if r.random() < 0.6 else f"<div>{p}</div>")
            else:
                out.append(self.part(r.choice(["advert", "share", "note", "side", "form"])))
        if r.random() < 0.06:
            out.append(self.part("talk"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        inner, style = self.body(), r.random()
        name = f' {r.choice(["class", "id"])}="{self.named(MAIN_NAMES, r.choice([1, 1, 2]))}"'
        if style < 0.45:
            main = f"<article{name if r.random() < 0.4 else ''}>{inner}</article>"
        elif style < 0.6:
            main = f"<main{name if r.random() < 0.4 else ''}>{inner}</main>"
        elif style < 0.9:
            main = f"<div{name}>{inner}</div>"
        else:
            main = f"<div>{inner}</div>" if style < 0.97 else inner
        if r.random() < 0.3:
            main = f"<{(t := r.choice(['main', 'div', 'section']))}>{main}</{t}>"
        before = [self.part(k) for k in ("menu", "head", "note", "advert", "form", "share", "side") if r.random() < (0.75 if k == "menu" else 0.3)]
        after = [self.part(k) for k in ("talk", "side", "advert", "form", "share", "menu", "note", "foot") if r.random() < (0.8 if k == "foot" else 0.4 if k == "talk" else 0.25)]
        if r.random() < 0.7:
            r.shuffle(before)
        middle = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(["wrapper", "container", "page", "wrap", "site", "row", "layout"])}">{middle}</div>'
        head = f"<title>{self.say(2, 8)}</title>" + "".join(r.sample(["<meta charset=utf-8>", "<link rel=stylesheet href=s.css>", "<style>h1 > b {color: red}</style>", "<script>if (a < b) go('<div>');</script>", "<base href=/>"], r.randint(0, 3)))
        if r.random() < 0.15:  # tags that HTML lets a page leave out
            return f"<!doctype html>{head}{middle}"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{middle}</body></html>"


def make_page(seed: int) -> str:
    return Maker(seed).page()
