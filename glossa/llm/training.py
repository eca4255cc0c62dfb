"""Labelled web pages written by rule, to train the block labeller of html_extract.

A page has a main part and boilerplate around and inside it; layouts, element names, classes, lengths and
broken markup vary at random from a seed. Words are random syllables, so that only structure, lengths and the
usual words of boilerplate can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import numpy as np

# Usual class and id words, and usual words of boilerplate.
MAIN = "article content post entry story body text main page single prose blog news detail description".split()
MENU = "nav menu navbar navigation breadcrumb breadcrumbs tabs pagination pager links toc skip topbar".split()
ASIDE = "sidebar side aside widget related recommended popular trending tags archive categories author bio recent".split()
ADVERT = "ad ads advert advertisement promo sponsor sponsored banner adsense dfp promotion offer".split()
NOTICE = "notice cookie consent alert popup modal overlay gdpr message warning disclaimer announcement paywall".split()
FORM = "form search newsletter subscribe signup login contact subscription survey".split()
COMMENTS = "comments comment replies reply discussion responses feedback disqus thread respond".split()
FOOTER = "footer foot copyright legal bottom colophon credits".split()
HEADER = "header head masthead logo top brand branding site tagline".split()
SHARE = "share social sharing follow buttons toolbar meta byline".split()
SAID = (
    "Home About Contact Privacy Terms Login Search Menu Share Tweet Subscribe Advertisement Sponsored Related Comments Reply Cookies Accept "
    "Copyright rights reserved Newsletter Email Read more Next Previous Tags Archive Categories Follow us Sign up"
).split()
NOISE = "col row wrap inner outer box item block grid container wrapper section left right card list module region layout".split()
SYLLABLES = "an be co de er fi go ha in jo ka le mi no or pe qui ra st te un ve wi xa yo zu th en re on é ü ch ó".split()


class Writer:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.main: set[str] = set()

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int, said: float = 0.0) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        noisy = self.pick(["", "", "", "", "###", "!!", " |"])
        out = [self.pick(SAID) if self.chance(said) else self.word() + (self.pick([".", ","]) if self.chance(0.12) else "") + noisy for _ in range(max(1, n))]
        text = " ".join(out)
        return text[:1].upper() + text[1:] + ("." if self.chance(0.8) and not said else "")

    def keep(self, text: str) -> str:
        """Main text, as it stands in the page."""
        self.main.add(" ".join(text.split()))
        return escape(text, quote=self.chance(0.5))

    def attributes(self, names: list[str], p: float = 0.9) -> str:
        own = [self.pick(names)] if self.chance(p) else []
        if own and self.chance(0.3):
            own = [own[0] + self.pick(["-", "_"]) + self.pick([*NOISE, self.word()])]
        if self.chance(0.3):
            own.insert(int(self.rng.integers(len(own) + 1)), self.pick([*NOISE, self.word()]))
        if not own:
            return ""
        return f' id="{own[0]}"' if self.chance(0.2) else f' class="{" ".join(own)}"'

    def tag(self, name: str, inner: str, attributes: str = "") -> str:
        return f"<{name}{attributes}>{inner}</{name}>"

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.words(1, 4, 0.2)}</a></li>' for _ in range(n))
        return self.tag("ul", items)

    def aside_text(self, low: int = 2, high: int = 25) -> str:
        text = escape(self.words(low, high, self.pick([0, 0, 0.2])))
        return self.tag("p", text) if self.chance(0.4) else text

    def boilerplate(self, kind: str) -> str:
        n = int(self.rng.integers(2, 9))
        if kind == "menu":
            return self.tag("nav", self.links(n), self.attributes(MENU, 0.4)) if self.chance(0.6) else self.tag("div", self.links(n), self.attributes(MENU))
        if kind == "header":
            inner = self.tag(self.pick(["div", "p", "h1", "h2", "span"]), self.words(1, 5), self.attributes(HEADER, 0.3)) + (self.links(n) if self.chance(0.4) else "")
            return self.tag("header", inner, self.attributes(HEADER, 0.3)) if self.chance(0.6) else self.tag("div", inner, self.attributes(HEADER))
        if kind == "advert":
            return self.tag(self.pick(["div", "div", "aside", "section"]), self.aside_text(2, 30), self.attributes(ADVERT, 1))
        if kind == "notice":
            return self.tag(self.pick(["div", "div", "section", "aside"]), self.aside_text(3, 40) + self.tag("button", "OK") * self.chance(0.5), self.attributes(NOTICE, 1))
        if kind == "form":
            inner = f'<label>{self.words(1, 4, 0.3)}</label><input type="text" name="q">' + self.tag("p", self.words(2, 14, 0.1)) * self.chance(0.4) + self.tag("button", self.words(1, 2, 0.7))
            if self.chance(0.3):
                inner += self.tag("select", "".join(self.tag("option", self.word()) for _ in range(n)))
            return self.tag("form", inner, self.attributes(FORM, 0.6))
        if kind == "aside":
            inner = self.tag(self.pick(["h2", "h3", "h4", "p"]), self.words(1, 4, 0.3)) + (self.links(n) if self.chance(0.6) else "".join(self.tag("p", escape(self.words(4, 40))) for _ in range(n // 2)))
            return self.tag("aside", inner, self.attributes(ASIDE, 0.5)) if self.chance(0.5) else self.tag(self.pick(["div", "section"]), inner, self.attributes(ASIDE, 1))
        if kind == "share":
            return self.tag("div", self.links(min(n, 4)) if self.chance(0.5) else self.words(1, 8, 0.3), self.attributes(SHARE, 1))
        if kind == "comments":
            one = lambda: self.tag(self.pick(["div", "li", "article"]), self.tag("p", self.words(1, 3), self.attributes(["author", "user", "date"])) * self.chance(0.5) + self.tag("p", escape(self.words(3, 60))), self.attributes(["comment", "reply", "message"], 0.8))
            return self.tag(self.pick(["section", "div", "ol"]), self.tag("h3", self.words(1, 3, 0.4)) * self.chance(0.6) + "".join(one() for _ in range(n)), self.attributes(COMMENTS, 1))
        inner = self.pick(["&copy; ", "&copy; 2020 ", "", "Copyright "]) + self.words(1, 14, self.pick([0, 0.2])) + self.pick(["", " &middot; " + self.words(2, 16)]) + (self.links(n) if self.chance(0.3) else "")
        inner = self.tag("p", inner) if self.chance(0.3) else inner
        return self.tag("footer", inner, self.attributes(FOOTER, 0.3)) if self.chance(0.65) else self.tag("div", inner, self.attributes(FOOTER, 1))

    def paragraph(self) -> str:
        text = self.words(1, 160)
        kind = self.rng.random()
        if kind < 0.62:
            if self.chance(0.2):
                a, b, c = self.words(1, 20), self.words(1, 3), self.words(1, 20)
                self.main.add(" ".join(f"{a} {b} {c}".split()))
                t = self.pick(["a", "b", "em", "i", "strong", "span"])
                return f"<p>{escape(a)} <{t}>{escape(b)}</{t}>\n {escape(c)}</p>"
            return self.tag("p", self.keep(text))
        if kind < 0.72:
            return f"<p><b>{self.keep(text)}<br>" + ("" if self.chance(0.7) else "</p>")
        if kind < 0.79:
            return self.tag(self.pick(["h2", "h3", "h4"]), self.keep(self.words(1, 9)))
        if kind < 0.85:
            return self.tag(self.pick(["ul", "ol"]), "".join(self.tag("li", self.keep(self.words(1, 25))) for _ in range(int(self.rng.integers(2, 6)))))
        if kind < 0.89:
            return self.tag("blockquote", self.tag("p", self.keep(text)))
        if kind < 0.92:
            return self.tag("figure", '<img src="x.png">' + self.tag("figcaption", self.keep(self.words(2, 12))))
        if kind < 0.95:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.keep(self.words(1, 4))) for _ in range(3))) for _ in range(2)))
        return self.tag("div", self.keep(text)) if self.chance(0.7) else self.tag("pre", self.keep(text))

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(int(np.exp(self.rng.uniform(0, np.log(26)))))]
        for _ in range(int(self.rng.integers(0, 3)) if self.chance(0.45) else 0):
            parts.insert(int(self.rng.integers(len(parts) + 1)), self.boilerplate(self.pick(["advert", "advert", "notice", "share", "form", "aside"])))
        title = self.tag("h1", self.keep(self.words(1, 14))) if self.chance(0.8) else ""
        if title and self.chance(0.12):
            title = self.tag("header", title)
        inner = "".join(parts)
        if self.chance(0.3):
            inner = self.tag(self.pick(["div", "section"]), inner, self.attributes(MAIN, 0.8))
        inner = title + inner
        if self.chance(0.2):
            inner += self.boilerplate("comments")
        if self.chance(0.12):  # no element of its own, or one without a name
            return inner if self.chance(0.5) else self.tag("div", inner)
        name = self.pick(["article", "article", "article", "main", "div", "div", "section"])
        own = self.attributes(MAIN, 0.35 if name in ("article", "main") else 0.97)
        if name == "div" and self.chance(0.2):
            own = ' role="main"'
        out = self.tag(name, inner, own)
        return self.tag("main", out) if name != "main" and self.chance(0.2) else out

    def plain(self) -> str:
        """A body of main text only, with little markup."""
        if self.chance(0.3):
            return self.keep(self.words(1, 120))
        texts = [self.keep(self.words(1, 90)) for _ in range(int(self.rng.integers(1, 12)))]
        t = self.pick(["p", "p", "p", "div", "h2"])
        body = "".join(self.tag(t if self.chance(0.9) else "p", x) for x in texts)
        for _ in range(int(self.rng.integers(0, 3))):
            body = self.tag("div", body, self.attributes(NOISE, 0.5))
        return body

    def page(self) -> str:
        title = self.words(2, 10)
        head = f"<head><meta charset=\"utf-8\"><title>{escape(title)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        before = [self.boilerplate(k) for k in ("menu", "header", "advert", "notice", "form", "aside") if self.chance({"menu": 0.8, "header": 0.45, "advert": 0.55}.get(k, 0.25))]
        after = [self.boilerplate(k) for k in ("share", "comments", "aside", "advert", "notice", "form", "menu", "footer") if self.chance({"footer": 0.85, "comments": 0.4, "aside": 0.4}.get(k, 0.2))]
        if self.chance(0.5):
            before = [before[i] for i in self.rng.permutation(len(before))]
        body = "".join([*before, "<!-- x -->" * self.chance(0.3), self.article(), *after])
        for _ in range(int(self.rng.integers(0, 3)) if self.chance(0.4) else 0):
            body = self.tag("div", body, self.attributes(NOISE, 0.8))
        if self.chance(0.08):
            self.main.clear()
            body = self.plain()
        page = f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
        if self.chance(0.12):
            page = page[: page.rfind("</p>")] if "</p>" in page and self.chance(0.5) else page.removesuffix("</body></html>")
        return page


def pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the main blocks)."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        writer = Writer(rng)
        yield writer.page(), writer.main
