"""HTML extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, inline tags and <br> not
counting. What is no text of the page (comments, titles, scripts, styles, templates, frames, text fields) makes no block;
formulas, `noscript` and the content of objects and drawings are text. Each block has
hashed vectors of its tag path (tag names and the words of class, id and role) and of its words, and a few
numbers. A bidirectional LSTM in numpy reads the whole sequence of a page and labels every block as main text
or not.

The labeller is trained on pages that `training.pages` writes by rule, with known labels, seeded; nothing is
read from the tables to train it; `extract` also takes a model that was trained before. Pages are scored whole, however
long, and read in time linear in their length, however deep or broken: open elements are found by their names'
last positions, a name without an end tag is searched for once.

Defined cases: a null or empty page has an empty text. Broken or cut markup is read as far as it goes: an
unclosed comment or tag ends the page, an unclosed element ends with its parent; from the first tag with an unclosed
quote on, tags end at the next >. Repeated rows get equal texts. Only the html goes to Python, so ids and other columns
stay as they are, beside nulls too; columns of other names than `keep` and html are not looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.session import ship

# HTML element names by role.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title template iframe textarea".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("ul ol table dl select body html div article section main nav aside header footer form blockquote td th".split())

_OTHER = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)"
TOKEN = re.compile(_OTHER + r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+)|<", re.S)
UNQUOTED = re.compile(_OTHER + r"([^>]*)(?:>|\Z)|([^<]+)|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

PATH, WORD, NUMBERS = 192, 48, 8
SIZE = PATH + WORD + NUMBERS


class Block:
    """A leaf block; path: how often its tag path has each hashed name or word."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, linked: int, path: np.ndarray) -> None:
        self.text, self.linked, self.path = text, linked, path


class _Open:
    """The open elements, with the last positions of their names."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.paths: list[np.ndarray] = []  # of the first so many blocks

    def push(self, name: str, own: tuple[str, ...]) -> None:
        i = len(self.stack)
        self.stack.append((name, own))
        self.at[name].append(i)
        if name in BLOCK:
            self.blocks.append(i)
        if name in SCOPE:
            self.scopes.append(i)

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else -1

    def pop_to(self, i: int) -> None:
        """Close the element at i and all above it."""
        while len(self.stack) > i:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            if name in SCOPE:
                self.scopes.pop()
        del self.paths[len(self.blocks) :]

    def close(self, name: str) -> None:
        i = self.last(name)
        if i >= 0 and (name in BLOCK or not self.blocks or self.blocks[-1] < i):
            self.pop_to(i)

    def close_implied(self, name: str) -> None:
        """What the start of a block element closes, inside its scope."""
        i = max(self.last(x) for x in CLOSES.get(name, CLOSES["p"]))
        if i >= 0 and (not self.scopes or self.scopes[-1] <= i):
            self.pop_to(i)

    def path(self) -> np.ndarray:
        for i in self.blocks[len(self.paths) :]:
            own = _path_vector(self.stack[i][1])
            self.paths.append(self.paths[-1] + own if self.paths else own)
        return self.paths[-1] if self.paths else _path_vector(())


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; text has character references decoded and white space folded."""
    page = page or ""
    opened = _Open()
    out: list[Block] = []
    parts: list[str] = []
    endless: set[str] = set()
    linked, at, end, token = 0, 0, len(page), TOKEN

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, opened.path()))
        parts.clear()
        linked = 0

    while at < end:
        m = token.match(page, at)
        closing, opening, attributes, text = m.group(1, 2, 3, 4)
        if m.end() - at == 1 and text is None and token is TOKEN and page[at + 1 : at + 2].isalpha():
            token = UNQUOTED  # a tag with an unclosed quote
            continue
        at = m.end()
        if text is not None:
            parts.append(text)
            if opened.at.get("a"):
                linked += len(text)
        elif opening is not None:
            name = opening.lower()
            if name in UNREAD:
                close = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if close is None:
                    endless.add(name)
                at = close.end() if close else (end if name in ("script", "style", "title", "textarea") else at)
                continue
            if name == "head":
                continue
            if name in BLOCK:
                flush()
                opened.close_implied(name)
            elif name == "br":
                parts.append(" ")
            foreign = name in FOREIGN or opened.at.get("svg") or opened.at.get("math")
            if name not in VOID and not (foreign and attributes.endswith("/")):
                own = [name]
                for a in ATTRIBUTE.findall(attributes):
                    own += [f".{w}" for w in NAME.findall(CAMEL.sub(" ", "".join(a[1:])).lower())]
                opened.push(name, tuple(own))
        elif closing is not None:
            name = closing.lower()
            if name in BLOCK:
                flush()
            opened.close(name)
        elif m.end() - m.start() == 1:  # a < that opens no tag
            if page[at : at + 1] == "/":
                cut = page.find(">", at)
                at = end if cut < 0 else cut + 1
            else:
                parts.append("<")
    flush()
    return out


@lru_cache(1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@lru_cache(1 << 14)
def _path_vector(own: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for x in own:
        v[_slot(x, PATH)] += 1
    return v


def vectors(bs: list[Block]) -> np.ndarray:
    x, crc = np.zeros((len(bs), SIZE), np.float32), zlib.crc32
    for i, b in enumerate(bs):
        x[i, :PATH] = np.minimum(b.path, 2)
        ws = b.text.lower().encode("utf-8", "surrogatepass").split()
        x[i, PATH : PATH + WORD] = np.bincount([crc(w) % WORD for w in ws], minlength=WORD) / len(ws)
        n = len(b.text)
        x[i, PATH + WORD :] = (
            np.log1p(n) / 8, b.linked / max(n, 1), np.log1p(len(ws)) / 6, b.text.count(".") / (1 + len(ws)), b.text[-1] in ".!?…",
            i / len(bs), np.log1p(i) / 6, np.log1p(len(bs) - 1 - i) / 6,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block. Arrays are time x pages x features."""

    def __init__(self, hidden: int = 20, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"wx{d}": draw(SIZE, 4 * hidden) * 0.7, f"wh{d}": draw(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1
        self.p |= {"wo": draw(2 * hidden, 1), "bo": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        steps, pages, h = x.shape[0], x.shape[1], self.hidden
        pre = x.reshape(-1, SIZE) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        pre = pre.reshape(steps, pages, 4 * h)
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out = np.zeros((steps, pages, h), np.float32)
        cache = {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ self.p[f"wh{d}"]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                cache[t] = (i, f, o, g, cell, squashed, state)
            cell = m * new + (1 - m) * cell
            state = m * o * squashed + (1 - m) * state
            out[t] = state
        return out, cache

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        (f, cf), (b, cb) = self._pass(x, mask, "f", keep), self._pass(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return _sigmoid((both @ self.p["wo"])[..., 0] + self.p["bo"]), both, (cf, cb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, both, caches = self.forward(x, mask, True)
        h, steps = self.hidden, len(x)
        out = ((prob - y) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"wo": both.reshape(-1, 2 * h).T @ out.reshape(-1, 1), "bo": out.sum(axis=(0, 1))}
        back = out @ self.p["wo"].T
        for d, cache, above in (("f", caches[0], back[..., :h]), ("b", caches[1], back[..., h:])):
            dz = np.zeros((steps, x.shape[1], 4 * h), np.float32)
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            wh = np.zeros_like(self.p[f"wh{d}"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, c, cell, squashed, state = cache[t]
                m = mask[t][:, None]
                ds = ds + above[t]
                on = m * ds
                new = on * o * (1 - squashed**2) + m * dc
                dz[t] = np.concatenate([new * c * i * (1 - i), new * cell * f * (1 - f), on * squashed * o * (1 - o), new * i * (1 - c**2)], axis=1)
                wh += state.T @ dz[t]
                ds = dz[t] @ self.p[f"wh{d}"].T + (1 - m) * ds
                dc = new * f + (1 - m) * dc
            flat = dz.reshape(-1, 4 * h)
            g |= {f"wx{d}": x.reshape(-1, SIZE).T @ flat, f"wh{d}": wh, f"b{d}": flat.sum(axis=0)}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 7, batch: int = 32, rate: float = 0.012, seed: int = 7) -> None:
        """Adam on mean cross entropy; pages: (vectors, labels)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        by_length = np.array_split(np.array(sorted(range(len(pages)), key=lambda i: len(pages[i][0]))), max(1, len(pages) // batch))
        for epoch in range(epochs):
            for at in rng.permutation(len(by_length)):
                order = by_length[at]
                x, mask = padded([pages[j][0] for j in order])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(order):
                    y[: len(pages[k][1]), j] = pages[k][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (0.3 if epoch >= epochs - 2 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        for group in _groups(order, pages):
            x, mask = padded([pages[i] for i in group])
            prob = self.forward(x, mask)[0]
            for j, i in enumerate(group):
                out[i] = prob[: len(pages[i]), j] >= 0.5
        return out


def _groups(order: list[int], pages: list[np.ndarray], cells: int = 16_384) -> Iterator[list[int]]:
    """Runs of pages with at most `cells` padded blocks, or one page."""
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * len(pages[i]) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, xs)), len(xs), SIZE), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for j, own in enumerate(xs):
        x[: len(own), j], mask[: len(own), j] = own, 1
    return x, mask


def train(n_pages: int = 1000, seed: int = 7) -> Labeller:
    """A labeller fitted to pages written by rule."""
    from glossa.llm.training import pages

    data = []
    for page, main in pages(n_pages, seed):
        bs = blocks(page)
        data.append((vectors(bs), np.array([b.text in main for b in bs], np.float32)))
    model = Labeller(seed=seed)
    model.fit([d for d in data if len(d[0])])
    return model


def extract(pages: DataFrame, model: Labeller | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages, text and n_chars."""
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("text string, n_chars long")
    def run(column: pd.Series) -> pd.DataFrame:
        texts: list[str] = []
        for i in range(0, len(column), 64):
            found = [blocks(h) for h in column.iloc[i : i + 64]]
            labels = held.value.label([vectors(bs) for bs in found])
            texts += ["\n".join(b.text for b, y in zip(bs, ys, strict=True) if y) for bs, ys in zip(found, labels, strict=True)]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]}, columns=["text", "n_chars"])

    return pages.select(*keep, run("html").alias("_found")).select(*keep, "_found.*")
