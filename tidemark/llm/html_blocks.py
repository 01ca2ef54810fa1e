"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into blocks, runs of text between block-level tags. Each block becomes a vector: hashed
names, classes and roles of its tag path, hashed words, and measures of the block and of the three
elements around it: how much of the page they hold, how much of that is linked. A bidirectional LSTM in
numpy reads the blocks of the whole page in both directions and labels every block as main text or not.

The labeller is trained here on a bounded sample. Pages with an ``article`` or ``main`` element label
themselves; more are laid out from their texts with known labels. Most of them are shown disguised, with
random names in place of classes and ids and ``div`` in place of the elements that name their purpose, so
that what is learned is how pages are built and not how one template calls its parts.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest

PATH, WORDS, MEASURES = 64, 32, 30
WIDTH = PATH + WORDS + MEASURES
HIDDEN = 24
SAMPLE = 240
SAMPLE_CHARS = 200_000
LAYOUTS = 900
EPOCHS = 14
#: How much of a path's vector the next element inside keeps.
KEEP_FAR, KEEP_NEAR = 0.9, 0.4

# Element kinds of the HTML standard.
RAW = "script style noscript template textarea iframe title"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a line of their own; all others, custom ones too, run on within their line.
BLOCK_LEVEL = set(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr "
    "ul video audio canvas map input textarea iframe".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}

# As in the standard, a quote opens a value only after an equals sign. One that nothing closes is a letter.
ATTRIBUTES = (
    r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+"
)
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{'|'.join(RAW.split())})(?=[\s/>])(?:{ATTRIBUTES}|[^>]*)"
    r"(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attributes>{ATTRIBUTES})>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][\w:-]*)[^>]*>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
#: Elements that do not cut the text of a drawing either.
INLINE_DRAWN = {"a", "tspan", "textpath"}
#: How many elements around a block are measured.
NEAR = 3


class Element:
    """An open element, its parent, and what its blocks add up to; ``kind`` numbers its path's names."""

    __slots__ = ("parent", "tag", "names", "depth", "drawn", "chars", "linked", "blocks", "kind", "main")

    def __init__(self, parent: Element | None, tag: str, names: tuple[str, ...]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.depth = parent.depth + 1 if parent else 0
        self.drawn = tag == "svg" or parent is not None and parent.drawn
        self.chars = self.linked = self.blocks = 0
        self.kind = -1
        self.main: tuple[bool, bool] | None = None


@dataclass
class Block:
    text: str
    element: Element
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        names: list[tuple[str, ...]] = []
        at: Element | None = self.element
        while at is not None:
            names.append(at.names)
            at = at.parent
        return tuple(n for own in reversed(names) for n in own)


@dataclass
class _Page:
    """Blocks of one page; ``top`` is the innermost open block-level element, ``open_tags`` counts all."""

    blocks: list[Block] = field(default_factory=list)
    top: Element = field(default_factory=lambda: Element(None, "", ()))
    open_tags: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False

    def text(self, piece: str) -> None:
        if self.in_link:
            self.linked += len(piece)
        self.pieces.append(html.unescape(piece) if "&" in piece else piece)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.top, self.linked))
                at: Element | None = self.top
                for _ in range(NEAR):
                    if at is None:
                        break
                    at.chars += len(text)
                    at.linked += min(self.linked, len(text))
                    at.blocks += 1
                    at = at.parent
            self.pieces = []
        self.linked = 0

    def _pop(self) -> None:
        self.open_tags[self.top.tag] -= 1
        self.top = self.top.parent

    def open(self, tag: str, attributes: str) -> None:
        drawn = self.top.drawn
        if tag not in BLOCK_LEVEL and not drawn:
            if tag == "a":
                self.in_link = True
            elif tag == "br":
                self.pieces.append(" ")
            return
        if drawn and tag in INLINE_DRAWN:
            return
        self.end_block()
        drawn = drawn or tag == "svg"
        self.in_link = self.in_link and drawn
        if tag in VOID or drawn and attributes.endswith("/"):
            return
        if tag in CLOSES_P and self.top.tag == "p":
            self._pop()
        if tag in SIBLINGS:
            while self.top.tag in SIBLINGS[tag] or self.top.tag == "p":
                self._pop()
        names = [tag]
        for _, a, b, c in NAMES.findall(attributes or ""):
            names += [w for w in SPLIT.split((a or b or c).lower()) if w]
        self.open_tags[tag] += 1
        self.top = Element(self.top, tag, tuple(names[:12]))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag not in BLOCK_LEVEL and not self.top.drawn or self.top.drawn and tag in INLINE_DRAWN:
            return
        self.end_block()
        if self.open_tags[tag]:
            while self.top.tag != tag:
                self._pop()
            self._pop()


def _walk(page: str) -> Iterator[tuple[_Page, str]]:
    """Read a page from left to right; yields the state after each tag, and the tag's name. Every match
    takes in what it has looked at; behind the last ``>`` no tag can end, and nothing is looked for."""
    out, at, seek = _Page(), 0, 0
    last = page.rfind(">")
    while (start := page.find("<", seek)) >= 0:
        if start > last:
            comment = page.find("<!--", start)
            if comment >= 0:
                out.text(page[at:comment])
                at = len(page)
            break
        m = TOKEN.match(page, start)
        if m is None:
            seek = start + 1
            continue
        if start > at:
            out.text(page[at:start])
        at = seek = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closes = m["close"] or m["close2"]
        if name and closes:
            out.close(name)
        elif name:
            out.open(name, m["attributes"] or "")
        elif m["raw"]:
            out.end_block()
        yield out, name if not closes else ""
    if at < len(page):
        out.text(page[at:])
    out.end_block()
    yield out, ""


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, in time that grows with its length. White space inside a block is one
    space, references are decoded within each run of text, so that a tag or comment ends them. Comments and
    the elements of ``RAW`` are no text and run to their end tag, or without one to the end of the page, as in
    browsers. Elements that are not block-level, custom ones too, do not cut a block. Broken markup never
    fails: any other element that is not closed ends with its parent, an unmatched end tag ends nothing."""
    for out, _ in _walk(page or ""):
        pass
    return out.blocks


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return found


class PathVectors:
    """Vectors of tag paths, each from its parent's: names far out fade slowly in one half of the sum and
    fast in the other. Equal paths of all pages share one vector."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[int, tuple[str, ...]], int] = {}
        self.far, self.near = [np.zeros(PATH, np.float32)], [np.zeros(PATH, np.float32)]
        self.names: dict[str, np.ndarray] = {}

    def _name(self, name: str) -> np.ndarray:
        if name not in self.names:
            if len(self.names) >= 50_000:
                self.names.clear()
            vector = np.zeros(PATH, dtype=np.float32)
            for kind in ("", "near "):
                code = zlib.crc32((kind + name).encode("utf-8", "surrogatepass"))
                vector[code % (PATH // 2) + (PATH // 2 if kind else 0)] += 1.0 if code >> 16 & 1 else -1.0
            self.names[name] = vector
        return self.names[name]

    def kind(self, element: Element) -> int:
        """The number of an element's path; elements whose number is known end the way up."""
        todo, at = [], element
        while at is not None and at.kind < 0:
            todo.append(at)
            at = at.parent
        known = at.kind if at is not None else 0
        for each in reversed(todo):
            key = known, each.names
            if key not in self.kinds:
                self.kinds[key] = len(self.far)
                own = sum((self._name(n) for n in each.names), np.zeros(PATH, np.float32))
                self.far.append(np.clip(KEEP_FAR * self.far[known] + own, -3, 3))
                self.near.append(np.clip(KEEP_NEAR * self.near[known] + own, -3, 3))
            known = each.kind = self.kinds[key]
        return known

    def matrix(self, elements: list[Element]) -> np.ndarray:
        kinds = [self.kind(e) for e in elements]
        half = PATH // 2
        out = np.empty((len(kinds), PATH), dtype=np.float32)
        for i, k in enumerate(kinds):
            out[i, :half], out[i, half:] = self.far[k][:half], self.near[k][half:]
        return out


class Vectors:
    """Blocks to matrices, with caches that live as long as the task and are emptied when they are full.
    A page's elements keep their path's number, so a page is turned into a matrix once."""

    def __init__(self) -> None:
        self.words, self.paths = WordHashes(), PathVectors()

    def matrix(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        out = np.zeros((n, WIDTH), dtype=np.float32)
        if not n:
            return out
        if len(self.paths.far) >= 20_000:
            self.paths = PathVectors()
        codes: list[int] = []
        sizes, measures, hashed = [], [], self.words.__getitem__
        whole = sum(len(b.text) for b in blocks)
        longest = max(len(b.text) for b in blocks)
        done = 0
        for i, block in enumerate(blocks):
            text = block.text
            words = text.split(" ")
            codes.extend(map(hashed, words))
            size, chars = len(words), len(text)
            sizes.append(size)
            around: list[float] = []
            at: Element | None = block.element
            for _ in range(NEAR):
                if at is None or not at.chars:
                    around += (1.0, 0.0, 0.0, 0.0)
                    continue
                around += (at.chars / whole, at.linked / at.chars, math.log1p(at.blocks) / 3, math.log1p(at.chars / at.blocks) / 6)
                at = at.parent
            measures.append(
                (
                    1.0,
                    chars / size / 10,
                    min(block.linked / chars, 1.0),
                    text[-1] in ".!?…",
                    text[0].isupper(),
                    block.element.depth / 10,
                    (i + 1) / n,
                    i == 0,
                    i == n - 1,
                    done / whole,
                    chars / whole,
                    chars / longest,
                    math.log1p(n) / 4,
                    math.log1p(whole) / 8,
                    (text.count(".") + text.count(",")) / size,
                    n - i <= 3,
                    i < 3,
                    *around,
                )
            )
            done += chars
        size = np.array(sizes)
        cells = np.repeat(np.arange(n) * WORDS, size) + np.array(codes)
        counts = np.bincount(cells, minlength=n * WORDS).reshape(n, WORDS)
        out[:, :PATH] = self.paths.matrix([b.element for b in blocks])
        out[:, PATH : PATH + WORDS] = counts / size[:, None]
        out[:, PATH + WORDS] = np.minimum(np.log1p(size) / 5, 2)
        out[:, PATH + WORDS + 1 :] = np.minimum(np.array(measures, dtype=np.float32), 3)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, p: dict[str, np.ndarray], side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states over (time, batch, width). ``keep`` collects what the way back needs."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN), dtype=x.dtype)
    c = np.zeros_like(h)
    out = np.empty((steps, batch, HIDDEN), dtype=x.dtype)
    driven = x @ p[f"W{side}"] + p[f"b{side}"]
    for t in range(steps):
        gates = driven[t] + h @ p[f"U{side}"]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def _lstm_back(x, p, side, keep, dout, grads) -> None:
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    dgates = np.empty((*dout.shape[:2], 4 * HIDDEN), dtype=x.dtype)
    for t in range(len(keep) - 1, -1, -1):
        h, before, i, f, o, g, tc = keep[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = dgates[t]
        d[:, :HIDDEN] = dc * g * i * (1 - i)
        d[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        d[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        d[:, 3 * HIDDEN :] = dc * i * (1 - g * g)
        grads[f"U{side}"] += h.T @ d
        dh, dc = d @ p[f"U{side}"].T, dc * f
    flat = dgates.reshape(-1, 4 * HIDDEN)
    grads[f"W{side}"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[f"b{side}"] += flat.sum(axis=0)


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every sequence backwards within its own length; the padding stays behind."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
    return x[at, np.arange(x.shape[1])[None, :]]


def _padded(matrices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(m) for m in matrices])
    x = np.zeros((lengths.max(), len(matrices), WIDTH), dtype=np.float32)
    for j, m in enumerate(matrices):
        x[: len(m), j] = m
    return x, lengths


@dataclass
class Labeller:
    parameters: dict[str, np.ndarray]

    def logits(self, matrices: list[np.ndarray]) -> list[np.ndarray]:
        """Per block: above zero is main text. Pages of similar length share a batch."""
        p, found = self.parameters, [np.zeros(0, dtype=np.float32)] * len(matrices)
        order = sorted((i for i, m in enumerate(matrices) if len(m)), key=lambda i: len(matrices[i]))
        at = 0
        while at < len(order):
            most = max(1, min(256, 60_000 // len(matrices[order[at]])))
            batch = order[at : at + most]
            while len(batch) > 1 and len(matrices[batch[-1]]) > 2 * len(matrices[batch[0]]) + 8:
                batch = batch[: max(1, len(batch) // 2)]
            at += len(batch)
            x, lengths = _padded([matrices[i] for i in batch])
            forth = _lstm(x, p, "f")
            back = _reversed(_lstm(_reversed(x, lengths), p, "b"), lengths)
            scores = np.concatenate([forth, back], axis=2) @ p["V"] + p["d"]
            for j, i in enumerate(batch):
                found[i] = scores[: lengths[j], j, 0]
        return found


def loss_and_gradients(
    p: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, y: np.ndarray
) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss of all blocks of a batch, and its gradients by backpropagation through time."""
    mask = (np.arange(len(x))[:, None] < lengths[None, :]).astype(x.dtype)
    forward, backward = [], []
    forth = _lstm(x, p, "f", forward)
    turned = _reversed(x, lengths)
    back = _reversed(_lstm(turned, p, "b", backward), lengths)
    both = np.concatenate([forth, back], axis=2)
    score = (both @ p["V"])[:, :, 0] + p["d"]
    loss = float(((np.logaddexp(0, score) - y * score) * mask).sum() / mask.sum())
    d = ((_sigmoid(score) - y) * mask / mask.sum())[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["V"] += both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1)
    grads["d"] += d.sum()
    dboth = d @ p["V"].T
    _lstm_back(x, p, "f", forward, dboth[:, :, :HIDDEN], grads)
    _lstm_back(turned, p, "b", backward, _reversed(dboth[:, :, HIDDEN:], lengths), grads)
    return loss, grads


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> Labeller:
    """Train on (matrix, labels) of each page with Adam on the logistic loss of all blocks."""
    if not any(len(m) for m, _ in pages):
        raise ValueError("no block to train on")
    rng = np.random.default_rng(seed)
    shapes = {
        "Wf": (WIDTH, 4 * HIDDEN), "Uf": (HIDDEN, 4 * HIDDEN), "bf": (4 * HIDDEN,),
        "Wb": (WIDTH, 4 * HIDDEN), "Ub": (HIDDEN, 4 * HIDDEN), "bb": (4 * HIDDEN,),
        "V": (2 * HIDDEN, 1), "d": (1,),
    }
    p = {k: (rng.standard_normal(s) * 0.15).astype(np.float32) for k, s in shapes.items()}
    p["bf"][HIDDEN : 2 * HIDDEN] += 1
    p["bb"][HIDDEN : 2 * HIDDEN] += 1
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    pages = sorted((x for x in pages if len(x[0])), key=lambda x: len(x[0]))
    batches = [pages[i : i + 32] for i in range(0, len(pages), 32)]
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, lengths = _padded([m for m, _ in batches[b]])
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for j, (_, labels) in enumerate(batches[b]):
                y[: len(labels), j] = labels
            _, grads = loss_and_gradients(p, x, lengths, y)
            step += 1
            rate = 0.01 * (0.5 if epoch > 0.6 * epochs else 1) * (0.4 if epoch > 0.85 * epochs else 1)
            for k in p:
                g = np.clip(grads[k] + 1e-5 * p[k], -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.002 * (g * g - second[k])
                fixed = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-8)
                p[k] -= (rate * fixed).astype(np.float32)
    return Labeller(p)


# Names that templates give to the parts of a page, for layouts with known labels.
MAIN_TAGS = (
    'article', 'main', 'article class="post"', 'div class="article-body"', 'div id="content"',
    'div class="entry-content"', 'section class="story"', 'div class="post-content"', 'div class="text"',
    'div itemprop="articleBody" class="body"', 'main role="main"', 'div class="main-content"',
)
LINK_PARTS = (
    "nav", 'div class="menu"', 'ul class="navigation"', 'div role="navigation"', 'aside class="related"',
    'div class="breadcrumb"', 'div class="sidebar"', 'div class="share social"', 'header',
    'div class="pagination"', 'div class="tags"', 'nav class="navbar"', 'footer class="links"',
)
TEXT_PARTS = (
    'div class="ad"', 'div class="advert"', 'div class="ads sponsored"', 'div class="promo banner"', 'aside',
    'aside class="sidebar"', 'div id="sidebar"', 'footer', 'div class="footer"', 'div id="footer" role="contentinfo"',
    'header', 'div class="header"', 'header class="site-header" role="banner"',
    'div class="cookie-notice"', 'div class="notice"', 'div class="cookie consent" role="dialog"',
    'div class="alert"', 'div class="newsletter"', 'div class="popup modal"', 'div class="copyright"',
    'div class="widget"', 'div class="disclaimer legal"', 'div role="complementary"', 'div class="subscribe"',
)
COMMENT_PARTS = (
    'div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ul class="comments"',
    'section class="responses discussion"', 'div class="reader-comments"',
)
BYLINES = ('div class="byline"', 'p class="author meta"', 'div class="date"', 'span class="by"', 'div class="post-meta"')
FORM_PARTS = ("form", 'form class="search"', 'form class="login"', 'div class="form contact"', 'form id="signup"')


class _Layout:
    """Pages laid out from given texts, with the label of every block known."""

    def __init__(self, main: list[str], other: list[str], seed: int):
        self.random, self.main, self.other = random.Random(seed), main, other

    def short(self) -> str:
        return " ".join(self.random.choice(self.other + self.main).split()[: self.random.randint(1, 4)]) or "x"

    def paragraph(self, pool: list[str], most: int = 80) -> str:
        words = self.random.choice(pool).split()
        at = self.random.randrange(max(1, len(words) - most + 1))
        return " ".join(words[at : at + self.random.randint(1, most)]) or "x"

    def links(self, tag: str) -> str:
        each = [f'<a href="#">{html.escape(self.short())}</a>' for _ in range(self.random.randint(2, 8))]
        form = self.random.choice(("<ul><li>{}</li></ul>", "{}", "<p>{}</p>"))
        joint = "</li><li>" if "li" in form else self.random.choice((" ", " ", "<br>", " | "))
        return self.wrap(tag, form.format(joint.join(each)))

    def texts(self, tag: str, n: int) -> str:
        own = self.random.choice(("p", "p", "div", "li", "span"))
        pool = self.random.choice((self.main, self.other))
        each = [f"<{own}>{html.escape(self.paragraph(pool, 40))}</{own}>" for _ in range(n)]
        return self.wrap(tag, "".join(each) if self.random.random() < 0.8 else html.escape(self.paragraph(pool, 20)))

    def comments(self, tag: str) -> str:
        """A thread: a heading, then who wrote what, with a link to answer."""
        r, said = self.random, []
        for _ in range(r.randint(1, 6)):
            text = html.escape(self.paragraph(r.choice((self.main, self.other)), 40))
            who = f"<b>{html.escape(self.short())}</b> <span>{r.randint(1, 59)} min</span>"
            answer = f'<a href="#">{html.escape(self.short())}</a>' if r.random() < 0.6 else ""
            said.append(r.choice(("<div>{}<p>{}</p>{}</div>", "<li>{}<div>{}</div>{}</li>", "<p>{} {} {}</p>")).format(who, text, answer))
        head = f"<h3>{r.randint(1, 90)} {html.escape(self.short())}</h3>" if r.random() < 0.6 else ""
        return self.wrap(tag, head + "".join(said))

    def byline(self) -> str:
        who = f'<a href="#">{html.escape(self.short())}</a>' if self.random.random() < 0.5 else html.escape(self.short())
        return self.wrap(self.random.choice(BYLINES), f"{who} {self.random.randint(1, 28)}.{self.random.randint(1, 12)}.")

    def form(self, tag: str) -> str:
        n = self.random.randint(1, 3)
        fields = "".join(f"<label>{html.escape(self.short())}</label><input>" for _ in range(n))
        return self.wrap(tag, f"<p>{html.escape(self.short())}</p>{fields}<button>{html.escape(self.short())}</button>")

    @staticmethod
    def wrap(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def part(self) -> str:
        kind = self.random.random()
        if kind < 0.4:
            return self.links(self.random.choice(LINK_PARTS))
        if kind < 0.85:
            return self.texts(self.random.choice(TEXT_PARTS), self.random.randint(1, 3))
        return self.form(self.random.choice(FORM_PARTS))

    def page(self) -> str:
        """A page whose main text is fenced by NUL characters."""
        r = self.random
        main = [f"<h1>{html.escape(self.paragraph(self.main, 10))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 8, 16, 30))):
            text = html.escape(self.paragraph(self.main))
            main.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>",
                                  "<blockquote>{}</blockquote>", "<p><b>{}<br>", "<p><a href='#'>{}</a></p>",
                                  "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<div>{}</div>")).format(text))
        tag = r.choice(MAIN_TAGS)
        inside = [self.part() for _ in range(r.choice((0, 0, 0, 1, 2)))]
        pieces: list[tuple[str, bool]] = [(x, True) for x in main]
        for x in inside:
            pieces.insert(r.randint(0, len(pieces)), (x, False))
        before = [self.part() for _ in range(r.randint(0, 4))]
        after = [self.part() for _ in range(r.randint(0, 3))]
        if r.random() < 0.4:
            spot = r.choice(COMMENT_PARTS)
            thread = self.comments(spot) if r.random() < 0.6 else self.texts(spot, r.randint(1, 6))
            if r.random() < 0.7:
                after.insert(0, thread)
            else:
                pieces.append((thread, False))
        if r.random() < 0.3:
            pieces.insert(min(1, len(pieces)), (self.byline(), False))
        title = self.wrap("title", html.escape(self.short()))
        outer = r.choice(("", 'div class="wrapper"', 'div class="container page"', 'div id="main"'))
        marker = "\x00"
        body = f"<{tag}>" + "".join(f"{marker}{x}{marker}" if m else x for x, m in pieces) + f"</{tag.split()[0]}>"
        if before and r.random() < 0.15:
            body = f"<table><tr><td>{''.join(before)}</td><td>{body}</td></tr></table>{''.join(after)}"
        else:
            body = "".join(before) + body + "".join(after)
        return f"<html><head>{title}</head><body>{self.wrap(outer, body) if outer else body}</body></html>"


def _marked_blocks(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a laid-out page; NUL characters fence the main text."""
    labels: list[bool] = []
    inside = False
    for out, name in _walk(page.replace("\x00", "<hr class=fence>")):
        labels += [inside] * (len(out.blocks) - len(labels))
        if name == "hr":
            inside = not inside
    return out.blocks, labels


BOILERPLATE = set(
    "nav aside footer header form ad ads advert sidebar menu comments comment notice cookie banner promo "
    "related share social newsletter widget breadcrumb pagination".split()
)
LANDMARK = re.compile(r"(</?)(?:article|main|nav|aside|header|footer|section|menu|address|figure)(?=[\s/>])", re.I)
NAMED = re.compile(r"""(\b(?:class|id|role|itemprop)\s*=\s*)(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def disguised(page: str, r: random.Random, names: bool = True, landmarks: bool = True) -> str:
    """A page with the same blocks, every class, id and role another random word, and ``div`` for the elements
    that name their purpose."""
    if landmarks:
        page = LANDMARK.sub(r"\1div", page)
    if not names:
        return page
    known: dict[str, str] = {}

    def renamed(m: re.Match) -> str:
        if m[0] not in known:
            words = ("".join(r.choices(LETTERS, k=r.randint(2, 9))) for _ in range(r.choice((1, 1, 2))))
            known[m[0]] = f'{m[1]}"{" ".join(words)}"'
        return known[m[0]] if r.random() < 0.95 else ""

    return NAMED.sub(renamed, page)


def _is_main(element: Element) -> bool:
    """Does the element lie in an ``article`` or ``main`` and in nothing named like another part?"""
    todo, at = [], element
    while at is not None and at.main is None:
        todo.append(at)
        at = at.parent
    inside, other = at.main if at is not None else (False, False)
    for each in reversed(todo):
        inside = inside or bool({"article", "main"} & set(each.names))
        other = other or bool(BOILERPLATE & set(each.names))
        each.main = inside, other
    return inside and not other


def training_pages(pages: list[str], layouts: int = LAYOUTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrices and labels: the pages that mark their article themselves, as they are and disguised, and
    layouts of their texts, three quarters of them disguised. Without any text, layouts of letters."""
    r, vectors, out = random.Random(5), Vectors(), []
    main, other = [], []
    for page in pages:
        blocks = blocks_of(page)
        own = [_is_main(b.element) for b in blocks]
        (main if any(own) else other).extend(b.text for b, o in zip(blocks, own) if o or not any(own))
        other.extend(b.text for b, o in zip(blocks, own) if not o)
        if any(own):
            labels = np.array(own, dtype=np.float32)
            out.append((vectors.matrix(blocks), labels))
            hidden = blocks_of(disguised(page, r))
            if [b.text for b in hidden] == [b.text for b in blocks]:
                out.append((vectors.matrix(hidden), labels))
    main, other = main or other, other or main
    if not main:
        letters = ["".join(r.choices(LETTERS, k=r.randint(2, 9))) for _ in range(300)]
        main = [" ".join(r.choices(letters, k=60)).capitalize() + "." for _ in range(60)]
        other = [" ".join(r.choices(letters, k=6)) for _ in range(60)]
    layout = _Layout(main, other, 11)
    for i in range(layouts):
        page = layout.page()
        blocks, labels = _marked_blocks(disguised(page, r, i % 4 in (1, 3), i % 4 in (2, 3)) if i % 4 else page)
        if blocks:
            out.append((vectors.matrix(blocks), np.array(labels, dtype=np.float32)))
    return out


def train(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS) -> Labeller:
    """Train on at most ``sample`` pages, the first by a hash of their id, of each at most the first
    ``SAMPLE_CHARS`` characters, and on ``layouts`` pages laid out from their texts. Without such pages
    layouts of letters are all there is to learn from."""
    fitting = pages.where(F.length("html") > 0)
    cut = fitting.select(F.substring("html", 1, SAMPLE_CHARS).alias("html"), F.xxhash64("page_id").alias("order"))
    some = lowest(cut, "order", sample)
    return fit(training_pages([r[0] for r in some.select("html").collect()], layouts))


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the blocks labelled as main text, joined by a space.

    The whole html is read. A null, empty or textless html gives an empty text. Pages are labelled alone:
    repeated rows get equal results, nulls and clashing names in other columns do not matter, an empty
    table gives no rows.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                blocks = [blocks_of(h.as_py()) for h in some.column(2)]
                scores = labeller.logits([vectors.matrix(b) for b in blocks])
                texts = [
                    " ".join(b.text for b, keep in zip(own, score > 0) if keep)
                    for own, score in zip(blocks, scores)
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
