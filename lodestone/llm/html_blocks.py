"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags, each with the path of
tags (and words of their class, id and role) that leads to it. A bidirectional LSTM in numpy reads
the page's blocks in order, as tag-path and hashed-word vectors, and labels every block as article
or not with the context of the whole page. It is trained here, on pages that a seeded generator
writes: many layouts, with menus, headers, sidebars, notices, adverts, forms, comments and footers
around and inside the article. Weights are a function of the seed and are broadcast (some 100 KB).

Defined cases: null and empty pages have an empty text; malformed markup is read as a browser would
(unclosed elements end with their parents, unknown end tags are skipped, a stray < is text); a page
may have any number of blocks, at any depth; repeated rows are labelled row by row; columns other than id, url
and html are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH_TERMS, WORD_TERMS, PLAIN_TERMS = 192, 48, 10
INPUTS = PATH_TERMS + WORD_TERMS + PLAIN_TERMS
HIDDEN = 20
SEED = 2024

# ---------------------------------------------------------------- pages to blocks

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
_FOREIGN = frozenset(("svg", "math"))
#: The start tags that end foreign content when it is not closed, as the HTML standard lists them.
_BREAKS_OUT = (
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
)
_FOREIGN_END = {t: re.compile(rf"</{t}\b[^>]*>|(?=<(?:{'|'.join(_BREAKS_OUT.split())})[\s/>])", re.I) for t in _FOREIGN}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("br img input hr meta link area base col embed source track param".split())
#: Which open elements a start tag closes, and where the search for them ends.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


class _Buckets(dict):
    """Word to bucket, forgotten as a whole when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[word] = _bucket(word, WORD_TERMS)
        return b


_WORD_BUCKET = _Buckets()


#: Elements nearest to a block whose distance is told apart; those beyond count alike, however many.
NEAR = 7


@dataclass
class Block:
    """``path``: the nearest elements, outermost first; ``above``: a bit for every term of the whole path."""

    text: str
    path: tuple[str, ...]
    above: int = 0
    link_chars: int = 0
    inline: int = 0


@lru_cache(maxsize=20_000)
def _terms(name: str) -> int:
    """Bits of the path terms of one element."""
    tag, *words = name.split(" ")
    bits = 1 << _bucket(f"<{tag}>", PATH_TERMS)
    for w in words:
        bits |= 1 << _bucket(w, PATH_TERMS)
    return bits


class _Open:
    """The open elements: their names, the terms of each path, and where every tag is open."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.names: list[str] = []
        self.above: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, name: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.names.append(name)
        self.above.append((self.above[-1] if self.above else 0) | _terms(name))

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
        del self.names[place:], self.above[place:]


def _name(tag: str, attributes: str) -> str:
    """Tag and the words of its telling attributes, as one string."""
    if not attributes:
        return tag
    words = [w.lower() for _, v in _ATTRIBUTE.findall(attributes) for w in _PART.findall(v)]
    return " ".join([tag, *words])


def parse_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = _Open()
    text: list[str] = []
    state = [0, 0, 0]  # characters in links, inline tags, open links

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, tuple(stack.names[-NEAR:]), stack.above[-1] if stack.above else 0, state[0], state[1]))
            text.clear()
        state[0] = state[1] = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if state[2]:
                state[0] += len(piece)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                text.append(html.escape(page[m.start() + 9 : m.end() - 3]))
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in _FOREIGN:
            if not closing and not attributes.endswith("/"):
                stop = _FOREIGN_END[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in _INLINE:
            state[1] += 1
            if tag == "a":
                state[2] = 0 if closing else 1
            continue
        if tag in _VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        state[2] = 0
        if closing:
            if (place := stack.last((tag,))) >= 0:
                stack.close(place)
            continue
        if stack.tags and stack.tags[-1] == "p":
            stack.close(len(stack.tags) - 1)
        if tag in _CLOSES:
            closes, until = _CLOSES[tag]
            if (place := stack.last(closes)) > stack.last(until):
                stack.close(place)
        stack.push(tag, _name(tag, attributes))
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...], above: int) -> np.ndarray:
    """Hashed words of the path; nearer elements count more, all beyond ``NEAR`` alike."""
    far = np.frombuffer(above.to_bytes(PATH_TERMS // 8, "little"), np.uint8)
    v = np.unpackbits(far, bitorder="little").astype(np.float32) * np.float32(0.4)
    for depth, name in enumerate(reversed(path)):
        weight = max(0.85**depth, 0.4)
        tag, *words = name.split(" ")
        k = _bucket(f"<{tag}>", PATH_TERMS)
        v[k] = max(v[k], weight)
        if depth == 0:
            v[_bucket(f"leaf {tag}", PATH_TERMS)] = 1
        for w in words:
            k = _bucket(w, PATH_TERMS)
            v[k] = max(v[k], weight)
    return v


def block_vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUTS), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        x[i, :PATH_TERMS] = _path_vector(b.path, b.above)
        words = b.text.split(" ")
        bag = np.bincount(np.fromiter(map(_WORD_BUCKET.__getitem__, words), np.int64, len(words)), minlength=WORD_TERMS)
        bag = np.sqrt(bag)
        x[i, PATH_TERMS : PATH_TERMS + WORD_TERMS] = bag / np.linalg.norm(bag)
        chars = len(b.text)
        x[i, PATH_TERMS + WORD_TERMS :] = (
            np.log1p(chars) / 8,
            np.log1p(len(words)) / 6,
            min(1.0, b.link_chars / chars),
            min(1.0, b.inline / 10),
            b.text[-1] in ".!?…:;\"»”",
            (b.text.count(".") + b.text.count(",")) / (len(words) + 1),
            i / n,
            1 - i / n,
            len(words) < 4,
            1.0,
        )
    return x


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm_forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: bool = True):
    """x: time x batch x inputs. Gives outputs and, if ``keep``, what the backward pass needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    inputs = x @ w + b
    out, saved = np.zeros((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ u
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        tanh_c = np.tanh(new_c)
        new_h = m * (o * tanh_c) + (1 - m) * h
        if keep:
            saved.append((h, c, i, f, o, g, tanh_c, m))
        h, c = new_h, new_c
        out[t] = h
    return out, saved


def _lstm_backward(x: np.ndarray, u: np.ndarray, saved: list, d_out: np.ndarray):
    steps, batch, _ = x.shape
    d_z = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
    d_u = np.zeros_like(u)
    d_h, d_c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, m = saved[t]
        d_h = d_h + d_out[t]
        through = m * d_h
        inner = m * d_c + through * o * (1 - tanh_c**2)
        z = d_z[t]
        z[:, :HIDDEN] = inner * g * i * (1 - i)
        z[:, HIDDEN : 2 * HIDDEN] = inner * c * f * (1 - f)
        z[:, 2 * HIDDEN : 3 * HIDDEN] = through * tanh_c * o * (1 - o)
        z[:, 3 * HIDDEN :] = inner * i * (1 - g**2)
        d_u += h.T @ z
        d_h = (1 - m) * d_h + z @ u.T
        d_c = (1 - m) * d_c + inner * f
    flat = d_z.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), INPUTS), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    @staticmethod
    def fresh(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"w{d}"] = (rng.standard_normal((INPUTS, 4 * HIDDEN)) * 0.15).astype(np.float32)
            w[f"u{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            w[f"b{d}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        w["o"] = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return Labeller(w)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True):
        w = self.weights
        forth, saved_f = _lstm_forward(x, w["wf"], w["uf"], w["bf"], mask, keep)
        back, saved_b = _lstm_forward(x[::-1], w["wb"], w["ub"], w["bb"], mask[::-1], keep)
        both = np.concatenate((forth, back[::-1]), axis=2)
        return _sigmoid(both @ w["o"] + w["c"][0]), both, saved_f, saved_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, both, saved_f, saved_b = self.forward(x, mask)
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        d = mask * (p - y) / n
        g = {"o": np.tensordot(d, both, ([0, 1], [0, 1])).astype(np.float32), "c": np.array([d.sum()], np.float32)}
        d_both = d[:, :, None] * self.weights["o"]
        g["wf"], g["uf"], g["bf"] = _lstm_backward(x, self.weights["uf"], saved_f, d_both[:, :, :HIDDEN])
        g["wb"], g["ub"], g["bb"] = _lstm_backward(x[::-1], self.weights["ub"], saved_b, d_both[::-1, :, HIDDEN:])
        return float(loss), g

    def label(self, pages: list[np.ndarray], cells: int = 6000) -> list[np.ndarray]:
        """Probability of every block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= cells:
                stop += 1
            group = order[at:stop]
            x, mask = _pad([pages[k] for k in group])
            p = self.forward(x, mask, keep=False)[0]
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
            at = stop
        return out


# ---------------------------------------------------------------- pages to learn from


class PageWriter:
    """Seeded pages of many layouts with the truth of every block."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        letters = self.pick("etaoinshr", "aeiouñlrst", "eaiéèurtnm", "enirsüäöch", "abcdefghijklmnop")
        n = int(self.rng.integers(low, high + 1))
        return " ".join("".join(self.rng.choice(list(letters), int(self.rng.integers(1, 9)))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 30) -> str:
        s = self.words(low, high)
        junk = self.pick("", "", "", "!!", "***", " |")
        s = s.replace(" ", f"{junk} ") if junk else s
        style = int(self.rng.integers(12))
        if style == 0:
            s = s.upper()
        elif style == 1:
            s = " ".join(w for w in s.split(" ")[:4] for _ in range(int(self.rng.integers(1, 6))))
        return s.capitalize() + self.pick(".", ".", ".", "!", "?", "")

    def text(self, good: bool, low: int = 4, high: int = 30, sentences: int = 1) -> str:
        plain = " ".join(" ".join(self.sentence(low, high) for _ in range(sentences)).split())
        self.truth[plain] = good
        words = html.escape(plain, quote=False).split(" ")
        if self.chance(0.3):
            k = int(self.rng.integers(len(words)))
            inner = self.pick("b", "i", "em", "span", "strong")
            words[k] = f"<{inner}>{words[k]}</{inner}>"
        if self.chance(0.12) and len(words) > 6:
            words[2] = f'<a href="/x">{words[2]}</a>'
        if self.chance(0.12):
            k = int(self.rng.integers(len(words)))
            words[k] += "<br>"
        return " ".join(words)

    def attribute(self, *names: str) -> str:
        name = self.pick(*names)
        name = self.pick(name, name, f"site-{name}", f"{name}-box", f"page_{name}", f"{name} block")
        return f' {self.pick("class", "class", "id")}="{name}"'

    def links(self, n: int) -> str:
        out = []
        for _ in range(n):
            label = self.words(1, 3) if self.chance(0.8) else self.pick("Home", "About", "Contact", "News", "Login", "Next", "Archive") + " " + self.words(1, 1)
            self.truth[label] = False
            out.append(f'<a href="/{self.words(1, 1)}">{label}</a>')
        return self.pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{x}</li>" for x in out)) if self.chance(0.7) else "".join(f"<div>{x}</div>" for x in out)

    def menu(self) -> str:
        inner = self.links(int(self.rng.integers(2, 9)))
        return f"<nav>{inner}</nav>" if self.chance(0.5) else f"<div{self.attribute('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'toc', 'pagination', 'tabs')}>{inner}</div>"

    def some(self, good: bool, most: int = 3, **how) -> str:
        return "".join(f"<{t}>{self.text(good, **how)}</{t}>" for t in (self.pick("p", "p", "div") for _ in range(int(self.rng.integers(1, most + 1)))))

    def header(self) -> str:
        inner = f"<{(t := self.pick('h1', 'h2', 'p', 'div'))}>{self.text(False, 1, 6)}</{t}>" + (f"<p>{self.text(False, 3, 12)}</p>" if self.chance(0.5) else "")
        inner += self.menu() if self.chance(0.3) else ""
        return f"<header>{inner}</header>" if self.chance(0.5) else f"<div{self.attribute('header', 'masthead', 'top', 'logo', 'topbar')}>{inner}</div>"

    def sidebar(self) -> str:
        inner = f"<h3>{self.text(False, 1, 4)}</h3>" + self.pick(self.links(4), self.some(False), self.some(False, sentences=2))
        return f"<aside>{inner}</aside>" if self.chance(0.45) else f"<div{self.attribute('sidebar', 'widget', 'related', 'recommended', 'aside', 'rail', 'popular', 'teaser')}>{inner}</div>"

    def boxed(self, *names: str, roles: tuple[str, ...] = ()) -> str:
        tag = self.pick("div", "div", "section", "p", "aside")
        if tag == "p":
            return f"<p{self.attribute(*names)}>{self.text(False)}</p>"
        mark = f' role="{self.pick(*roles)}"' if roles and self.chance(0.3) else self.attribute(*names)
        inner = self.text(False) if self.chance(0.5) else self.some(False, 2, sentences=int(self.rng.integers(1, 4)))
        return f"<{tag}{mark}>{inner}</{tag}>"

    def notice(self) -> str:
        return self.boxed("cookie", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "newsletter", "subscribe", "warning", "message", "paywall", roles=("alert", "dialog", "banner"))

    def advert(self) -> str:
        return self.boxed("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "adsense", roles=("complementary",))

    def form(self) -> str:
        parts = [self.pick(f"<label>{self.text(False, 1, 4)}</label><input name=q>", f"<p>{self.text(False, 3, 15)}</p>", f"<div>{self.text(False, 1, 4)}</div>", f"<select><option>{self.text(False, 1, 2)}<option>{self.text(False, 1, 2)}</select>") for _ in range(int(self.rng.integers(1, 4)))]
        return f'<form action="/s">{"".join(parts)}<button>{self.text(False, 1, 2)}</button></form>'

    def comments(self) -> str:
        items = []
        for _ in range(int(self.rng.integers(1, 5))):
            inner = (f"<{(t := self.pick('div', 'p', 'h4'))}>{self.text(False, 1, 3)}</{t}>" if self.chance(0.6) else "") + f"<p>{self.text(False, sentences=int(self.rng.integers(1, 4)))}</p>"
            items.append(self.pick(f'<div class="{self.pick("comment", "reply", "comment-body", "user-comment")}">{inner}</div>', f"<li>{inner}</li>", f'<article class="comment">{inner}</article>'))
        head = f"<h3>{self.text(False, 1, 3)}</h3>" if self.chance(0.6) else ""
        tag = self.pick("div", "section", "ol", "ul")
        return f"<{tag}{self.attribute('comments', 'comment-list', 'replies', 'discussion', 'responses', 'comment-section', 'disqus')}>{head}{''.join(items)}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attribute('share', 'social', 'sharing', 'tags', 'meta-links')}>{self.links(int(self.rng.integers(2, 5)))}</div>"

    def footer(self) -> str:
        inner = self.pick(self.text(False, 2, 10), "&copy; " + self.text(False, 2, 6), self.some(False), self.links(4))
        if inner.startswith("&copy; "):
            last = list(self.truth)[-1]
            self.truth[f"© {last}"] = self.truth.pop(last)
        return f"<footer>{inner}</footer>" if self.chance(0.6) else f"<div{self.attribute('footer', 'bottom', 'copyright', 'colophon', 'legal')}>{inner}</div>"

    def article(self) -> str:
        parts = [f"<{(t := self.pick('h1', 'h1', 'h2'))}>{self.text(True, 2, 12)}</{t}>"] if self.chance(0.85) else []
        for _ in range(int(self.rng.integers(1, 10))):
            kind = int(self.rng.integers(14))
            sentences = int(self.rng.integers(1, 6))
            if kind < 7:
                parts.append(f"<p>{self.text(True, sentences=sentences)}" + self.pick("</p>", "</p>", "</p>", ""))
            elif kind == 7:
                parts.append("<ul>" + "".join(f"<li>{self.text(True, 2, 14)}</li>" for _ in range(int(self.rng.integers(1, 5)))) + "</ul>")
            elif kind == 8:
                parts.append(f"<{(t := self.pick('h2', 'h3', 'blockquote', 'pre', 'figcaption'))}>{self.text(True, 1, 10)}</{t}>")
            elif kind == 9:
                parts.append(f"<table><tr><td>{self.text(True, 1, 4)}</td><td>{self.text(True, 1, 4)}</td></tr></table>")
            elif kind == 10:
                parts.append(f"<div>{self.text(True, sentences=sentences)}</div>")
            elif kind == 11:
                parts.append(f"<p>{self.text(True, 1, 4)}</p>")
            else:
                parts.append(self.pick(self.advert, self.advert, self.sidebar, self.form, self.share, self.notice)())
        for _ in range(int(self.rng.integers(0, 4))):
            parts.append(f"<p>{self.text(True, 1, self.pick(2, 4, 25))}</p>")
        if self.chance(0.15):
            parts.append(self.comments())
        inner = "".join(parts)
        names = ("content", "post", "entry", "article", "story", "post-body", "article-body", "main-content", "text", "entry-content")
        wrap = self.pick("article", "article", "article", "main", "named", "section", "both")
        if wrap == "named":
            return f"<div{self.attribute(*names)}>{inner}</div>"
        if wrap == "section":
            return f"<section{self.attribute(*names)}>{inner}</section>"
        if wrap == "both":
            return f"<main><article{self.attribute(*names)}><div>{inner}</div></article></main>"
        return f"<{wrap}>{inner}</{wrap}>"

    def page(self) -> tuple[str, list[Block], np.ndarray]:
        """(html, its blocks, truth of each block)."""
        while True:
            self.truth: dict[str, bool] = {}
            before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.sidebar, self.form) if self.chance(0.4)]
            after = [f() for f in (self.sidebar, self.comments, self.advert, self.share, self.notice, self.form, self.menu) if self.chance(0.3)]
            self.rng.shuffle(before)
            body = "".join(before) + self.article() + "".join(after)
            if self.chance(0.4):
                body = f"<div{self.attribute('wrapper', 'container', 'page', 'row', 'layout')}>{body}</div>"
            body += self.footer() if self.chance(0.8) else ""
            source = f'<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'
            found = parse_blocks(source)
            if all(b.text in self.truth for b in found):
                return source, found, np.array([self.truth[b.text] for b in found], np.float32)


@lru_cache(maxsize=2)
def trained(seed: int = SEED, pages: int = 700, steps: int = 560, batch: int = 12) -> Labeller:
    """The labeller, trained by Adam on generated pages; the same weights for the same arguments."""
    writer = PageWriter(seed)
    data = []
    for _ in range(pages):
        _, found, truth = writer.page()
        data.append((block_vectors(found), truth))
    data.sort(key=lambda d: len(d[1]))
    rng = np.random.default_rng(seed)
    net = Labeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        at = int(rng.integers(max(1, len(data) - batch)))
        chosen = data[at : at + batch]
        x, mask = _pad([d[0] for d in chosen])
        x[:, :, PATH_TERMS : PATH_TERMS + WORD_TERMS] *= rng.random(x.shape[:2])[:, :, None] < 0.4  # words may be of any language
        x[:, :, :PATH_TERMS] *= rng.random(x.shape)[:, :, :PATH_TERMS] < 0.93
        y = np.zeros(mask.shape, np.float32)
        for k, (_, truth) in enumerate(chosen):
            y[: len(truth), k] = truth
        _, grads = net.gradients(x, mask, y)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = 0.012 * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * min(1.0, 2.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] = (net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def main_text(blocks: list[Block], probability: np.ndarray) -> str:
    return " ".join(b.text for b, p in zip(blocks, probability, strict=True) if p >= 0.5)


def extract(pages: DataFrame, page: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """``pages`` without the html, with text, n_chars, n_blocks and n_kept (blocks)."""
    made = {"text", "n_chars", "n_blocks", "n_kept"}
    keep = [c for c in pages.columns if c != page and c.lower() not in made]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept")]])
    sent = pages.sparkSession.sparkContext.broadcast((labeller or trained()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(sent.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                blocks = [parse_blocks(h) if h else [] for h in part.column(page).to_pylist()]
                labels = net.label([block_vectors(x) for x in blocks])
                texts = [main_text(x, p) for x, p in zip(blocks, labels, strict=True)]
                counts = [[len(t) for t in texts], [len(x) for x in blocks], [int((p >= 0.5).sum()) for p in labels]]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)],
                    names=[*keep, "text", "n_chars", "n_blocks", "n_kept"],
                )

    return pages.select(*keep, F.col(page).cast("string").alias(page)).mapInArrow(run, schema)
