"""Main text of HTML pages by a recurrent block labeller in numpy.

A page becomes the sequence of its leaf blocks: the runs of text between block-level
tags, each with the path of the elements that are open around it. A block's input is a
hashed vector of its path (tag names, classes, ids and roles), a hashed vector of its words, and a few
numbers (length, share of linked text, place). A bidirectional LSTM reads all blocks of
a page, so each block is labelled in the context of the whole document, and the blocks
labelled main text are joined in page order.

The model is trained where it is used, on two bounded sets: layouts that a seeded
generator makes up (``MADE_UP`` pages; a part of them has no telling tags or class names, so that words, links and the blocks around must
do), and the ``SAMPLE`` pages of the table with the least hashes of their ids,
whose blocks are labelled only where semantic elements tell: article or main on one side; nav,
footer, aside, form and the like on the other.

Scripts, styles, comments and the head carry no text blocks. Inside a block, tags leave
nothing behind (a line break leaves a space), character references are decoded, and
white space becomes one space.

Edge cases: null or empty html, or a page without text: an empty text with 0 characters;
unclosed, stray or nested tags never fail (a closing tag without an opening one is
ignored; a head that isn't closed ends where the body's content begins; an embedded element that is
closed in its own tag, or never, hides nothing; attributes are read as the HTML standard reads them, odd quotes included);
pages of any length are read whole, in time by their length; repeated rows get equal rows; an empty table gives no rows; further columns are
carried, those named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, small_batches, string_buffers, word_hashes

#: Pages of the table and made-up pages that are learned from, training steps, and pages of a step.
SAMPLE, MADE_UP, STEPS, TOGETHER = 300, 700, 240, 24
#: Bytes of a sampled page at most, and blocks of a page in training.
SAMPLE_BYTES, TRAINED_BLOCKS = 200_000, 50
PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 256, 32, 6, 20
#: Blocks of a page that the LSTM reads as one sequence; longer pages go on with the state they reached.
STRIDE = 400

# fixed values: element names of the HTML standard
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option",
    "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
RAW, EMBEDDED = {"script", "style", "title", "textarea"}, {"iframe", "math", "noframes", "noscript", "object", "svg", "template"}
HEAD = RAW | EMBEDDED | {"head", "meta", "link", "base", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"button", "caption", "legend", "option", "select", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
NESTED = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in EMBEDDED}
BETWEEN, ATTRIBUTE, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
#: Elements of a path at most: the innermost ones.
DEPTH = 64
WORD = re.compile(r"[a-z]+")


def attributes(page: str, pos: int) -> tuple[int, list[str], bool]:
    """Where the tag whose attributes begin at pos ends, the values of its class, id and role, and whether it closes itself.

    Names and values are told apart as the HTML standard does: a quote inside a name is a part of it, a value may be bare or in quotes,
    and a tag that the page ends in takes the rest along.
    """
    values, n = [], len(page)
    while True:
        begin, pos = pos, BETWEEN.match(page, pos).end()
        if pos >= n:
            return n, values, False
        if page[pos] == ">":
            return pos + 1, values, page[begin:pos].rstrip().endswith("/")
        end = ATTRIBUTE.match(page, pos).end()
        name, pos = page[pos:end].lower(), end
        equals = EQUALS.match(page, pos)
        if not equals:
            continue
        pos = equals.end()
        if page[pos : pos + 1] in ('"', "'"):
            end = page.find(page[pos], pos + 1)
            end = n if end < 0 else end
            value, pos = page[pos + 1 : end], min(end + 1, n)
        else:
            end = BARE.match(page, pos).end()
            value, pos = page[pos:end], end
        if name in ("class", "id", "role"):
            values.append(value)


def _label(tag: str, values: list[str]) -> str:
    """An element in a path: its tag and the lower-case words of its class, id and role."""
    if not values:
        return tag
    words = [w for v in values for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())]
    return ".".join([tag, *dict.fromkeys(words)])


def _after(page: str, tag: str, pos: int) -> int | None:
    """Where an embedded element that begins before pos ends, elements of its name inside it counted; None if it doesn't."""
    depth = 1
    for m in NESTED[tag].finditer(page, pos):
        if m[1]:
            depth -= 1
        elif not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return None


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(path, text, share of the text inside links) of the leaf blocks, in page order; a path has DEPTH elements at most.

    The page is read once: each tag is parsed where it stands, and what is open is counted by name.
    """
    out: list[tuple[str, str, float]] = []
    path: list[str] = []  # labels of the open block elements
    tags: list[str] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    at = 0

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(("/".join(path[-DEPTH:]), whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(tag: str):
        """Close the innermost element of the name and all inside it."""
        while True:
            last = tags.pop()
            open_[last] -= 1
            if last in BLOCK:
                path.pop()
            if last == tag:
                return

    def piece(upto: int):
        nonlocal linked
        own = page[at:upto]
        if open_["head"]:
            if own.isspace():
                return
            close("head")  # text ends the head
        text.append(own)
        if open_["a"]:
            linked += len(own.strip())

    endless: set[str] = set()  # elements that aren't closed any more
    pos, n = 0, len(page)
    while (pos := page.find("<", pos)) >= 0:
        closing = page.startswith("</", pos)
        name = NAME.match(page, pos + 1 + closing)
        comment = page.startswith(("<!", "<?"), pos) or (closing and not name and pos + 2 < n)
        if not name and not comment:
            pos += 1
            continue
        if pos > at:
            piece(pos)
        if comment:
            long = page.startswith("<!--", pos)
            end = page.find("-->" if long else ">", pos + (2 if long else 1))
            at = pos = n if end < 0 else end + (3 if long else 1)
            continue
        tag = name[0].lower()
        end, values, closed = attributes(page, name.end())
        at = pos = end
        if closing:
            if open_[tag]:
                k = len(tags) - 1
                while tags[k] != tag and tags[k] not in BLOCK:
                    k -= 1
                if tags[k] in BLOCK:
                    flush()
                close(tag)
            continue
        if tag in EMBEDDED:  # its content is no text of the page
            if tag not in endless and not closed:
                end = _after(page, tag, pos)
                if end is None:
                    endless.add(tag)
                else:
                    at = pos = end
            continue
        if tag in RAW:
            m = ENDS[tag].search(page, pos)
            at = pos = m.end() if m else n
            continue
        if open_["head"] and tag not in HEAD:
            close("head")
        if tag in BLOCK:
            flush()
        if tag in ("br", "hr"):
            text.append(" ")
        if tag in VOID:
            continue
        if tag in ENDS_P and open_["p"]:
            close("p")
        elif tag in CLOSES and any(open_[t] for t in CLOSES[tag]):
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in CLOSES[tag]:
                    close(tags[k])
                    break
                if tags[k] in ("ul", "ol", "dl", "table", "select"):
                    break
        if not closed or tag in BLOCK:
            if tag in BLOCK:
                path.append(_label(tag, values))
            tags.append(tag)
            open_[tag] += 1
    if at < n:
        piece(n)
    flush()
    return out


# --- inputs -------------------------------------------------------------------


def path_vector(path: str) -> np.ndarray:
    """Signed hashes of the path's elements and their words, the inner ones also by their place from the leaf."""
    v = np.zeros(PATH_DIMS, np.float32)
    parts = path.split("/")
    for k, part in enumerate(reversed(parts)):
        words = part.split(".")
        for w in words:
            for key in (w, f"{w}@{k}") if k < 2 else (w,):
                h = zlib.crc32(key.encode())
                v[h % PATH_DIMS] += 1.0 if h >> 16 & 1 else -1.0
    return v


def word_vectors(texts: list[str]) -> np.ndarray:
    data, off = string_buffers(pa.array(texts, pa.string()))
    h, woff = word_hashes(data, off)
    count = np.diff(woff)
    row = np.repeat(np.arange(len(texts)), count)
    sign = np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(row * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), sign, len(texts) * WORD_DIMS).reshape(len(texts), WORD_DIMS)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)).astype(np.float32)


def numbers(page: list[tuple[str, str, float]]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, NUMBERS), np.float32)
    for i, (_, text, share) in enumerate(page):
        out[i] = np.log1p(len(text)) / 4, share, i / n, (n - i) / n, text[-1] in ".!?", min(n, 40) / 40
    return out


# --- the network --------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Input layer (path, words, numbers), an LSTM in either direction, a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH_DIMS + WORD_DIMS + NUMBERS
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.1, (size, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["i"] = np.zeros(size, np.float32)  # straight from the input
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, d: str, gates: np.ndarray, state=None):
        """gates: time x pages x 4H, from the inputs. All states, for the backward pass too."""
        steps, n, _ = gates.shape
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        w, H = self.p[f"h{d}"], HIDDEN
        kept = []
        out = np.zeros((steps, n, H), np.float32)
        for t in range(steps):
            g = gates[t] + h @ w
            i, f, o, u = _sigmoid(g[:, :H]), _sigmoid(g[:, H : 2 * H]), _sigmoid(g[:, 2 * H : 3 * H]), np.tanh(g[:, 3 * H :])
            before = c, h
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((i, f, o, u, s, before))
        return out, kept, (h, c)

    def _back(self, d: str, kept, dout: np.ndarray):
        steps, n, H = dout.shape
        w = self.p[f"h{d}"]
        dg = np.zeros((steps, n, 4 * H), np.float32)
        dh, dc, dw = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32), np.zeros_like(w)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, s, (c0, h0) = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - s * s)
            dg[t] = np.concatenate((dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)), 1)
            dw += h0.T @ dg[t]
            dh, dc = dg[t] @ w.T, dc * f
        return dg, dw

    def train_step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, lengths: np.ndarray):
        """x: time x pages x size; weight 0 beyond a page's end and where no label is known. Loss and gradients."""
        steps = len(x)
        # the backward direction reads each page from its own end
        back = np.where(np.arange(steps)[:, None] < lengths, lengths - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        col = np.arange(x.shape[1])
        xb = x[back, col]
        hf, kf, _ = self._run("f", x @ self.p["xf"] + self.p["cf"])
        hb, kb, _ = self._run("b", xb @ self.p["xb"] + self.p["cb"])
        both = np.concatenate((hf, hb[back, col]), 2)
        z = both @ self.p["o"] + x @ self.p["i"] + self.p["z"]
        q = _sigmoid(z)
        total = max(weight.sum(), 1.0)
        loss = -(weight * np.log(np.where(y > 0, q, 1 - q) + 1e-7)).sum() / total
        dz = (weight * (q - y) / total).astype(np.float32)
        grad = {"o": np.tensordot(dz, both, 2), "i": np.tensordot(dz, x, 2), "z": dz.sum(keepdims=True).reshape(1)}
        dboth = dz[:, :, None] * self.p["o"]
        for d, kept, dout, own in (("f", kf, dboth[:, :, :HIDDEN], x), ("b", kb, dboth[:, :, HIDDEN:][back, col], xb)):
            dg, grad[f"h{d}"] = self._back(d, kept, dout)
            grad[f"x{d}"] = np.tensordot(own, dg, ((0, 1), (0, 1)))
            grad[f"c{d}"] = dg.sum((0, 1))
        return loss, grad

    def predict(self, pages: list[list[tuple[str, str, float]]], cache: dict | None = None) -> list[np.ndarray]:
        """Probabilities of the blocks of each page; pages of like length run together."""
        cache = {} if cache is None else cache
        if len(cache) > 20_000:
            cache.clear()
        weights = np.concatenate((self.p["xf"], self.p["xb"], self.p["i"][:, None]), 1)
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            group, longest = [], 0
            while k < len(order) and len(group) < 256 and (not group or (len(group) + 1) * len(pages[order[k]]) <= 20_000):
                group.append(order[k])
                longest = len(pages[order[k]])
                k += 1
            flat = [b for i in group for b in pages[i]]
            for path in {b[0] for b in flat} - cache.keys():
                cache[path] = path_vector(path) @ weights[:PATH_DIMS]
            made = np.stack([cache[b[0]] for b in flat])
            made += word_vectors([b[1] for b in flat]) @ weights[PATH_DIMS : PATH_DIMS + WORD_DIMS]
            made += np.concatenate([numbers(pages[i]) for i in group]) @ weights[PATH_DIMS + WORD_DIMS :]
            lengths = np.array([len(pages[i]) for i in group])
            page = np.repeat(np.arange(len(group)), lengths)
            first = np.cumsum(lengths) - lengths
            time = np.arange(len(flat)) - first[page]
            gf, gb = (np.zeros((longest, len(group), 4 * HIDDEN), np.float32) for _ in range(2))
            gf[time, page] = made[:, : 4 * HIDDEN] + self.p["cf"]
            gb[lengths[page] - 1 - time, page] = made[:, 4 * HIDDEN : 8 * HIDDEN] + self.p["cb"]
            hf, hb = self._states("f", gf), self._states("b", gb)
            z = hf[time, page] @ self.p["o"][:HIDDEN] + hb[lengths[page] - 1 - time, page] @ self.p["o"][HIDDEN:] + made[:, -1] + self.p["z"]
            q = _sigmoid(z)
            for j, i in enumerate(group):
                out[i] = q[first[j] : first[j] + lengths[j]]
        return out

    def _states(self, d: str, gates: np.ndarray) -> np.ndarray:
        """Hidden states, STRIDE steps at a time so that what a long page keeps stays small."""
        parts, state = [], None
        for t in range(0, len(gates), STRIDE):
            out, _, state = self._run(d, gates[t : t + STRIDE], state)
            parts.append(out)
        return np.concatenate(parts)


# --- training -----------------------------------------------------------------

# words of class names and the elements that hold what they name, by which layouts are made up
MAIN = ["article", "main", "content", "post", "entry", "story", "body", "text", "page"]
PLAIN = ["wrap", "container", "row", "col", "inner", "box", "block", "grid", "section", "area", "item", "left", "right", "center"]
ASIDE = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "links"],
    "header": ["header", "masthead", "banner", "topbar", "branding", "logo", "site"],
    "footer": ["footer", "foot", "bottom", "copyright", "legal", "colophon", "site"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "more", "rail", "teaser", "tags", "archive"],
    "notice": ["notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "message", "announcement", "warning"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adbox", "adsense"],
    "form": ["form", "login", "signup", "search", "newsletter", "subscribe", "subscription", "contact", "register"],
    "comments": ["comments", "comment", "replies", "reply", "discussion", "responses", "respond", "disqus", "feedback", "thread", "reader"],
    "share": ["share", "social", "sharing", "follow", "buttons", "tools", "meta", "byline"],
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"], "ad": ["div", "aside", "section"], "form": ["form"], "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul"]}
#: What the parts around a text usually say.
SAYS = {
    "nav": ["home", "about us", "news", "menu", "next", "previous", "back to top", "categories", "all topics", "page"],
    "header": ["welcome to", "the official site of", "since"],
    "footer": ["copyright", "all rights reserved", "privacy policy", "terms of use", "imprint", "contact", "powered by"],
    "aside": ["related", "more from", "you may also like", "most read", "popular", "tags", "archive", "recent posts"],
    "notice": ["we use cookies", "accept all", "by using this site you agree", "this site uses cookies to", "please note", "javascript is disabled"],
    "ad": ["advertisement", "sponsored", "buy now", "special offer", "free shipping", "limited time"],
    "form": ["sign up", "log in", "your email", "password", "subscribe to our newsletter", "search", "submit", "register"],
    "comments": ["says", "reply", "great post", "thanks for sharing", "i agree", "posted by", "comments", "leave a comment"],
    "share": ["share", "tweet", "follow us", "like", "print", "by", "min read", "published"],
}
#: The share of made-up pages whose tags and class names say nothing.
NAMELESS = 0.25
_SURE_MAIN = re.compile(r"(?:^|/)(?:article|main)(?:[./]|$)")
_SURE_ASIDE = re.compile(r"(?:^|/)(?:nav|footer|aside|form|menu|dialog|button|select)(?:[./]|$)|(?:^|/)[a-z0-9]+(?:\.[a-z]+)*\.(?:ad|ads|advert|sidebar|cookie|comments?)(?:[./]|$)")


TELLING = {"nav", "header", "footer", "aside", "section", "dialog", "form", "article", "main", "menu", "button", "label"}


def made_up(seed: int) -> tuple[list[tuple[str, str, float]], list[int]]:
    """The blocks of an invented page and which of them are main text."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    out: list[tuple[str, str, float]] = []
    y: list[int] = []

    def words(n):
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) for _ in range(max(1, n)))

    def name(kind):
        return pick([kind, f"{kind}.{pick(PLAIN)}"])

    def leaf(path, kind, label):
        many = kind in ("nav", "share") or rng.random() < 0.3
        for _ in range(int(rng.integers(1, 9)) if many else int(rng.integers(1, 3))):
            tail = pick(["ul/li", "li", "ol/li", "div"]) if many else pick(["p", "", "div", "h3", "span.p", "form/label", "div/p", "li"])
            if kind == "comments" and rng.random() < 0.6:
                tail = pick([f"div.{pick(ASIDE['comments'])}/p", "li/p", "article/p", "article.comment/div/p", "ol/li/div/p", "p"])
            tail = tail.replace("span.p", "p")
            share = 1.0 if many and rng.random() < 0.8 else float(rng.random() < 0.2) * 0.5
            n = int(rng.integers(1, 5)) if many else int(rng.integers(2, 60))
            own = pick(SAYS[kind]) + " " if rng.random() < 0.5 else ""
            out.append((f"{path}/{tail}".rstrip("/"), (own + words(n)).strip() + pick(["", ".", "!"]), share))
            y.append(label)

    def aside(path, kinds):
        kind = pick(kinds)
        tag = pick(TAGS[kind])
        own = tag if tag not in ("div", "section", "ul", "ol") and rng.random() < 0.5 else f"{tag}.{pick(ASIDE[kind])}" + (f".{pick(PLAIN)}" if rng.random() < 0.3 else "")
        leaf(f"{path}/{own}", kind, 0)

    outer = "html/body" + "".join(f"/{name('div')}" for _ in range(int(rng.integers(0, 3))))
    for _ in range(int(rng.integers(0, 4))):
        aside(outer, ["nav", "header", "notice", "ad", "form", "share"])
    style = rng.random()
    holder = pick(["article", "main", "main/article", "main/div/article"]) if style < 0.55 else f"{pick(['div', 'section', 'td'])}.{pick(MAIN)}" if style < 0.9 else name("div")
    if rng.random() < 0.3:
        holder += f"/div.{pick(MAIN + PLAIN)}"
    path = f"{outer}/{holder}"
    if rng.random() < 0.8:
        out.append((f"{path}/{pick(['h1', 'h1', 'h2', 'header/h1'])}", words(int(rng.integers(2, 12))), 0.0))
        y.append(1)
    middle = rng.random() < 0.3
    for _ in range(int(rng.integers(1, 24))):
        tail = pick(["p", "p", "p", "p", "p", "h2", "ul/li", "blockquote/p", "pre", "table/tbody/tr/td", "div", "figure/figcaption", "h3", "ol/li", "dl/dd"])
        long = rng.random() < 0.75
        out.append((f"{path}/{tail}", words(int(rng.integers(8, 90)) if long else int(rng.integers(1, 8))) + (pick([".", ".", "!", "?"]) if long else pick(["", "."])), float(rng.random() < 0.1) * float(rng.random())))
        y.append(1)
        if middle and rng.random() < 0.1:
            aside(path, ["ad", "aside", "share", "form", "notice"])
    if rng.random() < 0.35:
        aside(path, ["comments", "share", "aside", "form"])
    for _ in range(int(rng.integers(0, 5))):
        aside(outer, ["comments", "aside", "footer", "footer", "ad", "nav", "form", "notice", "share"])
    if rng.random() < NAMELESS:
        out = [(nameless(path), text, share) for path, text, share in out]
    return out, y


def nameless(path: str) -> str:
    """A path without class names, its semantic elements as plain ones."""
    return "/".join("div" if x.partition(".")[0] in TELLING else x.partition(".")[0] for x in path.split("/"))


def known_labels(page: list[tuple[str, str, float]]) -> list[int]:
    """1, 0, or -1 where the elements around a block don't tell."""
    return [0 if _SURE_ASIDE.search(path) else 1 if _SURE_MAIN.search(path) else -1 for path, _, _ in page]


def train(sample: list[str], *, steps: int = STEPS, seed: int = 5) -> Labeller:
    """A labeller from made-up layouts and the sample's surely labelled blocks, by Adam."""
    pages = [made_up(i) for i in range(MADE_UP)]
    pages += [(b, known_labels(b)) for b in map(blocks, sample) if b]
    made = []
    for page, y in pages:
        if len(page) > TRAINED_BLOCKS:  # both ends of a training page; predictions read whole pages
            half = TRAINED_BLOCKS // 2
            page, y = page[:half] + page[-half:], y[:half] + y[-half:]
        x = np.concatenate((np.stack([path_vector(p) for p, _, _ in page]), word_vectors([t for _, t, _ in page]), numbers(page)), 1)
        made.append((x, np.array(y)))
    rng = np.random.default_rng(seed)
    model = Labeller(seed)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        batch = [made[i] for i in rng.integers(0, len(made), TOGETHER)]
        lengths = np.array([len(x) for x, _ in batch])
        x = np.zeros((lengths.max(), len(batch), PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
        y = np.full(x.shape[:2], -1.0)
        for j, (own, label) in enumerate(batch):
            x[: len(own), j], y[: len(own), j] = own, label
            if rng.random() < 0.25:  # the path alone must do
                x[:, j, PATH_DIMS:] = 0
        _, grad = model.train_step(x, np.maximum(y, 0), (y >= 0).astype(np.float64), lengths)
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            model.p[k] = (model.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller that has seen the ``sample`` pages (of SAMPLE_BYTES bytes at most) with the least hashes of their ids."""
    h = F.xxhash64(F.lit("sample"), F.col(id_col))
    small = pages.where(F.octet_length(html_col) <= SAMPLE_BYTES).select(h.alias("h"), F.col(html_col).alias("page"))
    edge = small.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # of pages with one hash (repeated ids) that of the least hash of its html: sample rows at most
    few = small.where(F.col("h") <= edge).groupBy("h").agg(F.min_by("page", F.struct(F.xxhash64("page"), "page")).alias("page")).collect() if edge is not None else []
    return train(sorted(r.page for r in few))


def extract(pages: DataFrame, model: Labeller, *, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        model, cache = shared.value, {}
        for batch in batches:
            found = [blocks(x or "") for x in batch.column(len(keep)).to_pylist()]
            texts = [" ".join(b[1] for b, q in zip(page, label, strict=True) if q > 0.5) for page, label in zip(found, model.predict(found, cache), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*([schema_of(pages, keep)] if keep else []), "text string", "n_chars long"])
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages))
