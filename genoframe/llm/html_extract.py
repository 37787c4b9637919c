"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks (leaf texts between block-level
tags). Each block has a vector of its tag path (tags, classes, ids), of its hashed
words and of a few measures; a bidirectional LSTM, written and trained in numpy,
reads the whole sequence and labels every block as main text or not.

The labeller is trained on pages that :func:`make_page` draws: articles of many
layouts among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, with names of classes and ids partly left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, OWN_DIM, WORD_DIM, MEASURES = 128, 48, 48, 8
INPUT = PATH_DIM + OWN_DIM + WORD_DIM + MEASURES
HIDDEN = 24
#: Pages labelled together in a task, and blocks (with padding) at a time.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 256, 20_000

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not shown as text.
_HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math canvas audio video head title".split())
#: Elements that a head may hold; any other tag, and text, ends a head left open.
_HEAD = frozenset("base link meta noscript script style template title".split())
_RAW = frozenset("script style title textarea iframe noscript template".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=20_000)
def _bits(tag: str, names: tuple[str, ...]) -> tuple[int, int]:
    """The bits that an element sets in the vector of a path, and in that of its innermost two."""
    path = own = 0
    for x in (tag, *names):
        own |= 1 << crc32(b"own " + x.encode()) % OWN_DIM
    if tag not in ("html", "body"):
        for x in (f"<{tag}>", *names):
            path |= 1 << crc32(x.encode()) % PATH_DIM
    return path, own


class Open:
    """An open element; its path is itself and its parents. What it adds to a vector is kept, so that a deep page costs no more than a flat one."""

    __slots__ = ("tag", "names", "parent", "path", "own")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Open | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.path, self.own = _bits(tag, names)
        if parent:
            self.path |= parent.path

    def __iter__(self) -> Iterator[tuple[str, tuple[str, ...]]]:
        node: Open | None = self
        while node:
            yield node.tag, node.names
            node = node.parent


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: Open | None, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page, in order, with white space made single and ends trimmed.

    An end tag without an open element of its name is passed over; a null or empty page has no blocks.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if hidden and stack[-1].tag == "head" and raw.strip():
            close("head")
        if raw and not hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(tag: str) -> None:
        nonlocal links, hidden
        if not opened[tag]:
            return
        while True:
            name = stack.pop().tag
            opened[name] -= 1
            links -= name == "a"
            hidden -= name in _HIDDEN_TAGS
            if name == tag:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        if not (m[1] or m[4]) and stack and stack[-1].tag == "head" and tag not in _HEAD and tag not in ("head", "html"):
            close("head")
        if m[1] or m[4]:
            close(tag)
            continue
        if tag == "br":
            say(" ")
        attributes = m[3] or m[6] or ""
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _BLOCK and any(e.tag == "p" for e in stack[-4:]):
            close("p")  # an open paragraph ends where a block begins
        if tag in ("li", "td", "th", "tr", "option", "dt", "dd") and stack and stack[-1].tag == tag:
            close(tag)
        names = ()
        if "class" in attributes or "id" in attributes or "role" in attributes:
            names = tuple(p.lower() for f in _NAMES.findall(attributes) for v in f if v for p in _PART.findall(v))
        stack.append(Open(tag, names, stack[-1] if stack else None))
        opened[tag] += 1
        links += tag == "a"
        hidden += tag in _HIDDEN_TAGS
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            say(page[at:stop])
            at = stop
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_vector(path: int, own: int) -> np.ndarray:
    bits = path | own << PATH_DIM
    return np.unpackbits(np.frombuffer(bits.to_bytes((PATH_DIM + OWN_DIM) // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


_WORD = re.compile(r"\w+")


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    for k, b in enumerate(blocks):
        x[k, : PATH_DIM + OWN_DIM] = _path_vector(b.path.path, b.path.own | (b.path.parent.own if b.path.parent else 0)) if b.path else 0
        words = _WORD.findall(b.text.lower())
        n = max(1, len(words))
        counts = np.bincount([crc32(w.encode()) % WORD_DIM for w in words], minlength=WORD_DIM) if words else 0
        x[k, PATH_DIM + OWN_DIM : PATH_DIM + OWN_DIM + WORD_DIM] = np.sqrt(counts) / np.sqrt(n)
        size = len(b.text)
        x[k, -MEASURES:] = (
            np.log1p(size) / 6,
            np.log1p(len(words)) / 5,
            b.linked / size,
            sum(map(b.text.count, ".!?")) / n,
            float(b.text[-1] in ".!?:\"'"),
            k / len(blocks),
            1 / (1 + k),
            1 / (len(blocks) - k),
        )
    return x


class BlockLabeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": draw(INPUT, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w |= {"o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (T, B, H) of one direction; masked steps pass the state on."""
        steps, n, _ = x.shape
        z = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{d}"]
            gates = self._sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            s = np.tanh(c2)
            if keep:
                tape.append((t, i, f, o, g, c, h, s, m))
            c, h = m * c2 + (1 - m) * c, m * (o * s) + (1 - m) * h
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        (hf, tf), (hb, tb) = self._run(x, mask, "f", keep), self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return self._sigmoid((both @ self.w["o"])[..., 0] + self.w["c"]), both, (tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, tapes = self.forward(x, mask, keep=True)
        e = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"o": np.einsum("tbh,tb->h", both, e)[:, None], "c": np.array([e.sum()], np.float32)}
        back = e[..., None] * self.w["o"][:, 0]
        for d, tape, at in (("f", tapes[0], 0), ("b", tapes[1], HIDDEN)):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, c, h, s, m in reversed(tape):
                dh = dh + back[t, :, at : at + HIDDEN]
                new_h, new_c = m * dh, m * dc
                dc2 = new_c + new_h * o * (1 - s * s)
                da = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), new_h * s * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
                dz[t] = da
                gh += h.T @ da
                dh = da @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = dc2 * f + (1 - m) * dc
            flat = dz.reshape(-1, 4 * HIDDEN)
            grads |= {f"x{d}": x.reshape(-1, INPUT).T @ flat, f"h{d}": gh, f"b{d}": flat.sum(axis=0)}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = [pages[k] for k in order[at : at + batch]]
                x, mask = padded([v for v, _ in own])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(own):
                    y[: len(labels), k] = labels
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text; similar lengths run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= BLOCKS_AT_ONCE:
                n += 1
            own, order = order[:n], order[n:]
            x, mask = padded([vectors(pages[k]) for k in own])
            p, _, _ = self.forward(x, mask)
            for j, k in enumerate(own):
                out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x = np.zeros((steps, len(xs), INPUT), np.float32)
    mask = np.zeros((steps, len(xs)), np.float32)
    for k, v in enumerate(xs):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


# Pages to learn from. Every block's text is drawn with a label: main text or not.

_SOUNDS = "the an er on re ti en nd ou st ing ha is it ly es of in sch ver ge ung ein eau que pa la ci os ado ñ é ü".split()
_CUES = {
    "nav": "home news about contact sports culture menu search login archive start themen inicio accueil".split(),
    "footer": "copyright © all rights reserved privacy terms imprint contact impressum · 2020".split(),
    "ad": "advertisement sponsored buy now sale offer free shipping shop anzeige publicidad".split(),
    "notice": "we use cookies accept consent privacy settings subscribe newsletter".split(),
    "form": "name email password submit sign up search subscribe send".split(),
    "comments": "reply comment says wrote report like posted ago guest user".split(),
    "side": "related popular most read latest more trending tags share follow".split(),
    "header": "welcome site logo daily subscribe login your account".split(),
}
_WRAPS = {
    "nav": [("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar"), ("ul", "navigation"), ("div", "breadcrumb"), ("div", "topnav"), ("nav", "menu")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "bottom"), ("div", "copyright"), ("div", "page-footer")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "ad"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("section", "advertisement"), ("div", "adsbygoogle")],
    "notice": [("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("div", "newsletter"), ("div", "popup"), ("div", "gdpr")],
    "form": [("form", ""), ("form", "search-form"), ("form", "subscribe"), ("form", "login")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("div", "reader-comments"), ("ol", "commentlist"), ("div", "disqus"), ("section", "discussion"), ("div", "responses")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("div", "share"), ("section", "recommended"), ("div", "social")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top-bar"), ("div", "logo")],
}
_ARTICLE = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post"), ("div", ""), ("main", "content")]


def make_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its text blocks, whether it is main text."""
    labels: list[bool] = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(_SOUNDS) for _ in range(int(rng.integers(1, 4))))

    def phrase(n: int, cues: list[str] = (), share: float = 0.5) -> str:
        ws = [pick(cues) if cues and rng.random() < share else word() for _ in range(max(1, n))]
        return " ".join(ws)

    def prose(n: int) -> str:
        out = []
        while n > 0:
            k = int(rng.integers(1, 16))
            out.append(phrase(min(n, k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    def say(text: str, main: bool) -> str:
        labels.append(main)
        return text

    def wrap(kind: tuple[str, str], inner: str, named: bool = True) -> str:
        tag, name = kind
        shown = f' {pick(["class", "class", "id"])}="{name}"' if name and named else ""
        return f"<{tag}{shown}>{inner}</{tag}>"

    def boiler(kind: str, named: bool) -> str:
        cues = _CUES[kind] if rng.random() < 0.6 else []
        if kind in ("nav", "side") and rng.random() < 0.8:
            items = "".join(f'<li><a href="/{word()}">{say(phrase(int(rng.integers(1, 4)), cues), False)}</a></li>' for _ in range(int(rng.integers(2, 9))))
            inner = f"<ul>{items}</ul>"
        elif kind == "comments":
            inner = "".join(wrap(("div", "comment"), f"<p>{say(prose(int(rng.integers(3, 50))), False)}</p>", rng.random() < 0.7) for _ in range(int(rng.integers(1, 6))))
            if rng.random() < 0.5:
                inner = f"<h3>{say(phrase(2, cues), False)}</h3>" + inner
        elif kind == "form":
            inner = "".join(f"<label>{say(phrase(1, cues), False)}</label><input>" for _ in range(int(rng.integers(1, 4)))) + f"<button>{say(phrase(1, cues), False)}</button>"
        else:
            n = int(rng.integers(2, 25))
            text = say(phrase(n, cues, 0.4) if rng.random() < 0.5 else prose(n), False)
            inner = f"<p>{text}</p>" if rng.random() < 0.4 else text
        return wrap(pick(_WRAPS[kind]), inner, named)

    named = lambda: rng.random() < 0.9
    top, inside, bottom = [], [], []
    for kind, chance in (("notice", 0.25), ("header", 0.5), ("nav", 0.85), ("ad", 0.5), ("form", 0.15), ("side", 0.2)):
        if rng.random() < chance:
            top.append(kind)
    for kind, chance in (("side", 0.4), ("ad", 0.3), ("comments", 0.4), ("form", 0.25), ("nav", 0.15), ("notice", 0.2), ("footer", 0.85)):
        if rng.random() < chance:
            bottom.append(kind)
    page = "".join(boiler(k, named()) for k in top)
    wrapper = pick(_ARTICLE[:3]) if rng.random() < 0.6 else pick(_ARTICLE)
    body, plain = "", rng.random() < 0.25  # some pages have no paragraphs, only plain divisions
    if rng.random() < 0.8:
        body += f"<h1>{say(phrase(int(rng.integers(2, 12))), True)}</h1>"
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        n = int(np.exp(rng.uniform(0, 5)))
        if kind < 0.7 and plain:
            body += f"<div>{say(prose(n), True)}</div>"
        elif kind < 0.7:
            body += f"<p>{say(prose(n), True)}</p>" if rng.random() < 0.9 else f"<p><b>{say(prose(n), True)}<br>"
        elif kind < 0.77:
            body += f"<{(t := pick(['h2', 'h3']))}>{say(phrase(int(rng.integers(1, 6))), True)}</{t}>"
        elif kind < 0.88:
            entry = prose if rng.random() < 0.5 else phrase
            items = "".join(f"<li>{say(entry(int(rng.integers(1, 12))), True)}</li>" for _ in range(int(rng.integers(1, 7))))
            body += f"<{(t := pick(['ul', 'ol']))}>{items}</{t}>"
        elif kind < 0.92:
            body += f"<blockquote><p>{say(prose(n), True)}</p></blockquote>"
        elif kind < 0.95:
            body += f'<p>{say(phrase(4) + f" <a href=x>{phrase(2)}</a> " + prose(8), True)}</p>'
        else:
            body += boiler(pick(["ad", "side", "form", "notice"]), True)
    article = wrap(wrapper, body)
    if rng.random() < 0.12:  # laid out by a table, the menus in one cell and the article in another
        page = f"<table><tr><td>{page}</td><td>{article}</td></tr></table>"
    else:
        page += article
    page += "".join(boiler(k, named()) for k in bottom)
    return f"<html><head><title>{phrase(4)}</title></head><body>{page}</body></html>", labels


@lru_cache(maxsize=2)
def trained_labeller(pages: int = 900, seed: int = 12) -> BlockLabeller:
    """The labeller, fitted on ``pages`` drawn pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = make_page(rng)
        blocks = blocks_of(page)
        assert len(blocks) == len(labels), page
        data.append((vectors(blocks), np.array(labels, np.float32)))
    model = BlockLabeller()
    model.fit(data)
    return model


def main_text(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """Main text of each page: its labelled blocks in page order, joined by newlines."""
    blocks = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(own, kept) if keep) for own, kept in zip(blocks, model.label(blocks))]


def extract_main_text(pages: DataFrame, model: BlockLabeller | None = None, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every row of ``pages`` with ``out_col`` added (replaced if there): the page's main text.

    Null and empty html, and pages without main text, give ""; other columns stay. Repeated
    rows come back as often, an empty table gives no rows, and long or deep pages are read
    whole, in time linear in their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_labeller())

    @F.pandas_udf("string")
    def extract(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in html:
            out: list[str] = []
            for at in range(0, len(batch), PAGES_AT_ONCE):
                out += main_text([None if p is None or p is pd.NA else p for p in batch.iloc[at : at + PAGES_AT_ONCE]], shared.value)
            yield pd.Series(out, dtype=object)

    return pages.withColumn(out_col, extract(F.coalesce(F.col(html_col), F.lit(""))))
