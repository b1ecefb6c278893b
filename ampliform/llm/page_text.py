"""Main text of web pages: a recurrent labeller reads a page's blocks in order and says which belong to the article.

A page is cut into its leaf blocks: runs of text between block tags, each with the path of tags above it (their names, classes and
ids). A block becomes the sum of the vectors of its path's hashed names, the mean vector of its hashed words, and a few shares (links, punctuation,
place in the page). A bidirectional LSTM in numpy runs over all blocks of the page, so each is judged by what stands around it,
and a logistic unit labels it. All vectors and weights are fitted together, by Adam.

The model is fitted on a bounded sample, the ``SAMPLE`` pages with the smallest hash, ``SAMPLE_BYTES`` bytes of them at most. Pages
that say by their tags what is article and what isn't label themselves; the same blocks are also dealt into ``VARIANTS`` pages of
other layouts, with menus, headers, sidebars, notices, adverts, forms, comments and footers under other tags or none that tell.
One task fits the sample to the same weights each time it runs. Every page is labelled whole.

Edge cases: a null or empty page has the text ''. Comments, scripts, styles and other elements that show no text are dropped with
what they hold, to the page's end if they aren't closed; a tag that is never closed ends with its parent. Pages are read one by
one, so repeated rows agree; an empty table gives no rows. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PUNCTUATION, batched_words, cut, utf8

#: Pages and bytes that the model is fitted on at most, and layouts that each is dealt into besides its own.
SAMPLE, SAMPLE_BYTES, VARIANTS = 600, 4 << 20, 3
#: Sizes: hashed names and words, their vectors, the LSTM's state; passes, pages a step, rate.
NAMES, WORDS, WIDE, STATE = 4096, 4096, 12, 16
PASSES, STEP, RATE = 8, 16, 0.01
#: Blocks of a page that one numpy step holds.
SPAN = 4096
SHARES = 8

#: Tags that stand within a line, that hold nothing, and whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("applet audio canvas datalist head iframe math noembed noframes noscript object script select style svg template textarea title video".split())
#: Of these, what ends only at its own closing tag, whatever looks like a tag in it.
RAW = frozenset("iframe noembed noframes script style textarea title".split())
#: A tag that ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main nav aside header footer form body blockquote".split())
#: Tags that tell by themselves.
MAIN, ASIDE = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "button", "dialog"))
#: Names of classes and ids: of articles, and of what isn't part of one.
GOOD = ("content", "article", "post", "entry", "story", "text", "main", "body")
BAD = {
    "header": ("header", "masthead", "top", "branding", "banner"), "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb"), "sidebar": ("sidebar", "related", "widget", "popular", "recommended"),
    "notice": ("notice", "cookie", "consent", "alert", "newsletter"), "advert": ("ad", "ads", "advert", "sponsored", "promo"), "form": ("form", "search", "login", "subscribe", "contact"),
    "comments": ("comments", "comment", "reply", "discussion", "responses"), "footer": ("footer", "copyright", "legal", "bottom", "credits"),
}
_BAD = frozenset(x for names in BAD.values() for x in names)
#: The tags under which such parts come, and a line that they may hold.
TAGS = {"header": "header", "menu": "nav", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comments": "section", "footer": "footer"}
LINES = {
    "header": "Welcome to our site", "menu": "Home About Contact", "sidebar": "Related stories you may like", "notice": "We use cookies to improve your experience. Accept all", "advert": "Advertisement. Buy now and save",
    "form": "Enter your email to sign in", "comments": "Posted by a reader: reply to this comment", "footer": "© All rights reserved. Privacy policy and terms of use",
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Block:
    """A run of text with the (tag, names) pairs above it, and how many of its characters are in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaves(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    silent = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
        held.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal silent
        for t, _ in stack[to:]:
            silent -= t in SILENT
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        i = n if i < 0 else i
        if i > at and not silent:
            text = html.unescape(page[at:i])
            held.append(text)
            linked += len(text) if any(t == "a" for t, _ in stack) else 0
        if i == n:
            break
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = _TAG.match(page, i) or _LOOSE.match(page, i)
        if m is None:  # no tag: a sign of its own
            if not silent:
                held.append("<")
            at = i + 1
            continue
        at, name = m.end(), m[2].lower()
        if name == "br" and not silent:
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if ends := CLOSES.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if name in VOID or m[3].endswith("/") and name in SILENT:
            continue
        names = tuple(w for _, v in _NAMED.findall(m[3]) for w in _WORD.findall(v.lower()))[:8]
        stack.append((name, names))
        silent += name in SILENT
        if name in RAW:
            low = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = low.start() if low else n
    flush()
    return out


def tokens(path: tuple) -> np.ndarray:
    """The hashed names of a path: each tag and name above the block, and those of the nearest three once more, by their distance."""
    key = _paths.get(path)
    if key is None:
        seen = ["."]
        for far, (tag, names) in enumerate(reversed(path)):
            for x in (tag, *(f".{w}" for w in names)):
                seen.append(x)
                if far < 3:
                    seen.append(f"{far}{x}")
        if len(_paths) > 50_000:
            _paths.clear()
        key = _paths[path] = np.unique(np.array([zlib.crc32(x.encode()) % NAMES for x in seen], np.int32))
    return key


_paths: dict[tuple, np.ndarray] = {}


class Bag:
    """Blocks as what the labeller reads: hashed names and words with where each block's begin, and shares."""

    def __init__(self, blocks: list[Block], worded: bool = True):
        n = len(blocks)
        paths = [tokens(b.path) for b in blocks]
        self.names, self.name_at = np.concatenate(paths), np.cumsum([0, *map(len, paths)])
        words, counts = [], np.zeros(n, np.int64)
        for first, w, k in batched_words([b.text.encode() for b in blocks], PUNCTUATION):
            words.append((w & np.uint64(WORDS - 1)).astype(np.int32))
            counts[first : first + len(k)] = k
        self.words, self.word_at = np.concatenate(words or [np.empty(0, np.int32)]), np.concatenate([[0], np.cumsum(counts)])
        if not worded:
            self.words, self.word_at = self.words[:0], np.zeros(n + 1, np.int64)
        # names add up, so that one that tells isn't lost among many; words are a mean
        self.name_by, self.word_by = np.full(n, 2, np.float32), 3 * np.maximum(1, np.diff(self.word_at)).astype(np.float32)
        size = np.array([len(b.text) for b in blocks])
        link = np.array([min(b.linked, len(b.text)) for b in blocks]) / size
        signs = np.array([b.text.count(".") + b.text.count(",") for b in blocks]) / np.maximum(1, counts)
        digits = np.array([sum(map(b.text.count, "0123456789")) for b in blocks]) / size
        place = np.arange(n) / max(1, n)
        self.shares = np.stack([np.log1p(counts) / 5, link, np.minimum(signs, 1), digits, place, place == 0, np.arange(n) >= n - 1, np.full(n, np.log1p(n) / 5)], axis=1).astype(np.float32)


def _sums(table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each block's ids."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    size = np.diff(at)
    some = np.flatnonzero(size)
    for s in range(0, len(some), 512):
        part = some[s : s + 512]
        low, high = int(at[part[0]]), int(at[part[-1] + 1])
        if high - low <= 1 << 18:
            out[part] = np.add.reduceat(table[ids[low:high]], at[part] - low, axis=0)
        else:  # very long blocks are summed by how often each id is there
            for i in part:
                out[i] = np.bincount(ids[at[i] : at[i + 1]], minlength=len(table)).astype(np.float32) @ table
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The weights, and how they read pages."""

    SHAPES = {"names": (NAMES, WIDE), "words": (WORDS, WIDE), "wo": (2 * STATE + 2 * WIDE + SHARES,), "bo": (1,)} | {f"{k}{d}": s for d in "fb" for k, s in (("wx", (2 * WIDE + SHARES, 4 * STATE)), ("wh", (STATE, 4 * STATE)), ("b", (4 * STATE,)))}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls) -> Labeller:
        rng = np.random.default_rng(13)
        w = {k: (rng.standard_normal(s) * (0.1 if k in ("names", "words") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in cls.SHAPES.items()}
        w["bo"][:] = 0
        for d in "fb":
            w[f"b{d}"][:] = 0
            w[f"b{d}"][STATE : 2 * STATE] = 1  # forgets late
        return cls(w)

    def vectors(self, bag: Bag, low: int = 0, high: int | None = None) -> np.ndarray:
        high = len(bag.shares) if high is None else high
        part = lambda table, ids, at, divisor: _sums(table, ids, at[low : high + 1]) / divisor[low:high, None]
        return np.concatenate([part(self.w["names"], bag.names, bag.name_at, bag.name_by), part(self.w["words"], bag.words, bag.word_at, bag.word_by), bag.shares[low:high]], axis=1)

    def run(self, x: np.ndarray, d: str, live: np.ndarray, h: np.ndarray, c: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States over (steps, pages, values); where a page isn't live its state stays."""
        z0, wh = x @ self.w[f"wx{d}"] + self.w[f"b{d}"], self.w[f"wh{d}"]
        out = np.empty((*x.shape[:2], STATE), np.float32)
        for t in range(len(x)):
            z = z0[t] + h @ wh
            gate = _sigmoid(z[:, : 3 * STATE])
            i, f, o, g = gate[:, :STATE], gate[:, STATE : 2 * STATE], gate[:, 2 * STATE :], np.tanh(z[:, 3 * STATE :])
            m = live[t][:, None]
            new = f * c + i * g
            y = np.tanh(new)
            if keep is not None:
                keep.append((i, f, o, g, c, y, h, m))
            c, h = np.where(m, new, c), np.where(m, o * y, h)
            out[t] = h
        return out, h, c

    def label(self, bag: Bag) -> np.ndarray:
        """The probability of each block of one page, span by span; what is held are the states of one direction."""
        n = len(bag.shares)
        zero = np.zeros((1, STATE), np.float32)
        back, h, c = np.empty((n, STATE), np.float32), zero, zero
        for s in range((n - 1) // SPAN * SPAN, -1, -SPAN):
            x = self.vectors(bag, s, min(n, s + SPAN))
            states, h, c = self.run(x[::-1, None], "b", np.ones((len(x), 1), bool), h, c)
            back[s : s + SPAN] = states[::-1, 0]
        out, h, c = np.empty(n, np.float32), zero, zero
        for s in range(0, n, SPAN):
            x = self.vectors(bag, s, min(n, s + SPAN))
            states, h, c = self.run(x[:, None], "f", np.ones((len(x), 1), bool), h, c)
            out[s : s + SPAN] = _sigmoid(np.concatenate([states[:, 0], back[s : s + SPAN], x], axis=1) @ self.w["wo"] + self.w["bo"])
        return out

    def label_all(self, bags: list[Bag]) -> list[np.ndarray]:
        """Pages of like size together, long ones alone."""
        out: list = [None] * len(bags)
        order = sorted(range(len(bags)), key=lambda i: len(bags[i].shares))
        at = 0
        while at < len(order):
            some = [order[at]]
            while at + len(some) < len(order) and len(some) < 128 and len(bags[order[at + len(some)]].shares) * (len(some) + 1) <= SPAN:
                some.append(order[at + len(some)])
            at += len(some)
            if len(some) == 1:
                out[some[0]] = self.label(bags[some[0]])
                continue
            x, live = _padded([self.vectors(bags[i]) for i in some])
            p = self.forward(x, live)[0]
            for k, i in enumerate(some):
                out[i] = p[: len(bags[i].shares), k]
        return out

    def forward(self, x: np.ndarray, live: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros((x.shape[1], STATE), np.float32)
        f, _, _ = self.run(x, "f", live, zero, zero, keep and keep[0])
        b, _, _ = self.run(x[::-1], "b", live[::-1], zero, zero, keep and keep[1])
        y = np.concatenate([f, b[::-1], x], axis=2)
        return _sigmoid(y @ self.w["wo"] + self.w["bo"]), y

    def slopes(self, bags: list[Bag], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The gradient of the mean log loss over the blocks of some pages."""
        x, live = _padded([self.vectors(b) for b in bags])
        want, _ = _padded([y[:, None].astype(np.float32) for y in labels])
        keep: tuple[list, list] = [], []
        p, y = self.forward(x, live, keep)
        e = np.where(live, p - want[:, :, 0], 0).astype(np.float32) / max(1, live.sum())
        g = {"wo": np.tensordot(e, y, 2), "bo": np.array([e.sum()], np.float32)}
        dy = e[:, :, None] * self.w["wo"]
        dx = dy[:, :, 2 * STATE :].copy()
        for d, kept, dh_all, xs in (("f", keep[0], dy[:, :, :STATE], x), ("b", keep[1], dy[::-1, :, STATE : 2 * STATE], x[::-1])):
            wh, wx = self.w[f"wh{d}"], self.w[f"wx{d}"]
            dz_all = np.zeros((*x.shape[:2], 4 * STATE), np.float32)
            dwh, dh, dc = np.zeros_like(wh), np.zeros((x.shape[1], STATE), np.float32), np.zeros((x.shape[1], STATE), np.float32)
            for t in range(len(kept) - 1, -1, -1):
                i, f, o, u, c, th, h, m = kept[t]
                dh = dh + dh_all[t]
                on = np.where(m, dh, 0)
                dn = on * o * (1 - th * th) + np.where(m, dc, 0)
                dz = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), on * th * o * (1 - o), dn * i * (1 - u * u)], axis=1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh, dc = np.where(m, 0, dh) + dz @ wh.T, np.where(m, dn * f, dc)
            g[f"wh{d}"], g[f"wx{d}"], g[f"b{d}"] = dwh, np.tensordot(xs, dz_all, ((0, 1), (0, 1))), dz_all.sum(axis=(0, 1))
            back = dz_all @ wx.T
            dx += back if d == "f" else back[::-1]
        g["names"], g["words"] = np.zeros_like(self.w["names"]), np.zeros_like(self.w["words"])
        for k, b in enumerate(bags):
            n = len(b.shares)
            for table, ids, at, by, part in (("names", b.names, b.name_at, b.name_by, slice(0, WIDE)), ("words", b.words, b.word_at, b.word_by, slice(WIDE, 2 * WIDE))):
                np.add.at(g[table], ids, np.repeat(dx[:n, k, part] / by[:, None], np.diff(at), axis=0))
        return g


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(r) for r in rows)
    x, live = np.zeros((n, len(rows), rows[0].shape[1]), np.float32), np.zeros((n, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], live[: len(r), k] = r, True
    return x, live


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """What a page's tags say of its blocks: 1 in an article, 0 elsewhere or in a part of it that isn't; nothing if there's no article."""
    if not any(t in MAIN for b in blocks for t, _ in b.path):
        return None
    out = np.zeros(len(blocks), np.int8)
    for i, b in enumerate(blocks):
        for t, names in reversed(b.path):
            if t in ASIDE or _BAD.intersection(names):
                break
            if t in MAIN:
                out[i] = 1
                break
    return out


def variant(rng: random.Random, article: list[str], articles: list[list[str]], other: list[str]) -> str:
    """A page of another layout with the same article, and parts made of lines of other pages: what is said doesn't tell what is article."""
    esc = lambda x: html.escape(x, quote=False)

    def wrap(tag: str, names: tuple[str, ...], inner: str) -> str:
        style = rng.random()
        word = rng.choice(names) + rng.choice(("", "", "-wrap", "-box", f" col{rng.randrange(9)}"))
        head = f' class="{word}"' if style < 0.5 else f' id="{word}"' if style < 0.75 else ""
        tag = tag if not head or rng.random() < 0.4 else rng.choice(("div", "section"))
        return f"<{tag}{head}>{inner}</{tag}>"

    def lines(k: int) -> list[str]:
        picked = [rng.choice(other) if rng.random() < 0.5 else rng.choice(rng.choice(articles)) for _ in range(k)]
        return [" ".join(x.split()[: rng.choice((3, 8, 25, 80, None))]) for x in picked]

    def part(kind: str) -> str:
        told = rng.random() < 0.85  # else only what is said tells
        said = [LINES[kind]] if not told or rng.random() < 0.3 else []
        link = lambda x: f'<a href="#">{esc(x)}</a>'
        if kind == "menu":
            inner = "<ul>" + "".join(f"<li>{link(' '.join(x.split()[:2]))}</li>" for x in lines(rng.randrange(3, 9))) + "</ul>" if rng.random() < 0.7 else " ".join(link(" ".join(x.split()[:2])) for x in lines(rng.randrange(2, 6)))
        elif kind == "sidebar":
            inner = "<h3>" + esc(" ".join(lines(1)[0].split()[:3])) + "</h3>" if rng.random() < 0.6 else ""
            inner += "".join(f"<p>{link(x)}</p>" if not told or rng.random() < 0.5 else f"<p>{esc(x)}</p>" for x in said + lines(rng.randrange(1, 5)))
        elif kind == "form":
            inner = "".join(f"<label>{esc(' '.join(x.split()[:3]))}</label><input name=q>" for x in said + lines(rng.randrange(1, 4))) + "<button>Go</button>"
        else:
            one = rng.choice(("<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{} ") if kind != "comments" else ("<p>{}</p>", "<div class=comment><p>{}</p></div>", "<div class=reply>{}</div>", "<li class=c>{}</li>"))
            inner = "<h3>Comments</h3>" * (kind == "comments" and (not told or rng.random() < 0.4)) + "&copy; " * (kind == "footer" and rng.random() < 0.5)
            inner += f"<{head}>{esc(' '.join(lines(1)[0].split()[:4]))}</{head}>" if kind == "header" and (head := rng.choice(("h1", "h2", "div", ""))) else ""
            inner += "".join(one.format(esc(x)) for x in said + (lines(rng.randrange(1, 4)) if told else []))
        return wrap(TAGS[kind], BAD[kind], inner) if told else f"<div>{inner}</div>"

    text = []
    for k, x in enumerate(article):
        tag = rng.choice(("h1", "h2")) if k == 0 and len(article) > 1 else rng.choice(("p", "p", "p", "p", "div", "li", "blockquote"))
        text.append(f"<{tag}>{esc(x)}</{tag}>")
        if rng.random() < 0.1 or k == len(article) - 1 and rng.random() < 0.2:
            text.append(part(rng.choice(("advert", "notice", "sidebar", "form"))))
    core = wrap(rng.choice(("article", "main", "div", "div")), GOOD, "".join(text))
    while rng.random() < 0.4:
        core = wrap("div", ("page", "wrapper", "container", "layout", "site"), core)
    before = [part(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.45]
    after = [part(k) for k in ("comments", "sidebar", "advert", "form", "notice", "menu") if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    return "<html><body>" + "".join(before) + core + "".join(after) + (part("footer") if rng.random() < 0.8 else "") + "</body></html>"


def examples(pages: list[str]) -> list[tuple[Bag, np.ndarray]]:
    """Labelled pages: those whose tags tell, and variants made of the articles and of the other blocks of all."""
    out, articles, other = [], [], []
    rng = random.Random(31)
    for page in pages:
        blocks = leaves(page)
        if not blocks:
            continue
        y = own_labels(blocks)
        if y is None:  # long blocks without links stand for an article
            y = np.array([len(b.text.split()) >= 15 and b.linked * 3 < len(b.text) for b in blocks], np.int8)
        else:
            out.append((Bag(blocks, rng.random() < 0.5), y))
        if y.any():
            articles.append([b.text for b, k in zip(blocks, y, strict=True) if k])
        other += [b.text for b, k in zip(blocks, y, strict=True) if not k]
    other = other + list(LINES.values())
    for article in articles:
        for _ in range(VARIANTS):
            i, n = rng.randrange(len(article)), rng.randrange(1, 30)
            some = article if rng.random() < 0.7 else article[i : i + n]
            blocks = leaves(variant(rng, some, articles, other))
            # blocks of the article come in its order; whatever else has the same words stands elsewhere
            left, y = list(reversed(some)), np.zeros(len(blocks), np.int8)
            for k, b in enumerate(blocks):
                inner = {w for _, names in b.path for w in names} | {t for t, _ in b.path}
                if left and b.text == left[-1] and not (inner & ASIDE) and not any(w in _BAD for w in inner):
                    y[k] = 1
                    left.pop()
            if not left:
                out.append((Bag(blocks, rng.random() < 0.5), y))  # half of them without words, so that tags and context must do
    return out


def fitted(pages: list[str]) -> Labeller:
    """A labeller after ``PASSES`` passes of Adam over the examples that the pages give; its weights are the mean of the last steps'."""
    model, known = Labeller.fresh(), examples(sorted(pages))
    known = [(b, y) for b, y in known if len(y) <= SPAN]
    if not known:
        return model
    rng = np.random.default_rng(7)
    first, second, mean = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(3))
    t = 0
    for turn in range(PASSES):
        order = rng.permutation(len(known))
        order = np.concatenate([sorted(order[s : s + 16 * STEP], key=lambda i: len(known[i][1])) for s in range(0, len(order), 16 * STEP)]).astype(int)
        steps = [order[s : s + STEP] for s in range(0, len(order), STEP)]
        for k in rng.permutation(len(steps)):
            g = model.slopes([known[i][0] for i in steps[k]], [known[i][1] for i in steps[k]])
            t += 1
            rate = RATE * (1 - turn / PASSES) + 1e-4
            for name, d in g.items():
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.001 * (d * d - second[name])
                model.w[name] -= rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                mean[name] += (model.w[name] - mean[name]) * max(0.01, 1 / t)
    return Labeller(mean)


def fit(pages: DataFrame, page: str = "html") -> Labeller:
    """The labeller of a table, fitted in one task on its bounded sample."""
    t = F.col(page).cast("string")
    rows = pages.select(F.xxhash64(t).alias("h"), F.coalesce(F.octet_length(t), F.lit(0)).alias("size")).where("size > 0").distinct().orderBy("h", "size").limit(SAMPLE)
    upto = F.sum("size").over(Window.orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0))
    some = cut(rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("h", "size"))
    taken = pages.select(t.alias("t"), F.xxhash64(t).alias("h")).join(F.broadcast(some), "h").groupBy("h").agg(F.first("t").alias("t"))
    names = list(Labeller.SHAPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted([x.decode() for b in batches for x in utf8(b.column(0))])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([model.w[k].astype("<f4").tobytes() for k in names], pa.binary())], names=["name", "w"])

    got = {r.name: np.frombuffer(r.w, "<f4").reshape(Labeller.SHAPES[r.name]) for r in cut(taken.select("t").coalesce(1).mapInArrow(run, "name string, w binary")).collect()}
    return Labeller(got)


def main_text(labeller: Labeller, pages: list[str]) -> list[str]:
    """The text of each page's article: its blocks, in order, one a line."""
    cut_up = [leaves(p) for p in pages]
    some = [i for i, b in enumerate(cut_up) if b]
    out = [""] * len(pages)
    for i, p in zip(some, labeller.label_all([Bag(cut_up[i]) for i in some]), strict=True):
        out[i] = "\n".join(b.text for b, y in zip(cut_up[i], p, strict=True) if y >= 0.5)
    return out


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast((labeller or fit(pages, page)).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(shared.value)
        for b in batches:
            for part in by_bytes(b):
                text = main_text(model, [x.decode() for x in utf8(part.column(2))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def by_bytes(b: pa.RecordBatch, rows: int = 128, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of so many rows and bytes at most, but one row at least."""
    at, held = 0, 0
    for i, x in enumerate(b.column(2)):
        n = len(x.as_buffer()) if x.is_valid else 0
        if i > at and (i - at >= rows or held + n > size):
            yield b.slice(at, i - at)
            at, held = i, 0
        held += n
    if b.num_rows > at:
        yield b.slice(at)


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
