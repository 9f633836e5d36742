"""Main-text extraction (operator 5): a recurrent labeller of a page's leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags; scripts, styles, comments, form
controls and other non-text elements are markup and give none).  Every block becomes a vector of hashed
tag-path tokens (tag names, words of classes and ids of its ancestors), hashed words of its whole text, and
a few densities.  A bidirectional LSTM in numpy reads the page's blocks in order, so each label depends on
the whole document, and the blocks labelled main text are joined.

The labeller is trained here, with back-propagation through time and Adam, on pages that
``training_pages`` invents: articles under changing containers amid menus, headers, notices, adverts,
sidebars, forms, reader comments and footers, all in random words, so that structure and context decide,
not vocabulary.  Training is seeded and takes some seconds once per driver process; the weights (about
100 KB whatever the table) travel to the tasks.

Defined cases: null or empty html, and a page without main blocks, give the empty text; unclosed and
unmatched tags are repaired as browsers do for paragraphs, list items and cells; a button, svg or other element
without text that is left open ends with its parent or at the next block, a script, style or other raw text with
the page; rows repeating a page
id are extracted one by one; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

# ------------------------------------------------------------------ pages -> leaf blocks

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe script style textarea title".split())  # no tags inside: text up to the closing tag or the page's end
SILENT_TAGS = frozenset("audio button canvas math noscript object select svg template video".split())
FOREIGN = frozenset({"svg", "math"})  # '/>' ends these
ALONE = frozenset({"button", "select"})  # never inside each other: the next one ends one left open
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")


def marks(page: str) -> tuple[list[tuple], dict[int, int]]:
    """The page's markup in order: (start, end, tag or '', closing, attributes), and which mark closes each
    silent element that is closed inside its parent.  A raw-text element is one mark without a tag."""
    out: list[tuple] = []
    closed: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: Counter = Counter()
    at = 0

    def pop(tag: str) -> int:
        """The mark that opened the innermost ``tag``, which is closed with all inside it; -1 if none is open."""
        while count[tag]:
            last, k = stack.pop()
            count[last] -= 1
            if last == tag:
                return k
        return -1

    def foreign() -> bool:
        return next((t in FOREIGN for t, _ in reversed(stack) if t in FOREIGN or t in BLOCK_TAGS), False)

    while m := _MARK.search(page, at):
        at = m.end()
        tag, closing = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        named = (m[3] if m[3] is not None else m[6]) or ""
        if closing:
            k = pop(tag)
            if k >= 0 and tag in SILENT_TAGS:
                closed[k] = len(out)
        elif named.endswith("/") and (tag in FOREIGN or tag in RAW_TAGS and foreign()):
            tag = ""
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at, tag = end.end() if end else len(page), ""
        elif tag and tag not in VOID_TAGS:
            if tag in ALONE:
                pop(tag)
            stack.append((tag, len(out)))
            count[tag] += 1
        out.append((m.start(), at, tag, closing, named))
    return out, closed


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order; a path is a tuple of (tag, words of class, id and role) from the root."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    pieces: list[str] = []
    linked = links = silent = 0
    at = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(s for s in stack if s[0] in BLOCK_TAGS), linked))
            pieces.clear()
        linked = 0

    def close(tag: str, within: frozenset | set = frozenset()):
        """Pops to the innermost open ``tag``, unless an element of ``within`` is met before."""
        nonlocal links, silent
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                links -= sum(s[0] == "a" for s in stack[i:])
                silent -= sum(s[0] in SILENT_TAGS for s in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    def add(text: str):
        nonlocal linked
        if text and not silent:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text)

    found, closed = marks(page)
    k = -1
    while (k := k + 1) < len(found):
        start, end, tag, closing, named = found[k]
        add(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            close(tag)
            continue
        if tag in SILENT_TAGS:
            if k in closed:
                k = closed[k]
                at = found[k][1]
            else:  # left open: its parent's end or the next block ends it
                if tag in ALONE:
                    close(tag)
                stack.append((tag, ()))
                silent += 1
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            while silent:
                close(next(t for t, _ in reversed(stack) if t in SILENT_TAGS))
            close("p", BLOCK_TAGS - {"p"})
            if tag in ITEMS:
                close(tag, ITEMS[tag])
        if tag in VOID_TAGS:
            continue
        words = tuple(w for x in _NAMED.findall(named) for w in _PART.findall("".join(x).lower())) if "=" in named else ()
        stack.append((tag, words))
        links += tag == "a"
    add(page[at:])
    flush()
    return out


# ------------------------------------------------------------------ blocks -> vectors

PATH, WORDS, MORE = 96, 24, 7
SIZE = PATH + WORDS + MORE


@lru_cache(maxsize=100_000)
def _slot(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for depth, (tag, words) in enumerate(reversed(path)):
        near = "leaf:" if depth == 0 else ""
        v[_slot(f"{near}{tag}", PATH)] += 1
        for w in words:
            v[_slot(f".{w}", PATH)] += 1
    return np.minimum(v, 1)


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), SIZE), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        out[i, :PATH] = _path_vector(b.path)
        counts = np.bincount(np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % WORDS, minlength=WORDS)
        out[i, PATH:PATH + WORDS] = counts / len(words)
        n = len(b.text)
        out[i, PATH + WORDS:] = (min(np.log1p(len(words)) / 5, 2), min(b.linked / n, 1), b.text[-1] in ".!?", "©" in b.text,
                                 (i + 1) / (len(blocks) + 1), 1 / (i + 1), 1 / (len(blocks) - i))
    return out


# ------------------------------------------------------------------ bidirectional LSTM

HIDDEN = 24


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Weights: per direction (input + HIDDEN + 1) x 4 HIDDEN, and an output layer over both directions."""

    def __init__(self, seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.w = [(rnd.normal(0, 0.12, (SIZE + HIDDEN + 1, 4 * HIDDEN))).astype(np.float32) for _ in range(2)]
        for w in self.w:
            w[-1, HIDDEN:2 * HIDDEN] = 1  # forget gates start open
        self.out = rnd.normal(0, 0.2, 2 * HIDDEN + 1).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: time x pages x SIZE; mask: time x pages.  Hidden states; a masked step carries the state on."""
        steps, pages, _ = x.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        hs = np.zeros((steps, pages, HIDDEN), np.float32)
        fed = x.reshape(-1, SIZE) @ w[:SIZE] + w[-1]
        fed = fed.reshape(steps, pages, -1)
        for t in range(steps):
            z = fed[t] + h @ w[SIZE:-1]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN:])
            live = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc))
            c = np.where(live, c2, c)
            h = np.where(live, o * tc, h)
            hs[t] = h
        return hs

    def scores(self, x: np.ndarray, mask: np.ndarray, keep=None) -> np.ndarray:
        a = self._run(x, mask, self.w[0], keep and keep[0])
        b = self._run(x[::-1], mask[::-1], self.w[1], keep and keep[1])[::-1]
        if keep:
            keep[2] = (a, b)
        return a @ self.out[:HIDDEN] + b @ self.out[HIDDEN:-1] + self.out[-1]

    def _back(self, x, mask, w, kept, dhs) -> np.ndarray:
        steps, pages, _ = x.shape
        grad = np.zeros_like(w)
        dh_next = np.zeros((pages, HIDDEN), np.float32)
        dc_next = np.zeros_like(dh_next)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc = kept[t]
            live = mask[t][:, None].astype(np.float32)
            dh = dhs[t] + dh_next
            dh_in = dh * live
            dc = dc_next * live + dh_in * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh_in * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[:SIZE] += x[t].T @ dz
            grad[SIZE:-1] += h.T @ dz
            grad[-1] += dz.sum(0)
            dh_next = dz @ w[SIZE:-1].T + dh * (1 - live)
            dc_next = dc * f + dc_next * (1 - live)
        return grad

    def gradients(self, x, mask, y) -> tuple[float, list[np.ndarray]]:
        keep: list = [[], [], None]
        s = self.scores(x, mask, keep)
        p = _sigmoid(s)
        n = mask.sum()
        loss = -np.sum(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))) / n
        ds = (mask * (p - y) / n).astype(np.float32)
        a, b = keep[2]
        d_out = np.concatenate([np.tensordot(ds, a, 2), np.tensordot(ds, b, 2), [ds.sum()]]).astype(np.float32)
        ga = self._back(x, mask, self.w[0], keep[0], ds[..., None] * self.out[:HIDDEN])
        gb = self._back(x[::-1], mask[::-1], self.w[1], keep[1], (ds[..., None] * self.out[HIDDEN:-1])[::-1])
        return float(loss), [ga, gb, d_out]

    def main_text(self, pages: list[str]) -> list[str]:
        """Main text per page; pages of like length are labelled together."""
        blocks = [leaf_blocks(p or "") for p in pages]
        texts = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
        while order:
            group = [order.pop()]
            while order and len(group) < 64 and (len(group) + 1) * len(blocks[group[0]]) <= 4096:
                group.append(order.pop())
            x, mask = padded([vectors(blocks[i]) for i in group])
            main = self.scores(x, mask) > 0
            for k, i in enumerate(group):
                texts[i] = "\n".join(b.text for b, m in zip(blocks[i], main[:, k]) if m)
        return texts


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), SIZE), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, True
    return x, mask


# ------------------------------------------------------------------ training pages

def training_pages(n: int, seed: int) -> list[tuple[str, dict[str, bool]]]:
    """Invented pages and, per block text, whether it is main text (texts are unique within a page)."""
    rnd = random.Random(seed)
    alphabet = ["ba", "to", "ri", "en", "sch", "th", "an", "é", "que", "ión", "ou", "er", "st", "li", "ka", "mo", "ü"]

    def words(a, b):
        return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4)))) for _ in range(rnd.randint(a, b))]

    def prose(a=8, b=60):
        style = rnd.random()
        w = words(a, b)
        if style < 0.06:
            w = [x + rnd.choice(["###", "&amp;&amp;", "%%%", "!!"]) for x in w]
        elif style < 0.1:
            return " | ".join(w) + rnd.choice([" |", "."])
        elif style < 0.14:
            return " ".join(w).upper()
        return " ".join(w).capitalize() + rnd.choice([".", ".", ".", "!", "?", ""])

    def short():
        return " ".join(words(1, 3))

    pages = []
    for _ in range(n):
        labels: dict[str, bool] = {}

        def put(text: str, main: bool) -> str:
            shown = " ".join(entities.unescape(text).split())
            while shown in labels:
                text, shown = text + " x", shown + " x"
            if shown:
                labels[shown] = main
            return text

        def link(main=False):
            return f'<a href="/{short()}">{put(short(), main)}</a>'

        def some(tag_choices, body):
            tag, *named = rnd.choice(tag_choices).split(" ", 1)
            attr = f' {rnd.choice(["class", "class", "id"])}="{named[0]}"' if named else ""
            return f"<{tag}{attr}>{body}</{tag}>"

        def menu():
            items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8)))
            return some(["nav", "nav", "nav main-nav", "div menu", "div navbar", "div nav", "div breadcrumb", "header"], f"<ul>{items}</ul>")

        def boiler(kind):
            line = lambda: put(prose(3, 25), False)
            par = lambda: f"<p>{line()}</p>" if rnd.random() < 0.7 else f"<div>{line()}</div>"
            if kind == "header":
                return some(["header", "div header", "div masthead", "div site-header top"], rnd.choice(["", f"<h2>{put(short(), False)}</h2>"]) + par())
            if kind == "notice":
                return some(["div cookie-notice", "div cookie-banner", "div consent", "div notice", "div alert banner", "section notice"], rnd.choice([line(), par()]))
            if kind == "ad":
                return some(["div ad", "div ad", "div ads", "div advert", "div advertisement", "aside ad", "div sponsored", "div promo"], rnd.choice([line(), line(), par()]))
            if kind == "sidebar":
                inner = f"<h3>{put(short(), False)}</h3>" + "".join(rnd.choice([f"<li>{link()}</li>", par()]) for _ in range(rnd.randint(1, 5)))
                return some(["aside", "aside sidebar", "div sidebar", "div widget", "div related", "div related-posts", "section related"], inner)
            if kind == "form":
                return f'<form action="/x">{rnd.choice(["", par()])}<label>{put(short(), False)}</label><input name="q"><button>Go</button></form>'
            if kind == "comments":
                one = lambda: rnd.choice(["<div class=\"comment\">{}</div>", "<li class=\"comment\">{}</li>", "<p>{}</p>", "<article class=\"comment\"><p>{}</p></article>"]).format(put(prose(3, 50), False))
                return some(["section comments", "div comments", "div comment-list", "ol comments", "div disqus responses"],
                            rnd.choice(["", f"<h3>{put(short(), False)}</h3>"]) + "".join(one() for _ in range(rnd.randint(1, 6))))
            if kind == "share":
                return some(["div share", "div social", "ul share-buttons"], "".join(link() for _ in range(3)))
            return some(["footer", "footer", "footer site-footer", "div footer", "div copyright footer"],
                        rnd.choice([put("&copy; " + short() + ".example &middot; " + prose(3, 20), False), par(), link() + par()]))

        def article():
            parts = []
            if rnd.random() < 0.85:
                parts.append(f"<h1>{put(prose(2, 12), True)}</h1>")
            for _ in range(rnd.choice([1, 2, 3, 4, 6, 8, 15, 30])):
                k = rnd.random()
                text = put(prose(1, 6) if rnd.random() < 0.1 else prose(), True)
                if k < 0.72:
                    parts.append(f"<p>{text}</p>")
                elif k < 0.82:
                    parts.append(f"<p><b>{text}<br>")
                elif k < 0.87:
                    parts.append(f"<h2>{text}</h2>")
                elif k < 0.92:
                    parts.append(f"<ul><li>{text}</li><li>{put(prose(2, 10), True)}</li></ul>")
                elif k < 0.95:
                    parts.append(f"<blockquote>{text}</blockquote>")
                elif k < 0.97:
                    parts.append(f"<table><tr><td>{text}</td><td>{put(short(), True)}</td></tr></table>")
                else:
                    parts.append(f"<pre>{text}</pre>")
                if rnd.random() < 0.06:
                    parts.append(boiler(rnd.choice(["ad", "share", "notice"])))
            body = "".join(parts)
            return some(["article", "article", "article", "article post", "main", "div content", "div post", "div post-content entry", "div article-body",
                         "section content", "div main", "div story", "div entry-content", "div"], body)

        before = [menu()] * (rnd.random() < 0.9) + [boiler(k) for k in ("header", "notice", "ad", "form", "sidebar") if rnd.random() < 0.35]
        rnd.shuffle(before)
        after = [boiler(k) for k in ("share", "comments", "sidebar", "ad", "form", "notice") if rnd.random() < 0.3]
        rnd.shuffle(after)
        middle = article()
        if rnd.random() < 0.2:
            middle = some(["main", "div wrapper", "div container", "div page"], middle + "".join(after))
            after = []
        foot = [boiler("footer")] if rnd.random() < 0.9 else []
        page = (f'<!DOCTYPE html><html><head><title>{prose(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
                + "".join([*before, middle, *after, *foot]) + rnd.choice(["</body></html>", ""]))
        pages.append((page, labels))
    return pages


def labelled(pages) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for page, labels in pages:
        blocks = [b for b in leaf_blocks(page)]
        if blocks:
            out.append((vectors(blocks), np.array([labels.get(b.text, False) for b in blocks], np.float32)))
    return out


def train(pages: int = 700, epochs: int = 14, batch: int = 25, rate: float = 0.01, seed: int = 1) -> Labeller:
    model, rows, rnd = Labeller(), labelled(training_pages(pages, seed)), np.random.default_rng(seed)
    weights = [*model.w, model.out]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        lr = rate * (0.5 ** (epoch // 5))
        order = rnd.permutation(len(rows))
        order = sorted(order, key=lambda i: len(rows[i][0]) // 8)  # pages of like length share a batch
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for g in rnd.permutation(len(groups)):
            x, mask = padded([rows[i][0] for i in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(groups[g]):
                y[:len(rows[i][1]), k] = rows[i][1]
            _, grads = model.gradients(x, mask, y)
            norm = max(1.0, float(np.sqrt(sum((d * d).sum() for d in grads))))
            step += 1
            for k, (w, d) in enumerate(zip(weights, grads)):
                d = d / norm
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def trained() -> Labeller:
    return train()


# ------------------------------------------------------------------ Spark

def extract_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row: page_id, url, text (main blocks joined by newlines), n_chars (code points)."""
    spark = pages.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(model or trained())  # about 100 KB, whatever the table

    def extract(batches):
        for batch in batches:
            texts = weights.value.main_text(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
