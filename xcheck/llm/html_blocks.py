"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks (text between block-level tags) in page order.
Each block has a vector: hashed tag path (names, classes and ids of the open
elements), hashed words, and a few ratios. A bidirectional LSTM in numpy reads
the whole sequence of vectors, so every block is labelled with the context of
all others; blocks labelled main are the text.

The network is trained here, on a bounded sample of pages (``SAMPLE``). Its
teacher is the markup of pages that say where their article is (article, main or
role=main): blocks inside are main unless they lie in a nested part that is no
article text (navigation, footers, asides, forms, adverts, notices, comments).
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_results
from .words import SPACES, byte_class, scan, utf8

SAMPLE = 240            # pages the network is trained on, about
PATH, WORD, MORE = 96, 48, 6
INPUT = PATH + WORD + MORE
HIDDEN = 12
EPOCHS = 14
TRAIN_BLOCKS = 160      # blocks of a training page that are read (prediction reads all)
CELLS = 40_000          # blocks, padding included, in a batch of pages

# Fixed values of HTML: elements that do not start a block, that hold no text, and that have no end
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements that an opening tag of the same kind ends
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table article section main aside nav header footer form body div".split())

ASIDE = frozenset("nav footer aside form button dialog menu".split())
ASIDE_WORD = re.compile(r"(^|[-_\s])(ad|ads|advert\w*|promo\w*|sponsor\w*|banner|nav\w*|menu|sidebar|side|footer|cookie\w*|notice|consent|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comment\w*|repl(y|ies)|discussion|breadcrumbs?|toolbar|login|signup|pagination|pager)($|[-_\s])", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASSES = byte_class(SPACES, True)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text, path, linked):
        self.text, self.path, self.linked = text, path, linked


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page with their open elements, as (tag, attribute words)."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def add(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw)

    def end():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
            parts.clear()
        linked = 0

    size, pos = len(page), 0
    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos:m.start()])
        pos = max(m.end(), m.start() + 1)
        tag = m.group(1)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                add(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag, closing = tag.lower(), m.group().startswith("</")
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if tag in RAW and not closing:
            end()
            if not m.group().endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = close.end() if close else size if tag in ("script", "style", "textarea", "title") else pos
            continue
        end()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ends = CLOSES.get(tag)
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k][0]
            if (ends and name in ends) or (name == "p" and tag not in ("p",)):
                del stack[k:]
                break
            if name in HOLDERS:
                break
        if tag not in VOID and not m.group().endswith("/>"):
            words = " ".join((x[1] or x[2] or x[3]) for x in _ATTRIBUTE.findall(m.group(2))) if m.group(2) else ""
            stack.append((tag, words))
    end()
    return out


def teacher(blocks: list[Block]) -> list[int] | None:
    """1 for main blocks, where the markup says so; None for pages that do not."""
    out, marked = [], False
    for b in blocks:
        main = aside = False
        for tag, words in b.path:
            if tag in ("article", "main") or "main" in words.split():
                main = True
            if tag in ASIDE or ASIDE_WORD.search(words):
                aside = True
        marked |= main
        out.append(1 if main and not aside else 0)
    return out if marked else None


_PATHS: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for depth, (tag, words) in enumerate(path):
            for item in [f"t:{tag}", *[f"c:{w.lower()}" for w in re.split(r"[\s_-]+", words) if w]]:
                h = zlib.crc32(item.encode())
                v[h % PATH] += 1.0 if (h >> 16) & 1 else -1.0
            if depth == len(path) - 1:
                h = zlib.crc32(f"leaf:{tag}".encode())
                v[h % PATH] += 1.0 if (h >> 16) & 1 else -1.0
        np.clip(v, -2, 2, out=v)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = v
    return v


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """Block vectors of each page."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, INPUT), np.float32) for _ in pages]
    x = np.zeros((len(flat), INPUT), np.float32)
    for k, b in enumerate(flat):
        x[k, :PATH] = _path_vector(b.path)
    data, off = utf8(pa.array([b.text for b in flat], pa.large_string()))
    w = scan(data, off, _CLASSES)
    n = np.diff(w.first)
    row = np.repeat(np.arange(len(flat)), n)
    slot = (w.hash % np.uint64(WORD)).astype(np.int64)
    sign = np.where((w.hash >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(row * WORD + slot, sign, len(flat) * WORD).reshape(len(flat), WORD)
    x[:, PATH:PATH + WORD] = v / np.maximum(1, np.sqrt((v * v).sum(axis=1)))[:, None]
    chars = np.diff(off)
    m = x[:, PATH + WORD:]
    m[:, 0] = np.log1p(n) / 4
    m[:, 1] = [min(1.0, b.linked / max(1, len(b.text))) for b in flat]
    m[:, 2] = [len(b.path) / 8 for b in flat]
    m[:, 3] = np.minimum(chars / np.maximum(n, 1) / 10, 2)
    m[:, 4] = [b.text[-1] in ".!?:;" for b in flat]
    out, at = [], 0
    for p in pages:
        y = x[at:at + len(p)]
        y[:, INPUT - 1] = np.linspace(0, 1, len(p)) if len(p) else 0
        out.append(y)
        at += len(p)
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = g.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            self.p["U" + d] = g.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["V"] = g.normal(0, 0.1, 2 * HIDDEN)
        self.p["S"] = np.zeros(INPUT)
        self.p["c"] = np.zeros(1)

    def _run(self, x, mask, d, keep):
        pages, steps, _ = x.shape
        z = x @ self.p["W" + d] + self.p["b" + d]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, tape = np.zeros((pages, steps, HIDDEN)), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            a = z[:, t] + h @ self.p["U" + d]
            i, f, o = (_sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN:])
            on = mask[:, t, None]
            c2 = on * (f * c + i * g) + (1 - on) * c
            e = np.tanh(c2)
            h2 = on * (o * e) + (1 - on) * h
            if keep:
                tape.append((t, i, f, o, g, c, e, h, on))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def logits(self, x, mask, keep=False):
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(x, mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["V"] + x @ self.p["S"] + self.p["c"], (h, tf, tb)

    def gradients(self, x, mask, y):
        z, (h, tf, tb) = self.logits(x, mask, True)
        dz = (_sigmoid(z) - y) * mask / mask.sum()
        grad = {"V": np.einsum("pt,pth->h", dz, h), "S": np.einsum("pt,pti->i", dz, x), "c": np.array([dz.sum()])}
        for d, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            du, da_all = np.zeros_like(self.p["U" + d]), np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, i, f, o, g, c, e, h0, on in reversed(tape):
                dh = dh + dz[:, t, None] * self.p["V"][part]
                through, dh_on = dh * (1 - on), dh * on
                dct = dc * on + dh_on * o * (1 - e * e)
                da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh_on * e * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                da_all[:, t] = da
                du += h0.T @ da
                dh = da @ self.p["U" + d].T + through
                dc = dct * f + dc * (1 - on)
            grad["U" + d], grad["b" + d] = du, da_all.sum(axis=(0, 1))
            grad["W" + d] = np.einsum("pti,pta->ia", x, da_all)
        return grad

    def fit(self, xs, ys, epochs: int = EPOCHS, seed: int = 5):
        """Adam over batches of pages of like length."""
        g, step = np.random.default_rng(seed), 0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(xs)), key=lambda k: len(xs[k]))
        batches = [order[k:k + 16] for k in range(0, len(order), 16)]
        for _ in range(epochs):
            for b in g.permutation(len(batches)):
                x, mask, y = _padded([xs[k] for k in batches[b]], [ys[k] for k in batches[b]])
                # a block's place and path decide more than its words: these are left out at random
                x[:, :, PATH:] *= g.random((*x.shape[:2], 1)) > 0.5
                step += 1
                for k, v in self.gradients(x, mask, y).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= 0.02 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def label(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Main or not, for every block of every page."""
        out: list = [np.zeros(0, bool)] * len(xs)
        order = [k for k in sorted(range(len(xs)), key=lambda k: len(xs[k])) if len(xs[k])]
        while order:
            longest, take = len(xs[order[-1]]), 1
            take = max(1, min(len(order), CELLS // longest))
            some, order = order[-take:], order[:-take]
            x, mask, _ = _padded([xs[k] for k in some])
            z, _ = self.logits(x, mask)
            for r, k in enumerate(some):
                out[k] = z[r, :len(xs[k])] > 0
        return out


def _padded(xs, ys=None):
    steps = max(len(x) for x in xs)
    x, mask, y = np.zeros((len(xs), steps, INPUT)), np.zeros((len(xs), steps)), np.zeros((len(xs), steps))
    for k, v in enumerate(xs):
        x[k, :len(v)], mask[k, :len(v)] = v, 1
        if ys is not None:
            y[k, :len(v)] = ys[k]
    return x, mask, y


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Labeller | None:
    """Fit on about ``sample`` pages, chosen by hash; their vectors and labels are
    made in the tasks. None if no sampled page marks its article."""
    some = pages.select(F.col(html_col).alias("html")).filter("html is not null")
    total = some.count()
    some = some.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30)))

    def run(batches):
        for b in batches:
            xs, ys = [], []
            for page in b.column(0).to_pylist():
                blocks = blocks_of(page)
                y = teacher(blocks)
                if y:
                    xs.append(vectors([blocks])[0][:TRAIN_BLOCKS].tobytes())
                    ys.append(bytes(y[:TRAIN_BLOCKS]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    got = some.mapInArrow(run, "x binary, y binary").orderBy("x").limit(2 * sample).toArrow()
    if not got.num_rows:
        return None
    xs = [np.frombuffer(v, np.float32).reshape(-1, INPUT).astype(float) for v in got["x"].to_pylist()]
    ys = [np.frombuffer(v, np.uint8).astype(float) for v in got["y"].to_pylist()]
    return Labeller().fit(xs, ys)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_name: str = "text", model: Labeller | None = None) -> DataFrame:
    """All columns of ``pages`` plus ``text_name`` and ``__n_blocks``.

    The main blocks in page order, joined by an empty line: character references
    decoded, white space inside a block one space, nothing capped. Null, empty
    and block-less pages: the empty text. Without a trainable sample no block is
    main. Rows are independent, repeated rows get equal texts; the new names must
    be free."""
    if model is None:
        model = train(pages, html_col)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def compute(column):
        texts = column.to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1_000_000):
                size += len(texts[hi] or "")
                hi += 1
            blocks = [blocks_of(t) for t in texts[lo:hi]]
            main = sent.value.label(vectors(blocks)) if sent.value else [np.zeros(len(b), bool) for b in blocks]
            found = ["\n\n".join([x.text for x, keep in zip(b, m) if keep]) for b, m in zip(blocks, main)]
            yield lo, hi, [pa.array(found, pa.string()), pa.array([len(b) for b in blocks], pa.int64())]
            lo = hi

    return with_results(pages, html_col, compute, [(text_name, "string"), ("__n_blocks", "long")])
