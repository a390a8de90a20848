"""Main text of web pages from a recurrent block labeller (dealt operator 13)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import adam, sigmoid
from .tables import stored
from .text import BLANKS, LOWER, pieces, row_sums, string_bytes, word_hashes, words

# Fixed values of the HTML standard: elements that stand inside a line, that have no content, and whose
# content is no text of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br input".split()
)
VOID = frozenset("area base col embed hr link meta param source track".split())
HIDDEN = "script|style|title|textarea|select|template|svg|iframe|noscript|noframes|canvas"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*>?",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

PATH, WORDS, HIDDEN_UNITS, BUCKETS = 64, 16, 16, 4096
NUMBERS = 9
WIDTH = PATH + WORDS + NUMBERS
_WORD = (np.random.default_rng(13).standard_normal((BUCKETS, WORDS)) / 2).astype(np.float32)
PADDED = 100_000  # blocks of padded pages that are read together

# Names that pages give to their regions, for training pages of other make (see ``_variant``).
CONTENT_NAMES = "article content post entry story body text main".split()
REGIONS = {
    "nav": "nav menu navbar navigation breadcrumb links".split(),
    "header": "header masthead banner top branding".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related trending".split(),
    "ad": "ad ads advert sponsor promo".split(),
    "notice": "cookie notice consent alert popup modal".split(),
    "form": "form newsletter subscribe login search signup".split(),
    "comments": "comments comment reply discussion respond".split(),
}
_CONTENT = frozenset(["article", "main"])
_OUTSIDE = frozenset([*REGIONS, *(n for names in REGIONS.values() for n in names)])


def leaf_blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of characters in links) of every block with text, in page order.

    A path lists the names of the enclosing elements and the words of their class, id and role. Elements
    left open end where the standard or their parent ends them.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked = [0, 0]  # characters in links, open links
    at = 0

    def add(raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            run.append(raw)
            linked[0] += len(raw) if linked[1] else 0

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                path = tuple(x for _, names in stack for x in names)
                out.append((path, text, min(linked[0] / len(text), 1.0)))
            run.clear()
        linked[0] = 0

    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:  # a comment, a declaration, or an element that holds no text of the page
            continue
        tag = tag.lower()
        closing = bool(token[2])
        if tag in INLINE:
            if tag == "a":
                linked[1] = 0 if closing else 1
            elif tag in ("br", "wbr", "img") and not closing:
                run.append(" " if tag == "br" else "")
            continue
        flush()
        linked[1] = 0
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag not in VOID:
            while stack and stack[-1][0] in ("p", *(_SAME.get(tag, ()))):
                stack.pop()
            names = [tag]
            for found in _NAMES.findall(token[4] or ""):
                names += [x.lower() for x in _PARTS.findall("".join(found))]
            stack.append((tag, tuple(names)))
    add(html[at:])
    flush()
    return out


# Elements that a sibling of the same kind ends.
_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody"),
    "body": ("head",),
}


def text_vectors(texts: list[str], links: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean hashed-word vector and plain measures of every block (block, WORDS + NUMBERS).

    ``bounds``: first block of every page.
    """
    data, offsets = string_bytes(pa.array(texts, pa.large_string()))
    starts, ends, first = words(data, offsets, BLANKS)
    bucket = (word_hashes(LOWER[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    n = np.diff(first)
    out = np.empty((len(texts), WORDS + NUMBERS), np.float32)
    for d in range(WORDS):  # one number a word at a time
        out[:, d] = row_sums(_WORD[bucket, d].astype(float), first) / np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    last = data[offsets[1:] - 1] if len(texts) else data
    sizes = np.diff(bounds)
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(texts)) - bounds[page]
    whole = np.bincount(page, n, len(sizes))
    numbers = [
        np.log1p(n) / 5,
        np.minimum(np.diff(offsets) / np.maximum(n, 1) / 10, 2),
        links,
        np.isin(last, list(b".!?")),
        share((data >= 0x30) & (data < 0x3A)),
        share((data >= 0x41) & (data < 0x5B)),
        np.exp(-place / 5),
        np.exp(-(sizes[page] - 1 - place) / 5),
        n / np.maximum(whole[page], 1),
    ]
    out[:, WORDS:] = np.stack(numbers, 1)
    return out


_NAME_VECTORS: dict[str, np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Sum of the names' hashed vectors; inner names weigh more."""
    out = np.zeros(PATH, np.float32)
    for i, name in enumerate(reversed(path)):
        if name not in _NAME_VECTORS:
            if len(_NAME_VECTORS) > 100_000:
                _NAME_VECTORS.clear()
            seed = zlib.crc32(name.encode("utf-8", "replace"))
            _NAME_VECTORS[name] = (np.random.default_rng(seed).standard_normal(PATH) / np.sqrt(PATH) * 2).astype(np.float32)
        out += _NAME_VECTORS[name] / (1 + 0.15 * i)
    return out


def path_vectors(paths: list[tuple[str, ...]]) -> np.ndarray:
    known: dict[tuple[str, ...], int] = {}
    index = np.fromiter((known.setdefault(p, len(known)) for p in paths), np.int64, len(paths))
    table = np.stack([path_vector(p) for p in known]) if known else np.zeros((0, PATH), np.float32)
    return table[index]


def _shapes() -> list[tuple[int, ...]]:
    one = [(WIDTH, 4 * HIDDEN_UNITS), (HIDDEN_UNITS, 4 * HIDDEN_UNITS), (4 * HIDDEN_UNITS,)]
    return [*one, *one, (2 * HIDDEN_UNITS,), (1,)]


def _split(flat: np.ndarray) -> list[np.ndarray]:
    sizes = [int(np.prod(s)) for s in _shapes()]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    return [p.reshape(s) for p, s in zip(parts, _shapes())]


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple:
    """States (time, page, unit) of one direction, and what its gradient needs."""
    t, n, _ = x.shape
    u = HIDDEN_UNITS
    gates = x @ wx + b
    h = np.zeros((t + 1, n, u), x.dtype)
    c = np.zeros((t + 1, n, u), x.dtype)
    for k in range(t):
        g = gates[k] + h[k] @ wh
        g[:, : 3 * u] = sigmoid(g[:, : 3 * u])
        g[:, 3 * u :] = np.tanh(g[:, 3 * u :])
        gates[k] = g
        c[k + 1] = g[:, u : 2 * u] * c[k] + g[:, :u] * g[:, 3 * u :]
        h[k + 1] = g[:, 2 * u : 3 * u] * np.tanh(c[k + 1])
    return h, c, gates


def _lstm_gradient(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, run: tuple, dh: np.ndarray) -> list[np.ndarray]:
    h, c, gates = run
    u = HIDDEN_UNITS
    d = np.zeros_like(gates)
    carry_h, carry_c = np.zeros_like(h[0]), np.zeros_like(c[0])
    for k in range(len(x) - 1, -1, -1):
        i, f, o, g = (gates[k][:, j * u : (j + 1) * u] for j in range(4))
        top = dh[k] + carry_h
        bent = np.tanh(c[k + 1])
        dc = carry_c + top * o * (1 - bent**2)
        d[k] = np.concatenate([dc * g * i * (1 - i), dc * c[k] * f * (1 - f), top * bent * o * (1 - o), dc * i * (1 - g**2)], 1)
        carry_h, carry_c = d[k] @ wh.T, dc * f
    return [np.einsum("tnd,tng->dg", x, d), np.einsum("tnu,tng->ug", h[:-1], d), d.sum((0, 1))]


def _padded(sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pages' blocks (time, page), the same in reverse order of each page, and which are real."""
    step = np.arange(sizes.max())[:, None]
    real = step < sizes
    forth = np.where(real, bounds + step, bounds)
    back = np.where(real, bounds + sizes - 1 - step, bounds)
    return forth, back, real


@dataclass(frozen=True)
class BlockModel:
    """Weights of both directions and of the output; without weights every block is text."""

    weights: np.ndarray | None

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability that a block is main text, from all blocks of its page. ``bounds``: first block of every page."""
        if self.weights is None:
            return np.ones(len(x))
        wx1, wh1, b1, wx2, wh2, b2, w, b = (p.astype(np.float32) for p in _split(self.weights))
        out = np.zeros(len(x))
        sizes = np.diff(bounds)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        start = 0
        while start < len(order):
            # pages of like length are read together
            room = sizes[order[start:]] * np.arange(1, len(order) - start + 1)
            stop = start + max(int(np.searchsorted(room, PADDED, "right")), 1)
            mine = order[start:stop]
            forth, back, real = _padded(sizes[mine], bounds[mine])
            ahead = _lstm(x[forth], wx1, wh1, b1)[0][1:] @ w[:HIDDEN_UNITS] + b[0]
            out[forth[real]] = ahead[real]
            behind = _lstm(x[back], wx2, wh2, b2)[0][1:] @ w[HIDDEN_UNITS:]
            out[back[real]] += behind[real]
            start = stop
        return sigmoid(out)


def marked(path: tuple[str, ...]) -> bool:
    """True for a path inside an article or main element and in no element of another use within it."""
    inner = next((i for i, x in enumerate(path) if x in _CONTENT), None)
    return inner is not None and not _OUTSIDE.intersection(path[inner:])


def _variant(rng: np.random.Generator, page: tuple, pool: dict[str, list]) -> tuple[list, np.ndarray, np.ndarray]:
    """A training page: as it is, or in other markup, with regions of other pages around and after its text.

    Marked pages name their article plainly, and a model of them alone would read the name only. So some pages
    get other element names, lose names, or gain menus, notices, forms and comments.
    """
    paths, x, y = page
    blocks = [(p, v, label) for p, v, label in zip(paths, x, y)]
    kind = rng.random()
    if kind < 0.4:  # other names, the same for a region of the page
        name = CONTENT_NAMES[rng.integers(len(CONTENT_NAMES))]
        renamed = {k: ("div", v[rng.integers(len(v))]) for k, v in REGIONS.items()}
        plain = rng.random() < 0.3

        def other(p: tuple[str, ...], label: float) -> tuple[str, ...]:
            q: list[str] = []
            for e in p:
                if e in _CONTENT and label:
                    q += ["div"] if plain else ["div", name]
                elif not label and e in renamed:
                    q += renamed[e]
                else:
                    q.append(e)
            return tuple(q)

        blocks = [(other(p, label), v, label) for p, v, label in blocks]
    elif kind < 0.6:
        blocks = [(tuple(e for e in p if rng.random() < 0.6), v, label) for p, v, label in blocks]
    text = [i for i, b in enumerate(blocks) if b[2]]
    first, last = (text[0], text[-1] + 1) if text else (0, len(blocks))
    if rng.random() < 0.6:
        for region in rng.permutation(list(REGIONS))[: rng.integers(1, 4)]:
            names = REGIONS[region]
            outer = (region,) if rng.random() < 0.4 and region in ("nav", "header", "footer", "aside", "form") else ("div", names[rng.integers(len(names))])
            source = pool["text" if region == "comments" or rng.random() < 0.25 else "rest"]
            if not source:
                continue
            inner = [("p",), ("ul", "li"), ("div",)][rng.integers(3)]
            more = [(("html", "body", *outer, *inner), source[rng.integers(len(source))], 0.0) for _ in range(rng.integers(1, 7))]
            where = first if region in ("header", "notice", "nav") else last
            blocks[where:where] = more
            first, last = (first, last) if where == last else (first + len(more), last + len(more))
    paths = [b[0] for b in blocks]
    return paths, np.stack([b[1] for b in blocks]), np.array([b[2] for b in blocks])


def _raw(most_blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for html in batch.column("html").to_pylist():
            blocks = leaf_blocks(html)
            if 0 < len(blocks) <= most_blocks and any(marked(b[0]) for b in blocks):
                x = text_vectors([b[1] for b in blocks], np.array([b[2] for b in blocks]), np.array([0, len(blocks)]))
                columns = [pa.array([["\t".join(b[0]) for b in blocks]]), pa.array([x.ravel().tolist()], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["paths", "x"])


def train(pages: DataFrame, sample: int = 300, most_blocks: int = 400, steps: int = 300, page_id: str = "page_id", html: str = "html") -> BlockModel:
    """Learn from pages that mark their text by an article or main element.

    At most ``sample`` pages, drawn by a hash, of at most ``most_blocks`` blocks are read for training; the driver
    holds 25 numbers a block of these. Without a marked page among them every block counts as text.
    """
    draw = F.xxhash64(F.col(page_id), F.col(html), F.lit("blocks"))
    drawn = pages.filter(F.col(html).isNotNull()).select(draw.alias("draw")).distinct().orderBy("draw").limit(sample)
    chosen = pages.select(draw.alias("draw"), F.col(html).alias("html")).join(F.broadcast(drawn), "draw", "left_semi")
    chosen = chosen.dropDuplicates(["draw"])
    rows = stored(chosen.mapInArrow(lambda it: _raw(most_blocks, it), "paths array<string>, x array<float>"), "blocks").collect()
    found = []
    for r in sorted(rows, key=lambda r: (len(r["x"]), r["x"])):
        paths = [tuple(p.split("\t")) if p else () for p in r["paths"]]
        x = np.array(r["x"], np.float32).reshape(len(paths), -1)
        found.append((paths, x, np.array([float(marked(p)) for p in paths])))
    if not found:
        return BlockModel(None)
    pool = {"text": [v for _, x, y in found for v, label in zip(x, y) if label], "rest": [v for _, x, y in found for v, label in zip(x, y) if not label]}
    rng = np.random.default_rng(13)
    start = np.concatenate([rng.standard_normal(int(np.prod(s))) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(int(np.prod(s))) for s in _shapes()])

    def gradient(flat: np.ndarray) -> np.ndarray:
        drawn = [_variant(rng, found[i], pool) for i in rng.integers(len(found), size=24)]
        # the shorter half of a draw is not padded to the longest page
        drawn = sorted(drawn, key=lambda p: len(p[0]))
        total = np.zeros(len(flat))
        for part in (drawn[:16], drawn[16:]):
            total += _slope(flat, part) / len(drawn)
        return total + 1e-5 * flat

    return BlockModel(adam(gradient, start, steps, 0.02))


def _slope(flat: np.ndarray, part: list[tuple]) -> np.ndarray:
    """Gradient of the log loss, every page weighing the same."""
    wx1, wh1, b1, wx2, wh2, b2, w, b = _split(flat)
    sizes = np.array([len(p[0]) for p in part])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate([np.concatenate([path_vectors(p[0]), p[1]], 1) for p in part]).astype(float)
    y = np.concatenate([p[2] for p in part])
    weight = np.repeat(1 / sizes, sizes)
    forth, back, real = _padded(sizes, bounds[:-1])
    x1, x2 = x[forth], x[back]
    run1, run2 = _lstm(x1, wx1, wh1, b1), _lstm(x2, wx2, wh2, b2)
    h1, h2 = run1[0][1:], run2[0][1:]
    states = np.zeros((len(x), 2 * HIDDEN_UNITS))
    states[forth[real], :HIDDEN_UNITS] = h1[real]
    states[back[real], HIDDEN_UNITS:] = h2[real]
    miss = (sigmoid(states @ w + b[0]) - y) * weight
    d1 = np.where(real, miss[forth], 0)[:, :, None] * w[:HIDDEN_UNITS]
    d2 = np.where(real, miss[back], 0)[:, :, None] * w[HIDDEN_UNITS:]
    parts = [*_lstm_gradient(x1, wx1, wh1, run1, d1), *_lstm_gradient(x2, wx2, wh2, run2, d2), states.T @ miss, [miss.sum()]]
    return np.concatenate([np.ravel(p) for p in parts])


def label_blocks(pages: DataFrame, model: BlockModel, html: str = "html", name: str = "blocks") -> DataFrame:
    """All columns of the pages and ``name``: array of (path, text, score) of every leaf block, in page order.

    A null or empty page, and a page without text, has no block. Rows are independent: repeated pages are
    labelled alike.
    """

    def labelled(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("score", pa.float64())]))
        out = [pa.array([], kind)]
        for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["html"]), "html"):
            found = [leaf_blocks(h or "") for h in piece.column("html").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            blocks = [b for f in found for b in f]
            own = [b[1] for b in blocks]
            x = np.concatenate([path_vectors([b[0] for b in blocks]), text_vectors(own, np.array([b[2] for b in blocks]), bounds)], 1)
            fields = [pa.array(["/".join(b[0]) for b in blocks], pa.string()), pa.array(own, pa.string()), pa.array(model.score(x, bounds))]
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["path", "text", "score"])).cast(kind))
        return pa.concat_arrays(out)

    udf = F.arrow_udf(labelled, "array<struct<path: string, text: string, score: double>>")
    return pages.withColumn(name, udf(F.col(html)))


def extract(pages: DataFrame, model: BlockModel, least: float = 0.5, html: str = "html") -> DataFrame:
    """All columns of the pages and ``main_text``: the blocks that score at least ``least``, joined by an empty line.

    Empty where no block is text; nothing is cut. A column of that name is replaced.
    """
    rows = label_blocks(pages, model, html, "__blocks")
    kept = F.filter("__blocks", lambda b: b["score"] >= least)
    return rows.withColumn("main_text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")).drop("__blocks")
