"""Document quality from a linear-chain CRF over lines (dealt operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import adam, labelled_sample
from .tables import stored
from .text import BLANKS, mix, pieces, string_bytes, word_hashes, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>~^_=+\\{}[]@")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = True  # ASCII letters and leading bytes
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True
# Cuts that turn a share into steps; the same for every share.
_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SHARES = ("symbols", "upper", "digits", "loud", "repeated", "stutter", "pairs", "seen", "long")


def line_features(piece: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of every line (line, len(SHARES) + 2), byte lengths, and the first line of each text."""
    data, offsets = string_bytes(piece)
    breaks = np.flatnonzero(data == 0x0A)
    text = np.concatenate([np.arange(len(piece)), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), text))
    start = np.concatenate([offsets[:-1], breaks + 1])[order]
    text = text[order]
    first = np.searchsorted(text, np.arange(len(piece) + 1))
    end = np.append(start[1:] - 1, 0)
    end[first[1:] - 1] = offsets[1:]
    w_start, w_end, _ = words(data, offsets, BLANKS)
    w_first = np.searchsorted(w_start, np.append(start, len(data)))
    # the lines of a text are in order of their bytes, and so are their words
    line = np.repeat(np.arange(len(start)), np.diff(w_first))
    n = np.maximum(np.diff(w_first), 1)
    h = word_hashes(data, w_start, w_end)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[end] - total[start]

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line, mask, len(start)) / n

    def again(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """True where a value stood earlier in the same group."""
        by = np.lexsort((values, of))
        same = np.zeros(len(values), bool)
        same[by[1:]] = (values[by[1:]] == values[by[:-1]]) & (of[by[1:]] == of[by[:-1]])
        return same

    pair = np.concatenate([[0], mix(h[:-1] * np.uint64(31) + h[1:])]).astype(np.uint64) if len(h) else h
    inner = np.concatenate([[False], line[1:] == line[:-1]]) if len(h) else np.zeros(0, bool)
    stutter = np.concatenate([[False], h[1:] == h[:-1]]) & inner if len(h) else inner
    letters = np.maximum(bytes_in(_LETTER), 1)
    shares = [
        np.minimum(bytes_in(_SYMBOLS) / n, 1),
        bytes_in(_UPPER) / letters,
        bytes_in(_DIGIT) / np.maximum(end - start, 1),
        np.minimum(bytes_in(_LOUD) / n, 1),
        per_line(again(h, line)),
        per_line(stutter),
        per_line(again(pair, line) & inner),
        per_line(again(h, text[line])),
        per_line(w_end - w_start > 25),
    ]
    size = np.log1p(np.diff(w_first))
    mean = bytes_in(~BLANKS) / n / 20
    return np.stack([*shares, size / 5, np.minimum(mean, 3)], 1).astype(np.float32), end - start, first


def observations(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Stepped features of each line beside those of the lines before and after it in its text."""
    k = len(SHARES)
    own = np.concatenate([(raw[:, :k, None] > _STEPS).reshape(len(raw), -1), raw[:, k:]], 1).astype(np.float32)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    after = np.zeros_like(own)
    after[:-1] = own[1:]
    edge = np.zeros((len(own), 2), np.float32)
    edge[first[:-1], 0] = 1
    edge[first[1:] - 1, 1] = 1
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([own, before, after, edge, np.ones((len(own), 1), np.float32)], 1)


def forward_backward(
    emit: np.ndarray, turn: np.ndarray, first: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all texts' chains at once.

    ``emit``: scores (line, 2), ``turn``: transition scores (2, 2), ``first``: bounds of the texts.
    Returns the marginals (line, 2), pair marginals (2, 2) summed over the texts with their ``weights``, and
    the log partition of each text. Texts step
    together, the longest first, so position t touches only texts that long.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = first[:-1][order], sizes[order]
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t lines
    for t in range(longest):
        at = start[: live[t]] + t
        alpha[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(alpha[at - 1, :1] + turn[0], alpha[at - 1, 1:] + turn[1])
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        onward = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(turn[:, 0] + onward[:, :1], turn[:, 1] + onward[:, 1:])
    whole = np.logaddexp(*alpha[first[1:] - 1].T)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    marginal = np.exp(alpha + beta - whole[owner, None])
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + turn + (emit[at] + beta[at])[:, None, :] - whole[owner[at], None, None])
    scale = np.ones(len(first) - 1) if weights is None else weights
    return marginal, np.einsum("nij,n->ij", pair, scale[owner[at]]), whole


@dataclass(frozen=True)
class QualityModel:
    """Weights of the observations for the state good, and the scores of the turns (bad, good)."""

    weights: np.ndarray
    turn: np.ndarray

    def _emit(self, x: np.ndarray) -> np.ndarray:
        good = (x @ self.weights.astype(np.float32)).astype(float)
        return np.stack([-good, good], 1) / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        raw, size, first = line_features(texts)
        marginal, _, _ = forward_backward(self._emit(observations(raw, first)), self.turn, first)
        weight = size + 1.0  # a line break counts, so that empty lines weigh something
        total = np.concatenate([[0.0], np.cumsum(weight * marginal[:, 1])])
        length = np.concatenate([[0.0], np.cumsum(weight)])
        share = (total[first[1:]] - total[first[:-1]]) / (length[first[1:]] - length[first[:-1]])
        return np.clip(share, 0.0, 1.0)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            raw, _, first = line_features(piece.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first * raw.shape[1], pa.int32()), pa.array(raw.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([piece.column("label"), lists], names=["label", "lines"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
) -> QualityModel:
    """Learn from about ``per_class`` labelled texts of each class (drawn by a hash of the id).

    Every line takes its document's label; the conditional likelihood of the label chains is maximised
    with a quadratic penalty. Features are computed in Spark; the driver holds a dozen
    numbers a line of the sample. With one class only, or none, every document scores by the
    share of good labels (a half without labels).
    """
    sample = stored(labelled_sample(docs, labels, label, per_class, "quality", doc_id, text), "quality-sample")
    rows = sample.mapInArrow(_raw, "label int, lines array<float>").toArrow().combine_chunks()
    y = rows["label"].to_numpy()
    width = len(SHARES) + 2
    lists = rows["lines"].combine_chunks() if len(y) else pa.array([], pa.list_(pa.float32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy() // width)]).astype(np.int64)
    x = observations(lists.flatten().to_numpy().reshape(-1, width), first) if len(y) else np.zeros((0, 3 * (len(SHARES) * len(_STEPS) + 2) + 3), np.float32)
    if not (0 < y.sum() < len(y)):
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.zeros(x.shape[1])
        weights[-1] = np.log(share / (1 - share))
        return QualityModel(weights, np.zeros((2, 2)))
    state = np.repeat(y, np.diff(first))
    truth = np.stack([1 - state, state], 1).astype(float)
    # each class weighs half, each text of a class the same
    per_text = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    turns = np.zeros((2, 2))
    for s in (0, 1):
        turns[s, s] = (np.maximum(np.diff(first) - 1, 0) * per_text)[y == s].sum()

    def gradient(p: np.ndarray) -> np.ndarray:
        model = QualityModel(p[:-4], p[-4:].reshape(2, 2))
        marginal, pair, _ = forward_backward(model._emit(x), model.turn, first, per_text)
        miss = (marginal - truth) * np.repeat(per_text, np.diff(first))[:, None]
        slope = ((miss[:, 1] - miss[:, 0]) / 2).astype(np.float32) @ x  # in the features' own precision: no copy of them
        return np.concatenate([slope + 1e-4 * p[:-4], (pair - turns).ravel() + 1e-2 * p[-4:]])

    p = adam(gradient, np.zeros(x.shape[1] + 4), 150, 0.1)
    return QualityModel(p[:-4], p[-4:].reshape(2, 2))


def score(model: QualityModel, text: Column) -> Column:
    """Length-weighted share of good line marginals; null and empty texts are one empty line."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        cut = pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
        parts = [model.score(p.column("text")) for p in cut]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.7, text: str = "text") -> DataFrame:
    """The documents that score at least ``least``, with their own columns."""
    return docs.withColumn("__score", score(model, F.col(text))).filter(F.col("__score") >= least).select(*docs.columns)
