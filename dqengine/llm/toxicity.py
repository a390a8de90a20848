"""Toxicity by a linear classifier on n-grams scaled by naive Bayes ratios (dealt operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import adam, labelled_sample, sigmoid
from .tables import stored
from .text import characters, gram_hashes, look_up, pieces, signed

SIZES = (3, 4, 5)
PIECE = 1 << 20
_FILTER_BITS = 22


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes at all places, and the text of each place; no n-gram spans two texts."""
    points, offsets = characters([" " + t.lower() for t in texts], " ")
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for n in SIZES:
        hashes = gram_hashes(points, n)
        inside = owner[: len(hashes)] == owner[n - 1 :]
        yield hashes[inside], owner[: len(hashes)][inside]


def _pairs(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once a text."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], o[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            label = np.array(piece.column("label").to_pylist())
            for hashes, owner in _grams(piece.column("text").to_pylist()):
                h, o = _pairs(hashes, owner)
                keys, inverse = np.unique(h, return_inverse=True)
                n = [np.bincount(inverse[label[o] == c], minlength=len(keys)) for c in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), *map(pa.array, n)], names=["key", "toxic", "clean"])


@dataclass(frozen=True)
class ToxicityModel:
    """Ascending n-gram hashes, their weights (ratio times coefficient), and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) for every feature in a text, each once."""
        known = np.zeros(1 << _FILTER_BITS, bool)
        known[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for hashes, owner in _grams(texts):
            maybe = np.flatnonzero(known[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = look_up(self.keys, hashes[maybe])
            rows.append(owner[maybe][at >= 0])
            found.append(at[at >= 0])
        pairs = np.unique(np.concatenate(rows) * max(len(self.keys), 1) + np.concatenate(found))
        return np.divmod(pairs, max(len(self.keys), 1))

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, found = self.present([t or "" for t in texts])
        length = np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))
        return sigmoid(self.bias + np.bincount(rows, self.weights[found], len(texts)) / length)


def _present(model: ToxicityModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            rows, found = model.present(piece.column("text").to_pylist())
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("label"), lists], names=["label", "features"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 6000,
    most: int = 20_000,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Learn from about ``per_class`` labelled texts of each class (drawn by a hash of the id).

    Presence of an n-gram is counted by class over the sample, in Spark. The ``most`` n-grams whose
    log ratio stands furthest from zero in its standard errors become features, valued at that ratio and
    divided by the root of the number of features in the text, so that length alone decides nothing. A
    logistic regression on them, with a quadratic penalty that eases as the sample grows, gives the coefficients. What the driver
    holds is bounded: 2 * ``per_class`` sparse rows of at most ``most`` features. With one
    class only, or none, the score is the share of toxic labels (a half without labels).
    """
    sample = stored(labelled_sample(docs, labels, label, per_class, "toxicity", doc_id, text), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not n_toxic or not n_clean:
        share = min(max((n_toxic + 0.5) / (n_toxic + n_clean + 1), 1e-6), 1 - 1e-6)
        return ToxicityModel(none, np.zeros(0), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(_count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q"))
    ratio = F.log((F.col("p") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("q") + 0.5) / (n_clean + 1.0))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    scored = counts.filter(F.col("p") + F.col("q") >= 3).select("key", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
    top = scored.orderBy(F.col("z").desc(), "key").limit(most).toArrow()
    order = np.argsort(keys := top["key"].to_numpy().view(np.uint64))
    keys, ratios = keys[order], top["ratio"].to_numpy()[order]
    bare = ToxicityModel(keys, np.zeros(len(keys)), 0.0)
    rows = sample.mapInArrow(lambda it: _present(bare, it), "label int, features array<int>").toArrow().combine_chunks()
    y = rows["label"].to_numpy().astype(float)
    lists = rows["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(size)])
    feature = lists.flatten().to_numpy()
    # each class weighs half, so the sampling rates do not move the threshold of 0.5
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    ratios_ = ratios.astype(np.float32)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    penalty = 0.33 / len(y)

    def gradient(x: np.ndarray) -> np.ndarray:
        out = np.append(penalty * x[:-1], 0.0)
        for a in range(0, len(y), 500):  # some texts at a time, so that only the features themselves are held
            b = min(a + 500, len(y))
            own = feature[bounds[a] : bounds[b]]
            of = np.repeat(np.arange(b - a), size[a:b])
            value = ratios_[own] * scale[a:b][of]
            miss = weight[a:b] * (sigmoid(x[-1] + np.bincount(of, value * x[own], b - a)) - y[a:b])
            out[:-1] += np.bincount(own, value * miss[of], len(keys))
            out[-1] += miss.sum()
        return out

    x = adam(gradient, np.zeros(len(keys) + 1), 200, 0.05)
    return ToxicityModel(keys, ratios * x[:-1], float(x[-1]))


def score(model: ToxicityModel, text: Column) -> Column:
    """Probability of toxicity of every whole text; null and empty texts score as one without n-grams."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        cut = pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", PIECE)
        parts = [model.score(p.column("text").to_pylist()) for p in cut]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)
