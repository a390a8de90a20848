"""Language identification by words first, character n-grams for the rest (dealt operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .text import characters, gram_hashes, look_up, pieces, prefix_hash, range_hash, signed

SIZES = (5, 4, 3, 2, 1)  # n-gram lengths in the order they are tried; words go first
UNKNOWN = "und"
_SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with non-letters as spaces, starts and ends of words, the word hashes, the text of each word."""
    points, offsets = characters([" " + t.lower() for t in texts], " ")
    inside = _letters()[points]
    points = np.where(inside, points, _SPACE)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return points, starts, ends, range_hash(prefix_hash(points), starts, ends), owner


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words with one space at each side, and the word of each."""
    begin, room = (starts - 1, ends - starts + 2) if n > 1 else (starts, ends - starts)
    count = np.maximum(room - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    place = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    return gram_hashes(points, n)[place], word


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (size, key, lang, n); size 0 are words."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            langs = np.array(piece.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = piece.column("text").filter(pa.array(langs == lang)).to_pylist()
                points, starts, ends, hashes, _ = _words(texts)
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                found = [(0, keys, n)]
                for size in SIZES:
                    grams, word = _grams(points, starts[first], ends[first], size)
                    keys, inverse = np.unique(grams, return_inverse=True)
                    found.append((size, keys, np.bincount(inverse, n[word], len(keys)).astype(np.int64)))
                for size, keys, n in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), size, np.int32)), pa.array(signed(keys)), pa.array([lang] * len(keys), pa.string()), pa.array(n)],
                        names=["size", "key", "lang", "n"],
                    )


@dataclass(frozen=True)
class LanguageModel:
    """Per size (0: words) the ascending keys and their log frequencies by language, less their mean."""

    langs: tuple[str, ...]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores (text, language), and which texts have a letter.

        A known word adds its log frequency; an unseen one the mean over its known n-grams of the
        greatest size that has any.
        """
        points, starts, ends, hashes, owner = _words(texts)
        total = np.zeros((len(texts), len(self.langs)))
        has_letter = np.bincount(owner, minlength=len(texts)) > 0

        def add(rows: np.ndarray, values: np.ndarray) -> None:
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(rows, values[:, k], len(texts))

        at = look_up(self.keys[0], hashes)
        add(owner[at >= 0], self.logs[0][at[at >= 0]])
        left = np.flatnonzero(at < 0)
        # equal unseen words back off alike: each is worked out once
        _, first, inverse = np.unique(hashes[left], return_index=True, return_inverse=True)
        unique = left[first]
        value = np.zeros((len(unique), len(self.langs)))
        open_ = np.arange(len(unique))
        for size in SIZES:
            grams, word = _grams(points, starts[unique[open_]], ends[unique[open_]], size)
            at = look_up(self.keys[size], grams)
            word, at = word[at >= 0], at[at >= 0]
            n = np.bincount(word, minlength=len(open_))
            for k in range(len(self.langs)):
                value[open_, k] = np.bincount(word, self.logs[size][at, k], len(open_)) / np.maximum(n, 1)
            open_ = open_[n == 0]
        add(owner[left], value[inverse])
        return total, has_letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, has_letter = self.scores([t or "" for t in texts])
        weight = np.exp(total - total.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        best = weight.argmax(1)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
        return names, np.where(has_letter, weight[np.arange(len(texts)), best], 0.0)


def train(
    labelled: DataFrame, docs_per_lang: int = 1500, most: int = 60_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """Learn from a sample of about ``docs_per_lang`` labelled documents of each language.

    The sample is drawn by a hash of the id and takes whole texts. The model keeps the ``most`` commonest
    words, and as many n-grams of each size, that occur at least twice; so its size is
    bounded by 6 * ``most`` rows whatever the input. Counting is a distributed aggregation.
    Rows without text or language are ignored.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "languages")
    langs = tuple(sorted(r["lang"] for r in sizes.select("lang").collect()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "lang").filter(draw * F.col("docs") < docs_per_lang).select("lang", "text")
    partial = sample.mapInArrow(_counts, "size int, key long, lang string, n long")
    counts = partial.groupBy("size", "key").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == v, F.col("n")).otherwise(0)).alias(f"l{i}") for i, v in enumerate(langs)]
    )
    counts = stored(counts.filter(F.col("n") >= 2), "language-counts")
    keys, logs = {}, {}
    for size in (0, *SIZES):
        top = counts.filter(F.col("size") == size).orderBy(F.col("n").desc(), "key").limit(most).toArrow()
        table = np.stack([top[f"l{i}"].to_numpy() for i in range(len(langs))], 1) if langs else np.zeros((0, 0))
        order = np.argsort(found := top["key"].to_numpy().view(np.uint64))
        log = np.log((table + 0.2) / (table.sum(0, keepdims=True) + 0.2 * max(len(table), 1)))
        keys[size], logs[size] = found[order], (log - log.mean(1, keepdims=True))[order] if langs else log
    return LanguageModel(langs, keys, logs)


def predict(model: LanguageModel, text: Column) -> Column:
    """Struct (lang, score): the likeliest language and its posterior under equal priors.

    Null text and text without a letter give ``und`` and 0; a text of whose words and
    characters none was learnt gives the first language with an even score.
    """

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            names, scores = model.predict(piece.column("text").to_pylist())
            out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return of(text)
