"""What the trained operators share: bounded labelled samples and a plain optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """About ``per_class`` labelled texts (text, label) of each class, drawn by a hash of the id.

    Rows without an id, a text or a label are left out; a label repeated for one id counts once
    (its least value). Labels of other documents than ``docs`` take no part, not even in the sizes of the classes.
    """
    here = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct()
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    marks = stored(marks.join(here, "doc_id", "left_semi"), "labels")
    sizes = marks.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.join(F.broadcast(sizes.filter("label in (0, 1)")), "label").filter(draw * F.col("n") < per_class)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return texts.join(stored(chosen.select("doc_id", "label"), "sample"), "doc_id").select("text", "label")


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam with a rate that falls to zero."""
    x, m, v = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        x -= rate * (1 - (t - 1) / steps) * step
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
