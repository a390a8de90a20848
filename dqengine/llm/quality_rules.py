"""Quality rules with risk-controlled cutoffs (dealt operator 4, DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BLANK_CHARS, stored

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject a document when ``sql``, an expression over the measures, exceeds a cutoff of the grid.

    The grid runs from the mildest cutoff to the strictest and is fixed beforehand, so
    choosing among its steps on labelled rows needs no second sample.
    """

    name: str
    sql: str
    cutoffs: tuple[float, ...]

    @property
    def value(self) -> Column:
        return F.expr(self.sql)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0D END"


_SHARES = tuple(round(0.95 - 0.05 * i, 2) for i in range(18))
RULES = (
    Rule("symbols", _ratio("n_symbols", "n_words"), _SHARES),
    Rule("repeats", _ratio("n_repeat_words", "n_words"), _SHARES),
    Rule("lines", _ratio("n_dup_lines", "n_lines"), _SHARES),
    Rule("long_words", _ratio("word_chars", "n_words"), tuple(float(x) for x in (40, 30, 25, 20, 18, 16, 14, 12, 11, 10))),
    Rule("upper", _ratio("n_upper", "word_chars"), _SHARES),
    Rule("same_words", "1D - (" + _ratio("n_distinct", "n_words") + ")", _SHARES),
)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document: the base ones and those that the rules use.

    Null or blank text has no words; all counts are 0. Runs inside the row, without a
    shuffle: only texts that hold an 8-word window twice pay for locating it.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blank = "[" + "".join({"\t": r"\t", "\n": r"\n", "\x0b": r"\x0B", "\f": r"\f", "\r": r"\r"}.get(c, r"\x20") for c in BLANK_CHARS) + "]+"
    split = base.select(
        "doc_id",
        F.array_remove(F.split("text", blank, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != "").alias("lines"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
        F.char_length(F.regexp_replace("text", blank, "")).alias("word_chars"),
    )
    hashed = split.select(
        "doc_id",
        "n_symbols",
        "n_upper",
        "word_chars",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.size("h")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, F.lit(WINDOW)))),
    )
    windowed = hashed.select(
        "doc_id", "n_symbols", "n_upper", "word_chars", "n_lines", "n_dup_lines",
        n.alias("n_words"), F.size(F.array_distinct("h")).alias("n_distinct"), windows.alias("w"),
    )
    again = F.col("w").isNotNull() & (F.size(F.array_distinct("w")) < F.size("w"))
    ordered = F.when(again, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    placed = windowed.select("*", ordered.alias("o")).drop("w")

    def twin(x: Column, i: Column) -> Column:
        return (F.get(F.col("o"), i - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("o"), i + 1)["h"].eqNullSafe(x["h"]))

    found = F.array_sort(F.transform(F.filter("o", twin), lambda x: x["i"]))
    spread = placed.select("*", found.alias("p")).drop("o")
    # windows at sorted places cover min(8, distance to the next) words each
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_distinct")
    return spread.select(
        "doc_id",
        *[F.col(c).cast("long").alias(c) for c in names],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)


def size_class() -> Column:
    """The default stratum, from the text alone: words below 100, 1000, or more."""
    return F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")


def _log_factorial(n: Column) -> Column:
    """ln(n!) from Stirling's series at n + 8, brought back by the eight factors."""
    x = n.cast("double") + 8
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    down = F.lit(0.0)
    for k in range(1, 9):
        down = down + F.log(n.cast("double") + k)
    return series - down


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for k below n * p, summed from the term at k downwards.

    Below the mean the terms fall faster and faster; the sum stops where what is left
    is far under the precision of a double.
    """
    log_term = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    steps = F.least(k.cast("long"), (F.ceil(F.sqrt(n.cast("double")) * 12) + 60).cast("long"))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) / (n - k + j + 1) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), start, down)["sum"]).otherwise(1.0)
    return F.exp(log_term) * tail


def select_cutoffs(
    labelled: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, confidence: float = 0.95
) -> DataFrame:
    """Cutoffs (stratum, rule, cutoff) whose false rejections are bounded.

    ``labelled``: measures of good documents with a ``stratum``. The rules of a stratum share ``risk``
    equally, so that together they reject at most that part of its good documents. A cutoff is safe when
    the exact binomial test P(X <= k | n, share) lies at or below the level, which is the same as
    the Clopper-Pearson upper bound of its rejection rate staying at or below the rule's share.
    ``1 - confidence`` is shared equally (Bonferroni) by all pairs of stratum and rule.
    Along the grid of one pair cutoffs are tested from the mildest on, each at the
    pair's level, up to the first failure (fixed-sequence testing), which keeps the
    family-wise error without a further split. A pair without a safe cutoff has no row:
    its rule rejects nothing in that stratum.
    """
    # one row a stratum: every step's rejections are sums of one aggregation
    counted = labelled.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(r.value > c).alias(f"{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)],
    )
    steps = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r.name}_{i}").alias("k"))
            for r in rules
            for i, c in enumerate(r.cutoffs)
        ]
    )
    counted = stored(counted.select("stratum", "n", F.explode(steps).alias("s")).select("stratum", "n", "s.*"), "rejections")
    pairs = counted.select("stratum").distinct().count() * len(rules)
    level, share = (1 - confidence) / max(pairs, 1), risk / len(rules)
    k, n = F.col("k"), F.col("n")
    safe = F.when(k < n * share, binomial_cdf(k, n, share) <= level).otherwise(False)
    tested = counted.withColumn("safe", safe)
    # the first failure ends the sequence of a pair; the step before it is the choice
    fail = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("safe"), F.col("step"))).alias("fail"), F.max("step").alias("last")
    )
    chosen = fail.select("stratum", "rule", (F.coalesce(F.col("fail"), F.col("last") + 1) - 1).alias("step"))
    return tested.join(chosen, ["stratum", "rule", "step"]).select("stratum", "rule", "cutoff")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.02,
    confidence: float = 0.95,
    stratum: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
) -> DataFrame:
    """Return doc_id, the measures, base_failed, stratum, kept and the rules that rejected.

    All labelled good documents that pass the base are the holdout. With probability
    ``confidence`` all rules together reject at most ``risk`` of the good documents of every
    stratum. Null text has no words and fails the base. Null labels are ignored; without labels, or
    in an empty table, no cutoff is chosen and ``kept`` is the base's verdict. Repeated
    rows are judged alike; a label repeated for one id counts once. Extra columns are ignored.
    """
    counts = stored(
        measures(docs, doc_id, text).withColumn("base_failed", base_failed()).withColumn("stratum", size_class() if stratum is None else stratum),
        "measures",
    )
    good = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(quality).alias("__q")).filter(F.col("__q") == 1)
    held = counts.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    cutoffs = select_cutoffs(held, rules, risk, confidence)
    # one row a stratum, one column a rule; a missing cutoff rejects nothing
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"__{r.name}") for r in rules])
    wide = stored(wide, "cutoffs")
    judged = counts.join(wide, "stratum", "left")
    rejecting = F.array_compact(F.array(*[F.when(r.value > F.col(f"__{r.name}"), F.lit(r.name)) for r in rules]))
    judged = judged.withColumn("rejected_by", rejecting)
    return judged.select(
        *counts.columns, (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by"
    )
