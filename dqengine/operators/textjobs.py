"""Jobs over a table of texts. All of them work inside the row: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import text as tx

# Words that mark a usable sentence.
SENTENCE_WORDS = ("pandas", "dataframe", "fillna", "astype", "groupby", "merge", "to_datetime")
TRUNCATED_MARK = "\n\n[Context truncated to fit model limits]"
# Patterns counted in a text.
FUNCTIONAL_PATTERNS = {
    "map_usage": r"\bmap\s*\(",
    "filter_usage": r"\bfilter\s*\(",
    "reduce_usage": r"\breduce\s*\(",
    "lambda_usage": r"\blambda\b",
    "yield_usage": r"\byield\b",
    "partial_usage": r"\bpartial\s*\(",
    "chain_usage": r"\bchain\s*\(",
    "global_variables": r"\bglobal\s+\w+",
    "print_statements": r"\bprint\s*\(",
    "input_statements": r"\binput\s*\(",
    "file_operations": r"\bopen\s*\(",
    "random_usage": r"\brandom\.",
}
FRAME_PATTERNS = {
    "pipe_usage": r"\.pipe\s*\(",
    "apply_usage": r"\.apply\s*\(",
    "transform_usage": r"\.transform\s*\(",
    "agg_usage": r"\.agg\s*\(",
    "query_usage": r"\.query\s*\(",
    "assign_usage": r"\.assign\s*\(",
    "iterrows_usage": r"\.iterrows\s*\(\s*\)",
    "itertuples_usage": r"\.itertuples\s*\(\s*\)",
    "inplace_operations": r"inplace\s*=\s*True",
}
# Bands of a 0-100 score.
BANDS = ((85, "excellent"), (70, "good"), (50, "needs_improvement"))
LOWEST_BAND = "poor"


def band(score: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for bound, name in reversed(BANDS):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def _bounded(c: Column, low: int, high: int) -> Column:
    return (F.length(c) > low) & (F.length(c) < high)


def extract_lines(
    df: DataFrame, id_col: str, text_col: str, low: int = 5, high: int = 100, limit: int = 10
) -> DataFrame:
    """Rows ``(id, position, line)``: the first lines of fitting length, without quotes and list marks."""
    lines = F.transform(F.split(F.col(text_col), "\n"), tx.trim_text)
    real = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("//"))

    def bare(s: Column) -> Column:
        s = F.regexp_replace(s, r"^[\"']|[\"']$", "")
        s = F.regexp_replace(s, rf"^[-*•]{tx.SPACE}*", "")
        return F.regexp_replace(s, rf"^[0-9]+\.{tx.SPACE}*", "")

    kept = F.filter(F.transform(real, bare), lambda s: _bounded(s, low, high))
    return df.select(id_col, F.posexplode(F.slice(kept, 1, limit)).alias("position", "line"))


def keyword_sentences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    words: Sequence[str] = SENTENCE_WORDS,
    low: int = 5,
    high: int = 100,
    limit: int = 6,
) -> DataFrame:
    """Rows ``(id, position, sentence)``: the first sentences of fitting length with any of the words."""
    sentences = F.transform(F.split(F.col(text_col), "[.!?]"), tx.trim_text)
    kept = F.filter(sentences, lambda s: tx.contains_any(s, words) & _bounded(s, low, high))
    return df.select(id_col, F.posexplode(F.slice(kept, 1, limit)).alias("position", "sentence"))


# Escaped characters, quotes, braces, and what lies between them.
_JSON_TOKENS = r'(?s)\\.|["{}]|[^"{}\\]+|\\'


def balanced_objects(text: Column) -> Column:
    """``array<struct<first, last>>``: places (from 1) of all ``{`` ... ``}`` with balanced braces, in the order they end.

    A fold over the text's tokens. Quotes shift between inside and outside of a string; as prose before an object may
    hold any number of quotes, braces seen after an even and after an odd number each have their own stack.
    """
    tokens = F.regexp_extract_all(text, F.lit(_JSON_TOKENS), F.lit(0))
    none = F.array().cast("array<int>")
    spans = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("odd"), none.alias("s0"), none.alias("s1"), spans.alias("spans"))

    def step(state: Column, token: Column) -> Column:
        opens, closes = token == "{", token == "}"
        mine = F.when(state["odd"] == 0, state["s0"]).otherwise(state["s1"])
        deep = F.size(mine)
        moved = F.when(opens, F.array_append(mine, state["at"])).when(closes & (deep > 0), F.slice(mine, 1, deep - 1)).otherwise(mine)
        found = F.when(
            closes & (deep > 0), F.array_append(state["spans"], F.struct(F.element_at(mine, -1).alias("first"), state["at"].alias("last")))
        ).otherwise(state["spans"])
        return F.struct(
            (state["at"] + F.length(token)).alias("at"),
            F.when(token == '"', 1 - state["odd"]).otherwise(state["odd"]).alias("odd"),
            F.when(state["odd"] == 0, moved).otherwise(state["s0"]).alias("s0"),
            F.when(state["odd"] == 1, moved).otherwise(state["s1"]).alias("s1"),
            found.alias("spans"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["spans"])


def first_object(text: Column) -> Column:
    """The first balanced object in a text that is valid JSON; one that holds others comes before them."""
    spans = F.array_sort(balanced_objects(text), lambda a, b: F.coalesce(F.nullif(a["first"] - b["first"], F.lit(0)), b["last"] - a["last"]))
    texts = F.transform(spans, lambda s: F.substring(text, s["first"], s["last"] - s["first"] + 1))
    return F.get(F.filter(texts, lambda t: F.try_parse_json(t).isNotNull()), F.lit(0))


def extract_json(df: DataFrame, text_col: str, schema: str, into: str = "parsed") -> DataFrame:
    """The JSON object in a text: the whole text, else a fenced block, else first ``{`` to last ``}``, else the first balanced object.

    Adds ``into`` (a struct, NULL when there is none) and ``json_method``.
    """
    text = F.col(text_col)
    candidates = {
        "whole": tx.trim_text(text),
        "fenced": F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1),
        "braces": F.regexp_extract(text, r"(?s)(\{.*\})", 1),
        # only where there is more than one way to pair braces
        "balanced": F.when(text.rlike(r"(?s)\{.*\{.*\}|\{.*\}.*\}"), first_object(text)),
    }
    method, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, c in reversed(candidates.items()):
        good = c.startswith("{") & F.try_parse_json(c).isNotNull()
        method = F.when(good, name).otherwise(method)
        found = F.when(good, c).otherwise(found)
    return df.withColumns({into: F.from_json(found, schema), "json_method": method})


def truncate_paragraphs(
    df: DataFrame, text_col: str, max_chars: int = 3000, sep: str = "\n\n", mark: str = TRUNCATED_MARK
) -> DataFrame:
    """A longer text keeps its leading parts while their lengths sum to ``max_chars`` at most, and gets a mark."""
    text = F.col(text_col)
    parts = F.split(text, "\\Q" + sep + "\\E")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("kept"))

    def step(state: Column, part: Column) -> Column:
        # past the limit the total only grows, so later short parts stay out
        total = state["total"] + F.length(part)
        return F.struct(total.alias("total"), (state["kept"] + (total <= max_chars).cast("int")).alias("kept"))

    kept = F.aggregate(parts, start, step, lambda state: state["kept"])
    short = F.array_join(F.slice(parts, F.lit(1), kept), sep)
    marked = F.concat(short, F.when(F.length(short) < F.length(text), F.lit(mark)).otherwise(F.lit("")))
    return df.withColumn(text_col, F.when(F.length(text) > max_chars, marked).otherwise(text))


def pattern_counts(df: DataFrame, text_col: str, patterns: Mapping[str, str]) -> DataFrame:
    """One count per pattern and, in ``present``, the names of those found."""
    counts = {name: F.regexp_count(F.col(text_col), F.lit(p)) for name, p in patterns.items()}
    names = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in patterns]))
    return df.withColumns(counts).withColumn("present", F.array_join(names, ","))


def rubric_score(df: DataFrame, rules: Sequence[tuple[str, float]]) -> DataFrame:
    """``rules`` are (condition, points); the sum is kept within 0-100 and put in a band."""
    total = F.lit(0.0)
    for condition, points in rules:
        total = total + F.when(F.expr(condition), F.lit(float(points))).otherwise(F.lit(0.0))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))
    return df.withColumn("score", score).withColumn("band", band(F.col("score")))


def weighted_complexity(df: DataFrame, weights: Mapping[str, float], into: str = "complexity") -> DataFrame:
    """The weighted sum of count columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(float(weight))
    return df.withColumn(into, total)
