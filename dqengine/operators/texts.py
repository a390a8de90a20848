"""Text operators on columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import text as tx
from dqengine.operators import stats as st


def on_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(st.quoted(c))) for c in cols})


def convert_case(df: DataFrame, cols: Sequence[str], case: str = "lower") -> DataFrame:
    return on_columns(df, cols, lambda c: tx.convert_case(c, case))


def trim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return on_columns(df, cols, tx.trim_text)


def normalize_whitespace(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return on_columns(df, cols, tx.normalize_whitespace)


def clean_text(
    df: DataFrame, cols: Sequence[str], level: str = "minimal", rules: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    return on_columns(df, cols, lambda c: tx.clean_text(c, level, rules))


def fix_encoding(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return on_columns(df, cols, tx.fix_encoding)


def remove_control_chars(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return on_columns(df, cols, tx.remove_control_chars)


def remove_accents(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return on_columns(df, cols, tx.remove_accents)


def string_op(df: DataFrame, column: str, op: str, into: str | None = None, **args) -> DataFrame:
    """strip, lower, upper, replace(pattern, to), contains(term), split(sep, part), extract(pattern, group)."""
    c = F.col(st.quoted(column))
    ops: dict[str, Callable[..., Column]] = {
        "strip": lambda: tx.trim_text(c),
        "lower": lambda: F.lower(c),
        "upper": lambda: F.upper(c),
        "replace": lambda pattern, to: F.regexp_replace(c, pattern, to),
        "contains": lambda term: c.contains(term),
        "split": lambda sep, part: F.get(F.split(c, sep), F.lit(part)),
        "extract": lambda pattern, group=1: F.regexp_extract(c, pattern, group),
    }
    if op not in ops:
        raise ValueError(f"unknown string operation {op!r}")
    return df.withColumn(into or column, ops[op](**args))
