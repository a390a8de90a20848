"""Grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.operators import stats as st
from dqengine.session import join_stats, match_keys

SIMPLE = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
}
KINDS = (*SIMPLE, "median", "mode")


def aggregate(
    df: DataFrame, by: Sequence[str], what: Mapping[str, str | Sequence[str]], approx: bool = False
) -> DataFrame:
    """Group and aggregate: ``{column: function or functions}`` gives ``<column>_<function>``.

    Medians and modes go by the two-level routes of ``stats``, joined to the
    rest by group, so no group's values meet in one task.
    """
    wanted = [(c, f) for c, fs in what.items() for f in ([fs] if isinstance(fs, str) else fs)]
    if unknown := {f for _, f in wanted} - set(KINDS):
        raise ValueError(f"unknown functions {sorted(unknown)}")
    by = list(by)
    simple = [SIMPLE[f](st.present(df, c)).alias(f"{c}_{f}") for c, f in wanted if f in SIMPLE]
    out = df.groupBy(*by).agg(*(simple or [F.count("*").alias("__n")])).drop("__n")
    medians = [c for c, f in wanted if f == "median"]
    modes = [c for c, f in wanted if f == "mode"]
    if medians:
        wide = st.quantile_columns(df, medians, [0.5], by, approx)
        named = [F.col(f"q_{i}")[0].alias(f"{c}_median") for i, c in enumerate(medians)]
        out = match_keys(out, wide.select(*by, *named), by, "left")
    if modes:
        wide = st.mode_columns(df, modes, by)
        named = {f"mode_{i}": f"{c}_mode" for i, c in enumerate(modes)}
        out = match_keys(out, wide.withColumnsRenamed(named), by, "left")
    return out.select(*by, *[f"{c}_{f}" for c, f in wanted])


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Rows ``(value, count)``, commonest first."""
    counts = df.groupBy(st.present(df, column).alias("value")).agg(F.count("*").alias("count"))
    if dropna:
        counts = counts.filter("value is not null")
    return counts.orderBy(F.desc("count"), "value")


def transform_agg(df: DataFrame, by: Sequence[str], column: str, fn: str, into: str | None = None) -> DataFrame:
    """Every row with its group's statistic beside it.

    Aggregated first and joined back: a window would hold a hot group in one task.
    """
    into = into or f"{column}_{fn}"
    groups = aggregate(df, by, {column: fn}).withColumnRenamed(f"{column}_{fn}", into)
    return join_stats(df, groups, by)


def chart_data(df: DataFrame, x: str, y: str | None = None, kind: str = "bar", bins: int = 10, unit: str = "day") -> DataFrame:
    """The table behind a chart: bars by value, a line over time, or a histogram of equal bins."""
    if kind == "bar":
        return df.groupBy(F.col(x).cast("string").alias("x")).agg(_height(df, y).alias("y"))
    if kind == "line":
        return df.groupBy(F.date_trunc(unit, F.col(x)).cast("timestamp_ntz").alias("x")).agg(_height(df, y).alias("y"))
    if kind == "histogram":
        v = st.present(df, x).cast("double")
        low, high = F.col("__ends")["min_0"], F.col("__ends")["max_0"]
        place = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1).cast("bigint"))
        return (
            st.attach(df.filter(v.isNotNull()), st.moments(df, [x]), "__ends")
            .groupBy(F.when(high > low, place).otherwise(0).cast("int").alias("x"))
            .agg(_height(df, y).alias("y"))
        )
    raise ValueError(f"unknown chart {kind!r}")


def _height(df: DataFrame, y: str | None) -> Column:
    return F.count("*") if y is None else F.sum(st.present(df, y))
