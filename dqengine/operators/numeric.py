"""Numeric operators on columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import numbers as nm
from dqengine.operators import stats as st


def parse_or(df: DataFrame, column: str, parsed: Column, errors: str) -> Column:
    """``coerce``: bad text gives NULL; ``raise``: it is an error; ``ignore``: one bad text keeps the column."""
    raw = F.col(st.quoted(column))
    bad = raw.isNotNull() & parsed.isNull()
    if errors == "coerce":
        return parsed
    if errors == "raise":
        message = F.concat(F.lit(f"cannot convert {column}: "), raw.cast("string"))
        return F.when(bad, F.raise_error(message)).otherwise(parsed)
    if errors == "ignore":
        # one small job decides: the type of a column cannot depend on a lazy result
        return raw if df.agg(F.coalesce(F.bool_or(bad), F.lit(False))).first()[0] else parsed
    raise ValueError(f"errors is coerce, raise or ignore, not {errors!r}")


def to_numeric(
    df: DataFrame,
    column: str,
    decimal: str = "dot",
    currency: bool = False,
    thousands: str | None = None,
    errors: str = "coerce",
) -> DataFrame:
    """Parse a text column; ``decimal`` may also be ``auto_detect`` or ``keep_original``."""
    if decimal == "keep_original":
        return df
    if decimal == "auto_detect":
        decimal = detect_decimal(df, column).first()["decimal"]
        thousands = thousands and {"dot": ",", "comma": "."}[decimal]
    parsed = nm.to_number(F.col(st.quoted(column)), decimal, currency, thousands)
    return df.withColumn(column, parse_or(df, column, parsed, errors))


def detect_decimal(df: DataFrame, column: str) -> DataFrame:
    """How many values look dot or comma decimal, and the more common of the two."""
    c = nm.bare_amount(F.col(st.quoted(column)))
    counts = df.agg(
        F.count_if(c.rlike(nm.DOT_DECIMAL)).alias("n_dot"),
        F.count_if(c.rlike(nm.COMMA_DECIMAL)).alias("n_comma"),
    )
    return counts.withColumn("decimal", F.when(F.col("n_comma") > F.col("n_dot"), "comma").otherwise("dot"))


def round_places(df: DataFrame, cols: Sequence[str], places: int, mode: str = "half_up") -> DataFrame:
    pick = {"half_up": F.round, "half_even": F.bround}[mode]
    return df.withColumns({c: pick(F.col(st.quoted(c)), places) for c in cols})


def normalize(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """``standard``: (x - mean) / population deviation; ``minmax``: (x - min) / (max - min); flat gives 0."""
    one = F.col("__moments")
    out = {}
    for i, c in enumerate(cols):
        v = st.present(df, c).cast("double")
        if method == "standard":
            base, width = one[f"mean_{i}"], one[f"std_{i}"]
        elif method == "minmax":
            base, width = one[f"min_{i}"], one[f"max_{i}"] - one[f"min_{i}"]
        else:
            raise ValueError(f"unknown method {method!r}")
        out[c] = F.when(v.isNotNull(), F.when(width == 0, F.lit(0.0)).otherwise((v - base) / width))
    return st.attach(df, st.moments(df, cols), "__moments").withColumns(out).drop("__moments")


def with_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, approx: bool = False) -> DataFrame:
    """Add ``__fences``: per column ``lo_i`` and ``hi_i``, quartiles less and plus ``k`` times their distance."""
    wide = st.quantile_columns(df, cols, [0.25, 0.75], (), approx)
    ends = []
    for i in range(len(cols)):
        low, high = F.col(f"q_{i}")[0], F.col(f"q_{i}")[1]
        ends += [(low - (high - low) * k).alias(f"lo_{i}"), (high + (high - low) * k).alias(f"hi_{i}")]
    return st.attach(df, wide.select(*ends), "__fences")


def outliers_iqr(
    df: DataFrame, cols: Sequence[str], k: float = 1.5, action: str = "flag", approx: bool = False
) -> DataFrame:
    """Values outside the fences: flag in ``<col>_outlier``, null, clip, or drop the row."""
    return _treat(with_fences(df, cols, k, approx), df, cols, action)


def outliers_zscore(df: DataFrame, cols: Sequence[str], z: float = 3.0, action: str = "flag") -> DataFrame:
    """Values more than ``z`` deviations from the mean."""
    ends = []
    for i in range(len(cols)):
        mean, reach = F.col(f"mean_{i}"), F.col(f"std_{i}") * z
        ends += [(mean - reach).alias(f"lo_{i}"), (mean + reach).alias(f"hi_{i}")]
    marked = st.attach(df, st.moments(df, cols).select(*ends), "__fences")
    return _treat(marked, df, cols, action)


def _treat(marked: DataFrame, df: DataFrame, cols: Sequence[str], action: str) -> DataFrame:
    flags, nulled, clipped, keep = {}, {}, {}, F.lit(True)
    for i, c in enumerate(cols):
        v = st.present(df, c).cast("double")
        low, high = F.col("__fences")[f"lo_{i}"], F.col("__fences")[f"hi_{i}"]
        outside = F.coalesce((v < low) | (v > high), F.lit(False))
        flags[f"{c}_outlier"] = outside
        nulled[c] = F.when(~outside, F.col(st.quoted(c)))
        clipped[c] = F.when(v < low, low).when(v > high, high).otherwise(v)
        keep = keep & ~outside
    treated = {
        "flag": lambda: marked.withColumns(flags),
        "null": lambda: marked.withColumns(nulled),
        "clip": lambda: marked.withColumns(clipped),
        "drop": lambda: marked.filter(keep),
    }
    if action not in treated:
        raise ValueError(f"unknown action {action!r}")
    return treated[action]().drop("__fences")


def convert_unit(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(st.quoted(column)).cast("double") * F.lit(float(factor)))


def scale_check(df: DataFrame, column: str, by: Sequence[str], approx: bool = False) -> DataFrame:
    """Groups whose median is about a power of ten away from the whole table's median.

    Rows ``(by..., median, overall, power, suspicious)``.
    """
    groups = st.quantile_columns(df, [column], [0.5], by, approx).select(*by, F.col("q_0")[0].alias("median"))
    whole = st.quantile_columns(df, [column], [0.5], (), approx).select(F.col("q_0")[0].alias("median"))
    ratio = F.try_divide(F.col("median"), F.col("overall"))
    power = F.when(ratio > 0, F.round(F.log10(ratio)).cast("int"))
    return (
        st.attach(groups, whole, "__whole")
        .withColumn("overall", F.col("__whole")["median"])
        .drop("__whole")
        .withColumn("power", power)
        .withColumn("suspicious", F.coalesce(F.col("power") != 0, F.lit(False)))
    )
