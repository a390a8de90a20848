"""Date operators on columns of a table."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.functions import dates as dt
from dqengine.operators import stats as st
from dqengine.operators.numeric import parse_or


def to_datetime(df: DataFrame, column: str, format: str = "auto", errors: str = "coerce") -> DataFrame:
    """Parse a text column, day first; a column that is a time already stays."""
    if st.is_time(df, column):
        return df
    parsed = dt.parse_date(F.col(st.quoted(column)).cast("string"), format)
    return df.withColumn(column, parse_or(df, column, parsed, errors))


def detect_date_format(df: DataFrame, column: str) -> DataFrame:
    """Values per format, those that fit both day-first and month-first, and the commonest format."""
    c = F.col(st.quoted(column))
    counts = df.agg(
        *[F.count_if(dt.parse_date(c, f).isNotNull()).alias(f"n_{f.split('_')[0]}") for f in dt.FORMATS],
        F.count_if(dt.parse_date(c, "br_format").isNotNull() & dt.parse_date(c, "us_format").isNotNull()).alias(
            "n_ambiguous"
        ),
        F.count(c).alias("n_values"),
    )
    most = F.greatest("n_br", "n_iso", "n_us")
    best = (
        F.when(most == 0, F.lit("none"))
        .when(F.col("n_br") == most, F.lit("br_format"))
        .when(F.col("n_iso") == most, F.lit("iso_format"))
        .otherwise(F.lit("us_format"))
    )
    return counts.withColumn("format", best)


def format_dates(df: DataFrame, cols: Sequence[str], style: str = "iso") -> DataFrame:
    return df.withColumns({c: dt.format_date(F.col(st.quoted(c)), style) for c in cols})


def invalid_dates(
    df: DataFrame,
    column: str,
    how: str = "drop",
    value: str | None = None,
    today: datetime.date | None = None,
    format: str = "auto",
) -> DataFrame:
    """Parse a text column; text that is no date drops its row or becomes a given day."""
    raw = F.col(st.quoted(column))
    parsed = dt.parse_date(raw, format)
    bad = raw.isNotNull() & parsed.isNull()
    if how == "drop":
        return df.filter(~bad).withColumn(column, parsed)
    if how == "fill_today":
        day = F.lit(today.isoformat()).cast("date") if today else F.current_date()
    elif how == "fill_custom":
        if value is None:
            raise ValueError("fill_custom needs a value")
        day = F.lit(value).cast("date")
    else:
        raise ValueError(f"unknown treatment {how!r}")
    return df.withColumn(column, F.when(bad, day.cast("timestamp_ntz")).otherwise(parsed))
