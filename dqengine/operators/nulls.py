"""Missing values: fills, drops and tokens that mean missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.functions.text import trim_text
from dqengine.operators import stats as st
from dqengine.session import join_stats, match_keys, materialize

# Texts and numbers that stand for a missing value.
NULL_TOKENS = ("", "NULL", "null", "NaN", "nan", "N/A", "#N/A")
IMPLICIT_TOKENS = ("N/A", "null", "--")
SENTINELS = (999999,)

STATISTICS = ("fill_mean", "fill_median", "fill_mode")
CONSTANTS = ("fill_zero", "fill_custom")
ORDERED = ("fill_forward", "fill_backward")


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn texts that equal a token, outer spaces aside, into NULL."""
    names = [c for c in (columns or df.columns) if st.is_text(df, c)]
    return df.withColumns({c: _without_tokens(F.col(st.quoted(c)), tokens) for c in names})


def _without_tokens(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~trim_text(c).isin(list(tokens)), c)


def normalize_nulls(
    df: DataFrame,
    tokens: Sequence[str] = IMPLICIT_TOKENS,
    sentinels: Sequence[float] = SENTINELS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Tokens in texts (case aside) and sentinel numbers become NULL."""
    out = {}
    for name in columns or df.columns:
        c = F.col(st.quoted(name))
        if st.is_text(df, name) or st.is_number(df, name):
            out[name] = F.when(~implicit_null(df, name, tokens, sentinels), c)
    return df.withColumns(out)


def implicit_null(
    df: DataFrame, name: str, tokens: Sequence[str] = IMPLICIT_TOKENS, sentinels: Sequence[float] = SENTINELS
) -> Column:
    c = F.col(st.quoted(name))
    if st.is_text(df, name):
        return F.upper(trim_text(c)).isin([t.upper() for t in tokens])
    return c.isin(list(sentinels))


def fill_value(df: DataFrame, column: str, value: object) -> Column:
    """The column with a constant of its own type in the gaps.

    A value that does not fit the type is an error: it would turn numbers to text.
    """
    kind = st.type_of(df, column)
    if st.is_number(df, column) and isinstance(value, str):
        try:
            value = float(value) if "." in value or isinstance(kind, st.FLOATS) else int(value)
        except ValueError as error:
            raise ValueError(f"{value!r} does not fit column {column} of type {kind.simpleString()}") from error
    return F.coalesce(st.present(df, column), F.lit(value).cast(kind))


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """A constant per column."""
    return df.withColumns({c: fill_value(df, c, v) for c, v in values.items()})


def fill_statistics(
    df: DataFrame, strategies: Mapping[str, str], by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Fill several columns by mean, median or mode, computed together.

    With ``by`` the statistic of the row's group is used, and the one of the
    whole table where the group has none. Whole numbers filled with a mean or
    median become doubles.
    """
    kinds = {k: [c for c, s in strategies.items() if s == k] for k in STATISTICS}
    if unknown := set(strategies.values()) - set(STATISTICS):
        raise ValueError(f"no statistic named {sorted(unknown)}")
    marked, whole = _whole_statistics(df, kinds, approx)
    if by:
        marked = join_stats(marked, _group_statistics(df, kinds, list(by), approx), by)
    filled = {}
    for c in strategies:
        group = [F.col(st.quoted(f"__g_{c}"))] if by else []
        filled[c] = F.coalesce(st.present(df, c), *group, whole[c])
    return marked.withColumns(filled).select(*map(st.quoted, df.columns))


def _whole_statistics(
    df: DataFrame, kinds: Mapping[str, list[str]], approx: bool
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with the table's statistics attached, and where each column's is."""
    out: dict[str, Column] = {}
    marked = df
    if means := kinds["fill_mean"]:
        marked = st.attach(marked, st.moments(df, means), "__mean")
        out |= {c: F.col("__mean")[f"mean_{i}"] for i, c in enumerate(means)}
    if medians := kinds["fill_median"]:
        marked = st.attach(marked, st.quantile_columns(df, medians, [0.5], (), approx), "__median")
        out |= {c: F.col("__median")[f"q_{i}"][0] for i, c in enumerate(medians)}
    if modes := kinds["fill_mode"]:
        marked = st.attach(marked, st.mode_columns(df, modes), "__mode")
        for i, c in enumerate(modes):
            found = F.col("__mode")[f"mode_{i}"]
            out[c] = F.coalesce(found, F.lit("Unknown")) if st.is_text(df, c) else found
    return marked, out


def _group_statistics(df: DataFrame, kinds: Mapping[str, list[str]], by: list[str], approx: bool) -> DataFrame:
    tables = [df.groupBy(*by).agg(*[F.avg(st.present(df, c)).alias(f"__g_{c}") for c in kinds["fill_mean"]] or [F.count("*").alias("__n")]).drop("__n")]
    if medians := kinds["fill_median"]:
        wide = st.quantile_columns(df, medians, [0.5], by, approx)
        tables.append(wide.select(*by, *[F.col(f"q_{i}")[0].alias(f"__g_{c}") for i, c in enumerate(medians)]))
    if modes := kinds["fill_mode"]:
        wide = st.mode_columns(df, modes, by)
        tables.append(wide.withColumnsRenamed({f"mode_{i}": f"__g_{c}" for i, c in enumerate(modes)}))
    out = tables[0]
    for table in tables[1:]:
        out = match_keys(out, table, by, "left")
    return out


def handle_nulls(
    df: DataFrame,
    column: str,
    strategy: str = "fill_zero",
    value: object = "N/A",
    by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
    limit: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """Treat the missing values of one column; see the strategies in the README."""
    if strategy == "keep_as_null":
        return df
    if strategy == "drop_rows":
        return df.filter(st.present(df, column).isNotNull())
    if strategy == "fill_zero":
        return fill_nulls(df, {column: 0 if st.is_number(df, column) else "0"})
    if strategy == "fill_custom":
        return fill_nulls(df, {column: value})
    if strategy in STATISTICS:
        return fill_statistics(df, {column: strategy}, by, approx)
    if strategy in ORDERED:
        return fill_ordered(df, column, strategy, order_by, partition_by, limit)
    if not st.is_text(df, column):
        raise ValueError(f"unknown strategy {strategy!r} for the non-text column {column}")
    return fill_nulls(df, {column: "N/A"})


def fill_ordered(
    df: DataFrame,
    column: str,
    strategy: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Carry the last (or next) present value over the gaps, at most ``limit`` rows far.

    Rows are dealt by ranges of the whole order (keys, all order columns, and the place in the input, which settles ties),
    so neither one hot key, nor one hot day, nor a table without keys is one task. Values travel
    inside a range by a window, and from range to range by a scan over one row per key and range.
    Order columns are of any type that sorts.
    """
    if not order_by:
        raise ValueError(f"{strategy} needs order_by: rows of a DataFrame have no order")
    back = strategy == "fill_backward"
    keys = [st.quoted(c) for c in partition_by]
    order = [*[st.quoted(c) for c in order_by], "__at"]
    v = st.present(df, column)
    placed = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*keys, *order)
    # written once: the ranges must be the same for the rows and for the scan over them
    marked = materialize(placed.withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *keys).orderBy(*[F.desc(c) if back else F.asc(c) for c in order])
    seen = F.last(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("__row").alias("r"))), True)
    here = marked.withColumn("__row", F.row_number().over(inside))
    here = here.withColumn("__seen", seen.over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = here.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"), F.max_by("__seen", "__row").alias("__last"))
    ranges = Window.partitionBy(*keys).orderBy(F.desc("__range") if back else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(ranges), F.lit(0))
    carried = ends.withColumn("__start", start)
    carry = F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.v").alias("v"), (F.col("__start") + F.col("__last.r")).alias("at")))
    carried = carried.select(*keys, "__range", "__start", F.last(carry, True).over(ranges).alias("__carry"))
    joined = match_keys(here, carried, [*partition_by, "__range"], "left")
    own = F.col("__seen.v")
    value = F.coalesce(own, F.col("__carry.v"))
    if limit is not None:
        far = F.when(own.isNotNull(), F.col("__row") - F.col("__seen.r")).otherwise(F.col("__start") + F.col("__row") - F.col("__carry.at"))
        value = F.when(far <= limit, value)
    return joined.withColumn(column, value).select(*[st.quoted(c) for c in df.columns])
