"""What a table looks like: shape, types, missing values, distinct and frequent values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.functions import numbers as nm
from dqengine.functions import text as tx
from dqengine.operators import stats as st
from dqengine.session import materialize

DISTINCT_SHOWN_BELOW = 50
TOP_SHOWN_BELOW = 20
LONG_TEXT = 64
# Values whose text is short; others may be of any length.
SHORT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Items a sketch follows for one column.
TRACKED = 10_000

# Terms whose presence in a text raises each flag.
KEYWORD_GROUPS = {
    "has_datetime": ("date", "time", "datetime", "timestamp"),
    "has_text_heavy": ("object", "string", "text", "categorical"),
    "has_numerical": ("float", "int", "numeric", "number"),
    "has_missing_data": ("missing", "null", "nan", "none"),
    "is_large_dataset": ("thousand", "million", "large", "rows"),
    "has_encoding_issues": ("encoding", "utf", "unicode", "character"),
    "has_duplicates": ("duplicate",),
    "has_mixed_types": ("mixed", "inconsistent"),
}

# The pattern of each kind of value found in a text column.
VALUE_KINDS = (
    ("int", r"^[+-]?[0-9]+$"),
    ("double", nm.PLAIN_NUMBER),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("bool", r"^(?i)(true|false)$"),
)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_rows")).withColumn(
        "num_columns", F.lit(len(df.columns)).cast("bigint")
    )


def shown(df: DataFrame, name: str) -> Column:
    """The present value as text."""
    return st.present(df, name).cast("string")


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), shown(df, c).alias("value")) for c in (columns or df.columns)]
    return df.select(F.inline(F.array(*cells)))


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, value, n)``: every distinct value as text, missing ones as NULL.

    One scan and one shuffle for all columns; counting starts before the shuffle.
    """
    return _cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def key_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, key, head, is_long, n)``: the same, a long text counted under its digest.

    The shuffle then moves the digest and the first 64 characters of a value, however long the texts.
    """
    keyed = _cells(df, columns).select("column", *_key(F.col("value")))
    return keyed.groupBy("column", "key", "head", "is_long").agg(F.count("*").alias("n"))


def _key(value: Column) -> tuple[Column, Column, Column]:
    is_long = F.coalesce(F.length(value) > LONG_TEXT, F.lit(False))
    key = F.when(is_long, F.sha2(value, 256)).otherwise(value)
    return key.alias("key"), F.substring(value, 1, LONG_TEXT).alias("head"), is_long.alias("is_long")


def top_values(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values per column, missing ones shown as ``nan``.

    Ties go by value, however long: by the first 64 characters first, and where these are equal
    too, the texts themselves are compared.
    """
    return _top(df, key_table(df, columns), k, columns)


def _top(df: DataFrame, keys: DataFrame, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    named = keys.withColumns({c: F.coalesce(c, F.lit("nan")) for c in ("key", "head")})
    # rank <= k is cut per task before the shuffle, so a wide column is no hot group
    order = Window.partitionBy("column").orderBy(F.desc("n"), "head")
    ranked = named.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k)
    # only texts and nested values can be longer than what is shown of them
    wide = [c for c in (columns or df.columns) if not isinstance(df.schema[c].dataType, SHORT)]
    found = ranked.select("column", F.col("head").alias("value"), "n")
    if wide:
        few = materialize(ranked)  # k rows per column, and those that tie with the last on 64 characters
        found = few.filter("not is_long").select("column", F.col("head").alias("value"), "n")
        wanted = few.filter("is_long").select("column", "key", "n")
        if not wanted.isEmpty():
            # read once more for the values behind the few digests
            cells = _cells(df, wide).select("column", "value", *_key(F.col("value"))).filter("is_long")
            long = cells.join(wanted, ["column", "key"]).groupBy("column", "key", "n").agg(F.any_value("value").alias("value"))
            found = found.unionByName(long.select("column", "value", "n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    placed = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return placed.select("column", "value", F.col("n").alias("count"), "rank")


def sketched_keys(df: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """``key_table`` of the likely most frequent values only, counted exactly.

    Frequent-item sketches, merged across tasks, name the candidates: every value that more than about
    1 / TRACKED of the rows hold is among them. A second scan counts these; no other value is shuffled.
    """
    named = [F.struct(*_key(shown(df, c))).getField("key").alias(f"k{i}") for i, c in enumerate(columns)]
    aggs = [F.expr(f"approx_top_k(k{i}, {max(4 * k, 100)}, {TRACKED})").alias(f"t{i}") for i in range(len(columns))]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"t{i}.item").alias("keys")) for i, c in enumerate(columns)]
    likely = df.select(*named).agg(*aggs).select(F.inline(F.array(*cells))).select("column", F.explode("keys").alias("key"))
    likely = materialize(likely.filter("key is not null"))  # some hundred rows per column
    keyed = _cells(df, columns).select("column", *_key(F.col("value")))
    found = keyed.filter("key is null").unionByName(keyed.join(likely, ["column", "key"], "left_semi").select(*keyed.columns))
    return found.groupBy("column", "key", "head", "is_long").agg(F.count("*").alias("n"))


def observed(df: DataFrame) -> DataFrame:
    """Rows ``(column, position, dtype, is_text, n_missing, min_value, max_value)``; one aggregation."""
    aggs, cells = [], []
    for i, name in enumerate(df.columns):
        v = st.present(df, name)
        ranged = st.is_number(df, name) or st.is_time(df, name)
        aggs.append(F.count_if(v.isNull()).alias(f"m_{i}"))
        aggs.append((F.min(v) if ranged else F.lit(None)).cast("string").alias(f"lo_{i}"))
        aggs.append((F.max(v) if ranged else F.lit(None)).cast("string").alias(f"hi_{i}"))
        cells.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(i).alias("position"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                F.lit(st.is_text(df, name)).alias("is_text"),
                F.col(f"m_{i}").alias("n_missing"),
                F.col("rows").alias("n_rows"),
                F.col(f"lo_{i}").alias("min_value"),
                F.col(f"hi_{i}").alias("max_value"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*cells)))


def profile(df: DataFrame, k: int = 5, approx: bool = False) -> DataFrame:
    """One row per column: type, observed missing, distinct, top values, range.

    Distinct values and top values show for texts, and for other columns with
    fewer than 50 and 20 distinct values. ``approx`` estimates the distinct
    counts and finds top values by sketches, so no distinct value is shuffled; the counts shown stay exact.
    """
    base = observed(df)
    if approx:
        guess = [F.approx_count_distinct(st.present(df, c)).alias(str(i)) for i, c in enumerate(df.columns)]
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("distinct")) for i, c in enumerate(df.columns)
        ]
        counted = df.agg(*guess).select(F.inline(F.array(*cells)))
        narrow = {r["column"] for r in counted.filter(F.col("distinct") < TOP_SHOWN_BELOW).collect()}
        # texts show their top values however many they have
        few = [c for c in df.columns if c in narrow or st.is_text(df, c)] or df.columns[:1]
        keys = sketched_keys(df, k, few)
        distinct = counted
    else:
        few = df.columns
        keys = key_table(df)
        distinct = keys.groupBy("column").agg(F.count("key").alias("distinct"))
    tops = (
        _top(df, keys, k, few)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))
        .select("column", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("tops"))
    )
    joined = base.join(distinct, F.col("name") == distinct["column"], "left").drop("column")
    joined = joined.join(tops, F.col("name") == tops["column"], "left").drop("column")
    n = F.coalesce("distinct", F.lit(0))
    return joined.select(
        "name",
        "dtype",
        (F.col("n_missing") > 0).alias("is_nullable"),
        F.when(F.col("is_text") | (n < DISTINCT_SHOWN_BELOW), n).alias("unique_values"),
        F.when(F.col("is_text") | (n < TOP_SHOWN_BELOW), F.col("tops")).alias("top_values"),
        "min_value",
        "max_value",
        "position",
    )


def value_kind(c: Column) -> Column:
    """int, double, date, bool or string, by the look of the text."""
    kind = F.lit("string")
    for name, pattern in reversed(VALUE_KINDS):
        kind = F.when(tx.trim_text(c).rlike(pattern), F.lit(name)).otherwise(kind)
    return F.when(c.isNotNull(), kind)


def mixed_types(df: DataFrame) -> DataFrame:
    """Text columns whose values look like more than one type, with 3 samples."""
    texts = [c for c in df.columns if st.is_text(df, c)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, types string, sample_values string")
    cells = _cells(df, texts).filter("value is not null")
    kinds = cells.select("column", value_kind(F.col("value")).alias("kind")).distinct()
    by_column = kinds.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"), F.count("*").alias("k"))
    # at most a row per column: sent to the cells, which by column alone would all meet in one task
    mixed = F.broadcast(materialize(by_column.filter("k > 1")))
    # the least values begin with the least heads: only values with one of these are compared whole
    cells = cells.join(mixed.select("column"), "column", "left_semi").withColumn("head", F.substring("value", 1, LONG_TEXT))
    heads = cells.select("column", "head").distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("head"))
    heads = F.broadcast(materialize(heads.withColumn("r", place).filter("r <= 3").drop("r")))
    whole = cells.join(heads, ["column", "head"], "left_semi").groupBy("column", F.sha2("value", 256)).agg(F.any_value("value").alias("value"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    samples = whole.withColumn("r", first).filter("r <= 3").groupBy("column")
    samples = samples.agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample_values"))
    return samples.join(mixed, "column").select("column", "types", "sample_values")


def missing_table(df: DataFrame) -> DataFrame:
    """Rows ``(column, n_rows, n_missing, rate)``."""
    aggs = [F.count_if(st.present(df, c).isNull()).alias(f"m_{i}") for i, c in enumerate(df.columns)]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows").alias("n_rows"),
            F.col(f"m_{i}").alias("n_missing"),
            F.try_divide(F.col(f"m_{i}"), F.col("rows")).alias("rate"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*cells)))


def missing_rate(df: DataFrame) -> DataFrame:
    return missing_table(df).select("column", "rate")


def missing_count(df: DataFrame) -> Column:
    """Missing cells of all columns, as one aggregate."""
    total = F.lit(0).cast("bigint")
    for c in df.columns:
        total = total + F.count_if(st.present(df, c).isNull())
    return total


def missing_cells(df: DataFrame) -> DataFrame:
    return df.agg(missing_count(df).alias("missing_cells"))


def run_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shapes, changes and missing cells before and after a cleaning."""
    def one(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows"), missing_count(df).alias("missing"))

    both = st.attach(st.attach(before.sparkSession.range(1), one(before), "b"), one(after), "a")
    nb, na = len(before.columns), len(after.columns)
    return both.select(
        F.col("b.rows").alias("original_rows"),
        F.lit(nb).cast("bigint").alias("original_columns"),
        F.col("a.rows").alias("final_rows"),
        F.lit(na).cast("bigint").alias("final_columns"),
        (F.col("b.rows") - F.col("a.rows")).alias("rows_changed"),
        F.lit(nb - na).cast("bigint").alias("columns_changed"),
        F.col("b.missing").alias("missing_before"),
        F.col("a.missing").alias("missing_after"),
    )


def keyword_flags(
    df: DataFrame, text_col: str, groups: Mapping[str, Sequence[str]] = KEYWORD_GROUPS
) -> DataFrame:
    """One boolean per group: the lower-cased text holds any of its terms."""
    return df.withColumns({name: tx.contains_any(F.col(text_col), terms) for name, terms in groups.items()})


def describe_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75), approx: bool = False
) -> DataFrame:
    """Rows ``(column, prob, value)``."""
    return st.quantile_table(df, cols, probs, (), approx)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min and max per numeric column; one aggregation."""
    aggs, cells = [], []
    for i, c in enumerate(cols):
        v = st.present(df, c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"s_{i}")
        )
        cells.append(F.col(f"s_{i}"))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))
