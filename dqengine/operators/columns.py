"""Column names, projections, filters, casts and choices between columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions import dates as dt
from dqengine.functions import names as nn
from dqengine.functions import numbers as nm
from dqengine.functions import text as tx
from dqengine.operators import profile as pf
from dqengine.operators import stats as st
from dqengine.operators.numeric import parse_or

# Words in a text column's name that suggest a date or an amount.
DATE_WORDS = ("data", "date", "time", "created", "updated")
MONEY_WORDS = ("valor", "price", "preco", "cost", "amount", "money")


# names


def distinct_names(names: Sequence[str]) -> list[str]:
    """Later twins get ``_2``, ``_3``: Spark cannot tell equal names apart."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        key = name.lower()
        seen[key] = seen.get(key, 0) + 1
        fresh = name if seen[key] == 1 else f"{name}_{seen[key]}"
        seen.setdefault(fresh.lower(), 1)
        out.append(fresh)
    return out


def standardize_names(df: DataFrame, columns: Sequence[str] | str = "all", style: str = "snake_case") -> DataFrame:
    chosen = set(df.columns if columns == "all" else columns)
    if missing := chosen - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.toDF(*distinct_names([nn.style_name(c, style) if c in chosen else c for c in df.columns]))


def clean_names(df: DataFrame, spaces: bool = True, accents: bool = True, specials: bool = True) -> DataFrame:
    return df.toDF(*distinct_names([nn.clean_plain_name(c, spaces, accents, specials) for c in df.columns]))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    if missing := set(mapping) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(dict(mapping))


def names_table(df: DataFrame) -> DataFrame:
    """Rows ``(position, name, dtype)`` of the schema."""
    fields = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(t).alias("dtype")) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.range(1).select(F.inline(F.array(*fields)))


def column_type_groups(names: DataFrame, name_col: str = "name", dtype_col: str = "dtype") -> DataFrame:
    """Which rule applies to each column of a names table: datetime, numeric, text or none."""
    lower = F.lower(F.col(name_col))
    text = F.col(dtype_col) == "string"
    return names.withColumns(
        {
            "is_number": F.col(dtype_col).rlike("int|double|float|decimal|short|byte|long"),
            "is_date_like": text & tx.contains_any(lower, DATE_WORDS),
            "is_money_like": text & tx.contains_any(lower, MONEY_WORDS),
        }
    )


# rows and values


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.filter(condition)


def derive_column(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def feature_columns(
    df: DataFrame, column: str, kind: str, low: float = 0.0, high: float = 1.0, bins: int = 10
) -> DataFrame:
    """New columns from one: ``date_parts``, ``bins`` of equal width, or ``text_length``."""
    c = F.col(st.quoted(column))
    if kind == "date_parts":
        new = {
            f"{column}_year": F.year(c),
            f"{column}_month": F.month(c),
            f"{column}_day": F.dayofmonth(c),
            f"{column}_dayofweek": F.dayofweek(c),
        }
    elif kind == "bins":
        new = {f"{column}_bin": F.width_bucket(c.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))}
    elif kind == "text_length":
        new = {f"{column}_length": F.length(c)}
    else:
        raise ValueError(f"unknown kind of feature {kind!r}")
    return df.withColumns(new)


def change_datatype(df: DataFrame, types: Mapping[str, str], errors: str = "coerce") -> DataFrame:
    """Cast columns; a bad value is NULL (coerce), an error (raise), or keeps its column (ignore)."""
    parsed = {c: F.col(st.quoted(c)).try_cast(t) for c, t in types.items()}
    return df.withColumns({c: parse_or(df, c, p, errors) for c, p in parsed.items()})


# which columns to keep: one small job decides, then a projection


def sparse_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Columns whose missing share is above the threshold."""
    return pf.missing_rate(df).filter(F.col("rate") > threshold)


def drop_sparse_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.drop(*[r["column"] for r in sparse_columns(df, threshold).collect()])


def flat_columns(df: DataFrame) -> DataFrame:
    """Rows ``(column, n_present, is_empty, is_constant)``; constant means one value at most.

    Least equals greatest is enough to see a single value: no distinct count is needed.
    """
    aggs, cells = [], []
    for i, name in enumerate(df.columns):
        v = pf.shown(df, name)
        aggs.append(F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"s_{i}"))
        s = F.col(f"s_{i}")
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                s["n"].alias("n_present"),
                (s["n"] == 0).alias("is_empty"),
                F.coalesce(s["lo"] == s["hi"], F.lit(True)).alias("is_constant"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[r["column"] for r in flat_columns(df).filter("is_empty").collect()])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[r["column"] for r in flat_columns(df).filter("is_constant").collect()])


def duplicate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs ``(earlier, later)`` of columns equal in every row.

    A first pass compares a count and a hash sum per column; only pairs that
    agree in both are compared value by value, all in one second pass.
    """
    aggs = []
    for i, name in enumerate(df.columns):
        c = F.col(st.quoted(name))
        # 20-bit hashes: the sum stays inside a bigint up to 8 trillion rows
        aggs.append(F.struct(F.count(c), F.sum(F.pmod(F.xxhash64(c), F.lit(1 << 20)))).alias(str(i)))
    marks = df.agg(*aggs).first()
    pairs = [
        (a, b)
        for j, b in enumerate(df.columns)
        for i, a in enumerate(df.columns[:j])
        if marks[i] == marks[j] and st.type_of(df, a) == st.type_of(df, b)
    ]
    if not pairs:
        return []
    same = df.agg(
        *[
            F.bool_and(F.col(st.quoted(a)).eqNullSafe(F.col(st.quoted(b)))).alias(str(i))
            for i, (a, b) in enumerate(pairs)
        ]
    ).first()
    return [p for p, equal in zip(pairs, same) if equal]


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    return df.drop(*{b for _, b in duplicate_columns(df)})


# types

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def fitting_types(df: DataFrame, few: int = 50) -> DataFrame:
    """Rows ``(column, dtype, proposed)``: the smallest integer type, bigint for whole doubles, category for few texts."""
    aggs, cells = [], []
    for i, name in enumerate(df.columns):
        v = st.present(df, name)
        kind = st.type_of(df, name)
        stat, proposed = None, F.lit(kind.simpleString())
        s = F.col(f"s_{i}")
        if isinstance(kind, INTEGERS):
            stat = F.struct(F.min(v).cast("bigint").alias("lo"), F.max(v).cast("bigint").alias("hi"))
            proposed = _smallest(s["lo"], s["hi"])
        elif isinstance(kind, st.FLOATS):
            whole = (v == F.floor(v)) & (F.abs(v) < F.lit(2.0**53))
            stat = F.struct(F.bool_and(whole).alias("whole"))
            proposed = F.when(F.coalesce(s["whole"], F.lit(False)), "bigint").otherwise(kind.simpleString())
        elif isinstance(kind, T.StringType):
            stat = F.struct(F.approx_count_distinct(v).alias("d"), F.count(v).alias("n"))
            proposed = F.when((s["d"] < few) & (s["n"] > 0), "category").otherwise("string")
        if stat is not None:
            aggs.append(stat.alias(f"s_{i}"))
        cells.append(F.struct(F.lit(name).alias("column"), F.lit(kind.simpleString()).alias("dtype"), proposed.alias("proposed")))
    return df.agg(*(aggs or [F.count("*")])).select(F.inline(F.array(*cells)))


def _smallest(lo: Column, hi: Column) -> Column:
    out = F.lit("bigint")
    for name, bits in (("int", 31), ("smallint", 15), ("tinyint", 7)):
        out = F.when((lo >= -(1 << bits)) & (hi < (1 << bits)), name).otherwise(out)
    return out


def optimize_types(df: DataFrame) -> DataFrame:
    """Cast to the proposed numeric types; texts stay, Parquet's dictionaries serve as categories."""
    proposed = {r["column"]: r["proposed"] for r in fitting_types(df).collect() if r["proposed"] not in ("category", r["dtype"])}
    return df.withColumns({c: F.col(st.quoted(c)).cast(t) for c, t in proposed.items()})


def infer_types(df: DataFrame, min_share: float = 0.9) -> DataFrame:
    """Rows ``(column, n_values, share_int, share_double, share_date, proposed)`` for text columns."""
    aggs, cells = [], []
    for i, name in enumerate([c for c in df.columns if st.is_text(df, c)]):
        c = tx.trim_text(F.col(st.quoted(name)))
        number = nm.to_number(c)
        aggs.append(
            F.struct(
                F.count(c).alias("n"),
                F.count_if(number.isNotNull() & c.rlike("^[+-]?[0-9]+$")).alias("int"),
                F.count_if(number.isNotNull()).alias("double"),
                F.count_if(dt.parse_date(c).isNotNull()).alias("date"),
            ).alias(f"s_{i}")
        )
        s = F.col(f"s_{i}")
        share = {k: F.coalesce(F.try_divide(s[k], s["n"]), F.lit(0.0)) for k in ("int", "double", "date")}
        proposed = (
            F.when(s["n"] == 0, "string")
            .when(share["int"] >= min_share, "bigint")
            .when(share["double"] >= min_share, "double")
            .when(share["date"] >= min_share, "timestamp")
            .otherwise("string")
        )
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                s["n"].alias("n_values"),
                *[v.alias(f"share_{k}") for k, v in share.items()],
                proposed.alias("proposed"),
            )
        )
    if not cells:
        empty = "column string, n_values bigint, share_int double, share_double double, share_date double, proposed string"
        return df.sparkSession.createDataFrame([], empty)
    return df.agg(*aggs).select(F.inline(F.array(*cells)))
