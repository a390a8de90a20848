"""Column statistics that stay distributed at any size.

``percentile``, ``median`` and ``mode`` keep every distinct value of a group in
one task. Here the exact quantile is found in two passes instead: mergeable
sketches bracket the wanted rank, then only the values inside the bracket are
counted and ranked. The mode comes from a two-level count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqengine.session import join_stats

FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (*FLOATS, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

SKETCH_ACCURACY = 10_000
SKETCH_GROUPS = 64


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), NUMBERS)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), TIMES)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.StringType)


def quoted(name: str) -> str:
    """The name as a column reference, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL: both mean missing."""
    c = F.col(quoted(name))
    return F.nanvl(c, F.lit(None).cast("double")) if isinstance(type_of(df, name), FLOATS) else c


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row table to every row as the struct ``name``: a scalar subquery, run once, no join.

    As a column it stays one subquery however often its fields are used.
    """
    return df.withColumn(name, one_row.select(F.struct("*").alias("s")).scalar())


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``mean_i, std_i, min_i, max_i`` over all ``cols``, one job."""
    aggs = []
    for i, name in enumerate(cols):
        v = present(df, name).cast("double")
        aggs += [
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_pop(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
    return df.agg(*aggs)


def _sketches(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group: a struct ``n_i, lo_i, hi_i`` bracketing each probability.

    Sketches are made per slice of the rows, dealt in turn within each partition, so neither
    a hot group nor the whole table ends in one merge, and a slice of sorted data is
    spread over all of it: the brackets stay narrow in any layout. The least lower and the greatest
    upper bound over the slices bracket the quantile of the union: were every
    slice's bound above it, every slice would hold too few smaller values.
    """
    margin = 2 / SKETCH_ACCURACY
    around = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    parts, merged = [], []
    for i, name in enumerate(cols):
        v = present(df, name).cast("double")
        parts += [F.count(v).alias(f"n_{i}"), F.percentile_approx(v, around, SKETCH_ACCURACY).alias(f"ends_{i}")]
        merged.append(F.sum(f"n_{i}").alias(f"n_{i}"))
        for side, pick, offset in (("lo", F.min, 0), ("hi", F.max, len(probs))):
            bounds = [pick(F.col(f"ends_{i}")[offset + j]) for j in range(len(probs))]
            merged.append(F.array(*bounds).alias(f"{side}_{i}"))
    sliced = df.withColumn("__slice", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(SKETCH_GROUPS)))
    return sliced.groupBy(*by, "__slice").agg(*parts).groupBy(*by).agg(F.struct(*merged).alias("__sk"))


def quantile_table(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """Rows ``(by..., column, prob, value)``: linearly interpolated quantiles."""
    by = list(by)
    if approx:
        return _approximate(df, cols, probs, by)
    narrow = df.select(*by, *[c for c in cols if c not in by])
    sketches = _sketches(narrow, cols, probs, by)
    if by:
        marked = join_stats(narrow, sketches, by)
    else:
        marked = narrow.withColumn("__sk", sketches.scalar())
    within, beyond = [], []
    for i, name in enumerate(cols):
        v = present(df, name).cast("double")
        for j, p in enumerate(probs):
            lo, hi, n = F.col("__sk")[f"lo_{i}"][j], F.col("__sk")[f"hi_{i}"][j], F.col("__sk")[f"n_{i}"]
            which = (F.lit(name).alias("column"), F.lit(float(p)).alias("prob"))
            within.append(F.when((v >= lo) & (v <= hi), F.struct(*which, v.alias("inside"), n.alias("n"))))
            for bucket, out in ((0, v < lo), (2, v > hi)):
                beyond.append(
                    F.struct(
                        *which,
                        F.lit(bucket).alias("bucket"),
                        F.count_if(out).alias("c"),
                        F.min(F.when(out, v)).alias("least"),
                        F.max(F.when(out, v)).alias("most"),
                        F.max(n).alias("n"),
                    )
                )
    # Below and above the bracket only a count and the nearest value are kept; only values inside become rows.
    none = F.lit(None).cast("double")
    outside = marked.groupBy(*by).agg(F.array(*beyond).alias("b")).select(*by, F.inline("b")).filter("c > 0")
    inside = (
        marked.select(*by, F.inline(F.array_compact(F.array(*within))))
        .groupBy(*by, "column", "prob", "inside")
        .agg(F.count("*").alias("c"), F.max("n").alias("n"))
    )
    counted = inside.select(
        *by, "column", "prob", F.lit(1).alias("bucket"), "inside", "c", none.alias("least"), none.alias("most"), "n"
    ).unionByName(outside.withColumn("inside", none))
    keys = [*by, "column", "prob"]
    upto = Window.partitionBy(*keys).orderBy("bucket", "inside").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("prob") * (F.col("n") - 1)
    placed = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("pos", position)

    def value_at(rank: Column) -> Column:
        here = (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
        value = (
            F.when(F.col("bucket") == 1, F.col("inside"))
            .when((F.col("bucket") == 0) & (rank == F.col("upto") - 1), F.col("most"))
            .when((F.col("bucket") == 2) & (rank == F.col("upto") - F.col("c")), F.col("least"))
            .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
        )
        return F.max(F.when(here, value))

    return (
        placed.groupBy(*keys)
        .agg(
            value_at(F.floor("pos")).alias("low"),
            value_at(F.ceil("pos")).alias("high"),
            F.max(F.col("pos") - F.floor("pos")).alias("part"),
        )
        .select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))
    )


def _approximate(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    aggs = [
        F.percentile_approx(present(df, name).cast("double"), wanted, SKETCH_ACCURACY).alias(f"q_{i}")
        for i, name in enumerate(cols)
    ]
    cells = [
        F.struct(F.lit(name).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"q_{i}")[j].alias("value"))
        for i, name in enumerate(cols)
        for j, p in enumerate(probs)
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells))).filter("value is not null")


def quantile_columns(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """The same, one row per group and one array column ``q_i`` per column."""
    table = quantile_table(df, cols, probs, by, approx)
    aggs = []
    for i, name in enumerate(cols):
        picks = [
            F.max(F.when((F.col("column") == name) & (F.col("prob") == float(p)), F.col("value"))) for p in probs
        ]
        aggs.append(F.array(*picks).alias(f"q_{i}"))
    return table.groupBy(*by).agg(*aggs)


def mode_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent present value per column, the smallest on ties: ``mode_i``."""
    cells = [
        F.struct(F.lit(i).alias("i"), present(df, name).cast("string").alias("v")) for i, name in enumerate(cols)
    ]
    counted = (
        df.select(*by, F.inline(F.array(*cells))).filter("v is not null").groupBy(*by, "i", "v").agg(
            F.count("*").alias("c")
        )
    )
    aggs = []
    for i, name in enumerate(cols):
        typed = F.when(F.col("i") == i, F.col("v")).cast(type_of(df, name))
        rank = F.when(F.col("i") == i, F.struct((-F.col("c")).alias("c"), typed.alias("v")))
        aggs.append(F.min(rank)["v"].alias(f"mode_{i}"))
    return counted.groupBy(*by).agg(*aggs)
