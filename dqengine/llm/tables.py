"""Helpers on DataFrames: written tables, bits of a learning split, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.session import discard
from dqengine.session import written as stored

__all__ = ["stored", "discard", "fold", "ascii_lower", "ranked", "WORD", "BLANK_CHARS"]

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts
BLANK_CHARS = " \t\n\x0b\f\r"


def fold(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text modulo ``buckets``; a missing id falls in no bucket (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), "utf-8")), F.lit(buckets)), F.lit(-1)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the quick way where a text has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in a total order without sorting them all in one task.

    Rows are dealt by range, numbered within their range, and shifted by the sizes of
    the ranges before; only those sizes (one row a range) meet in one place.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = df.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    dealt = stored(dealt.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = Window.partitionBy("__range").orderBy(*keys)
    return (
        dealt.join(sizes, "__range")
        .withColumn(name, F.col("__before") + F.row_number().over(local) - 1)
        .drop("__range", "__before", *keys)
    )
