"""Writing tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.operators.stats import quoted


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """The output format of every plan; parents of the path are made."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """Texts keep their outer blanks; a quote within a text is doubled."""
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    df.write.mode(mode).options(header=True, sep=sep, **whole).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, checksum)``, whatever the order and layout of the rows."""
    every = F.sum(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(every, F.lit(0)).cast("string").alias("checksum"))


def save_corpus(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, as a new version of the corpus at ``path``.

    The data is written aside first, read back and counted; only then one small manifest file, which appears
    at once or not at all, names the version. A crash before that leaves the version before it in force.
    """
    spark = chunks.sparkSession
    version = uuid.uuid4().hex
    chunks.write.parquet(f"{path}/data/{version}")
    back = spark.read.schema(chunks.schema).parquet(f"{path}/data/{version}")
    row = fingerprint(back).select(F.lit(version).alias("version"), F.lit(time.time_ns()).alias("written"), F.lit(chunks.schema.json()).alias("schema"), "*")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
