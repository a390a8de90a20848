"""Reading tables: CSV by a list of strategies, JSON, stored corpora."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.numbers import PLAIN_NUMBER
from dqengine.functions.text import trim_text
from dqengine.operators.nulls import NULL_TOKENS, null_tokens
from dqengine.operators.profile import mixed_types
from dqengine.operators.stats import quoted
from dqengine.sources.records import read_json_array, read_quoted_csv
from dqengine.sources.sinks import fingerprint, save_corpus

# Delimiters the sniffing strategy chooses from.
DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Strategy:
    """One way to read a CSV: ``sep=None`` sniffs; ``infer=False`` keeps texts.

    ``multiline`` lets a quoted text run over several lines.
    """

    name: str
    sep: str | None = ","
    tokens: tuple[str, ...] = ()
    infer: bool = True
    multiline: bool = False


# The order in which ways to read are tried.
DEFAULT = (
    Strategy("default", ",", NULL_TOKENS),
    Strategy("sep=','", ",", NULL_TOKENS, multiline=True),
    Strategy("auto-detect", None, NULL_TOKENS, multiline=True),
    Strategy("dtype=str", ",", NULL_TOKENS, False),
)


@dataclass(frozen=True)
class Loaded:
    """A table and the way it was read."""

    df: DataFrame
    method: str


def _texts(spark: SparkSession, path: str, sep: str, multiline: bool) -> DataFrame:
    options = {"header": True, "sep": sep, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    lines = spark.read.options(**options).csv(path)
    return read_quoted_csv(spark, path, lines.columns, sep) if multiline else lines


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that cuts the header into most fields; every row is held to that width when it is read."""
    return max(DELIMITERS, key=lambda d: len(_texts(spark, path, d, False).columns))


def _unbalanced(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes: a quoted text runs over its end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _read(spark: SparkSession, path: str, how: Strategy) -> DataFrame:
    best = sniff_delimiter(spark, path)
    sep = how.sep or best
    running = _unbalanced(spark, path)
    if running and not how.multiline:
        raise ValueError(f"{path} has quoted line breaks")
    texts = _texts(spark, path, sep, running)
    if len(texts.columns) == 1 and best != sep:
        raise ValueError(f"{path} is not separated by {sep!r}")
    clean = null_tokens(texts, how.tokens) if how.tokens else texts
    if how.infer:
        return typed(clean)
    # a row of another width fails here, before the strategy is accepted; choosing types reads every row too
    texts.select(F.max(F.hash(*[F.col(quoted(c)) for c in texts.columns]))).first()
    return clean


def typed(df: DataFrame) -> DataFrame:
    """Cast text columns whose every value is a whole number or a number; one aggregation.

    Spark's reader knows one null token, so texts are read first, tokens are
    taken out, and only then types are chosen. Dates stay text, as in pandas.
    """
    if not df.columns:
        return df
    found = []
    for name in df.columns:
        c = trim_text(F.col(quoted(name)))
        whole = F.bool_and(c.rlike("^[+-]?[0-9]{1,18}$"))
        found.append(F.struct(whole.alias("int"), F.bool_and(c.rlike(PLAIN_NUMBER)).alias("double")))
    # NULL where a column has no value at all: it stays text
    types = {c: "bigint" if s["int"] else "double" for c, s in zip(df.columns, df.agg(*found).first()) if s["double"]}
    return df.withColumns({c: trim_text(F.col(quoted(c))).try_cast(t) for c, t in types.items()})


def load_csv(spark: SparkSession, path: str, strategies: Sequence[Strategy] = DEFAULT) -> Loaded:
    """Try the strategies in order; the first that reads every row wins."""
    failures = (PySparkException, Py4JError, ValueError)
    last: Exception | None = None
    for how in strategies:
        try:
            return Loaded(_read(spark, path, how), how.name)
        except failures as error:
            last = error
    raise ValueError(f"no strategy could read {path}") from last


def read_csv(spark: SparkSession, path: str, strategies: Sequence[Strategy] = DEFAULT) -> DataFrame:
    return load_csv(spark, path, strategies).df


def read_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A JSON array of objects in one file, or with ``multiline=False`` one object per line.

    An array is cut into its objects by many tasks. Files of another kind (one object over several lines) are one
    task each.
    """
    try:
        rows = read_json_array(spark, path) if multiline else None
        if rows is not None:
            return rows
        return spark.read.option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    except PySparkException as error:
        raise ValueError(f"cannot read JSON {path}") from error


def load_source(spark: SparkSession, path: str, source_type: str = "csv") -> Loaded:
    readers: dict[str, Callable[[], Loaded]] = {
        "csv": lambda: load_csv(spark, path),
        "json": lambda: Loaded(read_json(spark, path), "json"),
        "json_lines": lambda: Loaded(read_json(spark, path, False), "json_lines"),
        "parquet": lambda: Loaded(spark.read.parquet(path), "parquet"),
    }
    if not path:
        raise ValueError("no path given")
    if source_type not in readers:
        raise ValueError(f"source type {source_type!r} is not supported")
    return readers[source_type]()


def read_source(spark: SparkSession, path: str, source_type: str = "csv") -> DataFrame:
    return load_source(spark, path, source_type).df


def load_report(df: DataFrame, method: str) -> DataFrame:
    """One row ``(method_used, warnings)``; the warning names the mixed-type columns."""
    mixed = mixed_types(df).agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("names"))
    return mixed.select(
        F.lit(method).alias("method_used"),
        F.when(F.col("names") != "", F.concat(F.lit("mixed types: "), F.col("names"))).otherwise("").alias("warnings"),
    )


def stored_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a corpus whose rows are all there and unchanged."""
    versions = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("written")).collect()  # one row a version
    for v in versions:
        schema = T.StructType.fromJson(json.loads(v["schema"]))
        found = spark.read.schema(schema).parquet(f"{path}/data/{v['version']}")
        try:
            if tuple(fingerprint(found).first()) == (v["n_rows"], v["checksum"]):
                return found
        except (PySparkException, Py4JError):
            continue
    raise ValueError(f"no whole version of a corpus at {path}")


def load_corpus(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The stored corpus; where it is missing, damaged or unreadable it is built, saved and read."""
    try:
        return stored_corpus(spark, path)
    except (PySparkException, ValueError):
        if build is None:
            raise
    save_corpus(build(), path)
    return stored_corpus(spark, path)
