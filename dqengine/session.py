"""Session helpers: shared folders and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a folder of one machine would be lost with it, so that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        # a local session's own folder goes with its process
        named = tempfile.mkdtemp(prefix="dqengine-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: no lineage, and its bytes are known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more."""
    jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """While this holds, shuffle files go when the write that needed them ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def size_checked(df: DataFrame) -> DataFrame:
    """A table meant to be the small side of a join, written so that its bytes decide.

    Below ``spark.sql.autoBroadcastJoinThreshold`` the planner sends it to every task. Beyond
    that the join shuffles, and adaptive execution splits a hot key.
    """
    return written(df, "side")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a missing key meeting a missing key; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join group statistics back to the rows; few groups are broadcast, so the rows stay in place."""
    return match_keys(df, size_checked(stats), keys, "left")
