"""Exact top-k of inner products over clusters of vectors, with bounds that skip whole clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from dqengine.session import materialize

CLUSTER_ROWS = 1024  # vectors of a cluster on average
MOST_CLUSTERS = 1024
SAMPLE = 20_000  # vectors from which the centres are learnt
PART_ROWS = 4096  # vectors of a cluster that one task scores together
BATCH_ROWS = 4096  # queries that meet them together
EARLY_ROWS = 2048  # vectors seen before a query has its threshold
SLACK = 1e-7  # room for rounding in bounds


@dataclass(frozen=True)
class Clusters:
    """``rows``: (chunk_id, vector, cluster, part). Centre, radius and size of every cluster; radii cover all rows."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _stack(lists: pa.Array, width: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), width)


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


def build(vectors: DataFrame, width: int) -> Clusters:
    """Cluster ``(chunk_id, vector)``. The driver holds a sample of SAMPLE vectors and a row a cluster."""
    vectors = materialize(vectors)
    sample = vectors.select("vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toArrow()
    points = np.concatenate([np.zeros((0, width)), *[_stack(c, width) for c in sample.column("vector").chunks]])
    count = int(min(max(-(-vectors.count() // CLUSTER_ROWS), 1), MOST_CLUSTERS))
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(1).permutation(len(distinct))[:count]] if len(distinct) else np.zeros((1, width))
    for _ in range(8 if len(points) else 0):
        near, _ = _nearest(points, centres)
        size = np.bincount(near, minlength=len(centres))[:, None]
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(size > 0, total / np.maximum(size, 1), centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = _nearest(_stack(batch.column("vector"), width), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cluster", "far"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("far", T.DoubleType())])
    placed = materialize(vectors.mapInArrow(place, schema))
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres))
    for r in placed.groupBy("cluster").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row a cluster
        radii[r["cluster"]], sizes[r["cluster"]] = r["far"], r["n"]
    parts = F.element_at(F.array(*[F.lit(int(n // PART_ROWS) + 1) for n in sizes]), F.col("cluster") + 1)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")  # a hot cluster is many parts
    return Clusters(placed.select("chunk_id", "vector", "cluster", part.alias("part")), centres, radii, sizes)


def visits(index: Clusters, queries: DataFrame, late: bool) -> DataFrame:
    """``(query_id, cluster)`` of ``(query_id, vector, floor)``.

    Early: the clusters with the highest bounds, until EARLY_ROWS vectors are seen. Late: all others whose bound
    reaches the query's floor. A bound is the product with the centre plus the query's length times the radius.
    """
    centres, radii, sizes = index.centres, index.radii, index.sizes
    schema = T.StructType([queries.schema["query_id"], T.StructField("cluster", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _stack(batch.column("vector"), centres.shape[1])
            bound = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii + SLACK * (1 + np.linalg.norm(q, axis=1)[:, None])
            order = np.argsort(-bound, axis=1, kind="stable")
            seen = np.cumsum(sizes[order], axis=1) - sizes[order]
            sorted_bound = np.take_along_axis(bound, order, 1)
            floor = batch.column("floor").to_numpy()[:, None]
            wanted = (sorted_bound >= floor) & (sizes[order] > 0) & ((seen >= EARLY_ROWS) if late else (seen < EARLY_ROWS))
            who, at = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(who)), pa.array(order[who, at], pa.int32())], names=["query_id", "cluster"])

    return queries.select("query_id", "vector", "floor").mapInArrow(choose, schema)


def _batched(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """Queries in batches (``lot``) of about BATCH_ROWS. Those with the same best clusters share one, so that a batch visits few."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_stack(batch.column("vector"), centres.shape[1]) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "near"])

    placed = materialize(queries.mapInArrow(best, T.StructType([*queries.schema.fields, T.StructField("near", T.IntegerType())])))
    counts = np.zeros(len(centres))
    for r in placed.groupBy("near").count().collect():  # one row a cluster
        counts[r["near"]] = r["count"]
    parts = np.maximum(np.ceil(counts / BATCH_ROWS), 1).astype(int)
    share = np.cumsum(counts / parts / BATCH_ROWS)
    first = np.floor(share).astype(int) + np.concatenate([[0], np.cumsum(parts - 1)[:-1]])
    of = [F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("near") + 1) for xs in (first, parts)]
    return placed.withColumn("lot", (of[0] + F.pmod(F.xxhash64("query_id"), of[1])).cast("int")).drop("near")


def inner_products(vectors: DataFrame, queries: DataFrame, width: int, top_k: int, least: float) -> DataFrame:
    """``(query_id, chunk_id, score)``: at least the best ``top_k`` of every query that score ``least`` or more.

    ``vectors``: (chunk_id, vector), ``queries``: (query_id, vector), arrays of ``width`` doubles. The clusters seen first
    give each query its threshold, the k-th score found; a cluster whose bound is
    below that, or below ``least``, is skipped with all its vectors. The result is that of all pairs. A vector
    meets a batch of queries only in the clusters that one of them visits.
    """
    index = build(vectors, width)
    asked = _batched(queries, index.centres).withColumn("floor", F.lit(float(least)))
    asked = materialize(asked)
    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return schema_table([pa.nulls(0, f.type) for f in arrow])
        x, q = (np.concatenate([_stack(c, width) for c in t.column("vector").chunks]) for t in (rows, some))
        names = rows.column("chunk_id").to_numpy()
        by = np.argsort(names.astype(str) if names.dtype == object else names, kind="stable")
        scores = q @ x[by].T
        compared = np.round(scores, 9)
        cut = np.maximum(some.column("floor").to_numpy() - 1e-8, least - 1e-8)[:, None]
        if len(by) > top_k:
            cut = np.maximum(cut, np.partition(compared, len(by) - top_k, axis=1)[:, [len(by) - top_k]])
        who, at = np.nonzero((compared >= cut) & (scores >= least))
        order = np.lexsort((at, -compared[who, at], who))
        who, at = who[order], at[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < top_k
        who, at = who[first], at[first]
        return schema_table([some.column("query_id").take(pa.array(who)), rows.column("chunk_id").take(pa.array(by[at])), pa.array(scores[who, at])])

    def schema_table(columns: list) -> pa.Table:
        return pa.Table.from_arrays(columns, schema=arrow)

    def visited(of: DataFrame, late: bool) -> DataFrame:
        calls = materialize(visits(index, of, late)).join(of, "query_id")
        places = index.rows.select("cluster", "part").distinct().withColumnsRenamed({"cluster": "at", "part": "within"})
        calls = calls.join(places, F.col("cluster") == F.col("at")).select("at", "within", F.col("lot").alias("batch"), "query_id", "vector", "floor")
        met = index.rows.join(calls.select(F.col("at").alias("cluster"), F.col("batch").alias("lot")).distinct(), "cluster")
        both = met.groupBy("cluster", "part", "lot").cogroup(calls.groupBy("at", "within", "batch"))
        return materialize(both.applyInArrow(score, schema))

    early = visited(asked, False)
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    floors = early.withColumn("place", kth).filter(F.col("place") <= top_k).filter(F.col("place") == top_k)
    floors = materialize(floors.select("query_id", F.col("score").alias("kth")))
    again = asked.join(floors, "query_id", "left").withColumn("floor", F.greatest("floor", F.coalesce(F.col("kth") - 1e-8, F.col("floor")))).drop("kth")
    return early.unionByName(visited(materialize(again), True))
