"""Top-k of sums over shared words, by an inverted index with upper bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqengine.session import materialize

# Words of more chunks are common: they are scored inside the task and bounded, the others are joined.
COMMON_CHUNKS = 1000
# Room for sums in another order.
SLACK = 1e-9


def top_pairs(
    postings: DataFrame,
    weights: DataFrame,
    top_k: int,
    least: float,
    search: Callable[..., DataFrame],
) -> DataFrame:
    """``(query_id, chunk_id, score)``: at least the best ``top_k`` chunks of every query that score ``least`` or more.

    ``postings``: ``(word, chunk_id, value)``; ``weights``: ``(query_id, word, weight, norm)``; the score of a
    pair is the sum of weight * value over the words of both, over the query's norm. All numbers are positive.

    Rare words meet their postings in an equi-join, so a pair costs a row only if it shares one; the k-th of these
    sums is the query's threshold. The common words of a query add at most the sum of weight times their largest
    value. So a pair that falls short of the threshold even with that is dropped, the others are completed
    by a join on word and chunk. Pairs without a rare word score what their common words give alone: queries for
    which that can reach the threshold are searched by their distinct sets of common words, over one short
    vector a chunk. The chunks themselves are never copied per query.
    """
    postings = materialize(postings.join(materialize(weights.select("word").distinct()), "word"))
    most = postings.groupBy("word").agg(F.count(F.lit(1)).alias("chunks"), F.max("value").alias("top"))
    asked = materialize(weights.join(materialize(most), "word"))
    rare, common = asked.filter(F.col("chunks") <= COMMON_CHUNKS), asked.filter(F.col("chunks") > COMMON_CHUNKS)
    common = materialize(common.select("query_id", "word", "weight", "top"))
    # the words of one query; sorted, so that queries asking alike share a pattern
    bounds = common.groupBy("query_id").agg(
        F.sum(F.col("weight") * F.col("top")).alias("more"), F.sort_array(F.collect_list(F.struct("word", "weight"))).alias("words")
    )
    norms = weights.groupBy("query_id").agg(F.first("norm").alias("norm"))
    bounds = materialize(norms.join(bounds, "query_id", "left").withColumn("pattern", F.xxhash64("words")).withColumn("more", F.coalesce("more", F.lit(0.0))))
    met = rare.select("query_id", "word", "weight").join(postings, "word")
    part = materialize(met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("value")).alias("part")))
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("part").desc()))
    floors = part.withColumn("place", kth).filter(F.col("place") <= top_k).filter(F.col("place") == top_k)
    bounds = bounds.join(floors.select("query_id", F.col("part").alias("kth")), "query_id", "left")
    # in the units of the sums
    floor = F.greatest(F.coalesce("kth", F.lit(0.0)), F.lit(float(least)) * F.col("norm")) - SLACK
    bounds = materialize(bounds.withColumn("floor", floor).drop("kth"))
    kept = part.join(bounds.select("query_id", "norm", "more", "floor"), "query_id").filter(F.col("part") + F.col("more") >= F.col("floor"))
    kept = materialize(kept.select("query_id", "chunk_id", "part", "norm"))
    frequent = materialize(postings.join(common.select("word").distinct(), "word"))
    wanted = kept.select("query_id", "chunk_id").join(common.select("query_id", "word", "weight"), "query_id")
    added = wanted.join(frequent, ["word", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("value")).alias("added"))
    whole = kept.join(added, ["query_id", "chunk_id"], "left")
    found = whole.select("query_id", "chunk_id", ((F.col("part") + F.coalesce("added", F.lit(0.0))) / F.col("norm")).alias("score"))
    alone = _alone(bounds, frequent, top_k, search)
    # a pair with rare words scores more than its common ones alone
    both = found.unionByName(alone).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return both.filter(F.col("score") >= least)


def _alone(bounds: DataFrame, frequent: DataFrame, top_k: int, search: Callable[..., DataFrame]) -> DataFrame:
    """Scores by common words alone, for the queries in which these can reach the threshold."""
    wide = bounds.filter("words is not null").filter(F.col("more") >= F.col("floor"))
    patterns = wide.groupBy("pattern").agg(F.first("words").alias("words"))
    patterns = materialize(patterns.select(F.col("pattern").alias("query_id"), F.col("words.word").alias("words"), F.col("words.weight").alias("weights")))
    each = patterns.select("query_id", F.explode("words").alias("word"))
    size = each.agg(F.count_distinct("query_id").alias("n"), F.count_distinct("word").alias("v")).first()
    vectors = frequent.groupBy("chunk_id").agg(F.collect_list(F.struct("word", "value")).alias("held"))
    vectors = vectors.select("chunk_id", F.col("held.word").alias("words"), F.col("held.value").alias("values"))

    def prepare(some: pa.Table) -> tuple:
        words, weights = some.column("words").to_pylist(), some.column("weights").to_pylist()
        vocabulary = sorted({w for ws in words for w in ws})
        place = {w: i for i, w in enumerate(vocabulary)}
        matrix = np.zeros((len(vocabulary), len(words)))
        for j, (ws, xs) in enumerate(zip(words, weights)):
            matrix[[place[w] for w in ws], j] = xs
        return pa.array(vocabulary, pa.string()), matrix

    def score(batch: pa.RecordBatch, ready: tuple) -> np.ndarray:
        vocabulary, matrix = ready
        words, values = batch.column("words"), batch.column("values")
        at = pc.index_in(words.flatten(), value_set=vocabulary)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        cell = row[known] * len(vocabulary) + at.drop_null().to_numpy(zero_copy_only=False)
        flat = np.bincount(cell, np.asarray(values.flatten())[known], minlength=batch.num_rows * len(vocabulary))
        return flat.reshape(batch.num_rows, len(vocabulary)) @ matrix

    scored = search(vectors, patterns, size["n"] * size["v"], prepare, score, top_k, float(np.nextafter(0.0, 1.0)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    scored = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k)
    named = scored.select(F.col("query_id").alias("pattern"), "chunk_id", F.col("score").alias("sum"))
    return wide.select("query_id", "pattern", "norm").join(named, "pattern").select("query_id", "chunk_id", (F.col("sum") / F.col("norm")).alias("score"))
