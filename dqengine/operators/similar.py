"""Near duplicates among long texts: MinHash bands, exact verification, classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions import text as tx
from dqengine.operators import stats as st
from dqengine.operators.dedup import components
from dqengine.session import discard, materialize, swept, written

SHINGLE_WORDS = 5
LEAST_SIMILAR = 0.8
# A band is the hash of ROWS least values; texts of similarity s miss every band with (1 - s**ROWS)**BANDS.
ROWS, BANDS = 4, 32
# Bands of more texts of different classes are split by further least values.
HOT_BAND = 1000
SPLIT_BANDS = 16
# Bits of a sketch, a power of two.
SKETCH_BITS = 2048
# Shingles whose least values are taken at once inside a task.
AT_ONCE = 1 << 20


def shingles(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``size`` words, each once; of all words where there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(runs))


def band_keys(hashes: Column, bands: int, seed: int) -> Column:
    """One key per band of a set of hashes; equal keys mean equal least values in the same band."""

    def keys(lists: pa.Array) -> pa.Array:
        draw = np.random.default_rng(seed)
        flips, factors = (draw.integers(1, 1 << 63, (bands, ROWS), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten().to_numpy().view(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(lists), bands), np.uint64)
        full = np.flatnonzero(sizes)
        start = 0
        while start < len(full):
            stop = max(int(np.searchsorted(bounds[full], bounds[full[start]] + AT_ONCE)), start + 1)
            mine = full[start:stop]
            part = flat[bounds[mine[0]] : bounds[mine[-1] + 1]]
            for b in range(bands):
                key = np.full(len(mine), b + 1, np.uint64)
                for flip, factor in zip(flips[b], factors[b]):
                    x = (part ^ flip) * factor
                    x ^= x >> np.uint64(29)
                    key = (key ^ np.minimum.reduceat(x, bounds[mine] - bounds[mine[0]])) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                out[mine, b] = key
            start = stop
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * bands
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))

    return F.arrow_udf(keys, "array<long>")(hashes)


def sketches(hashes: Column) -> Column:
    """``SKETCH_BITS`` bits of a set of hashes: bit i tells whether an odd number of them falls on i.

    The bits in which two sets differ are the odd ones of what one of them alone holds, so they are
    never more than that.
    """

    def bits(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        place = lists.flatten().to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(lists), SKETCH_BITS // 8), np.uint8)
        for start in range(0, len(lists), 256):
            stop = min(start + 256, len(lists))
            at = np.repeat(np.arange(stop - start), sizes[start:stop]) * SKETCH_BITS
            times = np.bincount(at + place[bounds[start] : bounds[stop]].astype(np.int64), minlength=(stop - start) * SKETCH_BITS)
            out[start:stop] = np.packbits((times & 1).astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * (SKETCH_BITS // 64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))

    return F.arrow_udf(bits, "array<long>")(hashes)


def _may_reach(least: float, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """False where sizes or sketches (two columns each) prove that a similarity of ``least`` is out of reach."""
    (size_a, bits_a), (size_b, bits_b) = a, b
    apart = sum((F.bit_count(F.col(bits_a)[i].bitwiseXOR(F.col(bits_b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    most = (1 - least) / (1 + least) * (F.col(size_a) + F.col(size_b)) + 1e-6  # what one of the two alone may hold
    return (F.least(size_a, size_b) >= least * F.greatest(size_a, size_b)) & (apart <= most)


def _sifted(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` that may reach ``least``."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("bits_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("bits_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.filter(_may_reach(least, ("size_a", "bits_a"), ("size_b", "bits_b"))).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, similarity)``: exact Jaccard similarity of the shingles of each pair."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.withColumn("similarity", common / (F.size("ha") + F.size("hb") - common)).drop("ha", "hb")


def _mixed(rows: DataFrame) -> DataFrame:
    """``(band, n)`` of the bands with nodes of different classes."""
    bands = rows.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"))
    return bands.filter("low < high").select("band", "n")


def near_documents(
    df: DataFrame,
    id_col: str,
    column: str,
    words: int = SHINGLE_WORDS,
    least: float = LEAST_SIMILAR,
) -> DataFrame:
    """Rows ``(id, class_id, class_size)``: texts linked by a Jaccard similarity of at least ``least``, step by step.

    Equal texts are one node with many members, so copies cost a row each. Nodes meet in MinHash bands. Every node of
    a band is first compared exactly with the band's least node: a band of near copies
    becomes one class without its pairs. Then only nodes of one band that are still in different
    classes are compared, those whose sizes and distances to the least node allow the similarity;
    a band with many of these is split by further least values. So no pair within a class is ever emitted.
    Sizes and sketches rule out nearly all pairs below the similarity before any is written (provably, see ``sketches``).

    With the default bands a pair of similarity 0.8 is missed with a probability of 5e-8; all that meet and are not ruled
    out are verified exactly. All joins are merge joins: every side grows with the texts, so none is sent through the driver.
    The texts are read twice, so that shingles are only written for nodes that share a band; tables and shuffles go as
    soon as they are used.
    Texts are split into words at blanks and lower-cased. A row without a
    text or word is a class of its own; rows without an id take no part; rows of one id are one member.
    """
    with swept(df.sparkSession):
        return _near_documents(df.select(F.col(st.quoted(id_col)).alias("id"), F.col(st.quoted(column)).alias("text")), words, least)


def _near_documents(texts: DataFrame, words: int, least: float) -> DataFrame:
    texts = texts.filter("id is not null").withColumn("words", tx.words(F.col("text")))
    texts = texts.withColumn("node", F.when(F.size("words") > 0, F.unhex(F.md5(F.array_join("words", " ")))))
    marked = written(texts.select("id", "node", band_keys(shingles(F.col("words"), words), BANDS, 1).alias("bands")), "marked")
    members = written(marked.select("id", "node"), "members")
    banded = marked.filter("node is not null").select("node", "bands").dropDuplicates(["node"])
    banded = written(banded.select("node", F.explode("bands").alias("band")), "bands")
    discard(marked)
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared.select(F.col("band").alias("of"), "first"), "shared")
    met = written(banded.join(shared.hint("merge"), F.col("band") == F.col("of")).drop("of"), "met")
    for table in (banded, shared):
        discard(table)
    # one row of each node that met another: the copies of a text are dealt by their ids
    heads = members.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    heads = written(heads.join(met.select("node").distinct().hint("merge"), "node", "left_semi"), "heads")
    found = texts.select("id", "node", "text").join(heads.hint("merge"), ["id", "node"], "left_semi").dropDuplicates(["node"])
    found = found.withColumn("words", tx.words(F.col("text"))).select("node", shingles(F.col("words"), words).alias("hashes"))
    sets = written(found.select("node", F.size("hashes").alias("size"), "hashes", sketches(F.col("hashes")).alias("sketch")), "sets")
    discard(heads)
    led = met.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    led = materialize(_compared(written(_sifted(led, sets, least), "led"), sets))
    near = led.filter(F.col("similarity") >= least).select("a", "b")
    classes = materialize(components(near, "a", "b"))
    # what of a band is still apart: the distance to the first node, where it is known, bounds the distance of two others
    led = led.select(F.col("a").alias("first"), F.col("b").alias("node"), "similarity")
    apart = met.join(led.hint("merge"), ["first", "node"], "left")
    apart = apart.join(classes.withColumnRenamed("id", "node").hint("merge"), "node", "left")
    known = F.when(F.col("node") == F.col("first"), F.lit(1.0)).otherwise(F.col("similarity"))
    apart = written(apart.select("band", "node", F.coalesce("component", "node").alias("class"), known.alias("similarity")), "apart")
    discard(met)
    several = apart.join(materialize(_mixed(apart)).hint("merge"), "band")
    hot = written(several.filter(F.col("n") > HOT_BAND), "hot")
    finer = sets.select("node", "hashes").join(hot.select("node").distinct().hint("merge"), "node", "left_semi")
    finer = finer.select(F.col("node").alias("of"), F.explode(band_keys(F.col("hashes"), SPLIT_BANDS, 2)).alias("more"))
    split = hot.join(finer.hint("merge"), F.col("node") == F.col("of")).withColumn("band", F.xxhash64("band", "more")).drop("of", "more", "n")
    split = written(split, "split")
    split = split.join(_mixed(split).drop("n").hint("merge"), "band", "left_semi")
    left = several.filter(F.col("n") <= HOT_BAND).drop("n").unionByName(split)
    left = written(left.join(sets.select("node", "size", "sketch").hint("merge"), "node"), "left")
    right = left.withColumnsRenamed({c: f"{c}_b" for c in left.columns})
    able = F.coalesce(F.abs(F.col("similarity") - F.col("similarity_b")) <= 1 - least + 1e-9, F.lit(True))
    able = able & _may_reach(least, ("size", "sketch"), ("size_b", "sketch_b"))
    pairs = left.hint("merge").join(right, (F.col("band") == F.col("band_b")) & (F.col("class") < F.col("class_b")) & able)
    pairs = written(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    for table in (apart, hot, split, left):
        discard(table)
    more = _compared(pairs, sets).filter(F.col("similarity") >= least).select("a", "b")
    classes = materialize(components(near.unionByName(more), "a", "b"))
    for table in (pairs, sets):
        discard(table)
    placed = members.join(classes.withColumnRenamed("id", "of").hint("merge"), F.col("node") == F.col("of"), "left").select("id", F.coalesce("component", "node").alias("node"))
    # rows of one id may hold different texts: they join what these belong to
    linked = _merged(placed)
    discard(members)
    sizes = linked.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return linked.join(sizes.hint("merge"), "class_id").select("id", "class_id", "class_size")


def _merged(placed: DataFrame) -> DataFrame:
    """``(id, class_id)`` once per id, classes named by their least id."""
    least = placed.filter("node is not null").groupBy("node").agg(F.min("id").alias("head"))
    least = least.withColumnRenamed("node", "of").hint("merge")
    named = materialize(placed.join(least, F.col("node") == F.col("of"), "left").select("id", F.coalesce("head", "id").alias("head")).distinct())
    twice = named.groupBy("id").agg(F.min("head").alias("low"), F.max("head").alias("high")).filter("low < high")
    links = named.join(twice.select(F.col("id").alias("of"), "low").hint("merge"), F.col("id") == F.col("of")).filter("head != low")
    joined = components(links, "low", "head")
    heads = named.groupBy("id").agg(F.min("head").alias("head"))
    return heads.join(joined.withColumnRenamed("id", "of").hint("merge"), F.col("head") == F.col("of"), "left").select("id", F.coalesce("component", "head").alias("class_id"))
