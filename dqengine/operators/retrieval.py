"""Passage retrieval in batch: a table of queries against a table of chunks.

Queries are ``(query_id, text)`` or ``(query_id, vector)``; chunks are
``(chunk_id, content, source, title, category)`` or ``(chunk_id, vector)``;
results are ``(query_id, chunk_id, score, rank)``.

Scores are compared after rounding to 9 decimals and then by chunk id, so the
order does not depend on how the sums were split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from dqengine.functions import text as tx
from dqengine.operators import clusters, inverted
from dqengine.session import materialize, size_checked

# Retrieval settings.
TOP_K = 10
MIN_SIMILARITY = 0.3
DENSE_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
PACK_FLOOR = 0.05
MAX_CONTEXT = 4000
NOTHING_FOUND = "No relevant documentation found."
PART_BREAK = "\n---\n"
SPARSE_WEIGHT, FUSED_DENSE_WEIGHT = 0.6, 0.4
MIN_SPARSE, MIN_DENSE = 5.0, 0.7
BM25_K1, BM25_B = 1.2, 0.75
DOMAIN_BOOSTS = (("pandas.pydata.org", 1.3), ("docs.python.org", 1.2))
TITLE_WORDS = ("example", "tutorial", "how to")
TITLE_BOOST = 1.1
MAX_RESULTS = 10

# Vectors of queries held by a task at once: 32 MB of doubles.
QUERY_BLOCK_CELLS = 4_000_000
# Scores computed at once inside a task.
SCORE_CELLS = 4_000_000
# Chunks of a slice, where the queries are more than one block.
SLICE_ROWS = 20_000
# Bytes of query words sent to every task.
WORDS_SENT = 4_000_000


def corpus(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source: Column | None = None,
    title: Column | None = None,
    category: Column | None = None,
) -> DataFrame:
    """One chunk per row of a document table."""
    none = F.lit(None).cast("string")
    return df.select(
        F.col(id_col).alias("chunk_id"),
        F.col(text_col).alias("content"),
        (none if source is None else source).alias("source"),
        (none if title is None else title).alias("title"),
        (none if category is None else category).alias("category"),
    )


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Rows ``(id, chunk_no, content)``: windows of ``size`` characters, each ``overlap`` into the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and below size")
    text = F.col(text_col)
    last = F.greatest(F.length(text) - overlap, F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return df.select(id_col, text_col, F.posexplode(starts).alias("chunk_no", "start")).select(
        id_col, "chunk_no", F.substring(text, F.col("start") + 1, F.lit(size)).alias("content")
    )


def unit(v: Column) -> Column:
    """The vector over its length, in double; a zero vector stays zero."""
    doubles = v.cast("array<double>")
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, doubles).otherwise(F.transform(doubles, lambda x: x / length))


def l2_normalize(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, unit(F.col(column)))


# searching


def _search(
    chunks: DataFrame,
    queries: DataFrame,
    cells: int,
    prepare: Callable[[pa.Table], tuple],
    score: Callable[[pa.RecordBatch, tuple], np.ndarray],
    top_k: int,
    least: float,
) -> DataFrame:
    """``(query_id, chunk_id, score)``: per task and query the best ``top_k`` chunks scoring ``least`` or more.

    ``prepare`` makes of some queries what ``score`` needs; ``score`` gives the scores of a few
    chunks (rows) for those queries (columns). Queries of at most QUERY_BLOCK_CELLS numbers are
    sent to all tasks, which read their chunks in place. More are dealt into blocks of that
    size, and every block meets every slice of the chunks in a task of its own: one
    job however many queries there are, and none of them passes the driver.
    """
    schema = T.StructType(
        [queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def best(asked: pa.Table, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        ready = prepare(asked)
        ids = asked.column("query_id").to_pylist()
        keep = _Best(len(ids), top_k, least)
        step = max(1, SCORE_CELLS // max(1, len(ids), *ready[-1].shape))
        for batch in batches if ids else ():
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                names = part.column("chunk_id").to_numpy(zero_copy_only=False)
                keep.add(names.astype(str) if names.dtype == object else names, score(part, ready))
        q, names, scores = keep.result()
        columns = [[ids[i] for i in q], names.tolist(), scores]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    if cells <= QUERY_BLOCK_CELLS:
        shared = chunks.sparkSession.sparkContext.broadcast(queries.toArrow())  # bounded: one block

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from best(shared.value, batches).to_batches()

        return chunks.mapInArrow(in_place, schema)

    blocks = -(-2 * cells // QUERY_BLOCK_CELLS)
    slices = -(-chunks.count() // SLICE_ROWS)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def hashed(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    left = chunks.select("*", hashed("chunk_id", slices).alias("slice"), every(blocks).alias("block"))
    right = queries.select("*", hashed("query_id", blocks).alias("block"), every(slices).alias("slice"))

    def together(some: pa.Table, asked: pa.Table) -> pa.Table:
        return best(asked, some.to_batches())

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(together, schema)


class _Best:
    """The best ``k`` (score, then id) per query among the chunks of a task."""

    def __init__(self, n_queries: int, k: int, least: float) -> None:
        self.k = k
        self.least = least
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, names: np.ndarray, scores: np.ndarray) -> None:
        compared = np.round(scores, 9)
        row, query = np.nonzero((compared >= self.floor) & (scores >= self.least))
        self.parts.append((query, names[row], compared[row, query], scores[row, query]))
        self.held += len(query)
        if self.held > 4 * self.k * len(self.floor) + 100_000:
            self.cut()

    def cut(self) -> None:
        query, names, compared, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((names, -compared, query))
        query, names, compared, scores = query[order], names[order], compared[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept, full = place < self.k, place == self.k - 1
        self.floor[query[full]] = compared[full]
        self.parts = [(query[kept], names[kept], compared[kept], scores[kept])]
        self.held = int(kept.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.array([], dtype=int), np.array([]), np.array([])
        self.cut()
        query, names, _, scores = self.parts[0]
        return query, names, scores


def _ranked(scored: DataFrame, top_k: int) -> DataFrame:
    """Rank per query by score and id, at most ``top_k``; cut per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


# vectors


def dense_search(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int = TOP_K,
    min_score: float = MIN_SIMILARITY,
    vector: str = "vector",
    normalize: bool = True,
) -> DataFrame:
    """Exact inner product; the best ``top_k`` per query of at least ``min_score``.

    Every task multiplies a bounded block of queries with its own chunks; no pair leaves it
    that did not win there or falls short of ``min_score``.
    """
    queries = queries.select("query_id", F.col(vector).cast("array<double>").alias("vector")).filter("vector is not null")
    if normalize:
        queries = queries.withColumn("vector", unit(F.col("vector")))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    narrow = chunks.select("chunk_id", F.col(vector).alias("vector")).filter("vector is not null")

    def prepare(asked: pa.Table) -> tuple:
        flat = np.concatenate([np.zeros(0), *[np.asarray(c.flatten(), np.float64) for c in asked.column("vector").chunks]])
        return (flat.reshape(max(asked.num_rows, 1), -1),)

    def score(batch: pa.RecordBatch, ready: tuple) -> np.ndarray:
        vectors = np.asarray(batch.column("vector").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
        if normalize:
            length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            vectors = np.divide(vectors, length, out=vectors.copy(), where=length != 0)
        return vectors @ ready[0].T

    cells = size["n"] * (size["width"] or 1)
    if cells > QUERY_BLOCK_CELLS:
        vectors = narrow.select("chunk_id", unit(F.col("vector")).alias("vector") if normalize else F.col("vector").cast("array<double>"))
        return _ranked(clusters.inner_products(vectors, queries, size["width"], top_k, min_score), top_k)
    found = _search(narrow, queries, cells, prepare, score, top_k, min_score)
    return _ranked(found, top_k)


# words


def _query_words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.array_distinct(tx.words(F.col("text"))).alias("words"))


def _word_cells(asked: DataFrame) -> int:
    """Queries times distinct words: the numbers of the matrix that one block would have."""
    words = asked.select("query_id", F.explode("words").alias("word"))
    size = words.agg(F.count_distinct("query_id").alias("n"), F.count_distinct("word").alias("v")).first()
    return size["n"] * size["v"]


def _word_matrix(asked: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The words of some queries, and the weight of each word (row) in each query (column)."""
    words = asked.column("words").to_pylist()
    weights = asked.column("weights").to_pylist()
    vocabulary = sorted({w for ws in words for w in ws})
    place = {w: i for i, w in enumerate(vocabulary)}
    matrix = np.zeros((len(vocabulary), len(words)))
    for j, (ws, xs) in enumerate(zip(words, weights)):
        matrix[[place[w] for w in ws], j] = xs
    return pa.array(vocabulary, pa.string()), matrix


def word_counts(batch: pa.RecordBatch, vocabulary: pa.Array) -> np.ndarray:
    """How often each chunk (row) holds each word of the vocabulary (column)."""
    lists = batch.column("words")
    at = pc.index_in(lists.flatten(), value_set=vocabulary)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    known = at.is_valid().to_numpy(zero_copy_only=False)
    cell = row[known] * len(vocabulary) + at.drop_null().to_numpy(zero_copy_only=False)
    flat = np.bincount(cell, minlength=batch.num_rows * len(vocabulary))
    return flat.reshape(batch.num_rows, len(vocabulary))


# Scores above nothing: a chunk without any of the words does not appear.
ABOVE_ZERO = float(np.nextafter(0.0, 1.0))


def keyword_search(queries: DataFrame, chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Share of the query's distinct words that the chunk has; chunks without any do not appear.

    Words are split by Spark. A task counts the query words in its chunks and
    multiplies them with the block of queries, so a word that every chunk and
    every query has costs no joined row, and only each task's ``top_k`` leave it.
    """
    lists = chunks.filter("content is not null").select("chunk_id", tx.words(F.col("content")).alias("words"))
    asked = _query_words(queries).filter(F.size("words") > 0)
    each = F.transform("words", lambda w: F.lit(1.0)).alias("weights")
    cells = _word_cells(asked)
    if cells > QUERY_BLOCK_CELLS:
        weights = asked.select("query_id", F.explode("words").alias("word"), F.lit(1.0).alias("weight"), F.size("words").cast("double").alias("norm"))
        held = lists.select("chunk_id", F.explode(F.array_distinct("words")).alias("word")).withColumn("value", F.lit(1.0))
        return _ranked(inverted.top_pairs(held, weights, top_k, ABOVE_ZERO, _search), top_k)

    def score(batch: pa.RecordBatch, ready: tuple) -> np.ndarray:
        listed, has = ready
        return ((word_counts(batch, listed) > 0) @ has) / np.maximum(has.sum(axis=0), 1)

    found = _search(lists, asked.select("*", each), cells, _word_matrix, score, top_k, ABOVE_ZERO)
    return _ranked(found, top_k)


def sparse_search(
    queries: DataFrame,
    chunks: DataFrame,
    method: str = "bm25",
    top_k: int = TOP_K,
    min_score: float = MIN_SPARSE,
) -> DataFrame:
    """BM25 or TF-IDF over the query's distinct words; the best ``top_k`` of at least ``min_score``.

    A first pass counts the chunks of each word, combined before the shuffle; the second scores as
    ``keyword_search`` does.
    """
    if method not in ("bm25", "tfidf"):
        raise ValueError(f"method is bm25 or tfidf, not {method!r}")
    lists = chunks.filter("content is not null").select("chunk_id", tx.words(F.col("content")).alias("words"))
    asked = _query_words(queries).filter(F.size("words") > 0)
    each = asked.select("query_id", F.explode("words").alias("word"))
    # words are never empty, so an empty one stands for the chunk itself: one pass counts both
    every = F.concat(F.array_distinct("words"), F.array(F.lit("")))
    held = lists.select(F.size("words").alias("length"), F.explode(every).alias("word"))
    wanted = materialize(each.select("word").union(queries.sparkSession.range(1).select(F.lit(""))).distinct())
    if wanted.agg(F.sum(F.octet_length("word") + 16)).first()[0] <= WORDS_SENT:
        held = held.join(F.broadcast(wanted), "word")
    # beyond that words are counted first: the join then meets one row a word, however common it is
    counted = held.groupBy("word").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    frequent = materialize(counted.join(wanted, "word"))
    total = frequent.filter("word = ''").first()
    n, mean = (total["df"], total["length"] / total["df"]) if total else (0, 0.0)
    df = F.coalesce("df", F.lit(0))
    # a word that no chunk has meets no count, so its weight is free
    idf = F.log1p((n - df + 0.5) / (df + 0.5)) if method == "bm25" else F.log(F.lit(float(max(n, 1))) / F.greatest(df, F.lit(1)))
    weighted = each.join(frequent.select("word", "df"), "word", "left").select("query_id", "word", idf.alias("weight"))
    cells = _word_cells(asked)
    if cells > QUERY_BLOCK_CELLS:
        counts = lists.select("chunk_id", F.size("words").alias("length"), F.explode("words").alias("word"))
        counts = counts.groupBy("word", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("length").alias("length"))
        whole = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(float(mean) or 1.0)))
        held = counts.select("word", "chunk_id", (whole if method == "bm25" else F.col("tf")).alias("value"))
        weights = weighted.filter("weight > 0").withColumn("norm", F.lit(1.0))
        return _ranked(inverted.top_pairs(held, weights, top_k, max(min_score, ABOVE_ZERO), _search), top_k)
    weighted = weighted.select("query_id", F.struct("word", "weight").alias("w"))
    weighted = weighted.groupBy("query_id").agg(F.collect_list("w").alias("w"))  # the words of one query
    weighted = materialize(weighted.select("query_id", F.col("w.word").alias("words"), F.col("w.weight").alias("weights")))

    def score(batch: pa.RecordBatch, ready: tuple) -> np.ndarray:
        listed, weights = ready
        tf = word_counts(batch, listed).astype(np.float64)
        if method == "bm25":
            length = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)[:, None]
            tf = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))
        return tf @ weights

    found = _search(lists, weighted, cells, _word_matrix, score, top_k, max(min_score, ABOVE_ZERO))
    return _ranked(found, top_k)


# combining


def combine(
    dense: DataFrame, keyword: DataFrame, top_k: int = TOP_K, w_dense: float = DENSE_WEIGHT, w_kw: float = KEYWORD_WEIGHT
) -> DataFrame:
    """Weighted sum per query and chunk; a missing side adds nothing."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    k = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"))
    both = d.join(k, ["query_id", "chunk_id"], "full_outer")
    zero = F.lit(0.0)
    score = F.coalesce("dense_score", zero) * w_dense + F.coalesce("keyword_score", zero) * w_kw
    return _ranked(both.select("query_id", "chunk_id", score.alias("score")), top_k)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int = TOP_K,
    w_dense: float = DENSE_WEIGHT,
    w_kw: float = KEYWORD_WEIGHT,
    min_score: float = MIN_SIMILARITY,
) -> DataFrame:
    """Vector search twice as deep as keyword search, added up.

    Without vectors on both sides the keyword search stands in for the vector search.
    """
    if "vector" in queries.columns and "vector" in chunks.columns:
        keyword = keyword_search(queries, chunks, top_k)
        dense = dense_search(queries, chunks, 2 * top_k, min_score)
    else:
        dense = materialize(keyword_search(queries, chunks, 2 * top_k))
        keyword = dense.filter(F.col("rank") <= top_k)
    return combine(dense, keyword, top_k, w_dense, w_kw)


def _beside_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with title and content. Counted first: few results are sent to the chunks, not the reverse."""
    return chunks.select("chunk_id", "title", "content").join(size_checked(results), "chunk_id")


def pack_context(
    results: DataFrame, chunks: DataFrame, queries: DataFrame | None = None, max_length: int = MAX_CONTEXT
) -> DataFrame:
    """Rows ``(query_id, context)``: the best chunks in order, up to ``max_length`` characters.

    Chunks below the floor are skipped; packing stops at the first that would
    pass the limit. If none fits, the best chunk alone. With ``queries`` given,
    those without results say so.
    """
    title = F.coalesce("title", F.lit("Unknown"))
    part = F.concat(F.lit("["), title, F.lit("]\n"), F.col("content"), F.lit("\n"))
    parts = _beside_chunks(results, chunks).select("query_id", "rank", "score", part.alias("part"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("score") >= PACK_FLOOR
    placed = parts.withColumn("total", F.sum(F.when(fits, F.length("part")).otherwise(0)).over(upto))
    taken = F.when(fits & (F.col("total") <= max_length), F.struct("rank", "part"))
    # at most top_k parts per query
    packed = placed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(taken)).alias("parts"), F.min_by("part", "rank").alias("first")
    )
    context = F.when(
        F.size("parts") > 0, F.array_join(F.transform("parts", lambda p: p["part"]), PART_BREAK)
    ).otherwise(F.col("first"))
    out = packed.select("query_id", context.alias("context"))
    if queries is not None:
        asked = queries.select("query_id").distinct()
        out = asked.join(out, "query_id", "left").select(
            "query_id", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context")
        )
    return out


def search_many(
    queries: DataFrame,
    chunks: DataFrame,
    max_queries: int | None = None,
    max_length: int = 800,
    top_k: int = 8,
    min_score: float = 0.1,
    heading: str = "\n\nRelevant Documentation:\n",
) -> DataFrame:
    """Rows ``(query_id, document)`` for all queries that found anything, or for the first ``max_queries``."""
    first = queries if max_queries is None else queries.orderBy("query_id").limit(max_queries)
    results = hybrid_search(first, chunks, top_k, min_score=min_score)
    packed = pack_context(results, chunks, None, max_length)
    text = F.concat(F.lit("Query: "), F.col("text"), F.lit(heading), F.col("context"))
    return first.join(packed, "query_id").select("query_id", text.alias("document"))


def fuse(
    sparse: DataFrame, dense: DataFrame, ws: float = SPARSE_WEIGHT, wd: float = FUSED_DENSE_WEIGHT, scale: bool = False
) -> DataFrame:
    """All sparse rows, then dense rows of urls the query's sparse rows do not have.

    Rows carry ``query_id, url, title, sparse_score, dense_score``. ``scale``
    brings each score to 0..1 per query first; their ranges differ otherwise.
    """
    keys = ["query_id", "url"]
    sparse = sparse.withColumn("source_type", F.lit("documentation"))
    rest = dense.join(sparse.select(*keys), keys, "left_anti").withColumn("source_type", F.lit("community"))
    both = sparse.unionByName(rest)
    if scale:
        ends = both.groupBy("query_id").agg(
            *[f(c).alias(f"__{n}_{c}") for c in ("sparse_score", "dense_score") for n, f in (("lo", F.min), ("hi", F.max))]
        )
        both = both.join(ends, "query_id")
        for c in ("sparse_score", "dense_score"):
            width = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
            both = both.withColumn(c, F.when(width == 0, 0.0).otherwise((F.col(c) - F.col(f"__lo_{c}")) / width))
        both = both.drop(*[c for c in both.columns if c.startswith("__")])
    zero = F.lit(0.0)
    score = F.coalesce("sparse_score", zero) * ws + F.coalesce("dense_score", zero) * wd
    return both.withColumn("hybrid_score", score)


def dedup_results(
    results: DataFrame, key: str = "url", order_by: Sequence[str] = ("query_id", "rank"), by: Sequence[str] = ("query_id",)
) -> DataFrame:
    """The first result per url within one request; ``by`` names the columns that tell requests apart."""
    first = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order_by))
    return results.withColumn("__first", first).filter("__first = 1").drop("__first")


def rerank(
    results: DataFrame,
    domain_boosts: Sequence[tuple[str, float]] = DOMAIN_BOOSTS,
    title_words: Sequence[str] = TITLE_WORDS,
    title_boost: float = TITLE_BOOST,
    max_results: int = MAX_RESULTS,
    by: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Raise scores by the first domain that the url has and by words of the title; the best of each request."""
    factor = F.lit(1.0)
    for domain, boost in reversed(list(domain_boosts)):
        factor = F.when(F.col("url").contains(domain), F.lit(boost)).otherwise(factor)
    lift = F.when(tx.contains_any(F.col("title"), title_words), F.lit(title_boost)).otherwise(F.lit(1.0))
    scored = results.withColumn("rerank_score", F.col("hybrid_score") * factor * lift)
    best = Window.partitionBy(*by).orderBy(F.round("rerank_score", 9).desc(), "url")
    return scored.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") <= max_results).drop("__best")


# queries

# Documentation terms added to a query that names the operation.
DOCUMENTATION_TERMS = {
    "convert object to datetime": (
        "pandas.to_datetime",
        "datetime conversion pandas",
        "parse dates pandas",
        "convert string to datetime",
    ),
    "fillna strategies": (
        "pandas.DataFrame.fillna",
        "handle missing data pandas",
        "missing value imputation",
        "forward fill backward fill",
    ),
    "missing values categorical": (
        "categorical data missing values",
        "pandas.Categorical fillna",
        "impute categorical pandas",
    ),
    "standardize categorical": (
        "pandas.Categorical",
        "category dtype pandas",
        "categorical data preprocessing",
    ),
    "normalize numerical": (
        "pandas normalization",
        "sklearn StandardScaler",
        "min-max scaling pandas",
        "feature scaling",
    ),
    "remove duplicates": (
        "pandas.DataFrame.drop_duplicates",
        "duplicate removal pandas",
        "unique values pandas",
    ),
    "rename columns": (
        "pandas.DataFrame.rename",
        "column names pandas",
        "rename multiple columns",
    ),
}
# Phrases per search strategy, the query in place of {}.
TEMPLATES = {
    "code_examples": ("{} example", "{} code snippet", "how to {}", "{} tutorial"),
    "best_practices": ("{} best practices", "{} performance", "{} efficient way", "{} recommended approach"),
    "troubleshooting": ("{} error", "{} troubleshooting", "{} common issues", "{} debugging"),
}
# Words that make a query technical.
TECHNICAL_TERMS = (
    "pandas",
    "dataframe",
    "fillna",
    "astype",
    "groupby",
    "merge",
    "to_datetime",
    "drop_duplicates",
    "rename",
    "categorical",
    "dtype",
    "preprocessing",
    "cleaning",
    "standardization",
)
# The relevance threshold and what lowers it.
BASE_THRESHOLD, LEAST_THRESHOLD = 6.0, 3.0
SPECIFIC_CUTS = ((0.8, 2.5), (0.5, 1.5), (0.2, 1.0))
COMPLEX_CUTS = ((2, 1.5), (1, 1.0))


def expand_queries(
    queries: DataFrame, mapping: Mapping[str, Sequence[str]] = DOCUMENTATION_TERMS, limit: int = 3
) -> DataFrame:
    """Rows ``(query_id, position, text)``: the query, then up to ``limit`` terms of matching operations.

    An operation matches when any of its words occurs in the query. The mapping
    is part of the expression, so no join takes place.
    """
    terms = [
        F.when(tx.contains_any(F.col("text"), key.split()), F.array(*map(F.lit, values))).otherwise(
            F.array().cast("array<string>")
        )
        for key, values in mapping.items()
    ]
    every = F.concat(F.array("text"), F.slice(F.concat(*terms), 1, limit))
    return queries.select("query_id", F.posexplode(every).alias("position", "text"))


def expand_templates(queries: DataFrame, strategy: str) -> DataFrame:
    """Rows ``(query_id, position, text)``: the query and its phrases."""
    if strategy not in TEMPLATES:
        raise ValueError(f"unknown strategy {strategy!r}")
    phrases = []
    for template in TEMPLATES[strategy]:
        before, after = template.split("{}")
        phrases.append(F.concat(F.lit(before), F.col("text"), F.lit(after)))
    return queries.select("query_id", F.posexplode(F.array("text", *phrases)).alias("position", "text"))


def merge_queries(lists: DataFrame, limit: int = 15, by: Sequence[str] = ("list_id",)) -> DataFrame:
    """Rows ``(by..., position, text)`` in, the first ``limit`` distinct texts per list out, order kept."""
    by = list(by)
    first = lists.groupBy(*by, "text").agg(F.min("position").alias("position"))
    order = Window.partitionBy(*by).orderBy("position", "text")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def adaptive_threshold(queries: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows ``(by..., specificity, complexity, threshold)``.

    The share of technical queries and the number of raised flags lower the
    threshold. A flag counts for the group when any of its rows raises it.
    """
    technical = tx.contains_any(F.col("text"), TECHNICAL_TERMS)
    groups = queries.groupBy(*by).agg(
        F.avg(technical.cast("double")).alias("specificity"),
        *[F.max(F.col(f).cast("int")).alias(f"__{f}") for f in flags],
    )
    complexity = F.lit(0)
    for f in flags:
        complexity = complexity + F.col(f"__{f}")
    specific, complex_ = F.lit(0.0), F.lit(0.0)
    for bound, cut in reversed(SPECIFIC_CUTS):
        specific = F.when(F.col("specificity") > bound, cut).otherwise(specific)
    for bound, cut in reversed(COMPLEX_CUTS):
        complex_ = F.when(F.col("complexity") >= bound, cut).otherwise(complex_)
    return (
        groups.withColumn("complexity", complexity)
        .withColumn("threshold", F.greatest(F.lit(LEAST_THRESHOLD), BASE_THRESHOLD - specific - complex_))
        .select(*by, "specificity", "complexity", "threshold")
    )


def graded_filter(df: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """Rows whose text carries ``Score=<number>`` of at least the threshold; no number counts 0."""
    number = F.regexp_extract(F.col(text_col), r"Score=([0-9]+)", 1)
    grade = F.coalesce(number.try_cast("int"), F.lit(0))
    return df.withColumn("grade", grade).filter(F.col("grade") >= threshold)
