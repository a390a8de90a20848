"""Hard negatives over an inverted multi-index of vectors (dealt operator 12)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.session import swept

from .tables import ranked, stored

CELL_ROWS = 1024  # rows that a cell holds on average
MOST_CODES = 256  # codes of a half; beyond that cells grow
SAMPLE = 20_000  # rows from which the codebooks are learnt
BLOCK_ROWS = 2048  # rows of a cell that one task scores together
BATCH = 1024  # anchors that meet a block together
SCALE = 256


@dataclass(frozen=True)
class MultiIndex:
    """Rows by cell, one cell for each pair of codes of the two halves of a vector.

    ``blocks``: (block, cell, n, ids, labels, vectors), packed rows of one cell by ascending id.
    ``books``: the centres of both halves. ``cells``: (rows, radius of each half) of every cell, at most
    MOST_CODES squared. Radii cover every row, not the sample alone.
    """

    blocks: DataFrame
    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, ``v`` holding floor(256 * x) of every component.

    Rows without id, label or vector, with a null or non-finite component, or with a length other than
    the commonest take no part.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # written with the checks before the arithmetic, so that a bad component never meets it
    v = F.when(finite, F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("int")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.agg(F.max(F.struct("n", "length")).alias("most")).select(F.col("most.length").alias("length"))
    return rows.join(F.broadcast(common), F.size("v") == F.col("length"), "left_semi")


def _means(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from evenly drawn distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(7).permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        near = _nearest(points, centres)[0]
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every point and its distance."""
    gap = (centres**2).sum(1) - 2 * points @ centres.T
    near = gap.argmin(1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width).astype(float)


def _assign(books: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = books
    width = a.shape[1] + b.shape[1]
    for batch in batches:
        v = _matrix(batch.column("v"), width)
        near1, far1 = _nearest(v[:, : a.shape[1]], a)
        near2, far2 = _nearest(v[:, a.shape[1] :], b)
        cell = near1 * len(b) + near2
        more = [pa.array(cell, pa.int32()), pa.array(far1), pa.array(far2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "far1", "far2"])


def _pack(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted by cell and part, then id."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        start = np.flatnonzero(new)
        bounds = np.append(start, batch.num_rows).astype(np.int64)
        v = batch.column("v").flatten().to_numpy().astype("<i4")
        vectors = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds * width * 4), pa.py_buffer(v)])
        offsets = pa.array(bounds, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("vec_id", "label")]
        columns = [pa.array(block + np.arange(len(start))), pa.array(cell[start]), pa.array(np.diff(bounds)), *lists, vectors.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "cell", "n", "ids", "labels", "vectors"])
        block += len(start)


def build_index(rows: DataFrame) -> MultiIndex | None:
    """Index every row of ``usable``; None without rows.

    The codebooks are learnt from at most SAMPLE rows, drawn by a hash; the driver holds that sample and
    one row per cell. The rows are shuffled once, a cell of many rows (copies of one vector) over many blocks.
    """
    draw = F.xxhash64("vec_id", F.lit("codes"))
    sample = rows.select("v").orderBy(draw, "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    lists = sample["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    width = len(lists[0])
    half = max(width // 2, 1)
    v = _matrix(lists, width)
    codes = int(min(np.ceil(np.sqrt(rows.count() / CELL_ROWS)), MOST_CODES))
    books = (_means(v[:, :half], codes), _means(v[:, half:], codes) if width > half else np.zeros((1, 0)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, cell int, far1 double, far2 double"
    placed = stored(rows.mapInArrow(lambda it: _assign(books, it), schema), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2"))
    sizes = stored(sizes, "cells")
    cells = np.zeros((len(books[0]) * len(books[1]), 3))
    for r in sizes.toLocalIterator():  # at most MOST_CODES squared
        cells[r["cell"]] = r["n"], r["far1"], r["far2"]
    parts = (F.floor(F.col("n") / BLOCK_ROWS) + 1).cast("int")
    dealt = placed.drop("far1", "far2").join(sizes.select("cell", parts.alias("parts")), "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "vec_id")
    dealt = dealt.select("vec_id", "label", "v", "cell", "part")
    packed = f"block long, cell int, n long, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vectors binary"
    return MultiIndex(stored(dealt.mapInArrow(lambda it: _pack(width, it), packed), "blocks"), books, cells)


def _sequence(index: tuple, q: np.ndarray) -> Iterator[tuple[float, int]]:
    """Cells by falling sum of half-score bounds (multi-sequence), each at most the score of its rows."""
    (a, b), cells = index
    half = a.shape[1]
    grid = cells.reshape(len(a), len(b), 3)
    # a code's radius covers all its cells, so that the sums fall along both sequences
    ub1 = a @ q[:half] + np.linalg.norm(q[:half]) * grid[:, :, 1].max(1)
    ub2 = b @ q[half:] + np.linalg.norm(q[half:]) * grid[:, :, 2].max(0)
    by1, by2 = np.argsort(-ub1, kind="stable"), np.argsort(-ub2, kind="stable")
    heap = [(-(ub1[by1[0]] + ub2[by2[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(by1[i] * len(b) + by2[j])
        if j + 1 < len(by2):
            heapq.heappush(heap, (-(ub1[by1[i]] + ub2[by2[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(by1):
            heapq.heappush(heap, (-(ub1[by1[i + 1]] + ub2[by2[0]]), i + 1, 0))


def _cells(index: tuple, first: int, late: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that each anchor visits, with the anchor's lot.

    Early, those that come first until ``first`` rows are seen; late, those that come after them, until the bound
    falls below the anchor's floor.
    """
    (a, b), cells = index
    for batch in batches:
        anchors, found = [], []
        for at, (q, floor) in enumerate(zip(_matrix(batch.column("v"), a.shape[1] + b.shape[1]), batch.column("floor").to_numpy())):
            norm1, norm2 = np.linalg.norm(q[: a.shape[1]]), np.linalg.norm(q[a.shape[1] :])
            seen = 0
            for bound, cell in _sequence(index, q):
                early = seen < first
                if bound < floor - 0.5:  # scores are whole numbers, bounds are rounded
                    break
                n, far1, far2 = cells[cell]
                seen += n
                if early == late:
                    if early:
                        continue
                    break
                own = a[cell // len(b)] @ q[: a.shape[1]] + b[cell % len(b)] @ q[a.shape[1] :] + norm1 * far1 + norm2 * far2
                if n and own >= floor - 0.5:  # the cell's own radii are tighter
                    anchors.append(at)
                    found.append(cell)
        at = pa.array(anchors, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("anchor").take(at), batch.column("lot").take(at), pa.array(found, pa.int32())], names=["anchor", "lot", "cell"]
        )


def _scores(rows: pa.Table, asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores (anchor, row) of a block, and its ids, its labels and the anchors' labels as codes."""
    raw = np.frombuffer(rows["vectors"][0].as_py(), "<i4").reshape(rows["n"][0].as_py(), -1)
    lists = asked["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    q = lists.flatten().to_numpy().reshape(-1, raw.shape[1])
    reach = int(np.abs(raw.astype(np.int64)).max()) * int(np.abs(q.astype(np.int64)).max()) * raw.shape[1]
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64  # exact in each case
    scores = (q.astype(kind) @ raw.astype(kind).T).astype(np.int64)
    ids, labels = rows["ids"][0].values, rows["labels"][0].values
    codes = pa.concat_arrays([labels, asked["label"].combine_chunks().cast(labels.type)]) if asked.num_rows else labels
    codes = codes.dictionary_encode().indices.to_numpy()
    return scores, ids, codes[: len(ids)], codes[len(ids) :]


def _top(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best fitting scores of every row; equal scores by ascending column."""
    n = scores.shape[1]
    # score and place in one number: all distinct
    key = np.where(fit, scores * n + np.arange(n - 1, -1, -1), -(1 << 62))
    at = np.argpartition(-key, k, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    who = np.repeat(np.arange(len(scores)), at.shape[1])
    at = at.ravel()
    good = fit[who, at]
    return who[good], at[good]


def _positives(k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    names = ["anchor", "id", "score"]
    if rows.num_rows and asked.num_rows:
        scores, ids, label, own = _scores(rows, asked)
        same = label == own[:, None]
        held = pa.concat_arrays([ids, asked["vec_id"].combine_chunks().cast(ids.type)]).dictionary_encode().indices.to_numpy()
        same &= held[: len(ids)] != held[len(ids) :, None]
        same &= scores >= asked["floor"].to_numpy()[:, None]
        who, at = _top(scores, same, k)
        return pa.Table.from_arrays([asked["anchor"].combine_chunks().take(pa.array(who)), ids.take(pa.array(at)), pa.array(scores[who, at])], names=names)
    return pa.table([pa.nulls(0, asked["anchor"].type), pa.nulls(0, rows["ids"].type.value_type), pa.nulls(0, pa.int64())], names=names)


def _negatives(k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    names = ["anchor", "window", "id", "score"]
    if rows.num_rows and asked.num_rows:
        scores, ids, label, own = _scores(rows, asked)
        other = label != own[:, None]
        parts: list[list] = [[], [], [], []]
        lists = asked["windows"].to_pylist()
        for w in range(max(map(len, lists))):
            here = np.array([i for i, x in enumerate(lists) if len(x) > w])
            low = np.array([max(lists[i][w]["low"], lists[i][w]["floor"]) for i in here])[:, None]
            high = np.array([lists[i][w]["high"] for i in here])[:, None]
            s = scores[here]
            who, at = _top(s, other[here] & (s >= low) & (s <= high), k)
            parts[0].append(here[who])
            parts[1].append(np.array([lists[i][w]["window"] for i in here], np.int64)[who])
            parts[2].append(at)
            parts[3].append(s[who, at])
        who, window, at, found = map(np.concatenate, parts)
        columns = [asked["anchor"].combine_chunks().take(pa.array(who)), pa.array(window, pa.int32()), ids.take(pa.array(at)), pa.array(found)]
        return pa.Table.from_arrays(columns, names=names)
    kinds = [asked["anchor"].type, pa.int32(), rows["ids"].type.value_type, pa.int64()]
    return pa.table([pa.nulls(0, t) for t in kinds], names=names)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    first: int = 4096,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Return (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the inner product of floor(256 * x) with the anchor's. An anchor's positives are its
    ``positives`` best other ids of the same label; for each, the ``negatives`` best rows of another label
    with low * positive_score <= 100 * score <= high * positive_score follow. Equal scores go by
    ascending id. ``is_anchor`` is a condition on ``vec_id``.

    Each of the two searches visits cells in the order of their bounds until ``first`` rows are seen, and then
    all cells whose bound reaches what was found (the last positive; the last negative of a window, or its
    lower end): the rest is certified to hold nothing better, so the result is that of all pairs. No table that
    grows with the anchors passes the driver.

    See ``usable`` for the rows that take no part. Equal rows count each, except that a repeated
    anchor is one anchor; an anchor without positives, or a window without rows, has no rows. Empty tables give
    no rows. Extra columns are ignored.
    """
    rows = stored(usable(vectors, vec_id, vector, label), "vectors")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    end = f"anchor_id {kinds['vec_id']}, positive_id {kinds['vec_id']}, rank int, negative_id {kinds['vec_id']}, positive_score long, negative_score long"
    built = build_index(rows)
    if built is None:
        return vectors.sparkSession.createDataFrame([], T.StructType.fromDDL(end))
    books, index, blocks = built.books, (built.books, built.cells), built.blocks
    anchors = rows.filter(is_anchor).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    near = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, anchor long, cell int, far1 double, far2 double"
    anchors = anchors.mapInArrow(lambda it: _assign(books, it), near).drop("far1", "far2")
    # anchors of near cells share a batch, so that a batch visits few cells
    anchors = ranked(anchors, [F.col("cell"), F.col("anchor")], "place").withColumn("lot", F.floor(F.col("place") / BATCH).cast("int"))
    anchors = stored(anchors.drop("cell", "place"), "anchors")
    places = blocks.select("block", "cell")

    def visited(asked: DataFrame, late: bool, score, schema: str, name: str) -> DataFrame:
        """Blocks of the cells each anchor visits meet their anchors, some at a time."""
        # few bytes but much work: a task for each core, not one for the file
        dealt = asked.select("anchor", "lot", "v", "floor").repartition(asked.sparkSession.sparkContext.defaultParallelism)
        cells = dealt.mapInArrow(lambda it: _cells(index, first, late, it), "anchor long, lot int, cell int")
        # merge joins: a row for each anchor and cell, which the planner takes for a row for each anchor
        with swept(asked.sparkSession):
            calls = stored(cells.hint("merge").join(places, "cell").select("anchor", "lot", F.col("block").alias("at")), "calls")
        wanted = calls.select(F.col("at").alias("block"), F.col("lot").alias("batch")).distinct()
        calls = calls.join(asked.drop("lot").hint("merge"), "anchor")
        met = blocks.join(wanted.hint("merge"), "block").groupBy("block", "batch").cogroup(calls.groupBy("at", "lot"))
        with swept(asked.sparkSession):
            return stored(met.applyInArrow(score, schema), name)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        ranking = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)

    least = F.lit(-(1 << 62)).cast("long")
    schema = f"anchor long, id {kinds['vec_id']}, score long"
    near = lambda a, b: _positives(positives, a, b)
    early = visited(anchors.withColumn("floor", least), False, near, schema, "early")
    floors = best(early, ["anchor"], positives).filter(F.col("rank") == positives).select("anchor", F.col("score").alias("floor"))
    asked = anchors.join(stored(floors, "floors").hint("merge"), "anchor", "left").withColumn("floor", F.coalesce("floor", least))
    late = visited(stored(asked, "asked"), True, near, schema, "late")
    chosen = best(early.unionByName(late), ["anchor"], positives).withColumnRenamed("rank", "window")
    # 100 * score between low and high percent of the positive's, in whole numbers
    whole = lambda x: f"((({x}) - pmod({x}, 100)) div 100)"
    bottom, top = F.expr(f"-{whole(f'-{low} * score')}"), F.expr(whole(f"{high} * score"))
    windows = chosen.withColumn("low", bottom).withColumn("high", top).filter("low <= high")
    windows = stored(windows.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), "windows")

    def in_windows(found: DataFrame | None, late: bool) -> DataFrame:
        """One search for all windows of an anchor; ``floor`` is the worst score that can still count."""
        part = windows.withColumn("floor", F.col("low"))
        if found is not None:
            last = best(found, ["anchor", "window"], negatives).filter(F.col("rank") == negatives)
            last = stored(last.select("anchor", "window", F.col("score").alias("last")), "last")
            part = windows.join(last.hint("merge"), ["anchor", "window"], "left").withColumn("floor", F.coalesce("last", "low"))
        lists = part.groupBy("anchor").agg(
            F.collect_list(F.struct("window", "low", "high", "floor")).alias("windows"), F.min("floor").alias("floor")
        )
        asked = stored(lists.join(anchors.hint("merge"), "anchor"), "asked")
        schema = f"anchor long, window int, id {kinds['vec_id']}, score long"
        return visited(asked, late, lambda a, b: _negatives(negatives, a, b), schema, "negatives")

    early = in_windows(None, False)
    found = best(early.unionByName(in_windows(early, True)), ["anchor", "window"], negatives)
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    named = found.join(windows.hint("merge"), ["anchor", "window"]).join(ids.hint("merge"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
