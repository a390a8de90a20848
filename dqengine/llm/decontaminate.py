"""Benchmark decontamination over a positional inverted index (dealt operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .text import LOWER, NON_ALNUM, pieces, row_sums, signed, string_bytes, word_hashes, words

WINDOW = 10
# Postings of one term in one segment. A segment is one piece of a partition (about four
# megabytes of whole texts), so a group of postings is bounded however common its term is.
# Row 0 of a segment, with a null term, lists its documents.
INDEX = "segment long, term long, n long, postings binary, doc_id array<long>, row array<long>, n_words array<int>"
HITS = "doc_id long, row long, n_words long, n_hit long, items array<string>, spans array<struct<item: string, first: long, last: long>>"


def _terms(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words of a piece, and the first word of each row."""
    data, offsets = string_bytes(piece.column("text"))
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NON_ALNUM)
    return signed(word_hashes(data, starts, ends)), first


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = TaskContext.get().partitionId() << 32
    names = [f.split()[0] for f in INDEX.split(", ")]
    for batch in batches:
        for piece in pieces(batch, "text"):
            terms, first = _terms(piece)
            # a free place between rows keeps a phrase from running over a row's end
            rows = np.repeat(np.arange(piece.num_rows), np.diff(first))
            places = (np.arange(len(terms)) + rows).astype("<u4")
            order = np.argsort(terms, kind="stable")
            ranked = terms[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(terms) else np.zeros(0, np.int64)
            bounds = np.append(cuts, len(terms))
            gaps = np.diff(places[order], prepend=np.uint32(0))  # small numbers: they pack well
            gaps[cuts] = places[order][cuts]
            raw = pa.BinaryArray.from_buffers(
                pa.binary(), len(cuts), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(gaps.astype("<u4"))]
            )
            k = len(cuts)
            per_row = [piece.column("doc_id").to_pylist(), piece.column("row").to_pylist(), np.diff(first).tolist()]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * (k + 1), pa.int64()),
                    pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(ranked[cuts], pa.int64())]),
                    pa.concat_arrays([pa.array([0], pa.int64()), pa.array(np.diff(bounds), pa.int64())]),
                    pa.concat_arrays([pa.nulls(1, pa.binary()), raw]),
                    *[pa.concat_arrays([pa.array([v], t), pa.nulls(k, t)]) for v, t in zip(per_row, kinds)],
                ],
                names=names,
            )
            segment += 1


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional inverted index of all documents, written to the shared folder.

    One row a term and segment; places count words within the segment and are kept as the
    gaps between them. Nothing is shuffled: each task indexes its own rows, piece by piece.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    return stored(rows.mapInArrow(_index, INDEX), "positions")


def _windows(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 18):
            terms, first = _terms(piece)
            sizes = np.diff(first)
            counts = np.where(sizes >= length, sizes - length + 1, np.minimum(sizes, 1))
            owner = np.repeat(np.arange(piece.num_rows), counts)
            begin = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            long = np.minimum(sizes[owner], length)
            bounds = np.concatenate([[0], np.cumsum(long)])
            flat = terms[np.repeat(begin - bounds[:-1], long) + np.arange(bounds[-1])]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("item").take(pa.array(owner)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["item", "terms"],
            )


def phrases(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The windows (item, terms) of every item; an item shorter than a window is one."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _windows(window, it), "item string, terms array<long>").distinct()


def _match(slack: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Intersect the offset-adjusted postings of one segment, the rarest term of a phrase first."""
    head = left.filter(pc.is_null(left["term"])).to_pylist()[0]
    left = left.filter(pc.is_valid(left["term"])).sort_by("term")
    n_words = np.array(head["n_words"], np.int64)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    n_hit = np.zeros(len(n_words), np.int64)
    spans: list[list[dict]] = [[] for _ in n_words]
    items: list[set] = [set() for _ in n_words]
    if right.num_rows and left.num_rows:
        terms = left["term"].to_numpy()
        counts = left["n"].to_numpy()
        bounds = np.concatenate([[0], np.cumsum(counts)])
        gaps = np.frombuffer(b"".join(left["postings"].to_pylist()), "<u4").astype(np.int64)
        upto = np.cumsum(gaps)
        places = upto - np.repeat(upto[bounds[:-1]] - gaps[bounds[:-1]], counts)
        room = int(places.max()) + 2
        keys = np.repeat(np.arange(len(terms)), counts) * room + places  # ascending: by term, then place
        lists = right["terms"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
        here = terms[index] == flat
        whole = np.bincount(owner[~here], minlength=len(sizes)) == 0  # phrases with all terms in the segment
        order = np.lexsort((offset, counts[index], owner))
        order = order[whole[owner[order]]]
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes[whole]) - sizes[whole], sizes[whole])
        table = np.full((len(sizes), int(sizes.max())), -1, np.int64)
        shift = np.zeros_like(table)
        table[owner[order], rank] = index[order]
        shift[owner[order], rank] = offset[order]
        # candidates: every place of the rarest term, moved back by its offset
        ids = np.flatnonzero(whole)
        rare = table[ids, 0]
        n = counts[rare]
        phrase = np.repeat(ids, n)
        at = places[np.repeat(bounds[rare], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] - shift[phrase, 0]
        # places of a row are shifted by one free place for every row before; a phrase stays in the row of its rarest term
        begins = starts[:-1] + np.arange(len(n_words))
        home = np.searchsorted(begins, at + shift[phrase, 0], "right") - 1
        for r in range(1, table.shape[1]):
            term = table[phrase, r]
            want = at + shift[phrase, r]
            if slack:  # proximity: the nearest place of the term within ``slack`` words of the same row
                low, high = np.maximum(want - slack, begins[home]), np.minimum(want + slack, begins[home] + n_words[home] - 1)
                near = np.minimum(np.searchsorted(keys, term * room + low), len(keys) - 1)
                found = (keys[near] >= term * room + low) & (keys[near] <= term * room + high)
            else:
                near = np.minimum(np.searchsorted(keys, term * room + want), len(keys) - 1)
                found = (keys[near] == term * room + want) & (want >= 0) & (want < room)
            ok = (term < 0) | found
            phrase, at, home = phrase[ok], at[ok], home[ok]
        if len(phrase):
            last = at + sizes[phrase] - 1
            doc = home
            floor = begins[doc]
            at = np.clip(at - floor, 0, None)
            last = np.minimum(last - floor, n_words[doc] - 1)
            edge = np.zeros(int(starts[-1]) + 1, np.int64)
            np.add.at(edge, starts[doc] + at, 1)
            np.add.at(edge, starts[doc] + last + 1, -1)
            n_hit = row_sums(np.cumsum(edge[:-1]) > 0, starts)
            names = right["item"].to_pylist()
            seen = np.unique(np.stack([doc, at, last, phrase], 1), axis=0)
            for d, a, b, p in seen.tolist():
                if names[p] is not None:
                    items[d].add(names[p])
                spans[d].append({"item": names[p], "first": a, "last": b})
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("row", pa.int64()),
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
        ]
    )
    columns = [head["doc_id"], head["row"], n_words, n_hit, [sorted(x, key=str.encode) for x in items], spans]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slack: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Return (doc_id, row, n_words, n_hit, items, spans), one row per document.

    ``row`` is the hash of the text, ``n_hit`` counts the words inside any occurrence of a
    window of an item, ``items`` lists the items found and ``spans`` where they stand
    (first and last word). ``slack`` 0 finds exact phrases; with a slack every term
    of a window may stand that many words from its place (proximity), within one document.

    The index is joined on terms: first the phrases meet the segments that hold
    their rarest term, then each segment intersects its own postings. Null or empty
    texts have no words; items without words match nothing; equal windows of several
    items, repeated items and repeated documents are each reported; empty tables give no hits.
    An item without an id counts in ``n_hit`` and has spans (with a null item), but is not in ``items``.
    Extra columns are ignored.
    """
    index = build_index(docs, doc_id, text)
    asked = stored(phrases(items, window, item_id, item_text), "phrases")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    # how often each asked term occurs in all documents; the rarest stands for its phrase
    frequent = stored(
        index.join(terms, "term").groupBy("term").agg(F.sum("n").alias("total")), "term-counts"
    )
    keyed = asked.withColumn("phrase", F.xxhash64("terms"))
    placed = keyed.select("phrase", F.explode("terms").alias("term")).distinct().join(frequent, "term", "left")
    rarest = placed.groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term")).alias("least")
    )
    anchored = keyed.join(rarest.filter(F.col("least.total") > 0), "phrase").select(
        "item", "terms", F.col("least.term").alias("term")
    )
    holding = index.filter(F.col("term").isNotNull()).select("segment", "term").join(anchored, "term")
    wanted = holding.select(F.col("segment").alias("at"), "item", "terms")
    heads = index.filter(F.col("term").isNull())
    needed = heads.unionByName(index.join(frequent.select("term"), "term", "left_semi"))
    return (
        needed.groupBy("segment")
        .cogroup(wanted.groupBy("at"))
        .applyInArrow(lambda postings, asked: _match(slack, postings, asked), HITS)
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    found = find_items(docs, items, doc_id=doc_id, text=text, **options)
    hit = found.filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__row"))
    return docs.join(stored(hit, "contaminated"), same, "left_anti")
