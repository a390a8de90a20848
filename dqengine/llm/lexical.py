"""Ranked lexical search over a length-stratified index (dealt operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored
from .text import LOWER, NON_ALNUM, pieces, signed, string_bytes, word_hashes, words

BLOCK_BYTES = 4 << 20  # texts of one block; a stratum of more bytes is several blocks
BATCH_TERMS = 100_000  # asked (item, term) pairs that meet one block together
CELLS = 1 << 22  # scores held at once by a task


@dataclass(frozen=True)
class LexicalIndex:
    """An index in the shared folder.

    ``postings``: one row per block and term. A block holds documents of one stratum, that is of one
    normaliser ``m``; its documents are numbered by ascending id. A term's documents are listed by
    falling ``tf``: run i of them has ``tf[i]`` and ends at ``upto[i]``. The row without a term
    lists the block's documents. ``strata``: documents per normaliser. ``docs``: documents with a term.
    """

    postings: DataFrame
    strata: DataFrame
    docs: int


def _index(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows that come sorted by stratum and part, then id."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for piece in pieces(batch, "text", BLOCK_BYTES):
            data, offsets = string_bytes(piece.column("text"))
            starts, ends, first = words(LOWER[data], offsets, NON_ALNUM)
            terms = signed(word_hashes(LOWER[data], starts, ends))
            m, part = piece.column("m").to_numpy(), piece.column("part").to_numpy()
            cut = np.concatenate([[True], (m[1:] != m[:-1]) | (part[1:] != part[:-1])])
            head = np.flatnonzero(cut)
            stratum = np.cumsum(cut) - 1
            doc = np.repeat(np.arange(piece.num_rows), np.diff(first))
            # a stable sort by term keeps strata, and documents within them, in order
            order = np.argsort(terms, kind="stable")
            t, d = terms[order], doc[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(t)))
            t, d = t[at], d[at]
            s = stratum[d]
            row = np.cumsum(np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])) - 1
            order = np.argsort(row * (int(tf.max()) + 1) - tf, kind="stable")  # within a row by falling tf, then id
            tf, local = tf[order], (d - head[s])[order]
            run = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (tf[1:] != tf[:-1])]))
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            bounds = np.append(begin, len(row))
            upto = np.append(run[1:], len(row)) - begin[row[run]]
            runs = np.append(np.searchsorted(run, begin), len(run)).astype(np.int32)
            of = s[begin]
            k, h = len(begin), len(head)
            doc_id = pa.ListArray.from_arrays(pa.array(np.append(head, piece.num_rows), pa.int32()), piece.column("doc_id"))
            lists = [pa.ListArray.from_arrays(pa.array(runs), pa.array(v, pa.int32())) for v in (tf[run], upto)]
            docs = pa.BinaryArray.from_buffers(
                pa.binary(), k, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(local.astype("<u4"))]
            )
            columns = [
                (pa.array(block + of), pa.array(block + np.arange(h))),
                (pa.array(m[head][of]), pa.array(m[head])),
                (pa.array(t[begin]), pa.nulls(h, pa.int64())),
                (pa.array(np.diff(bounds)), pa.array(np.diff(np.append(head, piece.num_rows)))),
                *[(v, pa.nulls(h, v.type)) for v in lists],
                (docs, pa.nulls(h, pa.binary())),
                (pa.nulls(k, pa.list_(kind)), doc_id.cast(pa.list_(kind))),
            ]
            names = ["block", "m", "term", "n", "tf", "upto", "docs", "doc_id"]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=names)
            block += h


def _count(texts: pa.Array) -> pa.Array:
    """Terms of every text."""
    found = [np.zeros(0, np.int64)]
    for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        data, offsets = string_bytes(piece.column("text"))
        found.append(np.diff(words(data, offsets, NON_ALNUM)[2]))
    return pa.array(np.concatenate(found))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index every document that has a term.

    Documents are dealt by stratum, a stratum of many bytes over several blocks, so a common length is
    no hot key. Texts are shuffled once; what meets before that is one row per text length in words.
    """
    kind = "long" if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else "string"
    rows = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("text"), F.arrow_udf(_count, "long")(F.col(text)).alias("n"))
    rows = rows.filter(F.col("n") > 0)
    lengths = stored(rows.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")), "lengths")
    totals = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms"))
    lengths = lengths.crossJoin(F.broadcast(totals.select(F.col("docs").alias("all_docs"), "terms")))
    lengths = lengths.withColumn("m", F.expr("100 - 90 + ((90 * n * all_docs) div terms)"))
    strata = lengths.groupBy("m").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
    strata = stored(strata.withColumn("parts", F.expr(f"cast(bytes div {BLOCK_BYTES} as int) + 1")), "strata")
    dealt = rows.join(stored(lengths.select("n", "m").join(strata.select("m", "parts"), "m"), "lengths"), "n")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    dealt = dealt.repartition("m", "part").sortWithinPartitions("m", "part", F.col("doc_id").asc_nulls_last())
    schema = f"block long, m long, term long, n long, tf array<int>, upto array<int>, docs binary, doc_id array<{kind}>"
    arrow = pa.int64() if kind == "long" else pa.string()
    postings = dealt.select("doc_id", "text", "m", "part").mapInArrow(lambda it: _index(arrow, it), schema)
    count = totals.first()["docs"]
    return LexicalIndex(stored(postings, "postings"), strata.select("m", "docs"), int(count or 0))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = string_bytes(piece.column("text"))
            starts, ends, first = words(LOWER[data], offsets, NON_ALNUM)
            owner = np.repeat(np.arange(piece.num_rows), np.diff(first))
            hashes = signed(word_hashes(LOWER[data], starts, ends))
            yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array(owner)), pa.array(hashes)], names=["item", "term"])


def _visit(k: int, kind: pa.DataType, postings: pa.Table, asked: pa.Table) -> pa.Table:
    """The ``k`` best documents of one block for every item that visits it."""
    out: list[list] = [[], [], []]
    heads = postings.filter(pc.is_null(postings["slot"]))
    rows = postings.filter(pc.is_valid(postings["slot"]))
    if heads.num_rows and rows.num_rows and asked.num_rows:
        doc_id = heads["doc_id"].combine_chunks().flatten()
        doc_id = doc_id.chunk(0) if isinstance(doc_id, pa.ChunkedArray) else doc_id
        docs, m = len(doc_id), heads["m"][0].as_py()
        runs = [rows[c].combine_chunks() for c in ("tf", "upto")]
        runs = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in runs]
        per_row = runs[0].value_lengths().to_numpy()
        tf, upto = [c.flatten().to_numpy().astype(np.int64) for c in runs]
        row = np.repeat(np.arange(rows.num_rows), per_row)
        first = np.cumsum(per_row) - per_row
        # one impact a run: all its documents share the normaliser and tf
        gain = rows["w"].to_numpy()[row] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        size = np.diff(upto, prepend=0)
        size[first] = upto[first]
        value = np.repeat(gain, size)
        n = rows["n"].to_numpy()
        local = np.frombuffer(b"".join(rows["docs"].to_pylist()), "<u4").astype(np.int64)
        start = np.cumsum(n) - n
        place = np.full(int(pc.max(rows["slot"]).as_py()) + 1, -1)
        place[rows["slot"].to_numpy()] = np.arange(rows.num_rows)
        lists = asked["slots"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        of = np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy())
        slot = lists.flatten().to_numpy()
        at = np.where(slot < len(place), place[np.minimum(slot, len(place) - 1)], -1)
        of, at = of[at >= 0], at[at >= 0]
        # the block's own bound; below the item's threshold no document of it can rank
        floor = np.maximum(asked["floor"].to_numpy(), 1)
        bound = np.zeros(asked.num_rows, np.int64)
        np.add.at(bound, of, gain[first[at]])
        live = bound >= floor
        of, at = of[live[of]], at[live[of]]
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        items = np.flatnonzero(live)
        edge = np.searchsorted(of, np.append(items, asked.num_rows))
        load = np.maximum(np.diff(np.concatenate([[0], np.cumsum(n[at])])[edge]), docs)
        chunk = np.concatenate([[0], np.cumsum(load)])[:-1] // CELLS if len(items) else np.zeros(0, np.int64)
        for c in np.unique(chunk):
            mine = np.flatnonzero(chunk == c)
            a, b = edge[mine[0]], edge[mine[-1] + 1]
            p = at[a:b]
            spread = np.repeat(start[p] - (np.cumsum(n[p]) - n[p]), n[p]) + np.arange(n[p].sum())
            scores = np.zeros(len(mine) * docs, np.int64)
            np.add.at(scores, np.repeat(np.searchsorted(items[mine], of[a:b]), n[p]) * docs + local[spread], value[spread])
            scores = scores.reshape(len(mine), docs)
            least = floor[items[mine]]
            if docs > k:
                least = np.maximum(least, np.partition(scores, docs - k, axis=1)[:, docs - k])
            who, what = np.nonzero(scores >= least[:, None])
            found = scores[who, what]
            order = np.lexsort((what, -found, who))  # equal scores by place, that is by id
            who, what, found = who[order], what[order], found[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            best = rank < k
            out[0].append(asked["item"].take(pa.array(items[mine][who[best]])).combine_chunks())
            out[1].append(doc_id.take(pa.array(what[best])))
            out[2].append(pa.array(found[best]))
    names, kinds = ["item", "doc_id", "score"], [pa.string(), kind, pa.int64()]
    columns = [pa.chunked_array(c, t) if c else pa.nulls(0, t) for c, t in zip(out, kinds)]
    return pa.Table.from_arrays(columns, schema=pa.schema(list(zip(names, kinds))))


def search(
    index: LexicalIndex, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", first: int = 1000
) -> DataFrame:
    """Return (item_id, rank, doc_id, score): the ``k`` best documents of every item.

    Strata are visited by falling bound: the sum over an item's terms of the impact of the largest tf
    in the stratum. The first strata that hold ``first`` documents are scored; the k-th
    score found is the item's threshold, and every other stratum whose bound reaches
    it is scored too. Nothing else can rank, so the result is that of scoring all documents.

    Items without an id, and items without a term that occurs, have no rows; rows of one id are one
    item. Equal scores go by ascending id, documents without an id last; repeated documents rank each.
    An empty index or no items gives no rows. Extra columns are ignored.
    """
    kind = index.postings.schema["doc_id"].dataType.elementType
    asked = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    asked = stored(asked.mapInArrow(_terms, "item string, term long").distinct(), "asked")
    batches = max(1, -(-asked.count() // BATCH_TERMS))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int"))
    held = stored(index.postings.join(stored(asked.select("term").distinct(), "terms"), "term", "left_semi"), "held")
    frequency = held.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(index.docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = stored(frequency.select("term", weight.alias("w")).filter("w > 0"), "weights")
    by_term = Window.partitionBy("batch").orderBy("term")
    slots = asked.select("batch", "term").distinct().join(weights, "term").withColumn("slot", F.row_number().over(by_term) - 1)
    slots = stored(slots, "slots")
    asked = stored(asked.join(slots, ["batch", "term"]), "asked")
    impact = F.expr("w * ((1000000000 * top) div (1000 * top + 8 * m))")
    tops = held.groupBy("m", "term").agg(F.max(F.col("tf")[0].cast("long")).alias("top"))
    bounds = tops.join(asked, "term").groupBy("batch", "item", "m").agg(F.sum(impact).alias("bound"))
    bounds = stored(bounds.join(index.strata, "m"), "bounds")
    before = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)
    order = bounds.withColumn("early", F.coalesce(F.sum("docs").over(before), F.lit(0)) < first)
    order = stored(order.drop("docs"), "order")
    blocks = index.postings.filter("term is null").select("block", "m")
    lists = stored(asked.groupBy("batch", "item").agg(F.collect_list("slot").alias("slots")), "lists")
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    schema = f"item string, doc_id {kind.simpleString()}, score long"

    def visited(strata: DataFrame) -> DataFrame:
        calls = strata.join(blocks, "m").join(lists, ["batch", "item"]).select(
            F.col("block").alias("at"), F.col("batch").alias("lot"), "item", "floor", "slots"
        )
        places = strata.select("batch", "m").distinct().join(index.postings.filter("term is null"), "m")
        heads = places.select("block", "batch", "m", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("w"), "n", "tf", "upto", "docs", "doc_id")
        rows = held.join(slots, "term").join(strata.select("batch", "m").distinct(), ["batch", "m"]).select(*heads.columns)
        both = heads.unionByName(rows).groupBy("block", "batch").cogroup(calls.groupBy("at", "lot"))
        return stored(both.applyInArrow(lambda a, b: _visit(k, arrow, a, b), schema), "visited")

    ranking = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    early = visited(order.filter("early").withColumn("floor", F.lit(1).cast("long")))
    floors = early.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    rest = order.filter("not early").join(stored(floors, "floors"), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    late = visited(stored(rest.filter(F.col("bound") >= F.col("floor")), "late"))
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), "rank", "doc_id", "score")
