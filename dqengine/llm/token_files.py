"""Token-id files with Elias-Fano document boundaries (dealt operator 3)."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.session import scratch_path

from .elias_fano import EliasFano
from .text import pieces, string_bytes

SHARD_IDS = 1 << 20  # ids of a shard; a longer document is a shard of its own
CACHE_MOST, CACHE_CORE = 450_000, 280_000  # encoded words a worker keeps

# A blank before a space, or a space at the start: there a text is not cut at spaces.
_UNEVEN = r"^ |[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "

# Bytes of a plain text: printable ASCII, line feeds, and the letters of Latin-1 (lead 0xC3; its
# only two signs, multiplication and division, end in 0x97 and 0xB7).
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True
_PLAIN[[0x97, 0xB7]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.")] = True
_GAP = np.zeros(256, bool)
_GAP[list(b" \n")] = True
_BARE, _COMMA, _POINT, _LINE = "\x01", "\x02", "\x03", "\x04"  # marks of cut pieces; no plain text holds them

# One row is one shard. Rows in the order of (part, shard) hold documents in ascending id order.
SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("least_id", T.LongType()),  # of the document ids; null where no document has one
        T.StructField("most_id", T.LongType()),
        T.StructField("width", T.IntegerType()),  # bytes of an id, little-endian
        T.StructField("doc_ids", T.BinaryType()),  # Elias-Fano; documents without an id stand last
        T.StructField("bounds", T.BinaryType()),  # Elias-Fano of n_docs + 1 offsets into ids
        T.StructField("ids", T.BinaryType()),
    ]
)
ROWS = "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts can also be cut at commas, points and line ends that follow a letter.

    Only Latin letters, no blank beside a blank, and no such mark after anything but a letter.
    """
    bad = ~_PLAIN[data]
    gap = _GAP[data]
    bad[1:] |= gap[1:] & gap[:-1]
    bad[1:-1] |= _STOP[data[1:-1]] & gap[2:] & ~_LETTER[data[:-2]]
    total = np.concatenate([[0], np.cumsum(bad)])
    first = np.zeros(len(offsets) - 1, bool)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    at = offsets[some]
    first[some] = gap[at] | _STOP[data[at]]
    return (total[offsets[1:]] == total[offsets[:-1]]) & ~first


def _cuttable(path: str) -> bool:
    """True for a tokenizer whose pieces begin at blanks: byte-level, no normaliser, no added token with a blank."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    plain_bytes = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    added = [t["content"] for t in made.get("added_tokens", [])]
    return plain_bytes and made.get("normalizer") is None and not any(re.search(r"\s", t) for t in added)


class Encoder:
    """Encodes texts with a tokenizers file whose pieces never run past a blank.

    Byte-level BPE splits a text before every blank that follows another character, and
    between a letter and a comma or point. So the stretches between are looked up once per batch and
    kept: the frequent ones for good, the rest until the cache is full. Texts where
    a cut could move a border of a piece are encoded whole, and so are all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.cuts = _cuttable(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        # tokens that begin with a blank, which byte-level vocabularies write as one letter
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True
        self.cache: dict[str, bytes] = dict(zip((_COMMA, _POINT, _LINE), self._bytes([",", ".", ".\n"])))

    def _bytes(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _learn(self, wanted: list[str]) -> None:
        """Encode pieces that are not kept yet; those after a blank many in one text, cut again where a token begins with one."""
        alone = [p for p in wanted if p[:1] == _BARE or p != p.strip() or not p]
        # a bare piece had no space before it, every other one had
        self.cache.update(zip(alone, self._bytes([p[1:] if p[:1] == _BARE else " " + p for p in alone])))
        left = set(alone)
        many = [p for p in wanted if p not in left]
        lots = [many[i : i + 500] for i in range(0, len(many), 500)]
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([" " + " ".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            start = np.flatnonzero(self.spaced[ids])
            if len(start) != len(lot) or start[0]:  # never with a byte-level vocabulary
                self.cache.update(zip(lot, self._bytes([" " + p for p in lot])))
                continue
            raw, ends = ids.tobytes(), [*(start[1:] * self.width).tolist(), len(ids) * self.width]
            self.cache.update(zip(lot, [raw[a:b] for a, b in zip((start * self.width).tolist(), ends)]))

    def encode(self, column: pa.Array) -> list[bytes]:
        texts = column.fill_null("")
        if len(self.cache) > CACHE_MOST:
            self.cache = dict(islice(self.cache.items(), CACHE_CORE))
        fine = plain(*string_bytes(column)) & self.cuts
        odd = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) | ~np.array(self.cuts)
        for mark in (_BARE, _COMMA, _POINT, _LINE):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd & ~fine)
        out: list[bytes] = [b""] * len(texts)
        for i, found in zip(whole.tolist(), self._bytes(texts.take(pa.array(whole)).to_pylist())):
            out[i] = found
        for mine, swaps in ((fine, ((".\n", f" {_LINE} {_BARE}"), (", ", f" {_COMMA} "), (". ", f" {_POINT} "))), (~fine & ~odd, ())):
            rows = np.flatnonzero(mine)
            part = texts.take(pa.array(rows))
            for old, new in swaps:
                part = pc.replace_substring(part, old, new)
            for i, found in zip(rows.tolist(), self._cut(part)):
                out[i] = found
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are cut at single spaces: distinct pieces are looked up, and their ids laid out in order."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_BARE, texts.type), texts, pa.scalar("", texts.type)), " ")
        held = lists.flatten().dictionary_encode()
        names = held.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [p for p in names if p not in self.cache]:
            self._learn(missing)
        found = [self.cache[p] for p in names]
        ids = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        index = held.indices.to_numpy()
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.repeat((np.cumsum(size) - size)[index] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        cuts = (upto[bounds] * self.width).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _shard(part: int, shard: int, width: int, ids: list[bytes], keys: list[int | None]) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype(np.int64)
    known = np.array([k for k in keys if k is not None], np.int64)
    row = {
        "part": part,
        "shard": shard,
        "n_docs": len(ids),
        "n_ids": int(bounds[-1]),
        "least_id": int(known[0]) if len(known) else None,
        "most_id": int(known[-1]) if len(known) else None,
        "width": width,
        "doc_ids": EliasFano.encode(known).to_bytes(),
        "bounds": EliasFano.encode(bounds).to_bytes(),
        "ids": b"".join(ids),
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def _write(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, part = _encoder(path), TaskContext.get().partitionId()
    end = np.array([end_id], f"<u{encoder.width}").tobytes()
    ids: list[bytes] = []
    keys: list[int | None] = []
    size = shard = 0
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 21):
            for key, text in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text"))):
                ids.append(text + end)
                keys.append(key)
                size += len(ids[-1])
                if size >= SHARD_IDS * encoder.width:
                    yield _shard(part, shard, encoder.width, ids, keys)
                    ids, keys, size, shard = [], [], 0, shard + 1
    if ids:
        yield _shard(part, shard, encoder.width, ids, keys)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text and write shards in ascending id order to ``path``.

    Null text is an empty one: only the end id. Integer ids may repeat (such rows stand
    side by side, ordered by their texts); rows without an id stand last. An empty
    table writes an empty folder. Extra columns are ignored. Rows are dealt by range of
    id and text, so one id may hold any share of the rows without meeting in one task.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = [F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.xxhash64("text").alias("hash")]
    rows = rows.select("doc_id", "text", keys[0], keys[2])
    dealt = rows.repartitionByRange("last", "doc_id", "hash").sortWithinPartitions("last", "doc_id", "hash")
    shards = dealt.select("doc_id", "text").mapInArrow(lambda it: _write(tokenizer, end_id, it), SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)


def _keys(row: dict) -> EliasFano:
    return EliasFano.from_bytes(row["doc_ids"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            n = row["n_docs"]
            bounds = EliasFano.from_bytes(row["bounds"]).at(np.arange(n + 1))
            held = _keys(row)
            keys = pa.concat_arrays([pa.array(held.at(np.arange(len(held))), pa.int64()), pa.nulls(n - len(held), pa.int64())])
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["part"], np.int32)),
                    pa.array(np.full(n, row["shard"], np.int32)),
                    keys,
                    pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(crcs, pa.int64()),
                ],
                names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Return (doc_id, start, n_tokens, ids_crc32), all from the files.

    ``start`` counts the ids of all documents before: the sizes of shards are summed within their part,
    and only one row a part meets in one place.
    """
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(parts, "part")
    bases = bases.select("part", "shard", (F.col("before") + F.col("within")).alias("base"))
    rows = shards.mapInArrow(_read, ROWS).join(bases, ["part", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Return (doc_id, ids) of the given documents, one row for each time that one stands in the files.

    Only shards whose id range holds one of them are read; there a document is found by halving over its selected ids,
    and its own ids lie between two selected bounds: nothing is decoded whole.
    """
    wanted = sorted(set(doc_ids))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, bounds = _keys(row), EliasFano.from_bytes(row["bounds"])
                for doc in wanted:
                    first, last = keys.find(doc), keys.find(doc + 1)
                    at = bounds.at(np.arange(first, last + 1)).tolist()
                    width = row["width"]
                    lists = [np.frombuffer(row["ids"][width * a : width * b], f"<u{width}").astype(np.int64) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(lists), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for doc in wanted:
        near = near | ((F.col("least_id") <= doc) & (F.col("most_id") >= doc))
    return spark.read.schema(SCHEMA).parquet(path).filter(near).mapInArrow(slices, "doc_id long, ids array<long>")


def encode_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder among the shared ones and read the files back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path)
