"""Near duplicates by SimHash, met at the anchors of a covering code (dealt operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.operators.dedup import components

from .tables import stored

BITS, SHINGLE, MAX_BITS = 64, 3, 3
# Blocks of the code: the perfect Golay code of 23 bits and repetition codes of odd length,
# which are perfect too. 4096 * 8 anchors; the covering radius is 3 + 6 + 6 + 7 = 22.
BLOCKS = (23, 13, 13, 15)
HOMES = 4096  # fingerprints compared at once in one task
_GOLAY = 0b101011100011  # generator polynomial of the Golay code
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 42
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a text: a bit is 1 if set in over half of the shingles' XXH64."""
    tokens = [w for w in _BLANKS.split((text or "").encode("utf-8", "surrogatepass").translate(_UPPER)) if w]
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - shingle + 1, 1)
    digest, seed = xxhash.xxh64_intdigest, _SEED
    cuts = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in cuts), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null or blank text has fingerprint zero."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


@lru_cache(maxsize=1)
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Golay block: syndromes of the two halves, error patterns by syndrome and weight, and their bounds."""
    unit = []
    for i in range(23):
        word = 1 << i
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= _GOLAY << (k - 11)
        unit.append(word)
    syndrome = np.zeros(1 << 23, np.uint16)
    for i, s in enumerate(unit):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ s
    patterns = np.array([sum(1 << i for i in c) for w in range(3 + MAX_BITS + 1) for c in combinations(range(23), w)], np.int64)
    order = np.lexsort((np.bitwise_count(patterns), syndrome[patterns]))
    patterns = patterns[order]
    bounds = np.searchsorted(syndrome[patterns], np.arange(1 << 11 | 1))
    return syndrome, patterns, bounds, np.bitwise_count(patterns).astype(np.int64)


def anchors(prints: np.ndarray, blocks: tuple[int, ...] = BLOCKS, reach: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (print index, anchor, excess) within the covering radius plus ``reach``.

    The distance to an anchor is the sum over the blocks. A block's excess is what its
    distance has over the block's own radius. A print at its nearest anchor has excess 0
    everywhere, and a partner within ``reach`` bits has at most as much excess there as it has differing bits,
    so anchors are visited up to a total excess of ``reach``.
    """
    index = np.arange(len(prints))
    anchor = np.zeros(len(prints), np.int64)
    excess = np.zeros(len(prints), np.int64)
    at = 0
    for size in blocks:
        part = (prints >> np.uint64(at)).astype(np.int64) & ((1 << size) - 1)
        at += size
        if size == 23:
            syndrome, patterns, bounds, weight = _cosets()
            s = syndrome[part[index]]
            n = bounds[s.astype(np.int64) + 1] - bounds[s]
            pick = np.repeat(bounds[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
            index, anchor, excess = np.repeat(index, n), np.repeat(anchor, n), np.repeat(excess, n)
            # any 12 neighbouring bits tell the words of a cyclic code of dimension 12 apart
            anchor = anchor << 12 | (part[index] ^ patterns[pick]) >> 11
            excess = excess + np.maximum(weight[pick] - 3, 0)
        else:
            ones = np.bitwise_count(part[index]).astype(np.int64)
            far = np.maximum(np.stack([ones, size - ones], 1) - size // 2, 0).ravel()
            index, excess = np.repeat(index, 2), np.repeat(excess, 2) + far
            anchor = np.repeat(anchor << 1, 2) | np.tile([0, 1], len(ones))
        keep = excess <= reach
        index, anchor, excess = index[keep], anchor[keep], excess[keep]
    return index, anchor, excess


def _expand(reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            signed = batch.column("print").slice(at, 2000).to_numpy()
            index, anchor, excess = anchors(signed.view(np.uint64), BLOCKS, reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(signed[index]), pa.array(excess == 0)],
                names=["anchor", "print", "home"],
            )


def _hook(parent: np.ndarray, rows: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Unite all homes that one row meets; ``parent`` are the roots of the homes so far."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    group = np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1])]))
    while True:
        root = parent[homes]
        least = np.minimum.reduceat(root, first)[group]
        if (root == least).all():
            return parent
        np.minimum.at(parent, root, least)
        while (parent[parent] != parent).any():
            parent = parent[parent]


class _Anchor:
    """The homes of one anchor (or of one part of them) and the roots found among them."""

    def __init__(self, key: tuple):
        self.key, self.homes, self.parent = key, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def meet(self, prints: np.ndarray, reach: int) -> list[np.ndarray]:
        """Links of visiting prints: one to the root of the homes within reach of each."""
        out = []
        step = max(1, (1 << 20) // max(len(self.homes), 1))
        for at in range(0, len(prints) if len(self.homes) else 0, step):
            part = prints[at : at + step]
            apart = np.bitwise_count(part[:, None] ^ self.homes[None, :])
            rows, homes = np.nonzero(apart <= reach)
            if len(rows):
                self.parent = _hook(self.parent, rows, homes)
                heads = self.homes[self.parent[homes]]
                pairs = np.stack([part[rows], heads], 1)[np.concatenate([[True], rows[1:] != rows[:-1]])]
                out.append(pairs[pairs[:, 0] != pairs[:, 1]])
        return out

    def roots(self) -> np.ndarray:
        pairs = np.stack([self.homes, self.homes[self.parent]], 1) if len(self.homes) else np.zeros((0, 2), np.uint64)
        return pairs[pairs[:, 0] != pairs[:, 1]]


def _compare(reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and part, the homes of each before its visitors."""
    now: _Anchor | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        part = batch.column("part").to_numpy()
        prints = batch.column("print").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        new = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        bounds = [0, *(np.flatnonzero(new | (home[1:] != home[:-1])) + 1).tolist(), len(anchor)]
        links = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = (int(anchor[a]), int(part[a]))
            if now is None or now.key != key:
                if now is not None:
                    links.append(now.roots())
                now = _Anchor(key)
            if home[a]:
                now.homes = np.concatenate([now.homes, prints[a:b]])
                now.parent = np.arange(len(now.homes))
            else:
                links += now.meet(prints[a:b], reach)
        yield _links(links)
    if now is not None:
        yield _links([now.roots()])


def _links(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], names=["id_a", "id_b"])


def print_links(prints: DataFrame, reach: int = MAX_BITS) -> DataFrame:
    """Pairs (id_a, id_b) of distinct fingerprints whose components are those of all links within ``reach`` bits.

    ``prints``: distinct longs in a column ``print``. Every fingerprint is at home at its nearest
    anchor and visits all anchors in reach (about a hundred). At an anchor every visitor is
    compared with every home; what leaves the task is a spanning set of the links found
    there (each print with the least home it is connected to), at most one a row, however dense a group of near copies is. An anchor with
    very many homes is split into parts, and its visitors go to each.
    """
    if not 0 <= reach <= MAX_BITS:
        raise ValueError(f"the code's tables reach {MAX_BITS} bits")
    # each print becomes a hundred rows: deal them out first, so that no task grows that much
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.select("print").repartition(tasks, "print")
    met = prints.mapInArrow(lambda it: _expand(reach, it), "anchor int, print long, home boolean")
    nearest = prints.mapInArrow(lambda it: _expand(0, it), "anchor int, print long, home boolean")
    # at most 32768 rows, as many as the code has anchors
    crowded = nearest.groupBy("anchor").count().filter(F.col("count") > HOMES)
    crowded = stored(crowded.select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts")), "crowded")
    dealt = met.join(F.broadcast(crowded), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    homes = F.when(F.col("home"), F.array(F.struct(F.lit(True).alias("home"), own.alias("part")))).otherwise(F.array())
    visits = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.lit(False).alias("home"), i.alias("part")))
    dealt = dealt.select("anchor", "print", F.explode(F.concat(homes, visits)).alias("as")).select("anchor", "print", "as.*")
    ordered = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("home").desc(), "print")
    return ordered.mapInArrow(lambda it: _compare(reach, it), "id_a long, id_b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return (doc_id, row, print, root, component_id), one row per input row; ``row`` is a hash of the text.

    ``component_id`` is the smallest doc_id reachable over links of at most ``reach``
    differing bits. Copies share a fingerprint and are compared once. Null and blank texts have
    fingerprint zero and link as any other. Repeated rows are in one component.
    A missing doc_id is never the smallest, unless no row of the component has one. Components
    without ids, and those that share an id, have the same ``component_id``; ``root``, the least
    fingerprint of the component, tells them apart. Extra
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), fingerprint(F.col(text), shingle).alias("print"))
    rows = stored(rows, "prints")
    heads = stored(rows.groupBy("print").agg(F.min("doc_id").alias("head")), "distinct-prints")
    links = stored(print_links(heads, reach), "print-links")
    groups = components(links).withColumnsRenamed({"id": "print", "component": "root"})
    rooted = heads.join(groups, "print", "left").select("print", "head", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    # written first, so that adaptive execution can split a fingerprint that very many rows share
    named = stored(rooted.join(least, "root").select("print", "root", "component_id"), "components")
    return rows.join(named, "print").select("doc_id", "row", "print", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest id.

    Among a component's rows that share this id (or have none, if no row has one), the one with the
    smallest hash of the text stays, and one of equal rows. Ids are joined, texts are moved once.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    first = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("doc_id", "row"))
    kept = found.groupBy("root").agg(F.min(first).alias("k")).select("k.*")
    kept = stored(kept.select(_key("doc_id"), F.col("row").alias("__row")), "kept")
    keyed = docs.select("*", _key(doc_id), F.xxhash64(text).alias("__row"))
    alike = Window.partitionBy("__id", "__row").orderBy("__row")
    joined = keyed.join(kept.hint("merge"), ["__id", "__row"], "left_semi")
    return joined.withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") == 1).select(*docs.columns)


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id")
