"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow string column.

Everything here works on one piece of a partition (a few megabytes of whole texts), so
the memory of a task does not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20  # texts handled at once; a single longer text is one piece

# The blanks of every contract: space and \t \n \v \f \r.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

# Separators of the decontamination words: every ASCII byte but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 12


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW, _LOW_INV = _powers(_BASE, 1 << _STEP), _powers(_INVERSE, 1 << _STEP)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together stay below ``limit`` bytes, or hold one text."""
    offsets = string_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from zero) of a string array; null is empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = cuts[inside[cuts + 1] & inside[cuts]]  # a row ends and the next begins inside a run
    first[cuts] = True
    last[cuts] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any range of bytes or code points follows (see ``range_hash``)."""
    step = 1 << _STEP
    out = np.zeros(len(data) + 1, np.uint64)
    high = _powers(int(_LOW[-1]) * _BASE % (1 << 64), (len(data) >> _STEP) + 1)
    # block by block, in place: the sums are the only array of the data's length
    for at, power in zip(range(0, len(data), step), high):
        part = data[at : at + step]
        values = _BYTE[part] if part.dtype == np.uint8 else mix(part.astype(np.uint64)) | np.uint64(1)
        out[at + 1 : at + 1 + len(part)] = values * _LOW[: len(part)] * power
    return np.cumsum(out, out=out)


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    high = _powers(int(_LOW_INV[-1]) * _INVERSE % (1 << 64), (int(starts.max()) >> _STEP) + 1)
    shift = high[starts >> _STEP] * _LOW_INV[starts & ((1 << _STEP) - 1)]
    return mix((prefix[ends] - prefix[starts]) * shift + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), starts, ends)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows whose words start at ``first``; rows without words are zero."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def characters(texts: list[str], between: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``between``, and the offsets of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + len(between)
    joined = (between.join(texts) + between).encode("utf-32-le", "surrogatepass") if texts else b""
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` code points from every place on (``n`` - 1 fewer than places)."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    out = points[: len(points) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out = out * np.uint64(_BASE) + points[k : len(points) - n + 1 + k]
    return mix(out + np.uint64(n))


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the ascending ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
