"""Language-model scores from a probabilistic suffix tree over words (dealt operator 9).

Symbols are the words, the end of a text, and one symbol for every unknown word; contexts are
the words before, back to the beginning of the text. The shortest context, the empty one, has
counts of all words. For the longer ones every token is dealt once, as a window of its code and the codes
of the words before it, by ranges of the reversed context: a part holds all that its contexts need, learns
them and scores its windows; only sums by text come back.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.session import swept

from .tables import discard, ranked, stored
from .text import BLANKS, LOWER, look_up, mix, pieces, signed, string_bytes, word_hashes, words

DEPTH = 4  # words of the longest context
LEAST = 2  # times a run of words must occur to be a context or a prediction
DISCOUNT = 0.5
BEGIN, END = np.uint64(1), np.uint64(2)  # stand for the beginning and the end of a text among the word hashes
SLICE_RUNS = 1 << 19  # tokens for each part that the windows are dealt to
CUT_SAMPLE = 32  # windows a part that the ranges of the parts are taken from
# One row a piece of a partition (about four megabytes of whole texts): its distinct words once,
# its texts as places in that list.
PACKED = "piece long, doc_id array<long>, held_out array<boolean>, first array<int>, words binary, n binary, at binary"
# The same texts with codes of their words in the whole corpus, and what each text needs no context for.
CODED = "piece long, doc_id array<long>, held_out array<boolean>, first array<int>, known array<long>, base array<double>, codes binary"
SUMS = "piece long, context int, text binary, score binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
SCALE = float(1 << 36)  # sums of logarithms come back as multiples of its inverse
BEGIN_CODE, END_CODE, FIRST_CODE = 1, 2, 3  # codes in windows; 0 is no word, or one that is too rare for runs


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = string_bytes(piece.column("text"))
            data = LOWER[data]
            starts, ends, first = words(data, offsets, BLANKS)
            held = piece.column("held_out").to_numpy(zero_copy_only=False)
            _, one, at = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            learnt = np.repeat(~held, np.diff(first))
            n = np.bincount(at[learnt], minlength=len(one)).astype(np.int64)
            often = np.argsort(-np.bincount(at, minlength=len(one)), kind="stable")  # small places for common words
            one, n = one[often], n[often]
            size = (ends - starts)[one] + 1
            bounds = np.concatenate([[0], np.cumsum(size)])
            spelt = np.full(bounds[-1], 0x0A, np.uint8)
            inner = np.repeat(starts[one] - bounds[:-1], size) + np.arange(bounds[-1])
            inside = np.ones(len(spelt), bool)
            inside[bounds[1:] - 1] = False
            spelt[inside] = data[inner[inside]]
            columns = [
                pa.array([number], pa.int64()),
                *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (piece.column("doc_id"), piece.column("held_out"), pa.array(first, pa.int32()))],
                *[pa.array([_shrink(x)], pa.binary()) for x in (spelt, n.astype("<i4"), np.argsort(often).astype("<i4")[at])],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PACKED.split(", ")])
            number += 1


def _shrink(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _grow(value: pa.Scalar, kind: type | str) -> np.ndarray:
    raw = value.as_buffer()
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd"), kind)


def _flat(batch: pa.RecordBatch | pa.Table, row: int, name: str) -> pa.Array:
    """The list that one packed row holds in a column."""
    return batch.column(name)[row].values


def _spelt(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a packed row's words, where each starts and ends."""
    data = _grow(batch.column("words")[row], np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    return data, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (piece, place, word, n) for each distinct word of a piece, the word as its hash."""
    for batch in batches:
        for row in range(batch.num_rows):
            word = signed(word_hashes(*_spelt(batch, row)))
            columns = [np.full(len(word), batch.column("piece")[row].as_py(), np.int64), np.arange(len(word), dtype=np.int32), word]
            n = pa.array(_grow(batch.column("n")[row], "<i4"), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), n], names=["piece", "place", "word", "n"])


def _longer(heads: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of runs that end at each symbol, from those one symbol shorter that end before it."""
    out = np.zeros(len(symbols), np.uint64)
    out[1:] = mix(heads[:-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[1:])
    return out


@dataclass(frozen=True)
class SuffixTree:
    """The empty context's smoothing, and by depth the contexts and predictions that stayed.

    ``contexts[d - 1]``: ascending hashes and what each leaves to the shorter context;
    ``symbols[d - 1]``: ascending hashes of context and symbol with the symbol's own share.
    """

    tokens: int
    ends: int
    discount: float
    unknown: float
    contexts: list[tuple[np.ndarray, np.ndarray]]
    symbols: list[tuple[np.ndarray, np.ndarray]]

    def alone(self, count: np.ndarray) -> np.ndarray:
        """Probability under the empty context of symbols with these training counts."""
        return np.where(count > 0, (count - self.discount) / max(self.tokens, 1), self.unknown)

    def chances(self, symbols: np.ndarray, before: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of the symbols ``at``: the state is the longest context of the tree that ends there.

        The tree holds every suffix of its contexts, so the search ends at the first that is absent.
        """
        p = self.alone(count)
        rising = np.arange(len(at))
        context = symbols
        for d, ((keys, left), (pairs, share)) in enumerate(zip(self.contexts, self.symbols), 1):
            if d > 1:
                context = _longer(context, symbols)
            rising = rising[before[at[rising]] >= d]
            place = look_up(keys, context[at[rising] - 1])
            rising, place = rising[place >= 0], place[place >= 0]
            if not len(rising):
                break
            own = look_up(pairs, _longer(context, symbols)[at[rising]])
            p[rising] = left[place] * p[rising] + (np.where(own >= 0, share[own], 0.0) if len(pairs) else 0.0)
        return p


@dataclass(frozen=True)
class Codes:
    """Codes of words by falling count: how often each occurs, and the sums of the empty context.

    Words that occur ``floor`` times or more have codes up to ``last``; a rarer one has ``last`` and its count.
    """

    root: SuffixTree
    types: int
    floor: float
    last: int
    firsts: np.ndarray  # rank of the first word of each count
    times: np.ndarray  # the counts, falling

    def of(self, rank: np.ndarray) -> np.ndarray:
        count = self.times[np.searchsorted(self.firsts, rank, "right") - 1]
        return np.where(count >= self.floor, rank + FIRST_CODE, self.last + count).astype(np.int32)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        out = np.where(codes > self.last, codes - self.last, 0).astype(np.int64)
        out[codes == END_CODE] = self.root.ends
        word = (codes >= FIRST_CODE) & (codes <= self.last)
        out[word] = self.times[np.searchsorted(self.firsts, codes[word] - FIRST_CODE, "right") - 1]
        return out


def _ranks(found: pa.Table) -> pa.Table:
    """One row for a piece: places of its distinct words that are known, ascending, and their ranks."""
    place, rank = found["place"].to_numpy(), found["rank"].to_numpy()
    order = np.argsort(place)
    blob = _shrink(_planes(np.stack([np.diff(place[order], prepend=0), rank[order]])))
    return pa.table([found["piece"][:1].cast(pa.int64()), pa.array([blob], pa.binary())], names=["piece", "ranks"])


def _coded(codes: Codes, packed: pa.Table, found: pa.Table) -> pa.Table:
    """One piece in codes, given the ranks of its distinct words that are known."""
    first = _flat(packed, 0, "first").to_numpy().astype(np.int64)
    place = _grow(packed.column("at")[0], "<i4")
    code = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int32)
    if found.num_rows:
        at, rank = _numbers(found["ranks"][0], 2)
        code[np.cumsum(at)] = codes.of(rank)
    each = codes.counts(code)[place]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends, whole = codes.root.ends, np.log10(codes.root.tokens + 1 * (codes.types + 1))
    known = np.bincount(text, each > 0, len(first) - 1).astype(np.int64) + int(ends > 0)
    base = np.bincount(text, np.log10(each + 1.0) - whole, len(first) - 1) + (np.log10(ends + 1.0) - whole)
    columns = [packed.column("piece").combine_chunks()]
    columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*[_flat(packed, 0, k) for k in ("doc_id", "held_out", "first")], pa.array(known), pa.array(base))]
    columns += [pa.array([_shrink(_planes(code[place][None]))], pa.binary())]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in CODED.split(", ")])


def _planes(columns: np.ndarray) -> np.ndarray:
    """Rows of 32-bit numbers as planes of bytes, which shrink better."""
    return np.ascontiguousarray(np.ascontiguousarray(columns, "<u4").view(np.uint8).reshape(*columns.shape, 4).swapaxes(1, 2))


def _numbers(value: pa.Scalar, rows: int) -> np.ndarray:
    planes = _grow(value, np.uint8)
    planes = planes.reshape(rows, 4, len(planes) // (4 * rows))
    return np.ascontiguousarray(planes.swapaxes(1, 2)).view("<i4")[:, :, 0].copy()


def _windows(batch: pa.RecordBatch, row: int, depth: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a piece the codes of the words before it, the nearest first, and its own; its text, and whether it is learnt from."""
    first = _flat(batch, row, "first").to_numpy().astype(np.int64)
    texts, sizes = len(first) - 1, np.diff(first)
    text = np.repeat(np.arange(texts), sizes + 1)
    at = np.arange(len(text)) + (text + 1) * depth  # so many places before each text: the beginning and none
    stream = np.zeros(len(text) + texts * depth, np.int32)
    end = at[np.cumsum(sizes + 1) - 1]
    stream[end - sizes - 1] = BEGIN_CODE
    stream[end] = END_CODE
    word = np.ones(len(text), bool)
    word[np.cumsum(sizes + 1) - 1] = False
    stream[at[word]] = _numbers(batch.column("codes")[row], 1)[0]
    out = np.empty((depth + 1, len(text)), np.int32)
    out[depth] = stream[at]
    stream[stream > last] = 0
    for d in range(depth):
        out[d] = stream[at - 1 - d]
        if d:
            out[d, out[d - 1] == 0] = 0  # nothing is known beyond a rare word
    return out, text, ~_flat(batch, row, "held_out").to_numpy(zero_copy_only=False)[text]


def _salt(piece: int, size: int) -> np.ndarray:
    """The last key of the windows of a piece, so that equal ones can be dealt to several parts."""
    start = np.array([piece + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(start + np.arange(size, dtype=np.uint64)) >> np.uint64(33)).astype(np.int32)


def _pair(columns: np.ndarray) -> np.ndarray:
    """The first two columns as one number, or the only one."""
    wide = columns[0].astype(np.uint64)
    return wide << np.uint64(32) | columns[1].astype(np.uint64) if len(columns) > 1 else wide


def _order(columns: np.ndarray) -> np.ndarray:
    """The order of windows by all their columns, the first one first."""
    return np.lexsort([_pair(columns[i : i + 2]) for i in range(0, len(columns), 2)][::-1])


def _some(depth: int, last: int, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each piece with their salts."""
    for batch in batches:
        for row in range(batch.num_rows):
            piece = batch.column("piece")[row].as_py()
            columns, _, _ = _windows(batch, row, depth, last)
            salt = _salt(piece, columns.shape[1])
            drawn = np.flatnonzero(mix(salt.astype(np.uint64) + np.uint64(piece)) % np.uint64(step) == 0)
            rows = np.vstack([columns, salt])[:, drawn].T.ravel()
            sizes = np.arange(0, len(rows) + 1, depth + 2, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(sizes), pa.array(rows, pa.int32()))], names=["window"])


def _cuts(coded: DataFrame, depth: int, codes: Codes, tokens: int) -> np.ndarray:
    """The first window of each part but the first, one a column."""
    parts = -(-tokens // SLICE_RUNS)
    none = np.zeros((depth + 2, 0), np.int32)
    if parts < 2:
        return none
    step = max(tokens // (parts * CUT_SAMPLE), 1)
    found = coded.mapInArrow(lambda it: _some(depth, codes.last, step, it), "window array<int>").toArrow()
    if not found.num_rows:
        return none
    drawn = np.concatenate([x.flatten().to_numpy() for x in found["window"].chunks]).reshape(-1, depth + 2).T
    drawn = drawn[:, _order(drawn)]
    return np.unique(drawn[:, np.arange(1, parts) * drawn.shape[1] // parts], axis=1)


@dataclass(frozen=True)
class Shared:
    """Contexts whose windows lie in several parts, by length as (number of the context one word shorter, word), and these parts."""

    keys: list[np.ndarray]
    numbers: list[np.ndarray]
    parts: list[tuple[int, int, int]]

    def of(self, words: np.ndarray, length: int, shorter: np.ndarray) -> np.ndarray:
        """Numbers of the contexts of ``length``, -1 for those in one part, given their first words and the numbers of the shorter ones."""
        at = np.flatnonzero(shorter >= 0)
        place = look_up(self.keys[length - 1], shorter[at] << 32 | words[at])
        out = np.full(len(shorter), -1)
        at, place = at[place >= 0], place[place >= 0]
        out[at] = self.numbers[length - 1][place]
        return out


def _shared(cuts: np.ndarray, depth: int) -> Shared:
    rows = [tuple(x) for x in cuts.T.tolist()]
    numbers: dict[tuple[int, ...], int] = {(): 0}
    keys: list[dict[int, int]] = [{} for _ in range(depth)]
    parts = []
    for row in rows:
        for d in range(1, depth + 1):
            head = row[:d]
            if not row[d - 1]:
                break
            if head not in numbers:
                number = numbers[head] = len(numbers)
                keys[d - 1][numbers[head[:-1]] << 32 | row[d - 1]] = number
                parts.append((number, bisect_right(rows, head), bisect_right(rows, (*head, 1 << 32))))
    return Shared([np.array(sorted(k), np.int64) for k in keys], [np.array([k[x] for x in sorted(k)], np.int64) for k in keys], parts)


def _shared_runs(depth: int, last: int, shared: Shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, symbol, n) of the shared contexts in the training texts of each piece; all rare symbols are one, 0."""
    for batch in batches:
        for row in range(batch.num_rows):
            columns, _, learnt = _windows(batch, row, depth, last)
            columns = columns[:, learnt]
            number, found = np.zeros(columns.shape[1], np.int64), [np.zeros(0, np.int64)]
            for d in range(1, depth + 1):
                number = shared.of(columns[d - 1], d, number)
                columns, number = columns[:, number >= 0], number[number >= 0]
                found.append(number << 32 | np.where(columns[depth] > last, 0, columns[depth]).astype(np.int64))
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["context", "symbol", "n"])


def _deal(depth: int, last: int, cuts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, piece, windows): the windows of a piece in each part, in the order of their first two columns, with text and whether it is learnt from."""
    heads = _pair(cuts[:2])
    for batch in batches:
        for row in range(batch.num_rows):
            piece = batch.column("piece")[row].as_py()
            columns, text, learnt = _windows(batch, row, depth, last)
            key = _pair(columns[:2])
            order = np.argsort(key)
            key = key[order]
            bounds, until = np.searchsorted(key, heads), np.searchsorted(key, heads, "right")
            # windows that begin as a cut does are told apart by their other columns
            salt = _salt(piece, columns.shape[1])
            for low in np.unique(bounds[bounds < until]):
                some = np.flatnonzero((bounds == low) & (bounds < until))
                own = order[low : until[some[0]]]
                both = _order(np.hstack([cuts[2:, some], np.vstack([columns[2:, own], salt[own]])]))
                cut = both < len(some)
                order[low : low + len(own)] = own[both[~cut] - len(some)]
                bounds[some] = low + np.flatnonzero(cut) - np.arange(len(some))
            bounds = np.concatenate([[0], bounds, [len(order)]])
            steps = np.vstack([columns[2:, order], (text * 2 + learnt)[order].astype(np.int32)])
            blobs = []
            parts = np.flatnonzero(np.diff(bounds))
            for i, j in zip(bounds[parts], bounds[parts + 1]):
                step = np.diff(key[i:j], prepend=np.uint64(0))
                head = np.stack([step >> np.uint64(32), step & np.uint64(0xFFFFFFFF)])
                blobs.append(_shrink(_planes(np.vstack([head, steps[:, i:j]]))))
            columns = [pa.array(parts, pa.int32()), pa.array([piece] * len(parts), pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "piece", "windows"])


@dataclass
class Level:
    """The contexts of one length in a part and their runs; ``context`` is that of each window."""

    context: np.ndarray
    start: np.ndarray
    parent: np.ndarray
    number: np.ndarray
    left: np.ndarray
    keep: np.ndarray
    runs: np.ndarray  # ascending: context and symbol
    share: np.ndarray

    def longer(self, at: np.ndarray, symbols: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Chances of the symbols of the windows ``at`` from those under the context one word shorter."""
        context = self.context[at].astype(np.int64)
        place = look_up(self.runs, context << 32 | symbols[at].astype(np.int64))
        return self.left[context] * p + (np.where(place >= 0, self.share[place], 0.0) if len(self.runs) else 0.0)


def _learnt(codes: Codes, shared: Shared, depth: int, columns: np.ndarray, learnt: np.ndarray, extra: pa.Table) -> list[Level]:
    """The contexts that windows in order have, judged by their divergence (see ``score_texts``)."""
    symbols, tokens = columns[depth], codes.root.tokens
    rising = np.flatnonzero(learnt & (symbols > 0) & (symbols <= codes.last)).astype(np.int32)
    new = np.zeros(len(symbols), bool)
    new[0] = True
    levels: list[Level] = []
    owner, symbol, times = (extra[k].to_numpy().astype(np.int64) for k in ("context", "symbol", "n"))
    runs, chance, above = np.zeros(0, np.int64), np.zeros(0), np.zeros(len(symbols), np.int32)
    number = np.zeros(len(symbols), np.int64)
    for d in range(1, depth + 1):
        new[1:] |= columns[d - 1][1:] != columns[d - 1][:-1]
        start = np.flatnonzero(new)
        context = (np.cumsum(new) - 1).astype(np.int32)
        total = np.add.reduceat(learnt, start, dtype=np.int64)
        parent = above[start]
        number = shared.of(columns[d - 1][start], d, number[parent] if d > 1 else np.zeros(len(start), np.int64))
        rising = rising[columns[d - 1][rising] > 0]
        keys = context[rising].astype(np.int64) << 32 | symbols[rising]
        own, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        often = n >= codes.floor
        rising = rising[often[back] | (number[context[rising]] >= 0)]
        often &= number[own >> 32] < 0  # the runs of shared contexts come counted over all parts
        own, n = own[often], n[often]
        del keys, back
        if (number >= 0).any():
            local = np.flatnonzero(number >= 0)
            local = local[np.argsort(number[local])]
            place = look_up(number[local], owner)
            at = np.flatnonzero(place >= 0)
            sums = symbol[at] < 0
            total[local[place[at[sums]]]] = times[at[sums]]
            at = at[~sums]
            own, n = np.concatenate([own, local[place[at]] << 32 | symbol[at]]), np.concatenate([n, times[at]])
            order = np.argsort(own)
            own, n = own[order], n[order]
        head = own >> 32
        if d > 1:
            below = chance[look_up(runs, parent[head].astype(np.int64) << 32 | own & 0xFFFFFFFF)] if len(own) else np.zeros(0)
        else:
            below = codes.root.alone(codes.counts(own & 0xFFFFFFFF))
        seen, k = np.bincount(head, n, len(start)), np.bincount(head, minlength=len(start))
        total = np.maximum(total, 1)
        left = np.clip(1 - (seen - DISCOUNT * k) / total, 1e-9, 1.0)
        share = (n - DISCOUNT) / total[head]
        runs, chance = own, left[head] * below + share
        value = np.bincount(head, n * np.log(chance / below), len(start)) + (total - seen) * np.log(left)
        levels.append(Level(context, start, parent, number, left, (k > 0) & (value >= k * np.log(max(tokens, 1))), runs, share))
        above = context
    for level, shorter in zip(levels[:0:-1], levels[-2::-1]):  # suffixes stay with what they end
        shorter.keep[level.parent[level.keep]] = True
    return levels


def _gathered(windows: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a part in the order of the words before them, and the row that each comes from."""
    sizes, columns = [], []
    for x in windows["windows"]:
        found = _numbers(x, depth + 2)
        key = np.cumsum(found[0].view(np.uint32).astype(np.uint64) << np.uint64(32) | found[1].view(np.uint32))
        found[0], found[1] = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        sizes.append(found.shape[1])
        columns.append(found)
    columns = np.hstack(columns)
    order = _order(columns[:depth])
    return columns[:, order], np.repeat(np.arange(len(sizes)), sizes)[order]


def _part_scored(codes: Codes, shared: Shared, depth: int, windows: pa.Table, extra: pa.Table) -> pa.Table:
    """Sums of the log10 probabilities of a part's windows by piece and text (context -1).

    Whether a shared context is kept by a longer one is known when all parts are done. What a text gains if it is
    comes under the context's number; the shared contexts that this part keeps are rows without a piece.
    """
    if not windows.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())], names=["piece", "context", "text", "score"])
    columns, piece = _gathered(windows, depth)
    text, learnt = columns[depth + 1] >> 1, columns[depth + 1] & 1 > 0
    symbols = columns[depth]
    levels = _learnt(codes, shared, depth, columns, learnt, extra)
    p = codes.root.alone(codes.counts(symbols))
    sure, maybe, q = np.arange(len(p)), np.zeros(0, np.int64), np.zeros(0)
    gains: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels:
        stays = level.keep[level.context[sure]]
        maybe, q = np.concatenate([maybe, sure[~stays]]), np.concatenate([q, p[sure[~stays]]])
        sure = sure[stays]
        p[sure] = level.longer(sure, symbols, p[sure])
        number = level.number[level.context[maybe]]
        maybe, q, number = maybe[number >= 0], q[number >= 0], number[number >= 0]
        then = level.longer(maybe, symbols, q)
        gains.append((maybe, number, np.log10(then) - np.log10(q)))
        q = then
    at, number, score = (np.concatenate(x) for x in zip((np.arange(len(p)), np.full(len(p), -1), np.log10(p)), *gains))
    forced = np.concatenate([x.number[x.keep & (x.number >= 0)] for x in levels])
    del levels, columns, symbols, learnt, sure
    owners, row = np.unique(number + 1 << 32 | piece[at], return_inverse=True)
    slots, slot = np.unique(row << 32 | text[at], return_inverse=True)
    sums = np.rint(np.bincount(slot, score, len(slots)) * SCALE).astype("<i8")
    cuts = np.searchsorted(slots >> 32, np.arange(1, len(owners)))
    texts = [_shrink(_planes(np.diff(x & 0xFFFFFFFF, prepend=0)[None])) for x in np.split(slots, cuts)]
    of = windows["piece"].to_numpy()[owners & 0xFFFFFFFF]
    columns = [
        pa.array([*of, *[None] * len(forced)], pa.int64()),
        pa.array([*(owners >> 32) - 1, *forced], pa.int32()),
        pa.array([*texts, *[None] * len(forced)], pa.binary()),
        pa.array([*[_shrink(_planes(x.view("<u4").reshape(-1, 2).T)) for x in np.split(sums, cuts)], *[None] * len(forced)], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, names=["piece", "context", "text", "score"])


def _texts_scored(coded: pa.Table, found: pa.Table) -> pa.Table:
    """Scores of the texts of one piece from the sums of all parts."""
    first = _flat(coded, 0, "first").to_numpy()
    score = np.zeros(len(first) - 1)
    for texts, sums in zip(found["text"], found["score"]):
        low, high = _numbers(sums, 2)
        score[np.cumsum(_numbers(texts, 1)[0])] += (high.astype(np.int64) << 32 | low.view(np.uint32)) / SCALE
    kept = [_flat(coded, 0, k) for k in ("doc_id", "held_out", "known", "base")]
    columns = [*kept[:2], pa.array(np.diff(first).astype(np.int64) + 1), *kept[2:], pa.array(score)]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])


def _encode(packed: DataFrame, counts: DataFrame, ends: int, least: float) -> tuple[Codes, DataFrame, DataFrame]:
    """Codes of the words, the packed texts in codes, and the ranks of the words (both written)."""
    known = counts.filter(F.col("c") > 0)
    # one row for each count that occurs: their number grows with the root of the corpus at most
    sums = known.groupBy("c").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("c")).toArrow()
    times, v = sums["c"].to_numpy(), sums["v"].to_numpy()
    tokens, types = int(times @ v) + ends, int(v.sum()) + int(ends > 0)
    n1, n2 = (int(v[times == k].sum()) for k in (1, 2))
    discount = (n1 + 1) / (n1 + 2 * n2 + 2)
    root = SuffixTree(tokens, ends, discount, types * discount / tokens if tokens else 1.0, [], [])
    floor = max(least, 2)
    codes = Codes(root, types, floor, FIRST_CODE - 1 + int(v[times >= floor].sum()), np.cumsum(v) - v, times)
    ranks = ranked(known.select("word", "c"), [-F.col("c"), F.col("word")], "rank")
    # written before the join, so that adaptive execution can split a word that is in every piece
    ranked_words = stored(ranks.select("word", "rank"), "ranks")
    discard(ranks)
    listed = packed.select("piece", "words", "n").mapInArrow(_listed, "piece long, place int, word long, n long")
    met = listed.select("piece", "place", "word").join(ranked_words, "word").select("piece", "place", F.col("rank").cast("int").alias("rank"))
    # written before it meets the texts, so that the shuffles of the words are gone by then
    met = stored(met.groupBy("piece").applyInArrow(_ranks, "piece long, ranks binary"), "met")
    coded = packed.drop("n", "words").groupBy("piece").cogroup(met.groupBy("piece")).applyInArrow(lambda a, b: _coded(codes, a, b), CODED)
    coded = stored(coded, "coded")
    discard(met)
    return codes, coded, ranked_words


def _nodes(codes: Codes, depth: int, hashes: np.ndarray, windows: pa.Table) -> pa.Table:
    """(length, key, left, share) of the contexts that stay and of their runs, when all windows are in one part."""
    columns, _ = _gathered(windows, depth)
    alone = Shared([np.zeros(0, np.int64)] * depth, [np.zeros(0, np.int64)] * depth, [])
    extra = pa.table({k: pa.array([], pa.int64()) for k in ("context", "symbol", "n")})
    out = []
    for d, level in enumerate(_learnt(codes, alone, depth, columns, columns[depth + 1] & 1 > 0, extra), 1):
        key = hashes[columns[d - 1][level.start]]
        step = np.uint64(0x9E3779B97F4A7C15)
        for i in range(d - 2, -1, -1):
            key = mix(key * step + hashes[columns[i][level.start]])
        run = level.keep[level.runs >> 32]
        of, symbol = level.runs[run] >> 32, level.runs[run] & 0xFFFFFFFF
        for keys, values in ((key[level.keep], (level.left[level.keep], None)), (mix(key[of] * step + hashes[symbol]), (None, level.share[run]))):
            columns_ = [np.full(len(keys), d), signed(keys), *(x if x is not None else [None] * len(keys) for x in values)]
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns_, (pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["length", "key", "left", "share"]))
    return pa.concat_tables(out)


def grow(packed: DataFrame, counts: DataFrame, ends: int, depth: int = DEPTH, least: float = LEAST) -> SuffixTree:
    """The whole tree in one place, to look at what a small corpus teaches (see ``score_texts``)."""
    codes, coded, words = _encode(packed, counts, ends, least)
    spelt = words.filter(F.col("rank") <= codes.last - FIRST_CODE).orderBy("rank").toArrow()
    hashes = np.concatenate([np.array([0, BEGIN, END], np.uint64), spelt["word"].to_numpy().view(np.uint64)])
    none = np.zeros((depth + 2, 0), np.int32)
    dealt = coded.mapInArrow(lambda it: _deal(depth, codes.last, none, it), "part int, piece long, windows binary")
    rows = dealt.groupBy("part").applyInArrow(lambda t: _nodes(codes, depth, hashes, t), "length int, key long, left double, share double").toArrow()
    both = [[_ascending(rows.filter(pc.equal(rows["length"], d)), k) for d in range(1, depth + 1)] for k in ("left", "share")]
    return replace(codes.root, contexts=both[0], symbols=both[1])


def _ascending(rows: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the rows that have the value, and the value."""
    rows = rows.filter(pc.is_valid(rows[value]))
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows[value].to_numpy()[order]


def score_texts(
    docs: DataFrame, held_out: Column, depth: int = DEPTH, least: float = LEAST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Contexts and counts are learnt from the rows that are not ``held_out``; every row is scored
    whole. Words are counted over all training texts by an aggregation on their 64-bit hashes (of a
    billion distinct words two share one with a chance of 3 %). Null text is an empty one: its end only. Without
    training rows nothing is known and every token is the unknown symbol. Rows are scored
    one by one, so repeated rows and ids are fine; extra columns are ignored.

    Runs of words that occur ``least`` times (at least twice) are tried, whatever the size of the corpus. A context of
    more than ``depth`` words is never tried. A context stays if its divergence from the context one word shorter, as log
    likelihood over the whole corpus, pays for its predictions at ln(tokens) nats each (minimum description length);
    its suffixes stay with it. Its symbols are discounted, and what is left is shared as the shorter context shares
    it, down to the empty one, whose discount by Ney's estimate is the chance of an unknown word.

    Every token goes once, as a window of codes, to one of the parts, which are ranges of about ``SLICE_RUNS`` windows by
    the words before the token, the nearest first: all runs of a context, of its suffixes and of its extensions are
    neighbours. The few contexts whose windows lie in several parts are counted beside that and given to all of these. Equal
    windows can be dealt to several parts too, so no part grows with a frequent word or a repeated text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    with swept(spark):
        packed = stored(rows.mapInArrow(_pack, PACKED), "packed")
        listed = packed.select("piece", "words", "n").mapInArrow(_listed, "piece long, place int, word long, n long")
        counts = stored(listed.groupBy("word").agg(F.sum("n").alias("c")), "words")
        ends = packed.select(F.sum(F.size(F.filter("held_out", lambda x: ~x))).alias("n")).first()["n"] or 0
        codes, coded, words = _encode(packed, counts, ends, least)
        for table in (packed, counts, words):
            discard(table)
        cuts = _cuts(coded, depth, codes, codes.root.tokens)
        shared = _shared(cuts, depth)
        dealt = coded.mapInArrow(lambda it: _deal(depth, codes.last, cuts, it), "part int, piece long, windows binary")
        found = coded.mapInArrow(lambda it: _shared_runs(depth, codes.last, shared, it), "context int, symbol int, n long")
        found = stored(found.groupBy("context", "symbol").agg(F.sum("n").alias("n")), "shared")
        totals = found.groupBy("context").agg(F.lit(-1).alias("symbol"), F.sum("n").alias("n"))
        extra = found.filter((F.col("symbol") > 0) & (F.col("n") >= codes.floor)).unionByName(totals)
        where = spark.createDataFrame(shared.parts, "context int, low int, high int")
        extra = extra.join(F.broadcast(where), "context").select(F.explode(F.sequence("low", "high")).alias("part"), "context", "symbol", "n")
        sums = dealt.groupBy("part").cogroup(extra.groupBy("part")).applyInArrow(lambda a, b: _part_scored(codes, shared, depth, a, b), SUMS)
        sums = stored(sums, "sums")
        discard(found)
        kept = [r["context"] for r in sums.filter(F.col("piece").isNull()).select("context").distinct().collect()]
    kept = spark.createDataFrame([(x,) for x in (-1, *kept)], "context int")
    used = sums.filter(F.col("piece").isNotNull()).join(F.broadcast(kept), "context", "left_semi").select("piece", "text", "score")
    scored = coded.drop("codes").groupBy("piece").cogroup(used.groupBy("piece")).applyInArrow(_texts_scored, SCORES)
    total = F.lit(codes.root.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", total, F.col("base").alias("base_score"), "score")
