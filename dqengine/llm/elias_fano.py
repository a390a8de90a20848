"""Elias-Fano code of a non-decreasing sequence, with select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sQqBQQ")  # magic, length, least value, low bits, high words, samples
_MAGIC = b"EF01"
SAMPLE = 256  # every so many-th one bit has its place stored, in 32 bits


class EliasFano:
    """``n`` integers up to ``u`` above the least in about n * (2 + log2(u / n)) bits.

    The low bits stand packed, the high parts in unary: entry i sets bit (x_i >> low) + i.
    ``select`` finds that bit from the nearest sample and the population counts after it.
    """

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits, self.low, self.high, self.samples = n, least, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        if np.any(values[1:] < values[:-1]):
            raise ValueError("the sequence must not decrease")
        least = int(values[0])
        rest = values.astype(np.uint64) - np.uint64(least % (1 << 64))
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        places = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if places[-1] >= 1 << 32:
            raise ValueError("too long for 32-bit samples: encode it in parts")
        bits = np.zeros((int(places[-1]) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, least, low_bits, low, high, places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(_MAGIC, self.n, self.least, self.low_bits, len(self.high), len(self.samples))
        return head + self.high.astype("<u8").tobytes() + self.samples.astype("<u4").tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, least, low_bits, words, samples = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano code")
        at = _HEAD.size
        high = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        sampled = np.frombuffer(data, "<u4", samples, at)
        return cls(n, least, low_bits, np.frombuffer(data, np.uint8, offset=at + 4 * samples), high, sampled)

    def select(self, i: int) -> int:
        """Place of the one bit of entry ``i``."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place // 64
        bits = int(self.high[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little") >> (first % 8)
        return self.least + (((self.select(i) - i) << self.low_bits) | (low & ((1 << self.low_bits) - 1)))

    def at(self, indices: np.ndarray) -> np.ndarray:
        """The entries at ``indices``, each by select: from its sample over the population counts to its bit."""
        i = np.asarray(indices, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError(f"{i.min()} to {i.max()} of {self.n}")
        high = self.high.astype(np.uint64)
        start = self.samples[i // SAMPLE].astype(np.int64)
        word, left = start // 64, i % SAMPLE
        # bits of the first word that stand before the sample do not count
        left = left + np.bitwise_count(high[word] & ((np.uint64(1) << (start % 64).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        while len(far := np.flatnonzero((ones := np.bitwise_count(high[word]).astype(np.int64)) <= left)):
            left[far] -= ones[far]
            word[far] += 1
        bits, place = high[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # within the word by halves
            low = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            place += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        rest = (word * 64 + place - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            packed = np.concatenate([self.low, np.zeros(8, np.uint8)])
            first = i * self.low_bits
            for k in range(self.low_bits):
                bit = first + k
                rest |= ((packed[bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return (rest + np.uint64(self.least % (1 << 64))).astype(np.int64)

    def find(self, value: int) -> int:
        """The first entry that is not below ``value``, by halving over selected entries."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self[middle] < value:
                low = middle + 1
            else:
                high = middle
        return low

    def __len__(self) -> int:
        return self.n

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        if not self.n:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high.astype("<u8").view(np.uint8), bitorder="little"))
        rest = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                rest |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return (rest + np.uint64(self.least % (1 << 64))).astype(np.int64)
