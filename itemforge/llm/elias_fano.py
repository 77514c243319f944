"""Elias-Fano sequences over flat buffers: monotone 64-bit numbers, read where they lie.

A value's low bits are packed one after the other; its high part is one bit of a bit vector, behind as
many zeros as the high part is. pack() makes the bytes; map() reads them in place from any buffer, a
memory-mapped file included, and adds counts of zeros, half a bit a bit. access(), successor() and all()
work on whole arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_HEAD = 4  # numbers of 64 bits in front: values, low bits, words of high bits, first value
MAX_LOW = 56  # a packed value is read with one load of 8 bytes
_PART = 1 << 16
_PAIRS, _FOURS, _EIGHTS, _EACH, _TOPS = (np.uint64(int.from_bytes(bytes([x]) * 8)) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: Position of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


def pack(values: np.ndarray) -> bytes:
    """values: sorted, unsigned 64-bit; repeats allowed."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    first = values[0] if n else np.uint64(0)
    rest = values - first
    top = int(rest[-1]) if n else 0
    low_bits = min(MAX_LOW, max(0, (top // n).bit_length() - 1)) if n else 0
    packed = b""
    if low_bits:
        parts = []
        for at in range(0, n, _PART):  # a multiple of 8 values fills whole bytes
            bits = np.unpackbits(rest[at : at + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            parts.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
        packed = b"".join(parts)
    packed += bytes(8 + -len(packed) % 8)
    where = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    words = (n + (top >> low_bits) + 1 + 63) // 64
    high = np.zeros(words * 64, np.uint8)
    high[where] = 1
    head = np.array([n, low_bits, words, first], np.uint64)
    return head.tobytes() + np.packbits(high, bitorder="little").tobytes() + packed


def starts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort, which for numbers is faster than numpy's hashing."""
    ordered = np.sort(values)
    return ordered[starts(ordered)]


class EliasFano:
    def __init__(self, buffer, at: int = 0):
        """Maps what pack() made, from byte `at` of a buffer."""
        head = np.frombuffer(buffer, np.uint64, _HEAD, at)
        self.n, self.low_bits, words = (int(x) for x in head[:3])
        self.first = head[3]
        at += _HEAD * 8
        self.high = np.frombuffer(buffer, np.uint64, words, at)
        at += words * 8
        size = (self.n * self.low_bits + 7) // 8
        size += 8 + -size % 8
        self.low = np.ndarray((max(size - 7, 0),), np.uint64, buffer, at, (1,))  # a load of 8 bytes from every byte
        self.end = at + size
        self._ones = self._zeros = None

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        if self._ones is None:
            self._ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
            self._zeros = np.arange(len(self._ones)) * 64 - self._ones
        return self._ones, self._zeros

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of the high bits."""
        upto = self._counts()[zeros]
        word = np.searchsorted(upto, k, side="right") - 1
        left = (k - upto[word]).astype(np.uint64)
        bits = ~self.high[word] if zeros else self.high[word].copy()
        # Ones up to each byte of a word, in that byte; then the byte that holds the one asked for.
        upto = bits - ((bits >> np.uint64(1)) & _PAIRS)
        upto = (upto & _FOURS) + ((upto >> np.uint64(2)) & _FOURS)
        upto = ((upto + (upto >> np.uint64(4))) & _EIGHTS) * _EACH
        byte = np.bitwise_count(((left * _EACH | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
        left -= (upto << np.uint64(8)) >> byte & np.uint64(255)
        out = word * 64 + byte.astype(np.int64) + _IN_BYTE[((bits >> byte) & np.uint64(255)).astype(np.int64) << 3 | left.astype(np.int64)]
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(np.uint64)
        return self.first + (high << np.uint64(self.low_bits) | self._lows(i))

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        high = (np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - i).astype(np.uint64)
        return self.first + (high << np.uint64(self.low_bits) | self._lows(i))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is x or more; the number of values if none is."""
        x = np.asarray(x, np.uint64)
        rest = np.where(x > self.first, x - self.first, 0).astype(np.uint64)
        zeros = self._counts()[1][-1] - (len(self.high) * 64 - self._top())
        bucket = np.minimum(rest >> np.uint64(self.low_bits), np.uint64(zeros)).astype(np.int64)
        # Values of bucket b stand between the zeros b - 1 and b.
        known = bucket < zeros
        stop = np.full(len(x), self.n, np.int64)
        stop[known] = self._select(bucket[known], True) - bucket[known]
        start = np.where(known, 0, self.n)
        behind = known & (bucket > 0)
        start[behind] = self._select(bucket[behind] - 1, True) - (bucket[behind] - 1)
        low = rest & np.uint64((1 << self.low_bits) - 1)
        while (todo := np.flatnonzero(start < stop)).size:
            middle = (start[todo] + stop[todo]) >> 1
            less = self._lows(middle) < low[todo]
            start[todo[less]] = middle[less] + 1
            stop[todo[~less]] = middle[~less]
        return start

    def _top(self) -> int:
        """Bits of the high part that count: up to the zero behind the last value."""
        last = int(self._select(np.array([self.n - 1]), False)[0]) if self.n else -1
        return last + 2


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, most of them small, by byte planes; loose() undoes it."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def loose(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
