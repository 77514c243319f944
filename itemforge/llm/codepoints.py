"""Many texts as one array of code points, with tables of character classes."""

from __future__ import annotations

import functools

import numpy as np

ALPHA, UPPER, DIGIT, SPACE = 1, 2, 4, 8
TABLE = 0x40000  # no later code point is a letter, a digit or white space


@functools.cache
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(TABLE):
        c = chr(i)
        out[i] = ALPHA * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit() | SPACE * c.isspace()
    return out


@functools.cache
def lower() -> np.ndarray:
    """The lower case of each code point where that is one code point, so offsets stay."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(TABLE):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends): the texts one after the other, a newline between them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts, starts + sizes


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@functools.lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash, then mixed, of values[start:end] for each run; position-free."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = _powers(int(BASE), size), _powers(int(INVERSE), size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
