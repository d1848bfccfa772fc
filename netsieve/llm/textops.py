"""Vectorised text helpers shared by the operators: code points, words, hashes, gathers. NumPy and Arrow, no Spark."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[SPACES] = True
_SOLID_BYTE = np.append(~_IS_SPACE[:128], np.ones(128, bool))  # of UTF-8: not white space of ASCII
_OTHER_SPACES = {chr(c).encode()[:1] for c in SPACES.tolist() if c >= 128}  # first bytes of white space beyond ASCII
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Give the system the memory that is free in this process; the C library alone keeps up to 64 MB of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task, behind whose last batch its worker keeps no memory that it does not use."""

    @functools.wraps(run)
    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))  # new, so the rest may be in place
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to ``limit`` at most; a larger item stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > lo:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def is_space(codes: np.ndarray) -> np.ndarray:
    """What ``str.isspace`` holds for white space."""
    return _IS_SPACE[np.minimum(codes, 0x3001)]


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run without white space."""
    solid = np.concatenate(([False], ~is_space(codes), [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(max(n, 1 << 16), base, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: equal spans have equal hashes, wherever they stand. Different ones may have equal
    hashes too, and texts can be made so that they do: whoever needs to know compares the spans."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``data`` cut into byte strings of ``sizes`` bytes, one after another."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    wide = ends[-1] > np.iinfo(np.int32).max
    kind, width = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in the order of :func:`words`. Each distinct word is hashed once."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    if any(byte in data for byte in _OTHER_SPACES):
        solid = ~is_space(code_points(text))[np.cumsum((raw & 0xC0) != 0x80) - 1]  # of each byte: that of its character
    else:
        solid = _SOLID_BYTE[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    if not len(edge):
        return np.zeros(0, U64)
    found = binaries(raw[solid], edge[1::2] - edge[0::2]).dictionary_encode()
    _, ends, data = found.dictionary.buffers()
    width = np.int64 if pa.types.is_large_binary(found.dictionary.type) else np.int32
    at, data = np.frombuffer(ends, width)[: len(found.dictionary) + 1].tolist(), data.to_pybytes()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[i:j], 1) for i, j in zip(at, at[1:])], U64)[found.indices.to_numpy()]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` values, by its first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out *= U64(0x100000001B3)
        out += mix(h[i : i + n] + U64(i + 1))
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges, one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def spans_equal(x: np.ndarray, at: np.ndarray, n: np.ndarray, y: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which spans of ``x`` (from ``at``, ``n`` long) and ``y`` (from ``other``, ``m`` long) are equal, pair by pair."""
    out = n == m
    some = np.flatnonzero(out & (n > 0) & ((at != other) | (x is not y)))
    if len(some):
        size = n[some]
        differ = x[ragged(at[some], size)] != y[ragged(other[some], size)]
        out[some] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return out


class IntMap:
    """A fixed map from 63-bit integers to integers, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(_BASE)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at, out = self._slot(keys), np.full(len(keys), default, np.int64)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out
