"""Whole texts as one byte array: word limits, rolling hashes and row groups in numpy.

A group of texts is joined with blanks between them, so that no word crosses a
text. Words and other slices that do not overlap are hashed by polynomials modulo the prime 2**61 - 1
(``part_hashes``). Overlapping slices of bounded length have polynomials modulo 2**64 with an odd base: the hash of any
slice is a difference of two prefix sums times a power of the base's inverse. Those tell long regular slices badly apart
(from 1,024 bytes on some are equal), so they are for windows of a few hundred bytes only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
PRIME = U((1 << 61) - 1)
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)
# A random number below the prime.
PART_BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
# Slices beyond that are hashed one by one.
_LONG_PART = 1 << 22
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of text that one numpy pass works on; only memory depends on it, never a result.
CHUNK = 1 << 20
# Bytes of several texts that are worked on together. A pass has a dozen numbers a byte, and workers keep what they once took.
GROUP = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, GROUP + 4096), U(base))
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 8 * GROUP:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``slice_hash`` takes the hash of any slice."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _below_prime(x: np.ndarray) -> np.ndarray:
    x = (x >> U(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2**61 - 1 of numbers below it."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a0 * b1 + a1 * b0
    return _below_prime(_below_prime(a1 * b1 * U(2) + (middle >> U(30))) + _below_prime(((middle & _LOW30) << U(31)) + a0 * b0))


_part_powers = [np.array([1], U)]


def part_powers(n: int) -> np.ndarray:
    """PART_BASE**0 .. PART_BASE**(n-1) modulo 2**61 - 1."""
    while len(_part_powers[0]) < n:
        have = _part_powers[0]
        step = U(pow(PART_BASE, len(have), int(PRIME)))
        _part_powers[0] = np.concatenate([have, times(have, np.full(len(have), step))])
    return _part_powers[0][:n]


def part_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices that are not empty; they are worked on about a megabyte at a time."""
    out = np.zeros(len(starts), U)
    size = ends - starts
    long = size > _LONG_PART
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(~long)
    upto = np.cumsum(size[short])
    at = 0
    while at < len(short):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")))
        some = short[at:stop]
        n = size[some]
        begin = np.cumsum(n) - n
        inside = np.arange(int(begin[-1] + n[-1])) - np.repeat(begin, n)
        symbol = buf[inside + np.repeat(starts[some], n)].astype(U) + U(1)
        power = part_powers(int(n.max()))[inside]
        # Halves of the powers, so that sums of up to 2**23 products stay below 2**64.
        high = np.add.reduceat(symbol * (power >> U(31)), begin)
        low = np.add.reduceat(symbol * (power & _LOW31), begin)
        value = _below_prime(times(_below_prime(high), np.full(len(n), U(1 << 31))) + _below_prime(low))
        out[some] = mix(value + n.astype(U) * U(0xD6E8FEB86659FD93))
        at = stop
    return out


def word_limits(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, a word being bytes other than ASCII white space."""
    space = np.ones(len(buf) + 2, np.int8)
    space[1:-1] = IS_SPACE[buf]
    change = np.diff(space)
    return np.flatnonzero(change == -1), np.flatnonzero(change == 1)


def groups(texts: Iterable[bytes], size: int = GROUP) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``size`` bytes together; a longer text is a group by itself."""
    part: list[bytes] = []
    total = 0
    for text in texts:
        if part and total + len(text) > size:
            yield part
            part, total = [], 0
        part.append(text)
        total += len(text) + 1
    if part:
        yield part


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and where each starts (with the end as last value)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of a group, and each text's offset in them (end as last)."""
    buf, at = joined(texts)
    buf = LOWER[buf]
    starts, ends = word_limits(buf)
    return part_hashes(buf, starts, ends), np.searchsorted(starts, at)


def utf8(values) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value starts, with the end as last entry."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives free memory back to the system at its end; a worker then waits for other tasks without it."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


class KeyTable:
    """Places of 64-bit keys in an array of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        index, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(index):
            free = self.slot[at] < 0
            self.slot[at[free]] = index[free]
            lost = self.slot[at] != index
            index, at = index[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is none of the table's."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left) and len(self.keys):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    limits = runs(keys)[:-1]
    return (keys[limits], np.add.reduceat(counts, limits)) if len(keys) else (keys, counts)
