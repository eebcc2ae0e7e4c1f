"""Words of whole texts as arrays: byte positions and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts arrive as Arrow columns and are worked
through in slices of a few megabytes, so that memory stays small however long the batch is; a text is
never cut.

Bytes are hashed by a polynomial modulo the prime 2**61 - 1 at a random base, so that two words of n bytes meet with a probability of at most
n / 2**61 whatever they look like; hashes of different ``seed`` have independent bases. Sequences of at most ``LONGEST`` such hashes
are hashed by a polynomial modulo 2**64: its terms are random numbers already, and so few powers of the base
differ by 2**9 at the most as a factor, which leaves 55 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


_PRIME, _LOW = (1 << 61) - 1, np.uint64((1 << 31) - 1)
#: Words in a sequence, and bytes of a word whose sums stay below 2**64; a longer word takes a digest.
LONGEST, _SUMMED = 13, 1 << 24


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, of values below 2**64."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a1 * b0 + a0 * b1
    half = (1 << 30) - 1
    return _reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64(half)) << np.uint64(31)) + a0 * b0)


@cache
def _base(seed: int) -> int:
    return int(np.random.Generator(np.random.PCG64(seed)).integers(1 << 60, _PRIME - 1))


def _prime_powers(base: int, n: int) -> np.ndarray:
    made, factor = np.ones(1, np.uint64), base
    while len(made) < n:
        made = np.concatenate([made, _times(made, np.full(1, factor, np.uint64))])
        factor = factor * factor % _PRIME
    return made[:n]


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of the powers of a seed's base, and the powers of its inverse, at least ``n`` of each."""
    have = _TABLES.get(seed)
    if have is None or len(have[0]) < n:
        size, base = max(n, SLICE_BYTES + 1), _base(seed)
        up = _prime_powers(base, size)
        have = (up >> np.uint64(31)).astype(np.uint32), (up & _LOW).astype(np.uint32), _prime_powers(pow(base, -1, _PRIME), size)
        if size <= 1 << 22:
            _TABLES[seed] = have
    return have


def byte_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of ``data[start:end]`` for every pair, from prefix sums."""
    high, low, down = _tables(seed, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    found = []
    for half in (high, low):
        np.cumsum(np.multiply(half[: len(data)], data, dtype=np.uint64), out=sums[1:])
        found.append(_reduced(sums[ends] - sums[starts]))
    whole = _reduced(_times(found[0], np.full(1, 1 << 31, np.uint64)) + found[1])
    size = (ends - starts).astype(np.uint64)
    made = mix(_times(whole, down[starts]) + size * _STEP)
    for i in np.flatnonzero(size > _SUMMED):
        digest = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=str(seed).encode()).digest()
        made[i] = np.frombuffer(digest, np.uint64)[0]
    return made


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    return x ^ (x >> np.uint64(32))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]``, at most ``LONGEST`` random numbers, for every pair."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


@dataclass
class Words:
    """The words of a slice of texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    rows: slice

    def hashes(self, seed: int = 1) -> np.ndarray:
        return byte_runs(self.data, self.starts, self.ends, seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(words: np.ndarray, first: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within a text, and where each text's begin.

    ``short``: a text of fewer words, but at least one, has its whole sequence as its only window.
    """
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    if short:
        many = np.where((n > 0) & (n < size), 1, many)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], many) + np.arange(at[-1])
    end = np.minimum(begin + size, np.repeat(first[1:], many))
    return runs(words, begin, end, 0x27BB2EE687B0B0FD), at


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def is_word(data: np.ndarray) -> np.ndarray:
    return ~is_space(data)


def is_alphanumeric(data: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and every byte of a sign outside ASCII."""
    folded = data | 32
    return (data >= 128) | ((folded >= 97) & (folded <= 122)) | ((data >= 48) & (data <= 57))


def slices(
    texts: pa.Array,
    lower: bool = False,
    limit: int = SLICE_BYTES,
    belongs: Callable[[np.ndarray], np.ndarray] = is_word,
) -> Iterator[Words]:
    """Words of a column of texts, a few megabytes at a time. Null is an empty text.

    ``belongs`` tells the bytes of words; ``lower`` turns A to Z into small letters first.
    """
    for data, offsets, rows in byte_slices(texts, limit):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = belongs(data)
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(data, starts, ends, np.searchsorted(starts, offsets), offsets, rows)


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """UTF-8 bytes and text offsets of slices of at most ``limit`` bytes or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slice(i, j)
        i = j


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of all ranges, one after the other."""
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))


def grouped(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per text of ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
