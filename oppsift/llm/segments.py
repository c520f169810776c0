"""Vectorised hashing of the words of many texts at once.

Texts are laid end to end in one array; a word is a span of that array. A polynomial prefix hash modulo 2**64 (its base
is odd, so powers have inverses) gives the hash of any span from two entries, and a splitmix finaliser spreads it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Texts are worked on in slices of about so many bytes or code points, which bounds the temporary arrays.
SLICE = 800_000


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, min(2 * len(have), SLICE + 1), 1 << 16)
        grown = np.full(size, BASE if kind == "up" else _INVERSE, np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(seed))


#: One pseudo-random number for each byte value.
BYTE_VALUES = spread(256, 7)


@functools.cache
def code_values() -> np.ndarray:
    """One for each code point."""
    return spread(0x110000, 11)


class Spans:
    """Hashes of spans of one array of values (uint64), as they are asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.prefix, self.down = np.zeros(len(values) + 1, np.uint64), _power("down", len(values) + 1)
        np.cumsum(values * _power("up", len(values)), out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of ``values`` (uint64); equal spans have equal hashes wherever they lie."""
    return Spans(values)(starts, ends)


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column, about ``size`` bytes at a time.

    A null counts as an empty text. A single longer text makes a slice of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut where a text ends, and how many lie before each text's start."""
    edge = np.zeros(len(inside) + 1, np.bool_)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class HashIndex:
    """A map from 64-bit hashes to entry numbers: open addressing in two arrays, probed for many keys at once."""

    def __init__(self, limit: int) -> None:
        """limit: entries that are expected; twice as many slots are held, and more once they are 7/8 full."""
        self.least = 1 << max(4, (2 * limit - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self._empty(self.least)

    def _empty(self, slots: int) -> None:
        self.slots = slots
        self.keys = np.zeros(self.slots, np.uint64)  # 0 is an empty slot
        self.entries = np.empty(self.slots, np.int32)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        keys = np.maximum(keys, np.uint64(1))
        at = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == keys, self.entries[at], np.int32(-1))
        left = np.flatnonzero((have != keys) & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            have = self.keys[at[left]]
            hit = have == keys[left]
            out[left[hit]] = self.entries[at[left[hit]]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Different keys, none of which is there."""
        if 8 * (self.count + len(keys)) > 7 * self.slots:  # without an empty slot, a search would not end
            held = np.flatnonzero(self.keys)
            old, numbers = self.keys[held], self.entries[held]
            self._empty(1 << (2 * (self.count + len(keys)) - 1).bit_length())
            self.add(old, numbers)
        keys, entries = np.maximum(keys, np.uint64(1)), entries.astype(np.int32)
        at = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        self.count += len(keys)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            mine = free & (self.keys[at] == keys)  # of several that came for a slot one has it
            self.entries[at[mine]] = entries[mine]
            keys, entries, at = keys[~mine], entries[~mine], (at[~mine] + 1) & (self.slots - 1)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] for each pair, end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]
