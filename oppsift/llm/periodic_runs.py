"""Periodic runs of words, found by Crochemore's partition refinement.

At level l the positions of a text are in classes of equal factors of l words. A step refines the classes by the class of the
next position, and looks only at positions before a class that the last step split off: of the parts of a split class all but
the largest count as split off (the smaller-half rule), so a position is looked at O(log n) times. Each class links its members
in text order. Two neighbours whose distance is l, while they are neighbours at level l, are the halves of a square
whose root is primitive; squares of one period at consecutive positions are one maximal run.

All texts of a few megabytes are refined side by side by array operations, one step for all of them a level; classes never
hold positions of two texts. A text needs levels up to a third of its words only, as a run is asked to repeat three times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.llm.shared import arrow, text_or_empty

#: Bytes of texts that are refined side by side; a single longer text is refined by itself.
STEP = 8_000_000

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, ..., start + length - 1 of each pair, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class _Classes:
    """The partition: members of a class lie side by side in ``members`` (in any order), and are linked in text order."""

    def __init__(self, words: np.ndarray, text: np.ndarray, parts: int) -> None:
        """Level 1. words: numbers of the words of all texts, text: their texts, ascending; parts: how many texts."""
        n = len(words)
        _, self.of = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)
        self.size = np.zeros(n, np.int64)
        count = np.bincount(self.of)
        self.size[: len(count)], self.used = count, len(count)
        self.start = np.zeros(n, np.int64)
        self.start[: len(count)] = np.cumsum(count) - count
        self.members = np.argsort(self.of, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        #: The level at which a position got the neighbour that ``after`` names.
        self.born = np.ones(n, np.int64)
        side = np.flatnonzero(self.of[self.members[1:]] == self.of[self.members[:-1]])
        self.after[self.members[side]] = self.members[side + 1]
        self.before[self.members[side + 1]] = self.members[side]
        self.moved = np.zeros(n, np.bool_)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        # of each text's classes all but the largest
        owner = text[self.members[self.start[: len(count)]]]
        order = np.lexsort((-count, owner))
        largest = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        small = np.ones(len(count), np.bool_)
        small[largest] = False
        self.split_off = np.flatnonzero(small[self.of])

    def close(self, at: np.ndarray, level: int | np.ndarray) -> None:
        """The neighbours behind ``at`` were so up to ``level``: squares among them are noted."""
        gap = self.after[at] - at
        good = (self.after[at] >= 0) & (self.born[at] <= gap) & (gap <= level)
        if good.any():
            self.squares.append((gap[good], at[good]))

    def _link(self, at: np.ndarray, after: np.ndarray, level: int) -> None:
        """New neighbours from ``level`` + 1 on, where they differ from the old."""
        new = self.after[at] != after
        at, after = at[new], after[new]
        self.close(at, level)
        self.after[at], self.born[at] = after, level + 1

    def refine(self, at: np.ndarray, level: int) -> None:
        """From ``level`` to the next, by the classes behind the positions ``at``, which are in classes of two members or more."""
        n = len(self.of)
        bits = n.bit_length()
        if 3 * bits <= 63:
            key = np.sort((self.of[at] << 2 * bits) | (self.of[at + 1] << bits) | at)
            at = key & ((1 << bits) - 1)
        else:
            at = at[np.lexsort((at, self.of[at + 1], self.of[at]))]
        own, behind = self.of[at], self.of[at + 1]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # of classes
        groups = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])])
        count = np.diff(np.append(groups, len(at)))
        first = np.searchsorted(groups, heads)  # the first group of each class
        best = np.maximum.reduceat(count, first)
        classes, taken = own[heads], np.diff(np.append(heads, len(at)))
        rest = self.size[classes] - taken
        start = self.start[classes]
        # what is left closes its ranks
        some = rest > 0
        if some.any():
            loose = at[np.repeat(some, taken)]
            of = self.of[loose]
            loose = np.sort((of << bits) | loose) & ((1 << bits) - 1) if 2 * bits <= 63 else loose[np.lexsort((loose, of))]
            opens, closes = np.ones(len(loose), np.bool_), np.ones(len(loose), np.bool_)
            opens[1:] = self.before[loose[1:]] != loose[:-1]
            closes[:-1] = opens[1:]
            left, right = self.before[loose[opens]], self.after[loose[closes]]
            self._link(left[left >= 0], right[left >= 0], level)
            self.before[right[right >= 0]] = left[right >= 0]
        # the moved members take the last places of their classes
        slots = _ranges(start + rest, taken)
        self.moved[at] = True
        held = self.members[slots]
        stay = held[~self.moved[held]]
        self.moved[at] = False
        holes = self.place[at]
        holes = holes[holes < np.repeat(start + rest, taken)]
        self.members[holes], self.place[stay] = stay, holes
        self.members[slots], self.place[at] = at, slots
        # and are linked anew
        after = np.append(at[1:], -1)
        after[np.append(groups[1:], len(at)) - 1] = -1
        self._link(at, after, level)
        before = np.concatenate([[-1], at[:-1]])
        before[groups] = -1
        self.before[at] = before
        # the largest part keeps the class's number
        group_class = np.repeat(np.arange(len(classes)), np.diff(np.append(first, len(groups))))
        keeps = np.zeros(len(groups), np.bool_)
        high = np.flatnonzero(count == best[group_class])
        high = high[np.r_[True, group_class[high][1:] != group_class[high][:-1]]]
        keeps[high] = (rest < best)[group_class[high]]
        number = self.used + np.cumsum(~keeps) - 1
        number[keeps] = classes[group_class[keeps]]
        self.used += int((~keeps).sum())
        stays = rest >= best
        self.size[classes[stays]] = rest[stays]
        out = [at[np.repeat(~keeps, count)]]
        less = np.flatnonzero(some & ~stays)
        if len(less):
            remaining = self.members[_ranges(start[less], rest[less])]
            fresh = self.used + np.arange(len(less))
            self.used += len(less)
            self.of[remaining] = np.repeat(fresh, rest[less])
            self.start[fresh], self.size[fresh] = start[less], rest[less]
            out.append(remaining)
        self.of[at] = np.repeat(number, count)
        self.start[number], self.size[number] = slots[groups], count
        self.split_off = np.concatenate(out)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the maximal runs of ``least`` words and ``times`` (2 or more) periods at least, by
    text, start and period. words: numbers of the words of texts of ``sizes`` words, end to end; equal words have equal numbers."""
    deep = np.where(sizes >= least, sizes // times, 0)
    use = deep > 0
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if not use.any():
        return none
    numbers, length, deep = np.flatnonzero(use), sizes[use], deep[use]
    words = words[np.repeat(use, sizes)]
    # a sign of its own ends each text
    text = np.repeat(np.arange(len(length)), length + 1)
    ends = np.cumsum(length + 1) - 1
    body = np.ones(len(text), np.bool_)
    body[ends] = False
    signs = np.full(len(text), int(words.max()) + 1)
    signs[body] = words
    found = _Classes(signs, text, len(length))
    first = np.zeros(len(text), np.bool_)
    first[ends - length] = True
    level, bound = 1, deep[text]
    while len(found.split_off):
        at = found.split_off
        at = at[~first[at]] - 1
        at = at[(found.size[found.of[at]] > 1) & (bound[at] > level)]
        if not len(at):
            break
        found.refine(at, level)
        level += 1
    every = np.flatnonzero(found.after >= 0)
    found.close(every, bound[every])
    if not found.squares:
        return none
    period, at = (np.concatenate(x) for x in zip(*found.squares, strict=True))
    order = np.lexsort((at, period))
    period, at = period[order], at[order]
    cut = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.append(cut[1:], len(at)) - 1
    start, period = at[cut], period[cut]
    size = at[last] - start + 2 * period
    good = size >= np.maximum(least, times * period)
    start, period, size = start[good], period[good], size[good]
    of = text[start]
    start = start - (ends - length)[of]
    order = np.lexsort((period, start, of))
    return numbers[of[order]], start[order], size[order], period[order]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _collapsed(docs: list, texts: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers = _Numbers()
    words = np.fromiter((n for t in texts for n in map(numbers.__getitem__, t)), np.int64, int(sizes.sum()))
    text, start, length, period = find_runs(words, sizes, least, times)
    runs: list[list[dict]] = [[] for _ in texts]
    kept = [b" ".join(t) for t in texts] if not len(text) else [None] * len(texts)
    first = np.cumsum(sizes) - sizes
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first[text] + start + period, 1)
    np.add.at(edge, first[text] + start + length, -1)
    drop = np.cumsum(edge[:-1]) > 0
    for t, s, n, p in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": n, "period": p})
    for k, t in enumerate(texts):
        if runs[k]:
            stay = np.flatnonzero(~drop[first[k] : first[k] + len(t)]).tolist()
            kept[k] = b" ".join([t[i] for i in stay])
        elif kept[k] is None:
            kept[k] = b" ".join(t)
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
    columns = [pa.array(docs, pa.int64()), pa.array(sizes), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])


def _split(batches: Iterator[pa.RecordBatch], change: Callable | None, least: int, times: int) -> Iterator[pa.RecordBatch]:
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if docs and size + len(text) > STEP:
                yield _collapsed(docs, texts, least, times)
                docs, texts, size = [], [], 0
            words = text.split()  # of bytes: at the ASCII white space
            docs.append(doc)
            texts.append(change(doc, words) if change else words)
            size += len(text)
    if docs:
        yield _collapsed(docs, texts, least, times)


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period) and text of every row of ``docs`` (doc_id, text).

    Words are what stands between ASCII white space. A run is a stretch of words with a smallest period, of at least ``least`` words and
    ``times`` (2 or more) periods, that no neighbouring word extends; the text that is returned has of each run only the words of
    its first period, and one space between words. change: gives the words to be looked at instead, from doc_id and words.

    Every row is worked on by itself, in the task that reads it: nothing is shuffled, repeated rows get equal results, and a null
    doc_id stays null. A null text is an empty one, without words or runs; an empty table gives an empty result; other columns
    are ignored. Memory grows with the longest text, not with the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.transform(arrow, lambda b: _split(b, change, least, times), RUNS)
