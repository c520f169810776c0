"""Byte-level BPE of whole texts with the ``tokenizers`` library, at several times the speed of a plain call.

A byte-level tokenizer encodes each pre-token (a word with the space before it, a run of digits, ...) by itself, and
most pre-tokens have occurred before. So texts are cut into pre-tokens with array operations, and only pre-tokens that
this process has not met go through the library, once; the ids of the rest are copied. The cut follows the library: the
class of each code point (letter, digit, space, other) is asked of its own pre-tokenizer. Texts that hold one of the
tokenizer's added tokens go through the library whole. ``tests/llm`` compares the ids with the library's.
"""

from __future__ import annotations

import os

import numpy as np

from oppsift.llm.segments import SLICE, HashIndex, code_values, gather, span_hashes
from oppsift.llm.shared import only

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4

#: Longer pre-tokens are encoded each time and not remembered.
LONG = 48



class CachedBpe:
    """Encodes lists of texts; remembers the ids of at most ``limit`` pre-tokens and then starts anew. special: whether the
    strings of special tokens in a text stand for these tokens, or are plain text."""

    def __init__(self, path: str, limit: int = 500_000, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)  # bytes of each id: one character stands for one
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.classes = np.zeros(0x110000, np.uint8)
        self.index = HashIndex((limit + SLICE // 2) * 5 // 8)  # its slots hold the limit and what one slice may add
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.entries = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _class(self, ch: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for other, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)):
            if len(cut(other + ch)) == 1:
                return kind
        return SPACE

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if not found.all():
            for c in np.unique(codes[found == 0]):
                self.classes[c] = self._class(chr(c))
            found = self.classes[codes]
        return found

    def _cut(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The positions where pre-tokens start. bounds: where texts start, and the end."""
        n, kind = len(codes), self._classes(codes)
        head = np.zeros(n + 1, np.bool_)
        head[bounds] = True
        run = head[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        blank, space = kind == SPACE, codes == 32
        start = run.copy()
        after = np.zeros(n, np.bool_)  # the character before is a plain space of the same text
        after[1:] = space[:-1] & ~head[1:-1]
        start &= blank | ~after  # a plain space goes with the word behind it
        stop = np.ones(n, np.bool_)  # the last of its text
        stop[:-1] = head[1:-1]
        tail = blank.copy()  # the last space of a run with something behind it stands alone or goes with that
        tail[:-1] &= ~blank[1:]
        tail &= ~stop
        start |= tail
        quote = np.flatnonzero((codes == 39) & run & ~after & ~stop)
        if len(quote):
            a = codes[quote + 1]
            one = np.isin(a, [115, 100, 109, 116])
            far = np.minimum(quote + 2, n - 1)
            b = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], codes[far], 0)
            two = ((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101))
            for at, size in ((quote[one], 2), (quote[two], 3)):
                start[at + 1] = False
                past = at + size
                past = past[past < n]
                start[past] = True
                # a space that follows still goes with the word behind it: it was a start of its own already
        return np.flatnonzero(start)

    def _remember(self, words: list[str]) -> np.ndarray:
        """Encodes pre-tokens and returns their entry numbers.

        Many go through the library as one string, each behind a line feed, which leaves them whole; the bytes that the
        ids stand for tell where each ends. Those that hold further white space go one by one.
        """
        lengths = np.zeros(len(words), np.int64)
        flats: list[np.ndarray] = []
        order: list[np.ndarray] = []
        plain = np.fromiter((self.classes[ord(w[-1])] != SPACE for w in words), np.bool_, len(words))
        for lo in range(0, len(words), 4096):
            at = lo + np.flatnonzero(plain[lo : lo + 4096])
            if not len(at):
                continue
            some = [words[i] for i in at.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n" + "\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.widths[ids])
            sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in some), np.int64, len(some)) + 1
            stop = np.searchsorted(ends, np.cumsum(sizes)) + 1
            if stop[-1] != len(ids) or (ends[stop - 1] != np.cumsum(sizes)).any():
                raise ValueError("the tokenizer isn't byte-level BPE that cuts at line feeds")
            first = np.concatenate([[0], stop[:-1]]) + 1  # without the line feed
            lengths[at] = stop - first
            flats.append(gather(ids, first, stop - first))
            order.append(at)
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = [e.ids for e in self.tokenizer.encode_batch([words[i] for i in rest.tolist()], add_special_tokens=False)]
            lengths[rest] = [len(x) for x in ids]
            flats.append(np.fromiter((i for x in ids for i in x), np.uint32))
            order.append(rest)
        flat, at = np.concatenate(flats), np.concatenate(order)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.entries + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        to = slice(self.entries, self.entries + len(words))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[to] = lengths
        self.starts[self.entries + at] = self.used + np.cumsum(lengths[at]) - lengths[at]
        self.used += len(flat)
        self.entries += len(words)
        return np.arange(to.start, to.stop)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For texts without added tokens."""
        if self.entries > self.limit:
            self._reset()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        starts = self._cut(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        keys, short = span_hashes(code_values()[codes], starts, ends), ends - starts <= LONG
        entry = self.index.find(keys).astype(np.int64)
        entry[~short] = -1
        new = np.flatnonzero((entry < 0) & short)
        if len(new):
            some, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[first]
            known = self._remember([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.index.add(some, known)
            entry[new] = known[which]
        if not short.all():
            at = np.flatnonzero(~short)
            entry[at] = self._remember([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        lengths = self.lengths[entry]
        before = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(starts, bounds)
        return gather(self.flat, self.starts[entry], lengths), before[at[1:]] - before[at[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (uint32), and how many each has. A null is an empty text."""
        texts = [t or "" for t in texts]
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        row = 0
        while row < len(texts):
            if any(s in texts[row] for s in self.special):
                found = self.tokenizer.encode(texts[row], add_special_tokens=False).ids
                ids.append(np.array(found, np.uint32))
                counts.append(np.array([len(found)]))
                row += 1
                continue
            end, size = row, 0
            while end < len(texts) and (end == row or size + len(texts[end]) <= SLICE // 2) and not any(s in texts[end] for s in self.special):
                size += len(texts[end])
                end += 1
            a, b = self._encode(texts[row:end])
            ids.append(a)
            counts.append(b)
            row = end
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint32), np.zeros(0, np.int64))


def cached_bpe(path: str) -> CachedBpe:
    """One for each tokenizer file and process, until another operator needs the room."""
    return only(("bpe", path), lambda: CachedBpe(path))
