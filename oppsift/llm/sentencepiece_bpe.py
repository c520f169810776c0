"""SentencePiece BPE with seeded merge-dropout, and its inverse.

Symbols start as characters and merge by an agenda of candidate pairs, best score first, leftmost on ties. Each candidate
that comes off the agenda is skipped if its keyed hash, of the seed, the document and the candidate's place in it, falls
below the rate, so a word is cut differently wherever it stands. Without dropout the ids are those of the library, but that a
U+2581 of the text itself is spelled in bytes, so that decoding gives every text back.

No piece spans two characters that stand side by side in no piece, so a text falls into segments that merge by
themselves. What a segment becomes depends on which of its candidates are skipped: a process remembers, for each segment, the
candidates in the order of the agenda as a tree that branches where one is skipped. All segments of some texts go down their
trees at once, a hash a step; those that come to a way that has not been gone before run their agendas side by side, with
array operations that take the best candidate of each at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.llm.segments import HashIndex, Spans, code_values, gather, mix, span_hashes, spread
from oppsift.llm.shared import arrow, only, text_or_empty

RATE = 0.1

#: Segments, and ends and forks of their trees, that a process remembers; segments longer than LONG it does not. Texts are
#: worked on STEP characters or so at a time.
REMEMBERED, LONG, STEP = 500_000, 48, 300_000

#: A lone surrogate, which no text can hold, stands for a U+2581 of the text.
_BLANK, _ESCAPE = "\u2581", "\ud800"
_MASK = (1 << 64) - 1
#: Of the first, middle and last place of a candidate, and of all three moved on by one.
_PLACES = [int(x) | 1 for x in spread(3, 67)]
_ALONG = np.uint64(sum(_PLACES) & _MASK)


def base_of(seed: int, doc: int) -> int:
    """What the hashes of a document's candidates have in common."""
    return mixed((doc * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) & _MASK)


def mixed(x: int) -> int:
    """``segments.mix`` of one number."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:].astype(np.uint64)


class DropoutBpe:
    """Encodes and decodes texts with one model file, seed and rate."""

    def __init__(self, path: str, seed: int = 0, rate: float = RATE) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed, self.rate = seed, int(rate * 2**64)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {names[i]: (-model.get_score(i), i) for i in plain}
        codes = np.frombuffer("".join(names[i] for i in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(names[i]) for i in plain])
        self.known = HashIndex(2 * len(plain))
        self.known.add(span_hashes(code_values()[codes], ends - np.diff(ends, prepend=0), ends), np.arange(len(plain)))
        self.ids = np.array(plain, np.int64)
        self.ranks = np.unique([self.pieces[names[i]][0] for i in plain], return_inverse=True)[1].astype(np.int64)
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
        inside = [_pairs(np.array([ord(c) for c in names[i]], np.uint32)) for i in plain if len(names[i]) > 1]
        self.apart = None
        self.joint = np.unique(np.concatenate(inside))
        spelled = [b""] * len(names)
        for i in plain:
            spelled[i] = names[i].replace(_BLANK, " ").encode()
        for value, i in self.bytes.items():
            spelled[i] = bytes([value])
        self.widths = np.array([len(s) for s in spelled])
        self.spelled, self.at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.widths) - self.widths
        self.index = None

    def _reset(self) -> None:
        self.index = self.index or HashIndex(REMEMBERED)  # twice as many slots
        self.index.clear()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        #: Where each segment begins. A number from 0 is a fork, -1 a way not gone yet, and from -2 down an end.
        self.roots = np.empty(0, np.int64)
        #: Of each fork: the hash part of its candidate, how many forks lie before it, and what follows if it merges or is skipped.
        self.forks, room = 0, 1 << 16
        self.codes, self.depths, self.next = np.empty(room, np.uint64), np.empty(room, np.int64), np.empty((room, 2), np.int64)

    def segment(self, text: str, base: int) -> tuple[list[int], list[tuple[int, bool]]]:
        """The ids of one segment, where spaces are U+2581, and its candidates as they came: hash part, skipped or not. base:
        that of the document, moved on to the segment's place."""
        pieces, n, rate = self.pieces, len(text), self.rate
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))
        agenda = [(p[0], i, i + 1, i + 2) for i in range(n - 1) if (p := pieces.get(text[i : i + 2]))]
        heapq.heapify(agenda)
        alive, taken = [True] * n, []
        x, y, z = _PLACES
        while agenda:
            _, a, m, b = heapq.heappop(agenda)
            if not alive[a] or ends[a] != m or m >= n or not alive[m] or ends[m] != b:
                continue
            if rate:
                code = (a * x + m * y + b * z) & _MASK
                skipped = mixed((base + code) & _MASK) < rate
                taken.append((code, skipped))
                if skipped:
                    continue
            alive[m] = False
            ends[a] = b
            after[a] = b
            if b < n:
                before[b] = a
                if p := pieces.get(text[a : ends[b]]):
                    heapq.heappush(agenda, (p[0], a, b, ends[b]))
            if (left := before[a]) >= 0 and (p := pieces.get(text[left:b])):
                heapq.heappush(agenda, (p[0], left, a, b))
        out, i = [], 0
        while i < n:
            if p := pieces.get(text[i : ends[i]]):
                out.append(p[1])
            else:
                out += [self.bytes[v] for v in text[i : ends[i]].replace(_ESCAPE, _BLANK).encode("utf-8", "surrogatepass")]
            i = ends[i]
        return out, taken

    def _agendas(self, codes: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``segment`` gives, for segments of ``sizes`` code points end to end: the ids end to end and how many each has; the
        segment, hash part and skip of each candidate, as they came within each segment."""
        hashes, first = Spans(code_values()[codes]), np.cumsum(sizes) - sizes
        never = np.int64(1) << 30

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = self.known.find(hashes(a, b))
            return np.where(found >= 0, self.ranks[found], never)

        cur, seg = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes)
        end, rank = cur + 1, np.full(len(codes), never)
        pair = np.flatnonzero(seg[1:] == seg[:-1])
        rank[pair] = ranks(cur[pair], end[pair + 1])
        x, y, z = (np.uint64(p) for p in _PLACES)
        done, taken = [], []
        while len(cur):
            heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(cur)), heads)
            going = best < never << 32
            drop = ~np.repeat(going, np.diff(np.append(heads, len(cur))))
            done.append((cur[drop], end[drop]))
            i = best[going] & 0xFFFFFFFF
            if self.rate:
                a, m, b = (v.astype(np.uint64) for v in (cur[i] - first[seg[i]], end[i] - first[seg[i]], end[i + 1] - first[seg[i]]))
                code = a * x + m * y + b * z
                skipped = mix(base[seg[i]] + code) < np.uint64(self.rate)
                taken.append((seg[i], code, skipped))
                rank[i[skipped]] = never
                i = i[~skipped]
            end[i], rank[i] = end[i + 1], never
            drop[i + 1] = True
            right = i[i + 2 < len(cur)]
            right = right[seg[right + 2] == seg[right]]
            rank[right] = ranks(cur[right], end[right + 2])
            left = i[i > 0]
            left = left[seg[left - 1] == seg[left]]
            rank[left - 1] = ranks(cur[left - 1], end[left])
            cur, end, seg, rank = (v[~drop] for v in (cur, end, seg, rank))
        a, b = (np.concatenate(v) for v in zip(*done, strict=True))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        of, found = np.searchsorted(first, a, side="right") - 1, self.known.find(hashes(a, b))
        ids, count = self.ids[found], np.ones(len(a), np.int64)
        odd = np.flatnonzero(found < 0)
        if len(odd):  # single characters that are no piece: the bytes that they are spelled in
            spelled = [[self.bytes[v] for v in chr(c).replace(_ESCAPE, _BLANK).encode("utf-8", "surrogatepass")] for c in codes[a[odd]].tolist()]
            count[odd] = [len(v) for v in spelled]
            ids = np.repeat(ids, count)
            ids[gather(np.arange(len(ids)), (np.cumsum(count) - count)[odd], count[odd])] = [v for one in spelled for v in one]
        owner, code, skipped = (np.concatenate(v) for v in zip(*taken, strict=True)) if taken else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.bool_))
        order = np.argsort(owner, kind="stable")
        return ids, np.bincount(of, count, len(sizes)).astype(np.int64), owner[order], code[order], skipped[order]

    def _entries(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ends with these ids."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        out = len(self.starts) + np.arange(len(lengths))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(ids)
        return out

    def _learn(self, codes: np.ndarray, sizes: np.ndarray, base: np.ndarray, depth: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends of segments, and of those that are ``new`` where the part of their way begins that lies beyond ``depth`` forks,
        which are known; it is put into their trees."""
        ids, lengths, owner, code, skipped = self._agendas(codes, sizes, base)
        ends = self._entries(ids, lengths)
        count = np.bincount(owner, minlength=len(sizes))
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        put = new[owner] & (place >= depth[owner])
        owner, code, skipped, place = owner[put], code[put], skipped[put], place[put]
        node = self.forks + np.arange(len(owner))
        to = np.where(place == count[owner] - 1, -2 - ends[owner], node + 1)
        follows = np.full((len(owner), 2), -1)
        follows[np.arange(len(owner)), skipped.astype(np.int64)] = to
        refs = -2 - ends
        refs[owner[place == depth[owner]]] = node[place == depth[owner]]
        self.forks += len(owner)
        while self.forks > len(self.codes):
            self.codes, self.depths, self.next = (np.concatenate([v, np.empty_like(v)]) for v in (self.codes, self.depths, self.next))
        self.codes[node], self.depths[node], self.next[node] = code, place, follows
        return ends, refs

    def _walk(self, at: np.ndarray, base: np.ndarray, codes_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The ends that segments reach from where they stand; ways not gone yet are learnt."""
        going, rate = np.flatnonzero(at >= 0), np.uint64(self.rate)
        lost, ways = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(going):
            fork = at[going]
            turn = (mix(base[going] + self.codes[fork]) < rate).astype(np.int64)
            at[going] = to = self.next[fork, turn]
            lost.append(going[to == -1])
            ways.append((2 * fork + turn)[to == -1])
            going = going[to >= 0]
        lost, ways = np.concatenate(lost), np.concatenate(ways)
        if len(lost):
            some, one = np.unique(ways, return_index=True)
            new = np.zeros(len(lost), np.bool_)
            new[one] = True
            ends, refs = self._learn(*codes_of(lost), base[lost], self.depths[ways // 2] + 1, new)
            self.next[some // 2, some % 2] = refs[one]
            at[lost] = -2 - ends
        return -2 - at

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (int32), and how many each has. keys: a number for each text, part of its hashes."""
        ids, counts, lo = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP):
                size += len(texts[hi]) + 1
                hi += 1
            a, b = self._encode(texts[lo:hi], keys[lo:hi])
            ids.append(a)
            counts.append(b)
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.index is None or self.index.count > REMEMBERED or max(self.forks // 4, len(self.starts)) > 2 * REMEMBERED:
            self._reset()
        ready = [_BLANK + t.replace(_BLANK, _ESCAPE).replace(" ", _BLANK) if t else "" for t in texts]
        whole = "".join(ready)
        if not whole:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in ready])]).astype(np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.ones(len(codes), np.bool_)
        start[1:] = ~self._joint(_pairs(codes))
        start[bounds[:-1][bounds[:-1] < len(codes)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(codes))
        at = np.searchsorted(starts, bounds)
        text = np.repeat(np.arange(len(texts)), np.diff(at))
        own = mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.seed * 0xD6E8FEB86659FD93) & _MASK))
        base = own[text] + (starts - bounds[text]).astype(np.uint64) * _ALONG

        def codes_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = ends[some] - starts[some]
            return gather(codes, starts[some], sizes), sizes

        key, short = span_hashes(code_values()[codes], starts, ends), ends - starts <= LONG
        known = self.index.find(key).astype(np.int64)
        new = np.flatnonzero((known < 0) & short)
        if len(new):
            some, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[first]
            _, roots = self._learn(*codes_of(one), base[one], np.zeros(len(one), np.int64), np.ones(len(one), np.bool_))
            known[new] = len(self.roots) + which
            self.index.add(some, len(self.roots) + np.arange(len(some)))
            self.roots = np.concatenate([self.roots, roots])
        place = np.empty(len(starts), np.int64)
        place[short] = self.roots[known[short]]
        long = np.flatnonzero(~short)
        if len(long):
            out = [self.segment(whole[starts[k] : ends[k]], b)[0] for k, b in zip(long.tolist(), base[long].tolist(), strict=True)]
            place[long] = -2 - self._entries(np.fromiter((i for x in out for i in x), np.int64), np.array([len(x) for x in out], np.int64))
        entry = self._walk(place, base, codes_of)
        lengths = self.lengths[entry]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return gather(self.flat, self.starts[entry], lengths), np.diff(total[at])

    def _joint(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two characters stand side by side in some piece."""
        if self.apart is None:
            self.apart = HashIndex(2 * len(self.joint))
            self.apart.add(mix(self.joint), np.arange(len(self.joint)))
        return self.apart.find(mix(pairs)) >= 0

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts end to end, and how many each has."""
        widths = self.widths[ids]
        data = gather(self.spelled, self.at[ids], widths)
        total = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(data), np.bool_)
        keep[total[:-1][counts > 0]] = False  # the space before each text
        return data[keep], np.diff(total) - (counts > 0)


def _of(*key) -> DropoutBpe:
    return only(("pieces", *key), lambda: DropoutBpe(*key))


def _binary(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _encode(batches: Iterator[pa.RecordBatch], path: str, seed: int, rate: float) -> Iterator[pa.RecordBatch]:
    bpe = _of(path, seed, rate)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            keys = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, counts = bpe.encode(part.column("text").to_pylist(), keys)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), _binary(ids.astype("<i4"), 4 * counts, pa.binary())], ["doc_id", "n_pieces", "pieces"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = _of(path, 0, 0.0)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            blobs = part.column("pieces").to_pylist()
            ids = np.frombuffer(b"".join(b or b"" for b in blobs), "<i4")
            data, sizes = bpe.decode(ids, np.array([len(b or b"") // 4 for b in blobs], np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, _binary(data, sizes, pa.string())], [*part.schema.names, "text"])


def encode_pieces(docs: DataFrame, model: str, seed: int = 0, rate: float = RATE) -> DataFrame:
    """doc_id, n_pieces and pieces (little-endian 32-bit ids) of every whole text of ``docs``.

    rate 0 leaves merges alone. The same seed, doc_id and text give the same pieces, on any cluster. A null text is an empty
    one and has no pieces; null ids count as -1 for the hash; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.transform(arrow, lambda b: _encode(b, model, seed, rate), "doc_id long, n_pieces long, pieces binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, n_pieces, pieces) with the text that the pieces spell."""
    rows = encoded.select("doc_id", "n_pieces", "pieces")
    return rows.transform(arrow, lambda b: _decode(b, model), "doc_id long, n_pieces long, pieces binary, text string")
