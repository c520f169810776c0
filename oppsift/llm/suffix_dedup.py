"""Removes repeated passages by a sorted order of suffixes that is merged over the cluster.

A passage is a window of ``length`` bytes that also starts earlier. Suffixes are sorted at anchors only: of the grams of K bytes in a
window the one with the least hash, the leftmost on ties, owns the window, so equal windows are owned at the same place by equal
grams, and a window is one of a run of windows that one anchor owns. An anchor's key is its suffix, as far as its windows go, then the
bytes before it, backwards, as far as they go, then how far that is; so equal keys are anchors whose windows are all equal.

1. Texts that repeat an earlier one whole are told by their SHA-256 and have no anchors. The others are dealt to blocks.
2. Blocks tell each other, by ranges of hashes, which grams occur once only in the whole table: these own no repeated window.
3. Each block sorts the keys that are left, each different one once, with its first place in the block; the run is front-coded
   (the prefix that a key shares with the one before, and the rest) and cut at common splitters.
4. A range merges the runs of all blocks by a loser tree that knows of each loser the prefix it shares with the last winner, so
   no byte of a shared prefix is compared again. Of equal keys the earliest place is first, all others are repeats.
5. In the merged order the keys that share their first bytes are neighbours, by the prefixes that the merge has found. So of each
   place of a window the keys with equal windows are found from the prefixes forwards and backwards, and the earliest of them
   is first. What a range cannot see whole, as it goes on beyond its ends, is settled between the ranges by its bytes.
6. Blocks learn which windows are repeats, and remove the bytes that these cover.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oppsift.checkpoints import measured, shared_folder, written
from oppsift.llm.segments import BYTE_VALUES, Spans, gather, mix
from oppsift.llm.shared import SMALL_ROWS, arrow, small_side, text_or_empty

#: Bytes of texts in a block and of texts that are hashed at once, hashes in a range of them, keys in a range of them, and in a row.
BLOCK, STEP, HASHES, KEYS, ROW = 2_000_000, 400_000, 2_000_000, 32_000, 4096

#: Of the keys at most about so many, evenly spaced in their runs, are looked at for the splitters.
SAMPLE = 50_000

SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


class Shape:
    """The sizes that follow from the length of a window."""

    def __init__(self, length: int) -> None:
        if length < 2:
            raise ValueError("a window has two bytes at least")
        self.length, self.gram = length, max(length // 2, length - 62)
        self.places = length - self.gram + 1  # of the anchor in a window, counted from the window's start
        self.key = length + self.places - 1 + 2  # bytes of a key


def anchors(data: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: where anchors are, the starts of the first and the last window of each, and the hashes of their grams."""
    n, count = len(data), len(data) - shape.length + 1
    none = np.empty(0, np.int64)
    if count <= 0:
        return none, none, none, none.astype(np.uint64)
    starts = np.arange(n - shape.gram + 1)
    hashes = Spans(BYTE_VALUES[data])(starts, starts + shape.gram)
    least, wide = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64), 1
    while 2 * wide <= shape.places:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:count], least[shape.places - wide :][:count])
    edge = np.zeros(n + 1, np.int64)  # windows that start in the last bytes of a text leave it
    size = np.diff(bounds)
    np.add.at(edge, np.maximum(bounds[1:] - shape.length + 1, bounds[:-1])[size > 0], 1)
    np.add.at(edge, bounds[1:][size > 0], -1)
    window = np.flatnonzero(np.cumsum(edge[:count]) == 0)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    owner = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    at = owner[cut]
    return at, window[cut], window[np.append(cut[1:], len(owner)) - 1], mix(hashes[at])


class Block:
    """The different texts of a block, by doc_id, and their anchors."""

    def __init__(self, texts: pa.Table, shape: Shape) -> None:
        self.shape, docs = shape, texts["doc_id"].to_pylist()
        raw, shas = texts["text"].to_pylist(), texts["sha"].to_pylist()
        order = sorted(range(len(docs)), key=lambda k: (docs[k] is None, docs[k] or 0, shas[k]))
        one = [k for i, k in enumerate(order) if not i or (docs[k], shas[k]) != (docs[order[i - 1]], shas[order[i - 1]])]
        self.raw = [raw[k] for k in one]
        #: Texts come by doc_id, null last, and those of one doc_id by their hashes.
        self.docs = np.array([np.iinfo(np.int64).max if docs[k] is None else docs[k] for k in one], np.int64)
        self.ties = np.array([int.from_bytes(shas[k][:7], "big") for k in one], np.int64)
        number = {(docs[k], shas[k]): i for i, k in enumerate(one)}
        #: Of each row of the block: its doc_id and its text's number.
        self.rows = [(docs[k], number[docs[k], shas[k]]) for k in order]
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in self.raw])]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found, lo, n = [], 0, len(self.raw)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + STEP, side="right")) - 1)
            base = self.bounds[lo]
            at, first, last, hashes = anchors(self.data[base : self.bounds[hi]], self.bounds[lo : hi + 1] - base, self.shape)
            found.append((at + base, first + base, last + base, hashes))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def keys(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A row of bytes for each anchor: forwards, backwards, and the first and last place of the anchor in its windows."""
        low, high = at - last, at - first
        column, side = np.arange(self.shape.length), np.arange(1, self.shape.places)
        out = np.zeros((len(at), self.shape.key), np.uint8)
        out[:, : self.shape.length] = self.data[np.minimum(at[:, None] + column, len(self.data) - 1)] * (column < self.shape.length - low[:, None])
        out[:, self.shape.length : -2] = self.data[np.maximum(at[:, None] - side, 0)] * (side <= high[:, None])
        out[:, -2], out[:, -1] = low, high
        return out


def _hash_rows(texts: pa.Table, shape: Shape, parts: int) -> pa.Table:
    """The hashes of a block's grams, by range: in order, and a bit for each that the block has twice."""
    some, count = np.unique(Block(texts, shape).anchors()[3], return_counts=True)
    part = _parts(some, parts)
    cut = np.searchsorted(part, np.arange(parts + 1)).tolist()
    block = texts["block"][0].as_py()
    rows = [{"part": r, "block": block, "hashes": some[i:j].tobytes(), "twice": np.packbits(count[i:j] > 1).tobytes()} for r, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
    return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())]))


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _repeated(asked: pa.Table) -> pa.Table:
    """To each block a bit for each of its hashes: does it occur twice anywhere?"""
    each = [np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(asked["twice"].to_pylist(), each, strict=True)])
    hashes = np.concatenate(each)
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    size = np.diff(np.append(heads, len(hashes)))
    out = np.empty(len(hashes), np.bool_)
    out[order] = np.repeat((size > 1) | (np.maximum.reduceat(twice[order], heads) > 0), size)
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum([len(x) for x in each])[:-1])]
    return pa.table({"block": asked["block"], "part": asked["part"], "n": pa.array([len(x) for x in each], pa.int64()), "bits": pa.array(bits, pa.binary())})


_RUN = pa.schema(
    [
        *((f, pa.int64()) for f in ("block", "start", "n")),
        *((f, pa.binary()) for f in ("shared", "rest", "docs", "ties", "at")),
        ("sample", pa.list_(pa.binary())),
        ("places", pa.binary()),
    ]
)
_RUN_SQL = "block long, start long, n long, shared binary, rest binary, docs binary, ties binary, at binary, sample array<binary>, places binary"


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def front_coded(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted rows of bytes: how many bytes each shares with the one before, and all other bytes."""
    shared = np.zeros(len(keys), np.uint8)
    other = keys[1:] != keys[:-1]
    shared[1:] = np.where(other.any(1), other.argmax(1), keys.shape[1])
    return shared.tobytes(), _small(keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes())


def decoded(shared: bytes, rest: bytes, width: int) -> list[bytes]:
    rest, out, last, i = _large(rest), [], b"", 0
    for h in shared:
        j = i + width - h
        last = last[:h] + rest[i:j]
        out.append(last)
        i = j
    return out


def _runs(texts: pa.Table, bits: pa.Table, shape: Shape) -> pa.Table:
    """A block's sorted run of different keys; and in a row with n = -1 the places of all its anchors that are left: text, place, low
    and high place in windows, and number of their key."""
    block = Block(texts, shape)
    at, first, last, hashes = block.anchors()
    some, which = np.unique(hashes, return_inverse=True)
    told = bits.sort_by("part")
    twice = np.concatenate([np.empty(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(told["bits"].to_pylist(), told["n"].to_pylist(), strict=True))])
    assert len(twice) == len(some)
    use = np.flatnonzero(twice[which] > 0)
    at, first, last = at[use], first[use], last[use]
    rows: list[dict] = []
    number = texts["block"][0].as_py()
    if len(at):
        low, high = at - last, at - first
        # equal keys have equal hashes; the first of each hash is sorted, and the others are compared with it
        hashes = mix(Spans(BYTE_VALUES[block.data])(first, last + shape.length) + (low << 8 | high).astype(np.uint64))
        _, one, entry = np.unique(hashes, return_index=True, return_inverse=True)
        again = np.flatnonzero(one[entry] != np.arange(len(at)))
        for lo in range(0, len(again), ROW):
            x = again[lo : lo + ROW]
            y = one[entry[x]]
            other = x[(block.keys(at[x], first[x], last[x]) != block.keys(at[y], first[y], last[y])).any(1)]
            entry[other] = len(one) + np.arange(len(other))
            one = np.concatenate([one, other])
        strings = [k.tobytes() for lo in range(0, len(one), ROW) for k in block.keys(*(v[one[lo : lo + ROW]] for v in (at, first, last)))]
        order = np.array(sorted(range(len(one)), key=strings.__getitem__), np.int64)
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        one, entry = one[order], rank[entry]
        text = np.searchsorted(block.bounds, at, side="right") - 1
        place = at - block.bounds[text]
        for lo in range(0, len(one), ROW):
            k = one[lo : lo + ROW]
            own = [strings[i] for i in order[lo : lo + ROW].tolist()]
            shared, rest = front_coded(np.frombuffer(b"".join(own), np.uint8).reshape(-1, shape.key))
            sample = own[:: ROW // 16]
            rows.append({"block": number, "start": lo, "n": len(k), "shared": shared, "rest": rest, "docs": block.docs[text[k]].tobytes(), "ties": block.ties[text[k]].tobytes(), "at": place[k].tobytes(), "sample": sample})
        places = np.column_stack([text, place, low, high, entry]).astype("<i8")
        rows.append({"block": number, "start": 0, "n": -1, "places": _small(places.T.tobytes())})
    return pa.Table.from_pylist(rows, _RUN)


def _dealt(batches: Iterator[pa.RecordBatch], splitters: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
    """Runs cut at the splitters: a range begins with its splitter."""
    cuts = np.array(splitters, dtype=f"S{width}") if splitters else None
    for batch in batches:
        for row in batch.to_pylist():
            strings = decoded(row["shared"], row["rest"], width)
            keys = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
            # zeros at an end don't count in this comparison, for splitters and keys alike, so ranges stay in order
            part = np.searchsorted(cuts, keys.view(f"S{width}").ravel(), side="right") if splitters else np.zeros(len(keys), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                shared, rest = front_coded(keys[i:j])
                piece = {"part": int(part[i]), "block": row["block"], "start": row["start"] + i, "n": j - i, "shared": shared, "rest": rest}
                piece |= {f: _small(row[f][8 * i : 8 * j]) for f in ("docs", "ties", "at")}
                yield pa.RecordBatch.from_pylist([piece], _DEALT)


_DEALT = pa.schema([*((f, pa.int64()) for f in ("part", "block", "start", "n")), *((f, pa.binary()) for f in ("shared", "rest", "docs", "ties", "at"))])


def merged(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Runs of sorted strings of ``width`` bytes, with the prefix that each shares with the one before it, merged by a loser tree: of
    each string in order, the run it comes from and the prefix it shares with the string before it.

    A node keeps the loser of the match that was played there, and the prefix that it shares with the winner. A run's next
    string comes with the prefix shared with the last one that left, which is the winner all losers on its way lost to: the
    longer prefix wins without a look at the strings, and equal prefixes are compared behind them only."""
    slots = 1 << max(0, (len(runs) - 1).bit_length())
    strings, shares = [r[0] for r in runs] + [[]] * (slots - len(runs)), [r[1] for r in runs] + [[]] * (slots - len(runs))
    here = [s[0] if s else b"" for s in strings]
    place, loser, prefix = [0] * slots, [0] * slots, [0] * slots

    def first_behind(a: bytes, b: bytes, h: int) -> tuple[int, bool]:
        """Where a and b differ, given that they are equal before h; and whether b is less."""
        x, y = int.from_bytes(a[h:], "big"), int.from_bytes(b[h:], "big")
        return width - ((x ^ y).bit_length() + 7) // 8, y < x

    def play(node: int) -> tuple[int, int]:
        """The winner of a subtree, and -1 if it is used up."""
        if node >= slots:
            return node - slots, 0 if strings[node - slots] else -1
        (r, h), (s, g) = play(2 * node), play(2 * node + 1)
        if g < 0 or h < 0:
            if h < 0:
                r, s, h, g = s, r, g, h
        else:
            g, less = first_behind(here[r], here[s], 0)
            if less:
                r, s = s, r
        loser[node], prefix[node] = s, g
        return r, h

    run, h = play(1)
    out, with_before = [], []
    while h >= 0:
        out.append(run)
        with_before.append(h)
        place[run] = i = place[run] + 1
        if i < len(strings[run]):
            here[run], h = strings[run][i], shares[run][i]
        else:
            h = -1
        node = (run + slots) >> 1
        while node:
            g = prefix[node]
            if g > h:
                run, loser[node], h, prefix[node] = loser[node], run, g, h
            elif g == h and 0 <= h < width:
                s = loser[node]
                g, less = first_behind(here[run], here[s], h)
                if less:
                    loser[node], run = run, s
                prefix[node] = g
            node >>= 1
    return out, with_before


_MARKS = pa.schema([("kind", pa.int32()), *((f, pa.int64()) for f in ("block", "n")), ("entries", pa.binary()), ("masks", pa.binary()), ("window", pa.binary()), *((f, pa.int64()) for f in ("doc", "tie", "at", "entry", "mask"))])
_MARKS_SQL = "kind int, block long, n long, entries binary, masks binary, window binary, doc long, tie long, at long, entry long, mask long"


def _merged_range(rows: pa.Table, shape: Shape, ranges: int) -> pa.Table:
    """Of each block the keys in this range that are repeats, with a bit for each place of the anchor in a repeated window (kind 0);
    and the windows that a neighbouring range may have too, with their first place here (kind 1)."""
    width, part = shape.key, rows["part"][0].as_py()
    rows = rows.sort_by([("block", "ascending"), ("start", "ascending")])
    runs: list[tuple[list[bytes], list[int]]] = []
    owner, numbers, whence = [], [], {f: [] for f in ("docs", "ties", "at")}
    for row in rows.select(["block", "start", "n", "shared", "rest", "docs", "ties", "at"]).to_pylist():
        strings, shares = decoded(row["shared"], row["rest"], width), list(row["shared"])
        if owner and owner[-1] == row["block"]:
            x, y = runs[-1][0][-1], strings[0]
            shares[0] = width - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
            runs[-1][0].extend(strings)
            runs[-1][1].extend(shares)
            numbers[-1] = np.concatenate([numbers[-1], row["start"] + np.arange(row["n"])])
        else:
            owner.append(row["block"])
            runs.append((strings, shares))
            numbers.append(row["start"] + np.arange(row["n"]))
        for f, values in whence.items():
            values.append(np.frombuffer(_large(row[f]), np.int64))
    order, shares = merged(runs, width)
    size = np.array([len(r[0]) for r in runs])
    order = np.array(order, np.int64)
    # of each string in the merged order its place in the runs laid end to end: those of a run come in their order
    flat = np.empty(len(order), np.int64)
    flat[np.argsort(order, kind="stable")] = np.arange(len(order))
    doc, tie, at = (np.concatenate(v)[flat] for v in whence.values())
    block, number = np.repeat(np.array(owner, np.int64), size)[flat], np.concatenate(numbers)[flat]
    when = np.empty(len(flat), np.int64)
    when[np.lexsort((at, tie, doc))] = np.arange(len(flat))
    # classes of equal keys; of each the earliest place stays
    shares = np.array(shares, np.int64)
    kind = np.cumsum(shares < width) - 1
    heads = np.flatnonzero(shares < width)
    by = np.argsort(kind << 32 | when)
    first = by[heads]  # classes keep their sizes in this order
    full = np.int64((1 << shape.places) - 1)
    mask = np.full(len(flat), full)
    mask[first] = 0
    # places of windows in the classes
    everything = [s for r in runs for s in r[0]]
    keys = np.frombuffer(b"".join([everything[k] for k in flat[heads].tolist()]), np.uint8).reshape(-1, width)
    shares, when = np.minimum(shares[heads], shape.length), when[first]
    low, high = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    side = shape.places - 1
    back = np.ascontiguousarray(keys[:, shape.length : -2])
    turned = np.argsort(back.view(f"S{side}").ravel(), kind="stable")
    other = back[turned][1:] != back[turned][:-1]
    same = np.concatenate([[0], np.where(other.any(1), other.argmax(1), side)])
    found = np.zeros(len(heads), np.int64)
    left: list[dict] = []
    n, bits = len(heads), int(len(flat)).bit_length()
    behind = np.empty(n, np.int64)
    for o in range(shape.places):
        some = np.flatnonzero((low <= o) & (o <= high))
        if not len(some):
            continue
        ahead = np.cumsum(shares < shape.length - o)
        behind[turned] = np.cumsum(same < o)
        group = ahead[some] * (n + 1) + behind[some]
        by = np.lexsort((when[some], group)) if 3 * bits > 62 else np.argsort(group << bits | when[some])
        start = np.r_[True, group[by][1:] != group[by][:-1]]
        found[some[by[~start]]] |= 1 << o
        touching = np.zeros(len(some), np.bool_)
        if part > 0:
            touching |= ahead[some] == ahead[0]
        if part < ranges - 1:
            touching |= ahead[some] == ahead[-1]
        for k in some[by[start & touching[by]]].tolist():
            window = keys[k, shape.length : shape.length + o][::-1].tobytes() + keys[k, : shape.length - o].tobytes()
            j = first[k]
            left.append({"kind": 1, "block": int(block[j]), "window": window, "doc": int(doc[j]), "tie": int(tie[j]), "at": int(at[j]) - o, "entry": int(number[j]), "mask": 1 << o})
    mask[first] = found
    some = np.flatnonzero(mask > 0)
    some = some[np.argsort(block[some], kind="stable")]
    cut = np.flatnonzero(np.diff(block[some])) + 1
    out = [(int(block[x[0]]), x) for x in np.split(some, cut) if len(x)]
    marks = [{"kind": 0, "block": b, "n": len(x), "entries": _small(number[x].tobytes()), "masks": _small(mask[x].tobytes())} for b, x in out]
    return pa.Table.from_pylist(marks + left, _MARKS)


def _cut_texts(texts: pa.Table, marks: pa.Table, shape: Shape) -> pa.Table:
    """The rows of a block with the spans that are repeats and the bytes that are left."""
    block = Block(texts, shape)
    edge = np.zeros(len(block.data) + 1, np.int64)
    rows = marks.to_pylist()
    places = next((r["entries"] for r in rows if r["kind"] == 2), None)
    if places is not None:
        text, place, low, high, entry = np.frombuffer(_large(places), "<i8").reshape(5, -1)
        count = int(entry.max()) + 1
        mask = np.zeros(count, np.int64)
        for r in rows:
            if r["kind"] == 0:
                number = np.frombuffer(_large(r["entries"]), np.int64)
                mask[number] |= np.frombuffer(_large(r["masks"]), np.int64)
            elif r["kind"] == 1:
                mask[r["entry"]] |= r["mask"]
        # but for its first place in the block a key is a repeat as a whole
        order = np.argsort(entry, kind="stable")
        again = np.ones(len(entry), np.bool_)
        again[order[np.r_[True, entry[order][1:] != entry[order][:-1]]]] = False
        own = mask[entry]
        own[again] = (1 << shape.places) - 1
        at = block.bounds[text] + place
        for o in range(shape.places):
            some = at[(own >> o & 1 > 0) & (low <= o) & (o <= high)] - o
            np.add.at(edge, some, 1)
            np.add.at(edge, some + shape.length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out: list[tuple[list[dict], bytes]] = []
    for k, raw in enumerate(block.raw):
        drop = gone[block.bounds[k] : block.bounds[k + 1]]
        step = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]]))).tolist()
        out.append(([{"start": a, "end": b} for a, b in zip(step[::2], step[1::2], strict=True)], np.frombuffer(raw, np.uint8)[~drop].tobytes() if step else raw))
    columns = [[d for d, _ in block.rows], [len(block.raw[k]) for _, k in block.rows], [out[k][0] for _, k in block.rows], [out[k][1] for _, k in block.rows]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT.types, strict=True)], schema=_CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df, written to the shared folder in buckets by ``key``, so that what groups by it later finds its rows together without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets its name; the files stay, and out reads them
    return out


def _sha() -> Column:
    return F.unhex(F.sha2("text", 256))


def suffix_dedup(docs: DataFrame, length: int = 100, limit: int = SMALL_ROWS) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (start and end of each maximal stretch of removed bytes) and kept
    (the other bytes; a stretch may cut a character in two).

    A byte is removed if a window of ``length`` bytes of its text that covers it also starts earlier: in a row with a smaller doc_id
    (null is the largest), or further ahead in the same text. Rows that repeat a doc_id with the same text are one document and share
    their result; with other texts they come one after the other in the order of these texts' SHA-256. Windows overlap, never
    leave their text, and are judged on the texts as they came. A null text is an empty one; what is shorter than a window stays. Empty
    tables give an empty result; other columns are ignored. limit: see ``small_side``.
    """
    spark, shape = docs.sparkSession, Shape(length)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    size = F.octet_length("text")
    short = texts.where(size < length).select("doc_id", size.cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    long = texts.where(size >= length).withColumn("sha", _sha())
    keys, seen = measured(long.select("doc_id", "sha", size.cast("long").alias("n_bytes")), "texts", bytes=F.sum("n_bytes"))
    if not seen["bytes"]:
        return short
    groups, n = measured(keys.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups", n=F.count("*"))
    copies, n = measured(keys.join(small_side(groups, n["n"], limit), "sha").where(~F.col("doc_id").eqNullSafe(F.col("first"))).drop("first"), "copies", n=F.count("*"))
    whole = copies.select("doc_id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
    gone = copies.select(F.col("doc_id").alias("gone"), F.col("sha").alias("of")).distinct()
    left = long.join(small_side(gone, n["n"], limit), (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    blocks = max(1, seen["bytes"] // BLOCK)
    block = F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks)).alias("block")
    held = bucketed(left.select(block, "doc_id", "sha", F.col("text").cast("binary").alias("text")), "texts", "block", -(-blocks // 2))
    by_block = held.groupBy("block")
    parts = max(8, seen["bytes"] // (20 * HASHES))
    asked = by_block.applyInArrow(lambda t: _hash_rows(t, shape, parts), "part long, block long, hashes binary, twice binary")
    bits = asked.groupBy("part").applyInArrow(_repeated, "block long, part long, n long, bits binary")
    runs, n = measured(by_block.cogroup(bits.groupBy("block")).applyInArrow(lambda t, b: _runs(t, b, shape), _RUN_SQL), "runs", keys=F.sum(F.when(F.col("n") > 0, F.col("n"))), samples=F.sum(F.coalesce(F.size("sample"), F.lit(0))))
    keys_left = n["keys"] or 0
    ranges = max(1, -(-keys_left // KEYS))
    splitters: list[bytes] = []
    if ranges > 1:
        sample = runs.select(F.explode("sample").alias("key"))
        sample = sample.sample(SAMPLE / n["samples"], 1) if n["samples"] > SAMPLE else sample
        heads = sorted(bytes(r["key"]) for r in sample.collect())  # at most SAMPLE or so
        splitters = sorted({heads[len(heads) * k // ranges].rstrip(b"\0") for k in range(1, ranges)}) if heads else []
    ranges = len(splitters) + 1
    dealt = runs.where("n > 0").drop("sample", "places").transform(arrow, lambda b: _dealt(b, splitters, shape.key), "part long, block long, start long, n long, shared binary, rest binary, docs binary, ties binary, at binary")
    marks = written(dealt.groupBy("part").applyInArrow(lambda t: _merged_range(t, shape, ranges), _MARKS_SQL), "marks")
    # windows that several ranges have: all but the earliest are repeats
    later = marks.where("kind = 1").withColumn("turn", F.row_number().over(W.partitionBy("window").orderBy("doc", "tie", "at"))).where("turn > 1")
    told = marks.where("kind = 0").unionByName(later.select(marks.columns)).select("kind", "block", "entries", "masks", "entry", "mask")
    told = told.unionByName(runs.where("n = -1").select(F.lit(2).alias("kind"), "block", F.col("places").alias("entries"), F.lit(None).cast("binary").alias("masks"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("mask")))
    cut = by_block.cogroup(told.groupBy("block")).applyInArrow(lambda t, m: _cut_texts(t, m, shape), SPANS)
    return short.unionByName(whole).unionByName(cut)
