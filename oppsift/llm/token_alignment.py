"""Alignment of the tokens of two tokenizers by elementary intervals.

Both tokenizers cut the same bytes. The union of the ends of both cuts bounds elementary intervals, each of which lies in one
token of either side, so each is one overlap. Where both sides end, a group closes; all pairs of a group's tokens are
links. How common a pair of ids is, is told by the documents that hold it linked.

Documents are worked on in blocks of a few megabytes. A block keeps its different pairs once, in order, and for each document the
places of its pairs among them. Pairs meet by hash: each block asks each range of hashes about its pairs in one row, is answered in
one row, and adds the counts up for its documents. So what is shuffled follows the different pairs of the blocks, not the
links, no key has more rows than there are blocks, and the only thing broadcast is one number for each id of the first vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, written
from oppsift.llm.bpe import CachedBpe
from oppsift.llm.segments import gather, mix
from oppsift.llm.sentencepiece_bpe import DropoutBpe
from oppsift.llm.shared import arrow, only, text_or_empty

#: Bytes of texts in a block, and of texts that are aligned at once. A longer text makes a block of its own.
BLOCK, STEP = 16_000_000, 600_000

#: A range of hashes has about so many pairs of blocks.
RANGE = 2_000_000

_DOCS = "docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"


class Aligner:
    """The tokens of texts by both tokenizers, with a space before each text, and the bytes that each token stands for."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = CachedBpe(byte_level, special=False), DropoutBpe(pieces, 0, 0.0)
        self.high = max(len(self.a.widths), len(self.b.widths))
        #: The decimal digits of each id and a sign behind them, in as many columns as the longest needs.
        spelled = [str(i).encode() for i in range(self.high)]
        wide = len(spelled[-1]) + 1
        self.digits = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in spelled), np.uint8).reshape(self.high, wide)
        self.sizes = np.array([len(s) for s in spelled])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a end to end and how many each text has, and those of b; none for a text that either doesn't give back whole."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        width = np.fromiter(map(len, raw), np.int64, len(raw))
        a, a_count = self.a.encode([" " + t if t else "" for t in texts])
        b, b_count = self.b.encode(texts, np.zeros(len(texts), np.uint64))
        # a byte-level vocabulary gives all bytes back; b may write another text with as many bytes
        good = (_sums(self.a.widths[a], a_count) == width) & (_sums(self.b.widths[b], b_count) == width)
        good &= np.fromiter(("▁" not in t for t in texts), np.bool_, len(texts))
        if good.any():
            of = np.repeat(good, b_count)
            data = gather(self.b.spelled, self.b.at[b[of]], self.b.widths[b[of]])
            want = np.frombuffer(b"".join(r for r, g in zip(raw, good.tolist(), strict=True) if g), np.uint8)
            text = np.repeat(np.flatnonzero(good), width[good])
            good[text[data != want]] = False
        keep_a, keep_b = np.repeat(good, a_count), np.repeat(good, b_count)
        return a[keep_a].astype(np.int64), a_count * good, b[keep_b].astype(np.int64), b_count * good

    def aligned(self, texts: list[str]) -> Aligned:
        return Aligned(self, *self.tokens(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


class Aligned:
    """The groups of some texts: of each the first and the number of its tokens on both sides, among those of all texts."""

    def __init__(self, aligner: Aligner, a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray) -> None:
        self.aligner, self.a, self.b, self.a_count, self.b_count = aligner, a, b, a_count, b_count
        a_ends, b_ends = np.cumsum(aligner.a.widths[a]), np.cumsum(aligner.b.widths[b])
        ends = np.sort(np.concatenate([a_ends, b_ends]))  # their union1d, but that sorting is faster than hashing
        ends = ends[np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])] if len(ends) else ends
        a_owner, b_owner = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        shared = (a_ends[a_owner] == ends) & (b_ends[b_owner] == ends) if len(ends) else np.empty(0, np.bool_)
        self.ends, self.a_last, self.b_last = ends[shared], a_owner[shared], b_owner[shared]
        self.n_a, self.n_b = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        #: The groups before each text, and of all; a text ends where a group does.
        self.bounds = np.searchsorted(self.a_last, np.concatenate([[0], np.cumsum(a_count)]) - 1, side="right")
        self.bounds[0] = 0
        self.n_groups = np.diff(self.bounds)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, token of a, token of b) of all links."""
        count = self.n_a * self.n_b
        group = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(group)) - (np.cumsum(count) - count)[group]
        wide = self.n_b[group]
        a = (self.a_last - self.n_a + 1)[group] + at // wide
        b = (self.b_last - self.n_b + 1)[group] + at % wide
        return np.repeat(np.arange(len(self.n_groups)), self.n_groups)[group], a, b

    def spelled(self) -> list[bytes]:
        """Of each text its groups as decimal ids: a1,a2|b1;a3|b2,b3"""
        n = len(self.a) + len(self.b)
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.n_b) - self.n_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.n_a)[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.a_last]], sign[at_b[self.b_last]] = ord("|"), ord(";")
        size = self.aligner.sizes[ids]
        rows = self.aligner.digits[ids]
        rows[np.arange(n), size] = sign
        data = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
        cut = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(self.a_count + self.b_count)])].tolist()
        return [data[i : j - 1] if j > i else b"" for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _aligner(byte_level: str, pieces: str) -> Aligner:
    return only(("align", byte_level, pieces), lambda: Aligner(byte_level, pieces))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], int]]:
    """doc_ids, texts and their bytes, about STEP bytes at a time."""
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= STEP:
                yield docs, texts, size
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts, size


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte in planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _hashed(pairs: np.ndarray) -> np.ndarray:
    return mix(pairs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _blocks(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """A row for each block. pairs: its different pairs (a << 16 | b) by hash; pair_docs: how many of its documents have each; of its
    documents one after the other, places: how many pairs each has, where they stand among those (as steps) and how often."""
    aligner, block, size = _aligner(byte_level, pieces), TaskContext.get().partitionId() << 32, 0
    docs: list[dict] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        nonlocal block
        pairs, times, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        some, which, n = np.unique(pairs, return_inverse=True, return_counts=True)
        order = np.argsort(_hashed(some), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, text = rank[which], np.repeat(np.arange(len(counts)), counts)
        by = np.argsort(text << 32 | place)
        place, times = place[by], times[by]
        steps = np.diff(place, prepend=0)
        first = (np.cumsum(counts) - counts)[counts > 0]
        steps[first] = place[first]
        row = {"block": block, "docs": docs, "n_pairs": len(some), "pairs": packed(some[order]), "pair_docs": packed(n[order]), "places": packed(counts), "steps": packed(steps), "times": packed(times)}
        block += 1
        return pa.RecordBatch.from_pylist([row], _BLOCKS)

    for ids, texts, n in _steps(batches):
        found = aligner.aligned(texts)
        text, a, b = found.links()
        key = np.sort(text << 32 | found.a[a] << 16 | found.b[b])
        one = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        owner = key[one] >> 32
        held.append((key[one] & 0xFFFFFFFF, np.diff(np.append(one, len(key))), np.bincount(owner, minlength=len(texts))))
        links = np.bincount(text, minlength=len(texts))
        for k, s in enumerate(found.spelled()):
            docs.append({"doc_id": ids[k], "n_a": int(found.a_count[k]), "n_b": int(found.b_count[k]), "n_groups": int(found.n_groups[k]), "n_links": int(links[k]), "groups_sha256": hashlib.sha256(s).hexdigest() if s else ""})
        size += n
        if size >= BLOCK:
            yield out()
            docs, held, size = [], [], 0
    if docs:
        yield out()


_BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(pa.struct([(f, pa.string() if f == "groups_sha256" else pa.int64()) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]))),
        ("n_pairs", pa.int64()),
        *((f, pa.binary()) for f in ("pairs", "pair_docs", "places", "steps", "times")),
    ]
)


def _asked(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each block, cut by ranges of their hashes."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, docs = unpacked(row["pairs"]), unpacked(row["pair_docs"])
            part = _range_of(pairs, ranges)
            cut = np.searchsorted(part, np.arange(ranges + 1)).tolist()
            rows = [{"part": r, "block": row["block"], "pairs": packed(pairs[i:j]), "pair_docs": packed(docs[i:j])} for r, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)


def _range_of(pairs: np.ndarray, ranges: int) -> np.ndarray:
    """Ascending where the pairs are by hash."""
    return ((_hashed(pairs) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _answered(asked: pa.Table) -> pa.Table:
    """To each block the documents of its pairs, in all blocks (``counts``); and the most documents of a pair of each id of a (``best``)."""
    blobs = asked["pairs"].to_pylist()
    each = [unpacked(x) for x in blobs]
    pairs, docs = np.concatenate(each), np.concatenate([unpacked(x) for x in asked["pair_docs"].to_pylist()])
    some, which = np.unique(pairs, return_inverse=True)
    total = np.bincount(which, docs).astype(np.int64)
    counts = np.split(total[which], np.cumsum([len(x) for x in each])[:-1])
    a = some >> 16
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    best = np.maximum.reduceat(total, first)
    rows = [{"part": asked["part"][0].as_py(), "block": b, "counts": _long(c), "ids": None, "best": None} for b, c in zip(asked["block"].to_pylist(), counts, strict=True)]
    rows.append({"part": asked["part"][0].as_py(), "block": None, "counts": None, "ids": a[first].tolist(), "best": best.tolist()})
    return pa.Table.from_pylist(rows, _ANSWERS)


_ANSWERS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))])


def _long(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, as two of 32."""
    return packed(np.concatenate([x & 0xFFFFFFFF, x >> 32]))


def _of_long(data: bytes) -> np.ndarray:
    x = unpacked(data)
    return x[: len(x) // 2] | x[len(x) // 2 :] << 32


def _summed(blocks: pa.Table, answers: pa.Table, best: np.ndarray) -> pa.Table:
    """The documents of a block with n_best and count_sum."""
    out = []
    answers = answers.sort_by("part")
    counts = np.concatenate([np.empty(0, np.int64), *(_of_long(x) for x in answers["counts"].to_pylist())])
    for row in blocks.to_pylist():
        is_best = counts == best[unpacked(row["pairs"]) >> 16]
        size, steps, times = unpacked(row["places"]), unpacked(row["steps"]), unpacked(row["times"])
        place = np.cumsum(steps)
        first = (np.cumsum(size) - size)[size > 0]
        place -= np.repeat(place[first] - steps[first], size[size > 0])
        docs = pa.Table.from_pylist(row["docs"], pa.schema(list(_BLOCKS.field("docs").type.value_type)))
        out.append(docs.append_column("n_best", pa.array(_sums(times * is_best[place], size))).append_column("count_sum", pa.array(_sums(times * counts[place], size))))
    return pa.concat_tables(out) if out else _RESULT.empty_table()


_RESULT = pa.schema([*_BLOCKS.field("docs").type.value_type, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def alignment_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of its groups spelled as
    a1,a2|b1;a3|b2,b3, n_best (links whose pair is held by as many documents as any pair of their id of a) and count_sum (documents
    that hold a link's pair, summed over the links). byte_level: file of a byte-level tokenizer (a), pieces: of a SentencePiece model (b).

    A text that is null, empty or not given back whole by either tokenizer (such as one with a U+2581) has zeros and an empty
    groups_sha256. Each row counts as a document, also one that repeats another; a null doc_id stays null; an empty table gives an
    empty result; other columns are ignored. A text longer than a block is a block by itself.
    """
    spark = docs.sparkSession
    cut = _texts(docs).transform(arrow, lambda b: _blocks(b, byte_level, pieces), f"block long, {_DOCS}, n_pairs long, pairs binary, pair_docs binary, places binary, steps binary, times binary")
    blocks, seen = measured(cut, "aligned", pairs=F.sum("n_pairs"))
    ranges = max(8, -(-(seen["pairs"] or 0) // RANGE))
    asked = blocks.select("block", "pairs", "pair_docs").transform(arrow, lambda b: _asked(b, ranges), "part long, block long, pairs binary, pair_docs binary")
    answers = written(asked.groupBy("part").applyInArrow(_answered, "part long, block long, counts binary, ids array<long>, best array<long>"), "answers")
    most = answers.where("block is null").select(F.explode(F.arrays_zip("ids", "best")).alias("x")).groupBy("x.ids").agg(F.max("x.best").alias("best"))
    found = most.toArrow()  # a row for each id of a at most
    best = np.zeros(1 << 16, np.int64)
    best[found["ids"].to_numpy()] = found["best"].to_numpy()
    share = spark.sparkContext.broadcast(best)
    back = answers.where("block is not null").select("block", "part", "counts")
    rows = blocks.select("block", "docs", "pairs", "places", "steps", "times").groupBy("block").cogroup(back.groupBy("block"))
    return rows.applyInArrow(lambda x, y: _summed(x, y, share.value), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _grouped(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(byte_level, pieces)
    group = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
    for ids, texts, _ in _steps(batches):
        x = aligner.aligned(texts)
        rows = []
        for lo, hi in zip(x.bounds[:-1].tolist(), x.bounds[1:].tolist(), strict=True):
            base = int(x.ends[lo - 1]) if lo else 0
            starts = [base, *x.ends[lo : hi - 1].tolist()] if hi > lo else []
            rows.append(
                [
                    {"start": s - base, "end": int(x.ends[g]) - base, "a": x.a[x.a_last[g] - x.n_a[g] + 1 : x.a_last[g] + 1].tolist(), "b": x.b[x.b_last[g] - x.n_b[g] + 1 : x.b_last[g] + 1].tolist()}
                    for g, s in zip(range(lo, hi), starts, strict=True)
                ]
            )
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, group)], ["doc_id", "groups"])


def align_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id and groups of every row of ``docs``: of each group its bytes (start and end, in the text with a space before it) and its
    ids on both sides. Texts without tokens (see ``alignment_counts``) have no groups."""
    return _texts(docs).transform(arrow, lambda b: _grouped(b, byte_level, pieces), "doc_id long, groups array<struct<start:long,end:long,a:array<long>,b:array<long>>>")
