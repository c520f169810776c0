"""Cost-balanced packing of token ids into sequences.

A piece of n tokens costs n + n * n / ``length``: the work that is linear in tokens and attention within the piece. What
fills whole sequences is cut off first. Then the rests, in descending order of cost, each go to the cheapest sequence
with room for them, among as many as hold all tokens of the window; a rest that fits nowhere whole is cut, into the
emptiest sequences. So all padding of a window together is less than one sequence; it may be spread over many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.llm.shared import arrow, text_or_empty
from oppsift.llm.token_files import encoded

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Tokens of a window: what one task packs at once. The padding is below one sequence for each window.
WINDOW = 4_000_000


def pack(sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, tokens, sequence, offset in it) of each piece, for documents of ``sizes`` tokens."""
    whole, rest = sizes // length, sizes % length
    pieces = [(d, k * length, length, 0, 0) for d in np.flatnonzero(whole).tolist() for k in range(int(whole[d]))]
    pieces = [(d, s, n, q, o) for q, (d, s, n, _, o) in enumerate(pieces)]
    base, count = len(pieces), -(-int(rest.sum()) // length)
    room, cost = np.full(count, length, np.int64), np.zeros(count)
    for d in np.argsort(-rest, kind="stable").tolist():
        start, left = int(whole[d]) * length, int(rest[d])
        while left:
            fits = room >= left
            q = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[q]))
            pieces.append((d, start, n, base + q, length - int(room[q])))
            room[q] -= n
            cost[q] += n + n * n / length
            start, left = start + n, left - n
    return pieces


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, length: int, window: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    held: list[tuple[list, np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal first
        docs = [d for x, _, _ in held for d in x]
        ids, sizes = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
        held.clear()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        pieces = pack(sizes, length)
        for lo in range(0, len(pieces), 2048):
            d, start, n, q, offset = np.array(pieces[lo : lo + 2048], np.int64).T
            data = [ids[a : a + k].astype("<u4").tobytes() for a, k in zip((bounds[d] + start).tolist(), n.tolist(), strict=True)]
            columns = [pa.array([docs[i] for i in d.tolist()], pa.int64()), start, n, sizes[d], first + q, offset]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(data, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        first += max(p[3] for p in pieces) + 1

    size = 0
    for part in encoded(batches, tokenizer, end_id):
        held.append(part)
        size += len(part[1])
        if size >= window:
            yield from out()
            size = 0
    if held:
        yield from out()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset and
    ids (little-endian unsigned 32-bit), sequences of at most ``length`` tokens without gaps from 0.

    Each input partition is packed by itself, a window at a time, so nothing is shuffled. A null text is empty and has
    its end id alone; a null doc_id stays null; repeated rows are packed as often as they occur; an empty table has no
    pieces. Other columns are ignored. sequence_id tells sequences apart and isn't consecutive between partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.transform(arrow, lambda b: _pack(b, tokenizer, end_id, length, window), PIECES)
