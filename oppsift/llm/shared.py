"""What several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows, counted beforehand; beyond, the join is shuffled.
SMALL_ROWS = 200_000


#: Bytes of a batch that goes to a Python step or comes from it, where the session leaves Spark's default.
BATCH_BYTES, _KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of bounded size: by default ten thousand rows make one, whatever they hold up to 64 MB."""
    conf = df.sparkSession.conf
    if conf.get(_KEY).lower() in ("67108864b", "64mb", "64m"):
        conf.set(_KEY, BATCH_BYTES)
    return df.mapInArrow(lambda batches: _lean(step, batches), schema)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told once to give large blocks back to the system as they are freed; None if it isn't glibc."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim") or not hasattr(libc, "mallopt"):
        return None
    trim, mapped = -1, -3
    libc.mallopt(mapped, 2 << 20)
    libc.mallopt(trim, 8 << 20)
    return libc


def _lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What step gives; a worker that waits for its next task afterwards holds no memory that it does not use."""
    libc = _libc()
    try:
        yield from step(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)


def small_side(df: DataFrame, rows: int | None = None, limit: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast only if it has at most ``limit`` rows. df should be a written table, as it is counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_held: dict[Hashable, Any] = {}


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a process for the last key asked for: one operator's tables make room for the next's."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def without(docs: DataFrame, dropped: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text) but those in dropped, a written table of doc_id and the xxhash64 of texts as text_hash."""
    hashed = docs.withColumn("dropped hash", F.xxhash64(text_or_empty()))
    dropped = small_side(dropped.withColumnRenamed("text_hash", "dropped hash"), limit=limit)
    return hashed.join(dropped, ["doc_id", "dropped hash"], "left_anti").select(docs.columns)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for hi in cuts.tolist():
            held.append(batch.slice(lo, hi - lo))
            yield pa.Table.from_batches(held)
            held, lo = [], hi
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)
