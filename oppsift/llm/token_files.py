"""Token ids in flat binary files.

A shard has three files: ids end to end (unsigned 16-bit where the vocabulary allows it, else 32-bit), the 64-bit offset
of each document in them and one more, and the documents' 64-bit ids; all little-endian, made for memory-mapping. A task
begins a new shard after so many ids or documents, so neither grows with the table. Shards follow one another in ascending
doc_id order, and manifest.json names each with its bases: the documents and ids before it, prefix sums over the
shards. A shard counts only once the manifest names it, so a task that is run again does no harm.

Readers map the files of a local store and read ranges of them elsewhere, a bounded part at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.checkpoints import shared_folder
from oppsift.llm.bpe import cached_bpe
from oppsift.llm.shared import arrow, text_or_empty

#: Documents are encoded so many code points or so at a time, and read so many ids at a time.
STEP = 600_000

#: A shard has so many ids and documents at most, but for its last document. A reader's part has so many documents.
SHARD_IDS, SHARD_DOCS, PART_DOCS = 1 << 26, 1 << 22, 1 << 16


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it; a plain path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, step: int = STEP) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids end to end, how many each) of some documents at a time; each document ends with ``end_id``."""
    bpe = cached_bpe(path)
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        lo = 0
        while lo < len(docs):
            hi, size, part = lo, 0, []
            while hi < len(docs) and (hi == lo or size < step):
                part.append(texts[hi].as_py() or "")
                size += len(part[-1])
                hi += 1
            ids, counts = bpe.encode(part)
            out = np.full(len(ids) + len(part), end_id, np.uint32)
            ends = np.cumsum(counts + 1) - 1
            body = np.ones(len(out), np.bool_)
            body[ends] = False
            out[body] = ids
            yield docs[lo:hi], out, counts + 1
            lo = hi


class _Shard:
    """The files of one shard as they are written."""

    def __init__(self, store: fs.FileSystem, root: str, name: str, kind: str) -> None:
        self.store, self.path, self.kind = store, f"{root}/{name}", kind
        self.row = {"name": name, "nulls": 0, "n_docs": 0, "n_tokens": 0}
        self.ids, self.offsets, self.docs = store.open_output_stream(f"{self.path}.ids"), [np.zeros(1, np.int64)], []

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.write(memoryview(ids.astype(self.kind)).cast("B"))
        self.offsets.append(self.row["n_tokens"] + np.cumsum(counts))
        self.docs.append(np.array([0 if d is None else d for d in docs], np.int64))
        self.row["n_tokens"] += len(ids)
        self.row["n_docs"] += len(docs)
        self.row["nulls"] += docs.count(None)

    def full(self, ids: int) -> bool:
        return self.row["n_docs"] >= SHARD_DOCS or self.row["n_tokens"] >= ids

    def close(self) -> dict:
        self.ids.close()
        for end, parts in (("offsets", self.offsets), ("docs", self.docs)):
            with self.store.open_output_stream(f"{self.path}.{end}") as f:
                f.write(memoryview(np.concatenate(parts).astype("<i8")).cast("B"))
        return self.row


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str, kind: str, shard_ids: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    store, root = file_system(folder)
    shard, n = None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": task.partitionId(), "place": n} | shard.close()])

    for docs, ids, counts in encoded(batches, path, end_id, min(STEP, shard_ids)):
        if shard is None:
            shard = _Shard(store, root, f"{task.partitionId():06d}-{n:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", kind)
        shard.add(docs, ids, counts)
        if shard.full(shard_ids):
            yield done()
            shard, n = None, n + 1
    if shard is not None:
        yield done()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> list[dict]:
    """Encodes every whole text of ``docs`` (doc_id, text) and writes shards and manifest.json to ``folder``, a URI that all
    executors reach. Returns the shards as in the manifest.

    A null text is empty, a document always has its end id; documents with a null id come first, and equal ids go by
    text. An empty table makes an empty manifest. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    shape = "part long, place long, name string, nulls long, n_docs long, n_tokens long"
    made = rows.transform(arrow, lambda b: _write(b, tokenizer, end_id, folder, kind, shard_ids), shape).collect()
    shards, documents, tokens = [], 0, 0
    for row in sorted(made, key=lambda r: (r["part"], r["place"])):
        shards.append(row.asDict() | {"doc_base": documents, "token_base": tokens})
        documents, tokens = documents + row["n_docs"], tokens + row["n_tokens"]
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": kind, "n_docs": documents, "n_tokens": tokens, "shards": shards}).encode())
    return shards


class _Numbers:
    """The numbers of a file by their places: mapped where the store is local, else read as they are asked for."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str) -> None:
        self.kind = np.dtype(kind)
        local = isinstance(store, fs.LocalFileSystem)
        self.mapped = np.memmap(path, kind, "r") if local else None
        self.file = None if local else store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.kind)


def _read(batches: Iterator[pa.RecordBatch], folder: str, kind: str) -> Iterator[pa.RecordBatch]:
    store, root = file_system(folder)
    for batch in batches:
        for shard in batch.to_pylist():
            ids, offsets, docs = (_Numbers(store, f"{root}/{shard['name']}.{end}", k) for end, k in (("ids", kind), ("offsets", "<i8"), ("docs", "<i8")))
            first, last = shard["first"], min(shard["first"] + PART_DOCS, shard["n_docs"])
            at, numbers = np.array(offsets[first : last + 1]), np.array(docs[first:last])
            lo = 0
            while lo < len(numbers):
                hi = min(len(numbers), max(lo + 1, int(np.searchsorted(at, at[lo] + STEP))))
                part = at[lo : hi + 1] - at[lo]
                data = ids[int(at[lo]) : int(at[hi])].astype("<u4").tobytes()
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((part * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
                null = first + np.arange(lo, hi) < shard["nulls"]
                columns = [pa.array(numbers[lo:hi], mask=null), pa.array(shard["token_base"] + at[lo:hi]), pa.array(np.diff(part)), blob]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                lo = hi


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids are little-endian unsigned 32-bit. A row holds 2 GB, so a document of
    2**29 ids or more can be read from the files only."""
    store, root = file_system(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.readall())
    shards = spark.createDataFrame([(s["name"], s["nulls"], s["token_base"], s["n_docs"]) for s in manifest["shards"]], "name string, nulls long, token_base long, n_docs long")
    parts = shards.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(PART_DOCS)).cast("array<long>")))
    kind, n = manifest["dtype"], sum(-(-s["n_docs"] // PART_DOCS) for s in manifest["shards"])
    return parts.repartition(max(1, n)).transform(arrow, lambda b: _read(b, folder, kind), "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
