"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the signed coordinate of greatest
magnitude is its cross-polytope vertex, and two vertices make a bucket. Each vector lies in its first bucket and in the
next-best ones (multiprobe), in each of several tables. Equal vectors are one class. Two classes are candidates where the
first bucket of one is among the buckets of the other; there they meet first with the signs of some rotated coordinates alone, 256
bits, which rule out what is far from similar. Only what is left meets with its vectors and is compared in double precision,
and each pair counts in the first bucket it shares only, so no list of pairs is made: a bucket gives counts of links and
a spanning forest. A bucket over ``block`` classes is split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, written
from oppsift.llm.segments import gather, mix, spread
from oppsift.llm.shared import arrow, runs, small_side
from oppsift.operators.components import connected_components, lowest_labels

TABLES, PROBES, ROUNDS, BLOCK = 10, 3, 3, 1024

#: Signs that are kept of a vector, and by how many standard errors of their number two vectors may differ in more of them
#: than vectors at the threshold do (a chance below one in 10**14).
SIGNS, ERRORS = 256, 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; their length is a power of two."""
    n, size, h = *x.shape, 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A pseudo-random rotation of the rows, zero-padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for k in range(rounds):
        signs = 1.0 - 2.0 * (spread(size, seed * 1009 + k) & np.uint64(1)).astype(np.float64)
        y = hadamard(y * signs) / np.sqrt(size)
    return y


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """The bucket numbers of each row: [row, table, probe], its own first, then the next likely ones."""
    out = np.empty((len(x), tables, probes), np.int32)
    for t in range(tables):
        vertex, loss = [], []
        for half in range(2):
            y = rotate(x, 2 * t + half + 1)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            top = np.take_along_axis(y, best, 1)
            vertex.append(2 * best + (top < 0))
            loss.append((np.abs(top[:, :1]) - np.abs(top)) ** 2)
        both = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(x), -1)
        first = np.argsort(both, axis=1, kind="stable")[:, :probes]
        width = vertex[0].shape[1]
        size = 2 << max(1, (x.shape[1] - 1).bit_length())
        out[:, t] = np.take_along_axis(vertex[0], first // width, 1) * size + np.take_along_axis(vertex[1], first % width, 1)
    return out


def signs(x: np.ndarray) -> np.ndarray:
    """SIGNS bits of each row in longs: the signs of rotated coordinates."""
    parts, size = [], 0
    while size < SIGNS:
        parts.append(rotate(x, 100_003 + len(parts)) > 0)
        size += parts[-1].shape[1]
    return np.packbits(np.concatenate(parts, axis=1)[:, :SIGNS], axis=1).view(np.uint64)


def most_different(threshold: float) -> float:
    """In how many signs two vectors at the threshold may differ."""
    p = float(np.arccos(np.clip(threshold, -1, 1))) / np.pi
    return SIGNS * p + ERRORS * np.sqrt(SIGNS * p * (1 - p))


def _vectors(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) with the embedding as bytes, null if it takes no part."""
    for batch in batches:
        lists = batch.column(2)
        n, data = len(lists), lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        offsets = lists.offsets.to_numpy().astype(np.int64)

        def count(some: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(some)])[offsets])

        size = np.diff(offsets)
        good = (size > 0) & (count(np.isfinite(data)) == size) & (count(data != 0) > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
        good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        width = np.where(good, size, 0)
        flat = gather(data, offsets[:-1], width).astype(kind).view(np.uint8)
        each = np.concatenate([[0], np.cumsum(width)]) * np.dtype(kind).itemsize
        bits = np.packbits(good, bitorder="little").tobytes()
        binary = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(bits), pa.py_buffer(each.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary], ["vec_id", "label", "vector"])


def _blob(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows[0].nbytes if len(rows) else 0
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _hashed(batches: Iterator[pa.RecordBatch], kind: str, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, signs, codes, buckets)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            batch = whole.slice(lo, 2048)
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors]) // np.dtype(kind).itemsize
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(vectors[k] for k in at.tolist()), kind).reshape(len(at), size).astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes, label = buckets(x, tables, probes), batch.column(1).to_numpy()[at].view(np.uint64)
                base = mix(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))
                table = np.arange(tables, dtype=np.uint64)[:, None]
                key = mix(base[:, None, None] + (codes.astype(np.uint64) * np.uint64(tables) + table + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                offsets = pa.array((np.arange(len(at) + 1) * tables * probes).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _blob(signs(x)), _blob(codes), lists], ["id", "signs", "codes", "buckets"])


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side 0: all pairs of the cell; sides 1 and 2: pairs of one with the other."""
    if (side != 0).any():
        return np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    return (np.arange(len(side)),) * 2


def _near(batches: Iterator[pa.RecordBatch], probes: int, most: float) -> Iterator[pa.RecordBatch]:
    """Of each cell (cell, side, slot, id, signs) the rows that some other one may be similar to."""
    for cell in runs(batches, "cell"):
        first, side = cell["slot"].to_numpy() % probes == 0, cell["side"].to_numpy()
        if cell.num_rows < 2 or not first.any():
            continue
        bits = np.frombuffer(b"".join(cell["signs"].to_pylist()), np.uint64).reshape(cell.num_rows, -1)
        left, right = _sides(side)
        near = np.zeros(cell.num_rows, np.bool_)
        for lo in range(0, len(left), 128):
            part = left[lo : lo + 128]
            different = np.zeros((len(part), len(right)), np.int64)
            for k in range(bits.shape[1]):
                different += np.bitwise_count(bits[part, k][:, None] ^ bits[right, k])
            pairs = (different <= most) & (first[part][:, None] | first[right]) & (part[:, None] != right)
            near[part] |= pairs.any(1)
            near[right] |= pairs.any(0)
        if near.any():
            yield cell.drop_columns(["signs"]).filter(pa.array(near)).combine_chunks().to_batches()[0]


FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch], kind: str, tables: int, probes: int, least: float) -> Iterator[pa.RecordBatch]:
    """For each cell: (u, null, links) of its classes and (u, v, null) that connect what is linked in it."""
    for cell in runs(batches, "cell"):
        slot, ids, weight = (cell[c].to_numpy() for c in ("slot", "id", "n"))
        x = np.frombuffer(b"".join(cell["vector"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        codes = np.frombuffer(b"".join(cell["codes"].to_pylist()), np.int32).reshape(len(ids), tables, probes)
        first, table = slot % probes == 0, int(slot[0]) // probes
        x = x / np.abs(x).max(1, keepdims=True)
        length = np.sqrt((x * x).sum(1))
        left, right = _sides(side := cell["side"].to_numpy())
        us, vs = [], []
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            cosine = (x[part] @ x[right].T) / (length[part][:, None] * length[right])
            i, j = np.nonzero((cosine >= least) & (first[part][:, None] | first[right]))
            keep = (side[part[i]] != 0) | (part[i] < right[j])
            us.append(part[i[keep]])
            vs.append(right[j[keep]])
        u, v = (np.concatenate([*k, np.empty(0, np.int64)]).astype(np.int64) for k in (us, vs))
        mine = np.ones(len(u), np.bool_)
        for t in range(table):
            mine &= ~((codes[u, t, :1] == codes[v, t]).any(1) | (codes[v, t, :1] == codes[u, t]).any(1))
        if not len(u):
            continue
        a, b, here = codes[u, table, 0], codes[v, table, 0], codes[u[0], table, int(slot[u[0]]) % probes]
        lower = np.where((codes[v, table] == a[:, None]).any(1), a, np.iinfo(np.int32).max)
        lower = np.minimum(lower, np.where((codes[u, table] == b[:, None]).any(1), b, np.iinfo(np.int32).max))
        mine &= lower == here
        u, v = u[mine], v[mine]
        if not len(u):
            continue
        links = np.bincount(u, weight[v], len(ids)) + np.bincount(v, weight[u], len(ids))
        some, root = np.flatnonzero(links), lowest_labels(len(ids), u, v)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        none = [None] * len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], ids[tied]])), pa.array([*none, *ids[root[tied]].tolist()], pa.int64()), pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(tied)], pa.int64())], schema=FOUND
        )


def _in_cells(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell")


def embedding_links(classes: DataFrame, kind: str, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(u, v, n): rows with n are parts of u's number of linked vectors; rows with v join two classes of one component.

    ``classes`` has id, label (long), vector (bytes of ``kind``) and n, how many vectors are equal to it; only those of one
    label and length are compared.
    """
    hashed = written(classes.select("id", "label", "vector").transform(arrow, lambda b: _hashed(b, kind, tables, probes), "id long, signs binary, codes binary, buckets array<long>"), "hashed")
    flat = hashed.select("id", "signs", F.posexplode("buckets").alias("slot", "bucket"))
    sizes = flat.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("slot") % probes == 0).alias("firsts")).where("n > 1 and firsts > 0").select("bucket", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # a class of block i meets block j in the cell (min, max); in the cell (i, i) its own block
    cells = flat.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    cells = cells.select("id", "signs", "slot", side.alias("side"), F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    most = most_different(threshold)
    near = written(_in_cells(cells).select("cell", "side", "slot", "id", "signs").transform(arrow, lambda b: _near(b, probes, most), "cell long, side int, slot int, id long"), "near")
    full = near.join(classes.select("id", "vector", "n"), "id").join(hashed.select("id", "codes"), "id")
    return _in_cells(full).transform(arrow, lambda b: _compare(b, kind, tables, probes, threshold), "u long, v long, n long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    A pair is linked if its cosine is ``threshold`` or more and some table brings it together (see ``embedding_links``);
    component_id is the smallest vec_id that links reach. Null ids, null labels, null, empty or zero vectors and those with
    null or non-finite components have no links and stay; a null vec_id has a null component. Rows that repeat a vec_id count
    each as a vector of its own and are judged each by its own embedding. An empty table gives an empty result; other
    columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label"), F.col("embedding").cast("array<double>" if kind == "<f8" else "array<float>").alias("embedding"))
    rows = rows.transform(arrow, lambda b: _vectors(b, kind), "vec_id long, label long, vector binary")
    keys = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "label", "vector")).alias(f"key_{k}") for k in range(2)]
    signed = written(rows.select("vec_id", *keys), "keys")
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.select("*", *keys, F.monotonically_increasing_id().alias("id")), "classes")
    found = written(embedding_links(classes, kind, threshold, tables, probes, block), "links")
    counts = found.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
    joined = connected_components(found.where("v is not null"), "u", "v").withColumnRenamed("node", "id")
    groups = classes.select("id", "least", "n", "key_0", "key_1").join(counts, "id", "left").join(joined, "id", "left").where("n > 1 or others is not null")
    groups = groups.withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "component").select("key_0", "key_1", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    groups, n = measured(groups, "groups", n=F.count("*"))
    out = signed.join(small_side(groups, n["n"]), ["key_0", "key_1"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
