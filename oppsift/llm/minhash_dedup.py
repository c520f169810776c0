"""Near-duplicate texts: b-bit MinHash over shingles of words.

One pass over the texts hashes the distinct shingles of each and keeps, for 128 permutations, the minima as 32 band keys of four
and their two low bits packed into four longs. Texts with equal shingle sets are one class, known by a number of its own. Of
classes that share a band, first each is paired with the band's first and last; pairs that the packed bits do not rule out are
confirmed on the full sets (of 64-bit shingle hashes), and links make components. Then, in bands that still hold several
components, blocks of their classes meet with their packed bits alone, and name the pairs of different components that
may be similar. Where these are few for the classes they join, pairs are confirmed one by one; where they are many, the full sets
of a block's classes meet and give a forest of the links found. So no pair of a band is left out unless both are joined
already, and large groups of copies cost rows in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, written
from oppsift.llm.segments import BYTE_VALUES, mix, span_hashes, spread, text_slices, word_spans
from oppsift.llm.shared import SMALL_ROWS, arrow, runs, small_side, text_or_empty
from oppsift.operators.components import connected_components

SHINGLE, PERMUTATIONS, BAND_ROWS, BITS = 5, 128, 4, 2

#: Pairs are confirmed on full sets if the similarity estimated from low bits is at least this: the threshold less over six
#: standard errors of the estimate.
ESTIMATE_MARGIN = 0.30

#: Classes of a band meet in blocks of so many. If a block has more likely pairs for each of its classes, their sets meet.
BLOCK, PAIRS_EACH = 256, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.bool_)
_WORD[[32, *range(9, 14)]] = False
_WEIGHTS = spread(SHINGLE * 16, 23) | np.uint64(1)


def shingles(column: pa.Array, words: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct 64-bit shingle hashes of each text) for some rows at a time.

    Shingles are of ``words`` words; a text with fewer words has one of all its words; one without words has none.
    """
    for first, end, data, offsets in text_slices(column):
        starts, ends, at = word_spans(_WORD[data], offsets)
        hashes = span_hashes(BYTE_VALUES[_LOWER[data]], starts, ends)
        every = hashes * _WEIGHTS[0]
        if len(hashes) >= words:
            every = sum(hashes[k : len(hashes) - words + 1 + k] * _WEIGHTS[k] for k in range(words))
        every = mix(every)
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= words:
                out.append(np.unique(every[lo : hi - words + 1]))
            elif hi > lo:
                out.append(mix((hashes[lo:hi] * _WEIGHTS[words + 1 : words + 1 + hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo)))
            else:
                out.append(np.empty(0, np.uint64))
        assert len(out) == end - first
        yield first, out


def minima(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """The minimum of each permutation for each of some non-empty sets: [set, permutation], 32-bit."""
    out = np.empty((len(sets), permutations), np.uint32)
    factor, add = (spread(permutations, s).astype(np.uint32) for s in (31, 37))
    factor |= np.uint32(1)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 1 << 15):
            size += len(sets[hi])
            hi += 1
        low = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo : hi - 1]])]).astype(np.int64)
        for k in range(permutations):
            x = low * factor[k] + add[k]
            x ^= x >> np.uint32(15)
            out[lo:hi, k] = np.minimum.reduceat(x, starts)
        lo = hi
    return out


def band_keys(low: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima, different between bands."""
    bands = low.reshape(len(low), low.shape[1] // rows, rows).astype(np.uint64)
    key = np.broadcast_to(spread(bands.shape[1], 41), bands.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + bands[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return key


def pack_bits(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed into longs."""
    shifts = (np.arange(64 // bits) * bits).astype(np.uint64)
    parts = (low & np.uint32((1 << bits) - 1)).reshape(len(low), low.shape[1] * bits // 64, 64 // bits).astype(np.uint64)
    return np.bitwise_or.reduce(parts << shifts, axis=2)


def estimate(a: str, b: str, permutations: int = PERMUTATIONS) -> Column:
    """The Jaccard similarity by the packed 2-bit minima in array columns a and b, corrected for equal bits by chance."""
    different = F.lit(0)
    for k in range(permutations * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        different = different + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return (1 - different / F.lit(float(permutations)) - chance) / (1 - chance)


def _long_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.uint64, copy=False).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bits", "bands"]
    for batch in batches:
        for first, sets in shingles(batch.column(2), words):
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            low = minima([sets[k] for k in full])
            bits, bands = ([np.empty(0, np.uint64)] * len(sets) for _ in range(2))
            for k, x, y in zip(full.tolist(), pack_bits(low), band_keys(low), strict=True):
                bits[k], bands[k] = x, y
            a = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            row = [batch.column(k).slice(first, len(sets)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*row, pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _long_lists(bits), _long_lists(bands)], names)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in shingles(batch.column(1), words):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), _long_lists(sets)], ["id", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"id": "v", "shingles": "right"}), "v").join(sets.withColumnsRenamed({"id": "u", "shingles": "left"}), "u")
    both = both.withColumn("common", F.size(F.array_intersect("left", "right")))
    union = F.size("left") + F.size("right") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("u", "v")


def common_counts(sets: list[np.ndarray], rows: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
    """[row, set]: how many items the sets (sorted, as unsigned) of ``rows`` share with every set; about so many items at once."""
    out, width = np.zeros((len(rows), len(sets)), np.float32), 2048
    parts = -(-sum(map(len, sets)) // at_once)
    bounds = np.array([k * (2**64 - 1) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for k in range(parts):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        flat, owner = np.concatenate(some), np.repeat(np.arange(len(some), dtype=np.int32), [len(x) for x in some])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, np.bool_)
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1 if len(flat) else np.empty(0, np.bool_)
        keep = shared[column]
        owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            out += part[rows] @ part.T
    return out


def _meets(mine: np.ndarray, side: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """[row, class]: of different components, and of different blocks unless the cell is one block's own."""
    return (mine[rows][:, None] != mine) & ((side[rows][:, None] == 0) | (side[rows][:, None] != side))


CANDIDATES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cell", pa.int64()), ("side", pa.int32()), ("mine", pa.int64())])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each cell (cell, side, id, mine, bits): the pairs (u, v) that may be similar; of cells with many, the classes (u, cell,
    side, mine) that have a part in any."""
    chance, width = 0.5**BITS, PERMUTATIONS * BITS // 64
    for cell in runs(batches, "cell"):
        ids, mine, side = (cell[c].to_numpy() for c in ("id", "mine", "side"))
        bits = cell["bits"].combine_chunks().values.to_numpy().view(np.uint64).reshape(len(ids), width)
        us, vs = [], []
        for lo in range(0, len(ids), 128):
            rows = np.arange(lo, min(lo + 128, len(ids)))
            different = np.zeros((len(rows), len(ids)), np.int64)
            for k in range(width):
                x = bits[rows, k][:, None] ^ bits[:, k]
                different += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
            similar = (1 - different / PERMUTATIONS - chance) / (1 - chance) >= least
            i, j = np.nonzero(similar & _meets(mine, side, rows))
            us.append(rows[i])
            vs.append(j)
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = np.minimum(u, v), np.maximum(u, v)
        u, v = np.unique(np.stack([u, v]), axis=1) if len(u) else (u, v)
        part = np.unique(np.concatenate([u, v]))
        none = lambda n, t: pa.nulls(n, t)
        if len(u) <= PAIRS_EACH * len(part):
            if len(u):
                a, b = np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(u), pa.int64()), none(len(u), pa.int32()), none(len(u), pa.int64())], schema=CANDIDATES)
        else:
            key = pa.array(np.full(len(part), cell["cell"][0].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), none(len(part), pa.int64()), key, pa.array(side[part].astype(np.int32)), pa.array(mine[part])], schema=CANDIDATES)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each cell (id, component, side, shingles): pairs (u, v) of a forest of the links between its components."""
    for cell in runs(batches, "cell"):
        ids, mine, side = (cell[c].to_numpy() for c in ("id", "mine", "side"))
        lists = cell["shingles"].combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sets = [flat[lo:hi] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        size = np.diff(offsets)
        names, member, count = np.unique(mine, return_inverse=True, return_counts=True)
        root = np.arange(len(names))
        outside = np.flatnonzero(member != count.argmax())
        found: list[tuple[int, int]] = []
        for lo in range(0, len(outside), BLOCK):
            rows = outside[lo : lo + BLOCK]
            common = common_counts(sets, rows)
            similar = 100 * common >= percent * (size[rows][:, None] + size - common)
            for i, j in zip(*(x.tolist() for x in np.nonzero(similar & _meets(mine, side, rows))), strict=True):
                a, b = root[member[rows[i]]], root[member[j]]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    found.append((int(ids[rows[i]]), int(ids[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])


def _cells(marked: DataFrame) -> DataFrame:
    """The classes of bands (band, n, id, mine, bits) in cells, so that every two classes of a band meet in one."""
    rows = marked.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), side.alias("side"), "id", "mine", "bits")
    return rows.repartition("cell").sortWithinPartitions("cell")


def judged(docs: DataFrame, percent: int = 75, words: int = SHINGLE, limit: int = SMALL_ROWS) -> DataFrame:
    """What ``minhash_dedup`` gives, with the xxhash64 of each text as text_hash, which tells rows of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    shape = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bits array<long>, bands array<long>"
    signed = written(texts.transform(arrow, lambda b: _sign(b, words), shape), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same)
    classes = classes.agg(F.min(F.struct("doc_id", "text_hash")).alias("doc"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = written(classes.select("doc.*", *same, "bits", "bands", "n", F.monotonically_increasing_id().alias("id")), "classes")
    bits = classes.select("id", "bits")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        """(id, shingles) of some classes, from the text of one row of each."""
        wanted, n = measured(classes.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "text_hash"), f"wanted-{name}", n=F.count("*"))
        some = texts.join(small_side(wanted, n["n"], limit), ["doc_id", "text_hash"]).select("id", "text")
        return written(some.transform(arrow, lambda b: _sets(b, words), "id long, shingles array<long>").dropDuplicates(["id"]), f"sets-{name}")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("id"))

    # bands of one class alone are the most: leave them behind
    banded = classes.select("id", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    members = written(banded.join(heads, "band"), "bands")
    pairs = members.select("id", F.explode(F.array("first", "last")).alias("head")).where("id != head").select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v")).distinct()
    pairs = pairs.join(bits.withColumnsRenamed({"id": "v", "bits": "right"}), "v").join(bits.withColumnsRenamed({"id": "u", "bits": "left"}), "u")
    pairs = written(pairs.where(estimate("left", "right") >= percent / 100 - ESTIMATE_MARGIN).select("u", "v"), "pairs")
    links = written(_confirmed(pairs, sets_of(ends(pairs), "pairs"), percent), "links")
    labels, n = measured(connected_components(links, "u", "v").withColumnRenamed("node", "id"), "labels", n=F.count("*"))
    # what was tried with a band's first and last is behind; left are bands with others of several components
    marked = members.where("id not in (first, last)").join(small_side(labels, n["n"], limit), "id", "left").select("band", "id", F.coalesce("component", "id").alias("mine"))
    mixed = marked.groupBy("band").agg(F.min("mine").alias("low"), F.max("mine").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("all")).where("low != high")
    # bands of the same classes need one look
    mixed = mixed.groupBy("n", "all").agg(F.min("band").alias("band")).select("band", "n")
    found = written(_cells(marked.join(mixed, "band").join(bits, "id")).transform(arrow, lambda b: _likely(b, percent / 100 - ESTIMATE_MARGIN), "u long, v long, cell long, side int, mine long"), "found")
    pairs, cells = found.where("cell is null").select("u", "v").distinct(), found.where("cell is not null").withColumnRenamed("u", "id").drop("v")
    sets = sets_of(ends(pairs).unionByName(cells.select("id")), "found")
    forest = cells.join(sets, "id").repartition("cell").sortWithinPartitions("cell").transform(arrow, lambda b: _linked(b, percent), "u long, v long")
    forest = written(forest, "forest")  # two Python steps in one task would need two workers at once
    links = labels.where("id != component").select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(_confirmed(pairs, sets, percent)).unionByName(forest)
    joined = connected_components(links, "u", "v").withColumnRenamed("node", "id")
    groups = classes.select(*same, "id", "doc_id", "n").join(joined, "id", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups, n = measured(groups.join(least, "component").select(*same, "component_id"), "groups", n=F.count("*"))
    out = signed.select("doc_id", "text_hash", *same).join(small_side(groups, n["n"], limit), same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def minhash_dedup(docs: DataFrame, percent: int = 75, words: int = SHINGLE, limit: int = SMALL_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and parted by ASCII white space. Texts are linked if 100 * intersection of their sets of
    shingles is ``percent`` * union or more; component_id is the smallest doc_id that links reach. Texts without words
    and rows with a null doc_id link with nothing and stay (a null id has a null component). Rows that repeat a doc_id with
    other texts are judged each by its own text, in any order of rows. Empty tables give an empty result; other columns are
    ignored.

    A pair of similarity 0.75 shares no band with a chance of 5 in a million, and more similar pairs less.
    """
    return judged(docs, percent, words, limit).drop("text_hash")
