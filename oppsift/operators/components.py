"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, removed, written

#: Edges that a task contracts at once.
AT_ONCE = 1_000_000


def lowest_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of n numbered nodes the smallest that the edges reach."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a task, a million at a time, a star for each component: the same nodes hang together."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([c.chunk(0) for c in table.columns]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        root = lowest_labels(len(order), at[: table.num_rows], at[table.num_rows :])
        nodes, some = ends.dictionary.take(pa.array(order)), np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(root[some]))], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= AT_ONCE:
            yield stars(held)
            held, rows = [], 0
    if held:
        yield stars(held)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node that can be reached.

    Each task first contracts the edges it has to stars; then come large-star and small-star steps (Kiveris et al., 2014) by
    joins and aggregates that combine before the shuffle. A hub's edges meet under one join key, which adaptive execution
    splits. Each round is written to the shared folder, which also tells whether it changed anything. Edges with a null
    end and loops count for nothing.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rows = {"n": F.count("*"), "sum": F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))}
    pairs, before = measured(pairs.mapInArrow(_contract, pairs.schema).distinct(), "edges", **rows)
    for _ in range(rounds if before["n"] else 0):
        both = _both(pairs)
        lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = _lowest(large)
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        last, (pairs, now) = pairs, measured(small.distinct(), "edges", **rows)
        removed(last)
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merge_components(labels: DataFrame, edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of the nodes whose component the new ``edges`` change, and of those that are new: what is to be put in
    the place of their rows in ``labels`` (node, component: the stored result of ``connected_components``, each node once).

    Each end stands for its stored component, so the new edges make a graph of the components that they touch, which is all that
    is searched; of the stored labels only those of components that get another smallest node are read out. The result is
    as from all edges together. Edges with a null end count for nothing; a loop makes no node.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    known = labels.select(F.col("node").alias("known"), F.col("component").alias("of"))
    for side in ("a", "b"):
        ends = ends.join(known, F.col(side) == F.col("known"), "left").withColumn(f"{side}_of", F.coalesce("of", side)).withColumn(f"{side}_new", F.col("of").isNull()).drop("known", "of")
    ends = written(ends, "ends")
    lowest = connected_components(ends.where("a_of <> b_of").select("a_of", "b_of").distinct(), "a_of", "b_of")
    lowest = written(lowest.select(F.col("node").alias("of"), F.col("component").alias("lowest")), "lowest")
    moved = labels.join(lowest.where("of <> lowest"), F.col("component") == F.col("of")).select("node", F.col("lowest").alias("component"))
    fresh = ends.where("a_new").select(F.col("a").alias("node")).unionByName(ends.where("b_new").select(F.col("b").alias("node"))).distinct()
    fresh = fresh.join(lowest, F.col("node") == F.col("of"), "left").select("node", F.coalesce("lowest", "node").alias("component"))
    return moved.unionByName(fresh)


def relabelled(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """labels with the rows of ``changes`` in place of their own."""
    return labels.join(changes.select("node"), "node", "left_anti").select("node", "component").unionByName(changes.select("node", "component"))
