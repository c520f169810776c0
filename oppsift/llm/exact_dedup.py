"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification.

Each partition puts the 64-bit fingerprints of its texts into a counting quotient filter. As quotient and remainder keep
all 64 bits, two filters merge without loss, run by run, by their sorted remainders; one with fewer quotients first hands
bits of its remainders over. Filters travel in compact form, cut by ranges of quotients; a merged range gives the
fingerprints counted more than once. Only texts with such a fingerprint are compared, byte for byte, by an aggregate that
combines copies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, written
from oppsift.llm.shared import SMALL_ROWS, arrow, small_side, text_or_empty

#: Runs of these become one space: the ASCII white space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


#: About so many fingerprints meet in a range of quotients, however many rows there are; and the fewest ranges.
RANGE, RANGES = 500_000, 16


class CountingQuotientFilter:
    """Values of ``width`` bits with counts. The top ``quotient_bits`` of a value are its quotient, the rest its remainder; the
    remainders of one quotient are a run, in ascending order, and runs lie in the order of their quotients."""

    def __init__(self, width: int, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.width, self.quotient_bits, self.runs, self.remainders, self.counts = width, quotient_bits, runs, remainders, counts

    @property
    def remainder_bits(self) -> int:
        return self.width - self.quotient_bits

    @classmethod
    def of(cls, values: np.ndarray, width: int = 64) -> CountingQuotientFilter:
        """Of values (uint64), each counted once; about as many quotients as values."""
        values, counts = np.unique(values, return_counts=True)
        bits = min(max(1, len(values).bit_length()), width - 1)
        quotients, remainders = _split(values, width - bits)
        return cls(width, bits, np.bincount(quotients, minlength=1 << bits), remainders, counts.astype(np.int64))

    def quotients(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.runs)), self.runs)

    def values(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.quotients()[some].astype(np.uint64) << np.uint64(self.remainder_bits) | self.remainders[some]

    def widened(self, quotient_bits: int) -> CountingQuotientFilter:
        """The same with more bits in the quotients: each remainder gives up its highest, which leaves the order as it is."""
        more = quotient_bits - self.quotient_bits
        if not more:
            return self
        high, remainders = _split(self.remainders, self.remainder_bits - more)
        return CountingQuotientFilter(self.width, quotient_bits, np.bincount((self.quotients() << more) + high, minlength=1 << quotient_bits), remainders, self.counts)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both runs of each quotient are merged by their sorted remainders; counts of equal ones add up. Nothing is lost,
        whatever the filters' sizes."""
        size = min(max(1, (len(self.remainders) + len(other.remainders)).bit_length()), self.width - 1)
        bits = max(size, self.quotient_bits, other.quotient_bits)
        a, b = self.widened(bits), other.widened(bits)
        quotients, starts = a.quotients(), np.cumsum(b.runs) - b.runs
        # the place of each of a's remainders in b's run of its quotient, by halving
        low, high = starts[quotients], starts[quotients] + b.runs[quotients]
        end = high.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at]) >> 1
            less = b.remainders[middle] < a.remainders[at]
            low[at[less]], high[at[~less]] = middle[less] + 1, middle[~less]
        same = low < end
        same[same] = b.remainders[low[same]] == a.remainders[same]
        counts = b.counts.copy()
        counts[low[same]] += a.counts[same]
        new = np.flatnonzero(~same)
        place, old = low[new] + np.arange(len(new)), np.ones(len(b.remainders) + len(new), np.bool_)
        old[place] = False
        out = [np.empty(len(old), x.dtype) for x in (b.remainders, counts)]
        for x, was, came in zip(out, (b.remainders, counts), (a.remainders, a.counts), strict=True):
            x[old], x[place] = was, came[new]
        return CountingQuotientFilter(self.width, bits, b.runs + np.bincount(quotients[new], minlength=len(b.runs)), *out)

    def pieces(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut by the top ``bits`` of its values, which the parts leave out; empty parts are not given."""
        wide = self.widened(max(self.quotient_bits, min(bits + 1, self.width - 1)))
        each = 1 << (wide.quotient_bits - bits)
        ends = np.concatenate([[0], np.cumsum(wide.runs)])
        for k in np.unique(wide.quotients() // each).tolist():
            lo, hi = ends[k * each], ends[(k + 1) * each]
            yield k, CountingQuotientFilter(wide.width - bits, wide.quotient_bits - bits, wide.runs[k * each : (k + 1) * each], wide.remainders[lo:hi], wide.counts[lo:hi])

    def bytes(self) -> bytes:
        """Compact: a bit for each quotient and value, the bytes that remainders need, and what counts exceed one."""
        n, unary = len(self.remainders), np.ones(len(self.runs) + len(self.remainders), np.uint8)
        unary[np.cumsum(self.runs) + np.arange(len(self.runs))] = 0  # a zero ends each run
        more, each = np.flatnonzero(self.counts > 1), -(-self.remainder_bits // 8)
        head = np.array([self.width, self.quotient_bits, n, len(more)], np.int64)
        short = self.remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :each]
        return b"".join(x.tobytes() for x in (head, more, self.counts[more], np.packbits(unary), short))

    @classmethod
    def read(cls, data: bytes) -> CountingQuotientFilter:
        width, bits, n, more = np.frombuffer(data, np.int64, 4).tolist()
        counts, at = np.ones(n, np.int64), 32 + 16 * more
        counts[np.frombuffer(data, np.int64, more, 32)] = np.frombuffer(data, np.int64, more, 32 + 8 * more)
        length = (1 << bits) + n
        unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-length // 8), at), count=length)
        zeros = np.flatnonzero(unary == 0)
        each, remainders = -(-(width - bits) // 8), np.zeros((n, 8), np.uint8)
        remainders[:, :each] = np.frombuffer(data, np.uint8, n * each, at + -(-length // 8)).reshape(n, each)
        return cls(width, bits, np.diff(zeros, prepend=-1) - 1, remainders.view("<u8")[:, 0].astype(np.uint64), counts)


def _split(values: np.ndarray, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (values >> np.uint64(low_bits)).astype(np.int64), values & np.uint64((1 << low_bits) - 1)


def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """All of them, merged two by two, so that each value is moved a logarithm of their number of times."""
    while len(filters) > 1:
        filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) & ~1 :]
    return filters[0]


def _filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One filter for each partition, or for each 4 million rows of it, cut into pieces."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        parts = [(k, f.bytes()) for k, f in CountingQuotientFilter.of(np.concatenate(held)).pieces(bits)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["part", "filter"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        rows += batch.num_rows
        if rows >= 4_000_000:
            yield out(held)
            held, rows = [], 0
    if rows:
        yield out(held)


def _repeated(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    whole = merged([CountingQuotientFilter.read(x) for x in group["filter"]])
    twice = np.flatnonzero(whole.counts > 1)
    top = np.uint64(int(group["part"].iloc[0])) << np.uint64(64 - bits)
    return pd.DataFrame({"fp": (whole.values(twice) | top).view(np.int64), "n": whole.counts[twice]})


def repeated_fingerprints(fingerprints: DataFrame, parts: int = RANGES) -> DataFrame:
    """(fp, n) of the values of the one long column that occur more than once. parts: into how many ranges filters are cut."""
    bits = max(1, min(24, (parts - 1).bit_length()))
    return fingerprints.transform(arrow, lambda b: _filters(b, bits), "part long, filter binary").groupBy("part").applyInPandas(lambda g: _repeated(g, bits), "fp long, n long")


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE_SPACE, " ")


def judged(docs: DataFrame, fingerprint: Column | None = None, limit: int = SMALL_ROWS) -> DataFrame:
    """What ``exact_dedup`` gives, with the xxhash64 of each text as text_hash, which tells rows of one doc_id apart."""
    fp = fingerprint if fingerprint is not None else F.xxhash64("norm")
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), normalised().alias("norm"))
    keys, n = measured(texts.select("doc_id", "text_hash", fp.alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "keys", n=F.count("*"))
    repeated = repeated_fingerprints(keys.select("fp"), max(RANGES, -(-n["n"] // RANGE)))
    twice, n = measured(repeated.select("fp"), "fingerprints", n=F.count("*"))
    copies = texts.withColumn("fp", fp).join(small_side(twice, n["n"], limit), "fp", "left_semi")
    groups = copies.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups, n = measured(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups", n=F.count("*"))
    out = keys.join(small_side(groups, n["n"], limit), "sha", "left").withColumn("grouped", F.col("group_size").isNotNull())
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    size, sha = F.coalesce("group_size", F.lit(1)), F.lower(F.hex("sha"))
    return out.select("doc_id", "text_hash", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), sha.alias("text_sha256"))


def exact_dedup(docs: DataFrame, fingerprint: Column | None = None, limit: int = SMALL_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after each run of ASCII white space has become one space; a null text is an empty
    one. The row with the smallest doc_id stays (a null id only if no row has one); rows that repeat an id with the same
    text share its result, and those that repeat it with other texts are judged each by its own. Empty tables give an empty
    result; other columns are ignored. fingerprint: a long Column of ``norm`` (tests give a weak one); limit: see ``small_side``.
    """
    return judged(docs, fingerprint, limit).drop("text_hash")
