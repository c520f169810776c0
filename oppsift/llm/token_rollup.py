"""Token counts by source, language and tokenizer version, maintained by deltas.

Changes carry a sign: an inserted document adds itself and its tokens, a deleted one takes them away, a revised count
takes the old count away and adds the new one. A batch of changes is summed up by key, which gives a delta of a few rows, and
added to the totals; new totals and the numbers of all batches in them are published as one version. A batch that is in
already is passed over, so that it may be sent again after a failure, and of two writers the later one adds to what
the other has published. Reading the totals costs what they hold, however many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.llm.bpe import cached_bpe
from oppsift.llm.shared import arrow, text_or_empty
from oppsift.manifests import Manifests, Taken

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = cached_bpe(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            counts = bpe.encode(part.column("text").to_pylist())[1]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(counts)], ["doc_id", "source", "lang", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer (``version``) and n_tokens of every whole text; a null text has none.

    Repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text_or_empty().alias("text"))
    counted = rows.transform(arrow, lambda b: _counted(b, tokenizer), "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(version))


def word_counts(docs: DataFrame, version: str = "words") -> DataFrame:
    """The same by the words that ASCII white space parts, also of repeated rows and empty tables."""
    n = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", n.alias("n_tokens"), F.lit(version).alias("tokenizer"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of documents whose counts were ``before`` and are ``after``: as many documents, other tokens (and perhaps other keys)."""
    return deletes(before).unionByName(inserts(after))


def _with(batches: list[list[int]], batch: int) -> list[list[int]]:
    """Ranges [first, last] of numbers, and one more number."""
    out: list[list[int]] = []
    for lo, hi in sorted([*batches, [batch, batch]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class TokenRollup:
    """A rollup in a folder that all executors reach (a URI)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Manifests(spark, folder)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commits signed changes (KEY, n_docs, n_tokens) as one batch; False if that number is committed already.

        Null counts add nothing; a null key is a key; repeated rows count each; an empty batch is committed too. What an attempt
        left that ended before it was published counts for nothing.
        """
        number, version = self.versions.latest()
        if self._has(version, batch):
            return False
        delta = f"{self.folder}/delta-{uuid.uuid4().hex}"
        self._sums(changes).write.parquet(delta)
        while not self._has(version, batch):
            totals = f"totals-{uuid.uuid4().hex}"
            added = self._sums(self._read(version).unionByName(self.spark.read.schema(DELTA).parquet(delta)))
            added.where("n_docs != 0 or n_tokens != 0").coalesce(1).write.parquet(f"{self.folder}/{totals}")
            try:
                self.versions.publish(number + 1, {"totals": totals, "batches": _with(version.get("batches", []), batch)})
            except Taken:  # another batch came first: add to its totals
                self.versions.remove(totals)
                number, version = self.versions.latest()
                continue
            # those who still read the last version may do so
            if before := self.versions.read(number - 1):
                self.versions.remove(before["totals"])
            break
        else:
            return False
        self.versions.remove(delta.rpartition("/")[2])
        return True

    def _sums(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(*KEY).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens")))

    def _has(self, version: dict, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi in version.get("batches", []))

    def _read(self, version: dict) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(f"{self.folder}/{version['totals']}")

    def batches(self) -> list[int]:
        return [k for lo, hi in self.versions.latest()[1].get("batches", []) for k in range(lo, hi + 1)]

    def totals(self) -> DataFrame:
        """KEY, n_docs and n_tokens over all committed batches; keys without documents and tokens are left out."""
        return self._read(self.versions.latest()[1])
