"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.checkpoints import shared_folder, written
from oppsift.llm import exact_dedup, minhash_dedup
from oppsift.llm.packing import pack_documents
from oppsift.llm.queries import table, tokenizer
from oppsift.llm.shared import without
from oppsift.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of ``labels`` finds toxic go. A null text counts as an empty one, which stays, as rows without an id and
    repeated rows are judged by their texts alike; an empty table stays empty; a column named score or predicted holds the model's."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def _kept(docs: DataFrame, judged: DataFrame, name: str) -> DataFrame:
    """docs without the rows that are not kept, told apart by doc_id and text: rows that repeat both share one fate."""
    return without(docs, written(judged.where("not kept and doc_id is not null").select("doc_id", "text_hash").distinct(), name))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the rows with the smallest doc_id stay, each of them if several have that id; rows without an id stay."""
    return _kept(docs, exact_dedup.judged(docs), "exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; rows without an id stay."""
    return _kept(docs, minhash_dedup.judged(docs), "near")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, in sequences of 2048. A null or empty text has its end id alone, repeated rows are packed each, a
    null doc_id stays null, an empty table has no pieces; other columns are not read."""
    pieces = pack_documents(docs, tokenizer(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("packing", packing),
]

#: The first stage's model and the last one's tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    shared_folder(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
