"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.checkpoints import shared_folder, written
from oppsift.llm import chat_format, embedding_dedup, exact_dedup, minhash_dedup, packing, periodic_runs, sentencepiece_bpe, suffix_dedup, token_alignment, token_files, token_rollup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(toxicity.remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(written(chat_format.format_conversations(turns.unionByName(own)), "formatted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer(), folder, end_id=0)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after four batches: all documents by both tokenizers; the first again, which changes nothing; documents
    in English leave the count of words; and those of src0 are counted again without their capital letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    pieces, words = token_rollup.token_counts(docs, tokenizer(), "byte_bpe_50k"), token_rollup.word_counts(docs)
    first = token_rollup.inserts(pieces.unionByName(words))
    rollup.apply(1, first)
    rollup.apply(1, first)
    rollup.apply(2, token_rollup.deletes(words.where("lang = 'en'")))
    lower = docs.where("source = 'src0'").withColumn("text", F.lower("text"))
    rollup.apply(3, token_rollup.revisions(pieces.where("source = 'src0'"), token_rollup.token_counts(lower, tokenizer(), "byte_bpe_50k")))
    return rollup.totals()


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_bpe.encode_pieces(table(spark, sf_dir, "documents"), model, seed=1)
    decoded = sentencepiece_bpe.decode_pieces(encoded, model)
    return decoded.select("doc_id", "n_pieces", F.crc32("pieces").alias("pieces_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11: in about a tenth of the documents, told by their ids, a period is repeated from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), least=24, times=3, change=planted)
    # exact comparison of length / period
    best = F.expr(
        "element_at(array_sort(runs, (a, b) -> CASE WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)"
        " WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) WHEN a.period <> b.period THEN IF(a.period < b.period, -1, 1) ELSE 0 END), 1)"
    )
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1,
        "op2_embedding_dedup": op2,
        "op3_exact_dedup": op3,
        "op4_chat_format": op4,
        "op5_token_files": op5,
        "op6_token_rollup": op6,
        "op7_sentencepiece": op7,
        "op8_minhash_dedup": op8,
        "op9_url_filter": op9,
        "op10_packing": op10,
        "op11_periodic_runs": op11,
        "op12_suffix_dedup": op12,
        "op13_token_alignment": op13,
    }


#: The same rows by DuckDB.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


#: No two vectors of a label are left out: all pairs, with the links' components.
ORACLE_SQL["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept FROM embeddings
LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u) USING (vec_id) LEFT JOIN (SELECT u AS vec_id, min(v) AS low FROM reach GROUP BY u) USING (vec_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL["op8_minhash_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM s LEFT JOIN (SELECT u AS doc_id, min(v) AS low FROM reach GROUP BY u) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op4_chat_format": chat_format.oracle_sql(), "op9_url_filter": url_filter.oracle_sql()}
