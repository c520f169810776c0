"""Queries on their whole table against plain versions, and odd rows that other tests leave out."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oppsift.llm import chat_format, exact_dedup, queries, sentencepiece_bpe, url_filter

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    """By the library itself."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op5_on_the_table(spark, sf, ids):
    start, want = 0, []
    for d in sorted(ids):
        own = [*ids[d], 0]
        want.append((d, start, len(own), crc(own)))
        start += len(own)
    assert sorted(tuple(r) for r in queries.op5(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op10_on_the_table(spark, sf, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op10(spark, sf).collect():
        own = [*ids[r["doc_id"]], 1]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        own.sort()
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) == len(ids[d]) + 1
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= 2048
    used = sum(len(x) + 1 for x in ids.values())
    assert len(sequences) * 2048 - used < 2048 * spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()


def test_op7_on_the_table(spark, sf, texts):
    """The pieces are of the vocabulary, and the library gives every text back from them."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = {r["doc_id"]: bytes(r["pieces"]) for r in sentencepiece_bpe.encode_pieces(docs, PIECES, seed=1).collect()}
    for r in queries.op7(spark, sf).collect():
        own = np.frombuffer(pieces[r["doc_id"]], "<i4").tolist()
        assert (r["n_pieces"], r["pieces_crc32"]) == (len(own), zlib.crc32(pieces[r["doc_id"]]))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert model.decode(own) == texts[r["doc_id"]] or "▁" in texts[r["doc_id"]]
    assert pieces.keys() == texts.keys()


def test_pieces_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert sentencepiece_bpe.decode_pieces(sentencepiece_bpe.encode_pieces(docs, PIECES), PIECES).count() == 0


def test_chats_of_repeated_rows_and_long_texts(spark):
    long = "</s>[INST] " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_conversations(turns)).collect()}
    said = [("user", long), ("assistant", long)]
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(long)
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[2]["n_turns"] == 4 and got[2]["loss_chars"] == 2, "each row is a turn"


def test_urls_that_repeat_or_are_very_long(spark):
    long = "https://Sub.Example.COM/en/" + "p" * 200_000 + "?q"
    rows = [(1, long), (2, "http://a.net/es/x"), (2, "http://a.net/es/x")]
    got = sorted(tuple(r) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", F.length("path").alias("n"), "rule", "verdict").collect())
    assert got == [(1, "sub.example.com", 200_004, "example.com/en/", "block"), (2, "a.net", 5, "net/es/", "block"), (2, "a.net", 5, "net/es/", "block")]


def test_exact_ranges_follow_the_rows(spark, monkeypatch):
    """How many fingerprints meet in a range doesn't depend on the session's number of partitions."""
    seen, whole = [], exact_dedup.repeated_fingerprints
    monkeypatch.setattr(exact_dedup, "RANGE", 5)
    monkeypatch.setattr(exact_dedup, "repeated_fingerprints", lambda f, parts=None: seen.append(parts) or whole(f, parts))
    docs = spark.createDataFrame([(k, f"text {k % 150}") for k in range(400)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert seen == [80] and sum(r["kept"] for r in rows) == 150 and all(r["keep_id"] == r["doc_id"] % 150 for r in rows)
