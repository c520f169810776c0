"""Cross-tokenizer alignment against the libraries and a plain search for shared ends."""

import base64
import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oppsift.llm import queries, token_alignment

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Groups of a text, by the libraries: lists of ids on both sides."""
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(ranks[i] for i in x) == b"".join(map(piece, y)) == (" " + text).encode():
            return []
        out, i, j, p, q, left, right = [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if p <= q and i < len(x) and not (p == q and left):
                left.append(x[i])
                p += len(ranks[x[i]])
                i += 1
            else:
                right.append(y[j])
                q += len(piece(y[j]))
                j += 1
            if p == q and left and right:
                out.append((left, right))
                left, right = [], []
        return out

    return groups


def plain_counts(found):
    """The query's columns of (doc_id, groups) rows."""
    held = collections.Counter()
    for _, groups in found:
        held.update({(a, b) for x, y in groups for a in x for b in y})
    best = collections.Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for doc, groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if text else "",
            sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links),
        )


def test_query_on_the_table(spark, sf, plain):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in queries.op13(spark, sf).collect())
    assert got == sorted(plain_counts([(d, plain(t)) for d, t in texts]))
    assert sum(r[4] > r[3] for r in got) > 100


ODD = [
    (1, "The  quick\tbrown\n\n\nfox 12345 don't"), (2, None), (3, ""), (4, "a ▁ b"), (5, "<|endoftext|> <s> </s> <unk>"), (6, "日本語 é ² \U0001f600 \x00 "), (None, "no id, no id"), (None, None), (7, "word " * 20_000),
    (7, "word " * 20_000), (8, "x" * 40_000), (9, " "), (10, " leading"), (11, "é ﬁ ａ"), (12, " " * 999),
]


def test_odd_rows_in_small_blocks(spark, plain, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"block": F.lit("x"), "n_a": F.lit(1), "pairs": F.lit(0)})
    want = sorted(plain_counts([(d, plain(t)) for d, t in ODD]), key=str)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in token_alignment.alignment_counts(docs.repartition(3), BPE, PIECES).collect()]
    assert sorted(got, key=str) == want
    assert [w for w in want if w[0] in (2, 3, 4)] == [(d, 0, 0, 0, 0, "", 0, 0) for d in (2, 3, 4)]
    monkeypatch.setattr(token_alignment, "RANGE", 50)  # many ranges of hashes
    more = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in token_alignment.alignment_counts(docs.repartition(5), BPE, PIECES).collect()]
    assert sorted(more, key=str) == want
    assert token_alignment.alignment_counts(docs.limit(0), BPE, PIECES).count() == 0


def test_groups(spark, plain):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for r in token_alignment.align_tokens(docs, BPE, PIECES).where("doc_id in (1, 2, 4, 5, 6, 11)").collect():
        text = dict(ODD)[r["doc_id"]]
        assert [(g["a"], g["b"]) for g in r["groups"]] == plain(text)
        ends = [g["end"] for g in r["groups"]]
        assert [g["start"] for g in r["groups"]] == [0, *ends[:-1]][: len(ends)] and (not ends or ends[-1] == len((" " + text).encode()))


def test_numbers_travel_whole():
    import numpy as np

    x = np.array([0, 1, 2**31, 2**32 - 1])
    assert token_alignment.unpacked(token_alignment.packed(x)).tolist() == x.tolist() and token_alignment.unpacked(token_alignment.packed(x[:0])).tolist() == []
    y = np.array([0, 2**40 + 3, 5])
    assert token_alignment._of_long(token_alignment._long(y)).tolist() == y.tolist()
