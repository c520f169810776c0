"""Repeated passages against a plain search with a dictionary of all windows."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oppsift.llm import queries, suffix_dedup


def plain(rows, length):
    """(doc_id, bytes, spans, kept) of (doc_id, text) rows; of one doc_id, different texts come by their SHA-256."""
    order = sorted({(d is None, d or 0, hashlib.sha256((t or "").encode()).digest(), (t or "").encode()) for d, t in rows})
    seen, out = set(), {}
    for none, d, _, t in order:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(t[s : s + length])
        edge = [i for i in range(len(t) + 1) if (i > 0 and gone[i - 1]) != (i < len(t) and gone[i])]
        out[None if none else d, t] = (list(zip(edge[::2], edge[1::2], strict=True)), bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return sorted(((d, len((t or "").encode()), *out[d, (t or "").encode()]) for d, t in rows), key=str)


def found(docs, length):
    rows = suffix_dedup.suffix_dedup(docs, length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in rows), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3_000)
    monkeypatch.setattr(suffix_dedup, "KEYS", 40)
    monkeypatch.setattr(suffix_dedup, "STEP", 1_000)


def test_query_on_the_table(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted((d, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in plain(texts, 100))
    assert sum(r[2] > 0 for r in got) > 10


@pytest.mark.parametrize("seed", range(4))
def test_many_blocks_and_ranges(spark, small, seed):
    """Texts put together from passages, with edits, so that windows are shared in part, backwards and forwards."""
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcde \0é") for _ in range(rnd.randint(5, 60))) for _ in range(12)] + ["ab" * 30, "\0" * 40, "x" * 50]
    rows = []
    for k in range(120):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        if text and rnd.random() < 0.6:
            i = rnd.randrange(len(text))
            text = text[:i] + rnd.choice(["", "q", "\0", "zz"]) + text[i + rnd.randint(0, 2) :]
        rows.append((rnd.randrange(100) if k % 10 else None, text))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length in (2, 7, 20, 100):
        assert found(docs, length) == plain(rows, length)


def test_a_hot_passage_between_ranges(spark, small):
    """All texts share a passage and differ around it, so its keys fill many ranges."""
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(90))
    rows = [(k, "".join(rnd.choice("ijklmnop") for _ in range(rnd.randint(0, 30))) + passage[rnd.randint(0, 9) : 90 - rnd.randint(0, 9)] + "".join(rnd.choice("ijklmnop") for _ in range(rnd.randint(0, 30)))) for k in range(400)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 40) == plain(rows, 40)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 99), (None, "b" * 150), (None, None), (4, "b" * 150), (4, "b" * 150), (4, "é" * 120), (5, "long " * 30_000), (6, "long " * 50), (7, "c" * 99), (8, "c" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("x"), "sha": F.lit(1), "kept": F.lit(0), "spans": F.lit(0), "first": F.lit(2)})
    assert found(docs, 100) == plain(rows, 100)
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    assert found(docs.where("doc_id in (1, 2, 3)"), 100) == plain(rows[:3], 100)
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, 1)


def test_copies_without_a_broadcast(spark):
    rows = [(k, "the same text in many rows, long enough to be a passage of its own " * 2) for k in range(50)] + [(99, "another text that stands for itself alone, in one row only, but long enough for a passage" * 2)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit=0).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in got), key=str) == plain(rows, 100)


@pytest.mark.parametrize("count", [1, 2, 3, 7, 16])
def test_loser_tree(count):
    rnd = random.Random(count)
    runs = []
    for _ in range(count):
        strings = sorted(bytes(rnd.choice(b"ab\0") for _ in range(6)) for _ in range(rnd.randint(0 if count > 1 else 1, 40)))
        runs.append((strings, [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(strings, strings[1:], strict=False)] if strings else []))
    order, shares = suffix_dedup.merged(runs, 6)
    at = [0] * count
    out = []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(s for r in runs for s in r[0])
    assert shares[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:], strict=False)]


def test_front_coding():
    keys = np.array([list(b"aaaa"), list(b"aaab"), list(b"aaab"), list(b"ab\0\0"), list(b"b\0\0\0")], np.uint8)
    assert suffix_dedup.decoded(*suffix_dedup.front_coded(keys), 4) == [bytes(k) for k in keys.tolist()]
