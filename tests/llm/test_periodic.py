"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oppsift.llm import periodic_runs, queries


def plain_runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            x = w[s : i + q]
            if len(x) >= max(least, times * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rnd, texts = random.Random(seed), []
    for _ in range(rnd.randint(1, 9)):
        n, k = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 5])
        t = [rnd.randrange(k) for _ in range(n)]
        if n > 4 and rnd.random() < 0.5:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 6)
            t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
        texts.append(t)
    for least, times in ((24, 3), (6, 3), (2, 2)):
        got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]), least, times)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, least, times)]


def test_fibonacci_words_and_long_keys(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, [0] * 300, [0, 1] * 200 + [2] + [0, 1] * 200):
        got = periodic_runs.find_runs(np.array(words), np.array([len(words)]), 6, 2)
        assert list(zip(*(x.tolist() for x in got[1:]), strict=True)) == plain_runs(words, 6, 2)


def test_query_on_the_table(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, w0 = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [w0[i] if i < a else w0[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(w, 24, 3), got[doc]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, runs)).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (None, "no id"), (4, "ab " * 500), (4, "ab " * 500), (5, "x" * 300_000), (6, ("a b c " * 10_000) + "é ü"), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("x"), "start": F.lit(0)})
    got = sorted(((r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic_runs.collapse_runs(docs).collect())
    assert got == [
        (0, 2, [], "no id"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 500, [(0, 500, 1)], "ab"), (4, 500, [(0, 500, 1)], "ab"), (5, 1, [], "x" * 300_000),
        (6, 30_001, [(0, 30_000, 3)], "a b c é ü"), (7, 2, [], "one two"),
    ]
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_texts_beyond_a_step(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "p q r s " * (10 * k)) for k in range(20)], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, periodic_runs.collapse_runs(docs).collect()))
    batches = docs.toArrow().to_batches()
    monkeypatch.setattr(periodic_runs, "STEP", 100)
    parts = list(periodic_runs._split(iter(batches), None, 24, 3))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == len(want)
    assert [r["runs"] for p in parts for r in p.to_pylist()] == [[{"start": 0, "length": 40 * k, "period": 4}] if k else [] for k in range(20)]
