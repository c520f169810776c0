"""Column functions, each against values worked out by hand or by plain Python."""

import html
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oppsift.functions import lexicon as L
from oppsift.functions import scalars as S
from oppsift.functions import similarity
from oppsift.functions import text as T
from oppsift.functions import urls as U
from oppsift.functions.similarity import common_length, token_set_ratio


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_counter(spark):
    got = values(spark, S.counter, ["1200", "1,234", "1.2K", "3M", "", None, "N/A", "many", "-5", "9" * 30])
    assert got == [1200, 1234, 1200, 3_000_000, None, None, None, None, None, 10**15]
    assert values(spark, S.counter_of_number, [1.9, -2.5, float("nan"), float("inf")], "double") == [1, -2, None, None]


def test_dates(spark):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    assert values(spark, lambda v: iso(S.mail_date(v)), ["Wed Sep 02 19:33:47 +0000 2026", "junk", None]) == ["2026-09-02 19:33:47", None, None]
    assert values(spark, lambda v: iso(S.epoch_date(v)), ["1700000000", "x", "1e300"]) == ["2023-11-14 22:13:20", None, None]
    assert values(spark, lambda v: iso(S.parts_date(v)), [[2024, 5, 6, 7, 8, 9, 0], [2024, 13, 1, 0, 0, 0], [1]], "array<int>") == ["2024-05-06 07:08:09", None, None]
    since = values(spark, lambda v: S.hours_since(S.iso_date(v), F.lit("2024-01-02").cast("timestamp")), ["2024-01-01T00:00:00Z", "2025-01-01", "bad", None])
    assert since == [24.0, 0.0, 999.0, 999.0]


def test_clean_and_dedup_text(spark):
    rows = ["  a&amp;b   c ", "ﬁx ①", None, "Hi @bob see https://x.y/z, OK!", "é̀ ü"]
    got = values(spark, T.clean_text, rows)
    assert got == [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(r or ""))).strip() for r in rows]
    assert values(spark, lambda v: T.dedup_text(T.clean_text(v)), ["Hi @bob see https://x.y/z, OK! Ünder_1", "https://only.link"]) == ["hi see ok ünder_1", ""]
    assert values(spark, T.strip_tags, ["<p>a</p>", None]) == [" a ", ""]


def test_shingles_and_similarity(spark):
    assert values(spark, T.shingles, ["a b c d", "a b", "", "a b c a b c"]) == [["a b c", "b c d"], ["a b"], [], ["a b c", "b c a", "c a b"]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 0.0]
    same = df.select(T.signature_similarity(T.minhash(F.col("x")), T.minhash(F.col("x")))).collect()
    assert [r[0] for r in same] == [1.0, 0.0]


def test_entities(spark):
    got = values(spark, T.entities, ["Win $ 500 or 20 USDC with Orbit Labs now #Free_1 ABC", "", None])
    assert got == [["#free_1", "$500", "20usdc", "orbit labs", "usdc"], [], []]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_common_length(a, b):
    assert common_length(a, b) == slow_common(a, b)
    assert token_set_ratio(a, b) == pytest.approx(token_set_ratio(b, a))
    assert 0 <= token_set_ratio(a, b) <= 100


def test_token_set_ratio():
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert token_set_ratio("", "a") == token_set_ratio(None, "a") == 0
    assert token_set_ratio("new york mets", "new york yankees") == pytest.approx(100 * (1 - 5 / 21))


def test_urls(spark):
    got = values(spark, U.canonical_url, ["HTTPS://Ex.org:443/A?utm_source=f&b=1&ref=x#top", "http://a.b/c?ref=1", "http://a.b/c", "", None])
    assert got == ["https://ex.org/A?b=1", "http://a.b/c", "http://a.b/c", None, None]
    assert values(spark, U.is_social, ["https://x.com/a", "https://m.youtube.com/", "https://netflix.com/"]) == [True, True, False]


def test_lexicon(spark):
    text = ["Rewards and prizes, sign up before the deadline, hackathon", "the Senate race and an election", "plain", ""]
    got = values(spark, lambda v: L.relevance_score(L.positive_reasons(v), L.off_topic_reasons(v)), text)
    assert got == [pytest.approx(x) for x in (0.92, 0.0, 0.12, 0.12)]
    risky = values(spark, lambda v: L.risk_total(L.risk_reasons(v)), ["enter your seed phrase", "submit your wallet addresses", "fine"])
    assert risky == [pytest.approx(x) for x in (0.9, 0.25, 0.0)]
    assert values(spark, L.effort_score, ["complete multiple steps", "just visit", ""]) == [pytest.approx(x) for x in (0.75, 0.0, 0.3)]
    assert values(spark, L.money_mention, ["get $1,000 or 5 ETH", "none"]) == ["$1,000", ""]
    compound = values(spark, lambda v: L.compounded(L.risk_reasons(v), F.lit(0.1)), ["connect your wallet", "claim now"], "string")
    assert compound == [["connect_wallet", L.COMPOUND_REASON], ["claim_now_unverifiable"]]


LETTERS = "abcdeé日 "


@pytest.mark.parametrize("seed", range(6))
def test_common_lengths_of_many_pairs(seed):
    """Lanes give what one pair at a time gives, whatever the lengths, alphabets and limits."""
    rnd = random.Random(seed)
    texts = [["".join(rnd.choice(LETTERS[: rnd.randint(1, 8)] + "xyz"[k]) for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 130, 300]))) for _ in range(60)] for k in range(2)]
    want = [common_length(a, b) for a, b in zip(*texts, strict=True)]
    least = [rnd.choice([0, n - 1, n, n + 0.5, n + 1, n * 1.2]) for n in want]
    got = similarity.common_lengths(pa.array(texts[0]), pa.array(texts[1]), np.array(least, float))
    assert got.tolist() == [n if n >= low else -1 for n, low in zip(want, least, strict=True)]


@pytest.mark.parametrize("long", [100, 10_000])
def test_common_lengths_of_long_texts(long, monkeypatch):
    """One at a time or in lanes of many words, whose carries run through all of them."""
    monkeypatch.setattr(similarity, "LONG", long)
    rnd = random.Random(4)
    a = ["ab" * 4000, "x" * 5000, "".join(rnd.choice("abc") for _ in range(4500)), "short"]
    b = ["ba" * 4000, "x" * 4800 + "y", a[2][:2000] + "zz" + a[2][2100:], "shot"]
    want = [common_length(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.common_lengths(pa.array(a), pa.array(b), np.zeros(4)).tolist() == want == [7999, 4800, want[2], 4]
    assert similarity.common_lengths(pa.array(a), pa.array(b), np.array(want) + 0.5).tolist() == [-1] * 4


def test_common_lengths_in_small_batches(monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 500)
    rnd = random.Random(1)
    a, b = (["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 200))) for _ in range(50)] for _ in range(2))
    assert similarity.common_lengths(pa.array(a), pa.array(b), np.zeros(50)).tolist() == [common_length(x, y) for x, y in zip(a, b, strict=True)]


def test_token_set_ratio_column_is_the_plain_function(spark):
    rnd = random.Random(2)
    words = ["a", "ab", "win", "free", "credits", "nowhere", "now here", "x" * 70, "é日", "tab\there", "　wide\xa0space"]
    texts = [None, "", "  "] + [" ".join(rnd.sample(words, rnd.randint(1, 7))) for _ in range(60)]
    pairs = [(a, b) for a in texts[:25] for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    ratios = [similarity.ratio_of_tokens(similarity.tokens(F.col("a")), similarity.tokens(F.col("b")), low).alias(f"from_{int(low)}") for low in (60.0, 85.0)]
    for r in df.select("a", "b", similarity.token_set_ratio_column("a", "b").alias("ratio"), *ratios).collect():
        want = token_set_ratio(r["a"], r["b"])
        assert r["ratio"] == pytest.approx(want)
        for low in (60, 85):
            assert r[f"from_{low}"] == (pytest.approx(want) if want >= low else None)
    ids = df.select("a", "b", similarity.tokens(F.col("a")).alias("x"), similarity.tokens(F.col("b")).alias("y"))
    common = similarity.common_sizes(similarity.token_ids(F.col("x")), similarity.token_ids(F.col("y")))
    bounds = similarity.ratio_bounds(similarity.set_lengths(F.col("x")), similarity.set_lengths(F.col("y")), F.col("common.n"), F.col("common.chars"))
    for r in ids.withColumn("common", common).select("a", "b", bounds.alias("x")).collect():
        assert r["x"][0] - 1e-9 <= token_set_ratio(r["a"], r["b"]) <= r["x"][1] + 1e-9
    assert spark.createDataFrame([("w" * 4096 + " a",)], "t string").select(similarity.token_ids(similarity.tokens(F.col("t"))).isNull().alias("wide")).first()["wide"]
