"""Operators on hand-made rows; what matters of each behaviour is asserted on the result."""

import os
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oppsift.checkpoints import shared_folder
from oppsift.functions import text as T
from oppsift.functions.scalars import rounded
from oppsift.functions.similarity import token_set_bounds, token_set_ratio
from oppsift.operators import alerts as A
from oppsift.operators import clusters as C
from oppsift.operators import duplicates as D
from oppsift.operators import normalize as N
from oppsift.operators import resolve as R
from oppsift.operators import scoring as SC
from oppsift.operators import state as ST
from oppsift.operators import verify as V
from oppsift.operators.components import connected_components, merge_components, relabelled
from oppsift.operators.ranking import ranked
from oppsift.operators.trend import trend, velocity
from oppsift.plans import fixtures as X
from oppsift.plans.queries import _items, q_minhash_signature, q_resolve_runs, q_token_set_ratio, raw_rows

T0 = datetime(2024, 1, 1)


def posts(spark, rows):
    """rows: (source, id, text, author, minutes, url)."""
    found = [(s, i, t, a, (T0 + timedelta(minutes=m)).isoformat() + "+00:00", u, k) for k, (s, i, t, a, m, u) in enumerate(rows)]
    df = spark.createDataFrame(found, "source string, source_id string, text string, author string, published_at string, url string, pos long")
    df = df.withColumn("title", F.lit(None).cast("string")).withColumn("subreddit", F.lit(None).cast("string")).withColumn("basis", F.col("text"))
    return N.finished(df.withColumn("engagement", F.struct(F.lit(1).cast("long").alias("likes"), *(F.lit(None).cast("long").alias(c) for c in ("comments", "views", "score")))))


VARIANTS = [f"Orbit Labs giveaway: win bonus credits today, sign up before the deadline at noon {w}" for w in ("", "now", "folks", "please", "again")]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (None, 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert connected_components(edges.limit(0)).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_of_any_graph(spark, pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in pairs)}


@pytest.mark.parametrize("seed", range(3))
def test_components_merged_batch_by_batch(spark, seed):
    """After each batch of edges the labels are those of all edges so far, and what was not touched is not written again."""
    rng, labels, so_far = random.Random(seed), spark.createDataFrame([], "node long, component long"), []
    for size in (12, 1, 20, 0, 30):
        batch = [(rng.randrange(40), rng.randrange(40)) for _ in range(size)] + [(None, 3), (50, 50)]
        so_far += batch
        changed = [tuple(r) for r in merge_components(labels, spark.createDataFrame(batch, "src long, dst long")).collect()]
        before = {r["node"]: r["component"] for r in labels.collect()}
        assert len({n for n, _ in changed}) == len(changed) and all(before.get(n) != c for n, c in changed)
        rows = sorted(tuple(r) for r in relabelled(labels, spark.createDataFrame(changed, "node long, component long")).collect())
        assert rows == sorted(tuple(r) for r in connected_components(spark.createDataFrame(so_far, "src long, dst long")).collect())
        labels = spark.createDataFrame(rows, "node long, component long")


def test_totals_are_those_of_a_recount(spark):
    """Ten runs, one of them repeated: snapshots by totals and pairs are what counting all signals gives."""
    rng = random.Random(7)
    runs = [[(f"o{rng.randrange(4)}", f"k{rng.randrange(60)}", rng.choice(["u1", "u2", "u3", "u4", None])) for _ in range(12)] for _ in range(10)]
    stored, totals, authors = {}, [], []
    for n, rows in enumerate([*runs, runs[-1]]):
        run = f"r{min(n, 9)}"
        if n == 10:  # the last run again: its own rows are put aside first, as the store does
            stored = {k: v for k, v in stored.items() if v[2] != run}
            totals, authors = [t for t in totals if t[1] != run], [a for a in authors if a[2] != run]
        members = {k: (o, a) for o, k, a in rows}
        added = [(o, k, a) for k, (o, a) in members.items() if k not in stored]
        df = spark.createDataFrame(added, "opportunity_id string, key string, author string")
        pairs = ST.added_authors(df, spark.createDataFrame([a[:2] for a in authors], "opportunity_id string, author string"))
        new = ST.added_totals(df, pairs, run)
        engaged = spark.createDataFrame([(o, "s", (1, 1, 1, 1)) for o, _ in members.values()], "opportunity_id string, source string, engagement struct<likes:long,comments:long,views:long,score:long>")
        shots = ST.snapshot(engaged, spark.createDataFrame(totals, ST.SCHEMAS["totals"]), new, run, F.lit(T0)).collect()
        totals += [tuple(r) for r in new.select("opportunity_id", "run_id", "signals", "authors").collect()]
        authors += [(r["opportunity_id"], r["author"], run) for r in pairs.collect()]
        stored |= {k: (o, a, run) for o, k, a in added}
        for r in shots:
            mine = [v for v in stored.values() if v[0] == r["opportunity_id"]]
            assert (r["signal_count"], r["unique_authors"]) == (len(mine), len({a for _, a, _ in mine if a}))
            assert r["new_signal_count"] == sum(o == r["opportunity_id"] for o, _, _ in added)
        assert {r["opportunity_id"] for r in shots} == {o for o, _ in members.values()}


def test_normalize(spark):
    rows = {(r["source"], r["source_id"]): r for r in N.normalize(N.raw_dedup(raw_rows(spark)), F.lit(T0)).collect()}
    t = rows["twitter", "t1"]
    assert (t["engagement"]["likes"], t["author"], t["published_at"], t["canonical_url"]) == (1200, "ann", "2026-09-02T19:33:47+00:00", "https://x.example/t1")
    assert t["matched_queries"] == ["q1", "q2"] and t["media"] == ["m1"]
    r = rows["reddit", "r1"]
    assert (r["text"], r["normalized_text"], r["engagement"]["score"], r["subreddit"]) == ("Win & go", "prize win go", 5, "s")
    assert rows["github", "a/b"]["author"] == "" and rows["github", "a/b"]["engagement"]["score"] == 9
    assert rows["hackernews", "h1"]["url"].endswith("item?id=h1")
    assert rows["youtube", "y1"]["url"] == "https://y.example/1" and rows["youtube", "y1"]["text"] == "Video"
    assert rows["rss", "https://f.example/1"]["published_at"] == "2024-05-06T07:08:09+00:00"
    assert sum(s == "rss" for s, _ in rows) == 4, "entries without ids stay apart"
    odd = next(v for (s, i), v in rows.items() if s == "twitter" and i != "t1")
    assert (odd["text"], odd["author"], odd["engagement"]["likes"], odd["engagement"]["views"]) == ("", "12", None, 1)
    assert {r["reason"] for r in N.rejected(raw_rows(spark)).collect()} == {"unknown source", "no object"}


def test_near_duplicates(spark):
    rows = posts(spark, [("twitter", "1", VARIANTS[0], "a", 0, ""), ("reddit", "2", VARIANTS[1], "b", 1, ""), ("twitter", "3", "Rain expected later in the north, nothing else to report at all", "c", 2, "")])
    found = D.find_duplicates(D.prepared(D.with_key(rows))).where("is_duplicate").collect()
    assert [(r["a"], r["b"]) for r in found] == [("reddit:2", "twitter:1")]


def test_bare_links_and_short_texts_are_no_duplicates(spark):
    long = " ".join(f"word{k} what is at home" for k in range(80))
    rows = posts(spark, [("twitter", str(k), f"https://t.example/{k}", "a", k, "") for k in range(3)] + [("reddit", "9", "what is at home", "b", 3, ""), ("twitter", "10", long, "c", 4, "")])
    assert D.find_duplicates(D.prepared(D.with_key(rows))).where("is_duplicate").count() == 0
    assert C.build_clusters(rows)[0].select("cluster_id").distinct().count() == 3, "equal hashes of empty texts make one cluster"


def test_shingle_pairs_are_exact(spark):
    texts = [" ".join(f"w{(k * j) % 17}" for j in range(1 + k % 9)) for k in range(40)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, t string").select("key", D.T.shingles(F.col("t")).alias("shingles"))
    sets = {r["key"]: set(r["shingles"]) for r in items.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert {(r["a"], r["b"]) for r in D.shingle_pairs(items, 0.3).collect()} == want


def test_clusters(spark):
    rows = [(("twitter", "reddit")[k % 2], str(k), VARIANTS[k // 2], f"u{k}", k * 60, "") for k in range(10)]
    rows += [("twitter", "x", "Rain expected later in the north, nothing else to report", "z", 0, ""), ("reddit", "y", "Quarry wine harvest begins in the valley under clear skies", "z", 0, "")]
    members, evidence = C.build_clusters(posts(spark, rows))
    summary = C.cluster_summary(members).collect()
    assert sorted(r["signal_count"] for r in summary) == [1, 1, 10]
    big = max(summary, key=lambda r: r["signal_count"])
    assert big["platforms"] == ["reddit", "twitter"] and big["unique_authors"] == 10 and big["total_engagement"] == 10
    assert big["rep"]["text"] == max(VARIANTS, key=len)
    assert sorted(r["cluster_id"] for r in summary) == ["cluster-000", "cluster-001", "cluster-002"]
    assert evidence.where("a_cluster = b_cluster").count() > 0


def test_same_url_is_one_cluster(spark):
    rows = [("twitter", "1", "Alpha text here is one", "a", 0, "https://e.example/p?ref=1"), ("reddit", "2", "Something else entirely different", "b", 0, "https://e.example/p?ref=2")]
    assert C.build_clusters(posts(spark, rows))[0].select("cluster_id").distinct().count() == 1


def test_independence(spark):
    def of(rows):
        members = posts(spark, rows).withColumn("cluster_id", F.lit("c")).withColumn("key", F.concat("source", "source_id"))
        return C.independence(C.cluster_summary(members), C.average_fuzzy(members)).first()["source_independence"]

    assert of([("twitter", "1", "one", "a", 0, "")]) == 1.0
    assert of([("twitter", str(k), "same bait text", "a", 0, "") for k in range(4)]) < 0.3
    texts = ["big news about orbit", "labs release a tool today", "hackers meet in town"]
    want = 0.4 + 0.4 * (1 - sum(token_set_ratio(texts[i], texts[j]) for i in range(3) for j in range(i)) / 300) + 0.2
    assert of([("twitter", str(k), t, f"u{k}", k * 240, "") for k, t in enumerate(texts)]) == pytest.approx(want, abs=1e-3)


def series(spark, counts, step=1):
    return spark.createDataFrame([("o", T0 + timedelta(hours=step * k), c) for k, c in enumerate(counts)], "opportunity_id string, snapshot_at timestamp, signal_count long")


@pytest.mark.parametrize(
    ("counts", "want"),
    [([1, 2], "insufficient_data"), ([1, None, 3], "insufficient_data"), ([1, 2, 3, 8], "accelerating"), ([1, 10, 18, 19], "saturating"), ([1, 2, 4, 8, 16, 17, 17, 17], "saturating"), ([1, 2, 3, 4, 8, 16, 30], "accelerating"), ([3, 3, 3], "steady"), ([1, 1, 1, 1, 1], "steady")],
)
def test_trend(spark, counts, want):
    assert trend(series(spark, counts)).first()["trend"] == want


def test_velocity(spark):
    assert velocity(series(spark, [10, 20], 2)).first()["velocity"] == 5.0
    assert velocity(series(spark, [10])).first()["velocity"] is None
    assert velocity(series(spark, [10, 20], 0)).first()["velocity"] is None


def opportunity(spark, text, **more):
    row = {"velocity": None, "trend": "insufficient_data", "engagement": 100, "hours": 1, "platforms": ["twitter"], "independence": 1.0, "n": 1} | more
    df = spark.createDataFrame([(text, row["velocity"], row["trend"], row["engagement"], T0 - timedelta(hours=row["hours"]), row["platforms"], row["independence"], row["n"])], "combined_text string, velocity double, trend string, total_engagement long, published_ts timestamp, platforms array<string>, source_independence double, signal_count long")
    rep = F.struct(F.col("combined_text").alias("text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("canonical_url"), F.lit("u").alias("url"))
    df = df.withColumns({"rep": rep, "opportunity_id": F.lit("o"), "cluster_id": F.lit("c"), "is_new": F.lit(True), "independence_details": F.lit(None).cast("string")})
    return SC.decide(SC.score(df, F.lit(T0)))


GOOD = "Hackathon prizes and rewards, $5,000 and 20 USDC and $300, sign up before the deadline"


def test_score_and_decide(spark):
    fresh, stale = opportunity(spark, GOOD).first(), opportunity(spark, GOOD, hours=400).first()
    assert fresh["recency_score"] > 0.5 > stale["recency_score"]
    assert fresh["tier"] == "do_now" and len(fresh["why"]) >= 2 and fresh["money_mention"] == "$5,000"
    four = opportunity(spark, GOOD, platforms=["a", "b", "c", "d"], velocity=100.0, trend="accelerating", n=500, engagement=10**9).first()
    assert four["diversity_score"] == 1.0 and all(0 <= four[c] <= 1 for c in four.asDict() if c.endswith("_score") and four[c] is not None)
    assert opportunity(spark, GOOD + " enter your seed phrase").first()["tier"] == "ignore"
    assert opportunity(spark, GOOD + " says the president").first()["tier"] == "ignore"
    raffle = opportunity(spark, GOOD + " enter to win").first()
    assert raffle["tier"] != "do_now" and SC.L.SELECTIVE_CONCERN in raffle["concerns"]
    assert opportunity(spark, "nothing here").first()["tier"] == "ignore"
    assert opportunity(spark, "connect your wallet", independence=0.1).first()["risk_score"] == pytest.approx(0.45)


def test_decided_ones_come_back_only_if_moved(spark):
    scores = opportunity(spark, GOOD)
    value = scores.first()["opportunity_score"]
    for prior, n in ((value, 0), (value - 0.14, 0), (value + 0.2, 1)):
        decisions = spark.createDataFrame([("o", "ignore", T0, prior)], ST.SCHEMAS["decisions"])
        assert SC.undecided(scores, decisions).count() == n


def test_alerts(spark):
    rows = spark.createDataFrame([("a", "1", 0.9, 0.0), ("b", "2", 0.2, 0.1), ("c", "3", 0.1, 0.6)], "opportunity_id string, cluster_id string, opportunity_score double, before_viral_score double")
    assert [r["opportunity_id"] for r in A.top(A.eligible(rows, 0.5), 5).collect()] == ["a", "c"]
    history = spark.createDataFrame([("a", T0 - timedelta(hours=2), 0.9), ("b", T0 - timedelta(hours=30), 0.2), ("c", T0 - timedelta(hours=1), 0.2)], ST.SCHEMAS["alert_history"])
    assert {r["opportunity_id"] for r in A.cooled_down(rows, history, F.lit(T0)).collect()} == {"b", "c"}


def test_leaders(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("d", "e")], "a string, b string")
    assert {r["key"]: r["leader"] for r in R.leaders(pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "a"}


def test_resolve(spark):
    rep = "struct<text: string, title: string, canonical_url: string, normalized_text: string>"
    texts = {"c1": VARIANTS[0].lower(), "c2": "quarry wine harvest begins in the valley", "c3": "quarry wine harvest begins in the valley today", "c4": "unrelated text of its own kind", "c5": "today here now credits free win"}
    fresh = spark.createDataFrame([(k, (t, None, None, t)) for k, t in texts.items()], f"cluster_id string, rep {rep}")
    old = spark.createDataFrame([("o1", T0, T0, VARIANTS[1].lower(), None, [], "q"), ("o2", T0 + timedelta(1), T0, VARIANTS[0].lower(), None, [], "q"), ("o3", T0, T0, "win free credits now here today", None, [], "q")], ST.SCHEMAS["opportunities"])
    got = {r["cluster_id"]: r for r in R.resolve(fresh, old, "r").collect()}
    assert got["c1"]["opportunity_id"] == "o1" and not got["c1"]["is_new"]
    assert got["c5"]["opportunity_id"] == "o3", "the same words in another order"
    assert got["c2"]["opportunity_id"] == got["c3"]["opportunity_id"] != got["c4"]["opportunity_id"] and got["c2"]["is_new"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "ab", "win", "free", "credits", "nowhere", "x" * 20]), max_size=7).map(" ".join)] * 2), min_size=1, max_size=20))
def test_token_set_bounds(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", token_set_bounds(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        ratio, (least, most) = token_set_ratio(r["a"], r["b"]), r["x"]
        assert least - 1e-9 <= ratio <= most + 1e-9


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=150), st.text("abc d", max_size=150), st.sampled_from([1.0, 60.0, 85.0, 100.0]))
def test_token_set_ratio_from_a_least(a, b, least):
    ratio, found = token_set_ratio(a, b), token_set_ratio(a, b, least)
    assert found == ratio if ratio >= least else found < least


def test_word_pairs_miss_no_common_words(spark):
    """Of random texts, every pair that reaches the rule by common words is found, whatever their order and frequency."""
    rng = random.Random(3)
    words = [f"w{k}" * rng.randint(1, 4) for k in range(40)]
    texts = []
    for k in range(80):
        own = rng.sample(words, rng.randint(2, 12))
        texts.append((f"t{k:02d}", " ".join(own)))
        if k % 3 == 0:
            texts.append((f"v{k:02d}", " ".join(rng.sample(own, max(1, len(own) - 1)))))
            texts.append((f"x{k:02d}", " ".join(rng.sample([*own, rng.choice(words)], len(own) + 1))))
    items = spark.createDataFrame([(k, t, len(t.split())) for k, t in texts], "key string, normalized_text string, words int")
    found = {(r["a"], r["b"]) for r in R.word_pairs(items, items).collect()}
    for a, x in texts:
        for b, y in texts:
            both = set(x.split()) & set(y.split())
            shared = len(" ".join(both))
            low, high = sorted((len(x.split()), len(y.split())))
            if both and low / high >= 0.35:
                by_common = max(2 * shared / (shared + len(" ".join(set(t.split())))) for t in (x, y))
                assert by_common < 0.85 or (a, b) in found


def test_ranked(spark):
    rows = spark.createDataFrame([(k % 3, (k * 37) % 101, k) for k in range(300)], "kind int, value int, id int")
    got = ranked(rows, ["kind"], [F.desc("value"), "id"]).collect()
    for kind in range(3):
        own = sorted((r for r in got if r["kind"] == kind), key=lambda r: (-r["value"], r["id"]))
        assert [r["rank"] for r in own] == list(range(1, 101))
    assert ranked(rows.limit(0), ["kind"], ["id"]).count() == 0 and sorted(r["n"] for r in ranked(rows, [], ["id"], "n").collect()) == list(range(1, 301))


def test_average_fuzzy_in_blocks(spark):
    """The mean over all pairs, however a cluster is dealt out."""
    rng = random.Random(5)
    texts = [("c", " ".join(rng.sample("abcdefgh", rng.randint(1, 6)))) for _ in range(30)] + [("c", "a b")] * 3 + [("d", "x"), ("e", "y"), ("e", "y z"), ("f", ""), ("f", "")]
    members = spark.createDataFrame(texts, "cluster_id string, normalized_text string")
    for block in (100, 4):
        got = {r["cluster_id"]: r["avg_fuzzy"] for r in C.average_fuzzy(members, block=block).collect()}
        for c in ("c", "e", "f"):
            own = [t for k, t in texts if k == c]
            ratios = [token_set_ratio(x, y) for k, x in enumerate(own) for y in own[:k]]
            assert got[c] == pytest.approx(sum(ratios) / len(ratios))
        assert "d" not in got


def test_rounding_goes_by_the_binary_value(spark):
    values = [0.01275, 0.0125, 2.5, 0.5, 0.1285, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 4).alias("x")).collect()
    assert [r["x"] for r in got] == [0.0127, 0.0125, 2.5, 0.5, 0.1285, 0.0]


def test_verify(spark):
    pages = spark.createDataFrame([("https://h.example/a", "Win! Deadline: 12 October 2026, $10,000 in prizes"), ("https://h.example/b", "Checking your browser"), ("https://x.com/p", "Deadline May 3, 2025")], "url string, page_text string")
    tag, none = ["hackathon_or_competition"], []
    rows = [("1", "https://h.example/a", "", tag), ("2", "https://x.com/p", "see https://h.example/b).", tag), ("3", "https://x.com/p", "no link", tag), ("4", "https://h.example/a", "", none), ("5", "javascript:alert(1)", "https://gone.example/z", tag)]
    scores = spark.createDataFrame(rows, "opportunity_id string, representative_url string, representative_text string, relevance_reasons array<string>")
    got = {r["opportunity_id"]: r for r in V.verify(scores, pages).collect()}
    assert (got["1"]["deadline_text"], got["1"]["prize_text"], got["1"]["note"]) == ("deadline : 12 October 2026", "$10,000 in prizes", V.VERIFIED)
    assert got["2"]["blocked"] and got["2"]["official_url"] == "https://h.example/b"
    assert [got[k]["note"] for k in "345"] == [V.NO_LINK, V.NOT_TAGGED, V.NO_PAGE]
    projects = spark.createDataFrame([("summer-hack", "tool for the summer hackathon", "t", "u"), ("other", "nothing alike", "t", "u")], "name string, description string, updatedAt string, url string")
    hints = spark.createDataFrame([("1", "Summer hackathon")], "opportunity_id string, representative_text string")
    assert [r["name"] for r in V.project_matches(hints, projects).collect()] == ["summer-hack"]


def test_phrases(spark, sf):
    assert X.phrased(spark, sf).where("text like 'Orbit Labs giveaway%'").count() > 0


def test_token_set_ratio_of_whole_texts(spark, sf):
    tables = {k: spark.read.parquet(f"{sf}/{k}.parquet") for k in ("documents", "benchmark")}
    docs, marks = ({r[0]: r[1] for r in tables[k].select(c, T.clean_text(F.col("text"))).collect()} for k, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {r["doc_id"]: r["ratio"] for r in q_token_set_ratio(spark, sf).collect() if r["doc_id"] >= 0}
    want = {d: token_set_ratio(t, marks[d % len(marks)]) for d, t in docs.items() if d % len(marks) in marks}
    assert got == {d: pytest.approx(x, abs=1e-3) for d, x in want.items()}


def test_stored_opportunities_have_entities(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "resolve", lambda fresh, stored, run_id: stored)
    assert q_resolve_runs(spark, sf).where(F.size("entities") > 0).count() > 0


def test_shingle_pairs_leave_only_their_result(spark):
    """Of the sets, ranges and shares on the way nothing is left on disk when the pairs are there; copies stand for one another."""
    folder = shared_folder(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    rows = [(k, [100 * (k // 3) + j for j in range(20 + k % 3 // 2)]) for k in range(60)] + [(99, [7]), (100, [])]
    items = D.written(D.with_set(spark.createDataFrame(rows, "key long, shingles array<bigint>")), "items")
    pairs, classes = D.class_pairs(items, 0.5)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(k, k + 2) for k in range(0, 60, 3)]
    assert {r["key"]: r["class_key"] for r in classes.collect()} == {k: k - (k % 3 == 1) for k in range(60)} | {99: 99, 100: 100}
    assert {n[:-33] for n in set(os.listdir(folder)) - there} == {"set-hashes", "shingle-pairs", "class-pairs", "classes"}


def test_pairs_are_compared_by_turns(spark, monkeypatch):
    """The evidence of pairs is the same however many turns it is found in, and no turn fetches what more than some pairs ask for."""
    texts = [" ".join(f"w{(7 * k + j * (1 + k % 3)) % 40}" for j in range(8 + k % 5)) + (" Orbit Labs" if k % 4 == 0 else "") for k in range(60)] + ["w1 w2 w3 w4"] * 2
    rows = posts(spark, [("twitter", f"{k:03}", t, "a", k, "") for k, t in enumerate(texts)])
    items = D.written(D.prepared(D.with_key(rows)).drop("shingles"), "items")
    once, seen, real = sorted(map(str, D.find_duplicates(items).collect())), [], D.measured

    def counted(df, name, **measures):
        out, n = real(df, name, **measures)
        seen.append((name, out.count()))
        return out, n

    monkeypatch.setattr(D, "FEWEST", 20)
    monkeypatch.setattr(D, "measured", counted)
    found = D.find_duplicates(items)
    assert sorted(map(str, found.collect())) == once and len(once) > 60
    turns = [n for name, n in seen if name == "judged"]
    assert len(turns) > 1 and sum(turns) == len(once) and max(turns) < len(once)
    jaccard = {(r["a"], r["b"]): r["jaccard"] for r in found.collect()}
    sets = {f"twitter:{k:03}": {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in enumerate(texts) for w in [t.lower().split()]}
    assert jaccard == {(a, b): pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in jaccard}


@pytest.mark.parametrize("block", [1_000, 2])
def test_copies_have_all_their_pairs(spark, monkeypatch, block):
    """Each copy of a text meets the other copies and all that is like it, not the first of them alone; rows without shingles meet nothing."""
    monkeypatch.setattr(D, "BLOCK", block, raising=False)
    texts = ["one two three four five six"] * 5 + ["one two three four five seven"] * 3 + ["one two three four nine ten"] + ["far from all the other rows"] * 2 + [""] * 2
    rows = posts(spark, [("twitter", f"{k:02}", t, "a", k, f"https://x.example/{k}") for k, t in enumerate(texts)])
    found = D.find_duplicates(D.prepared(D.with_key(rows))).collect()
    sets = {f"twitter:{k:02}": {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in enumerate(texts) for w in [t.split()] if w}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in want.items() if j >= D.CANDIDATE_JACCARD}
    assert len(found) == len(want) == 37 and {(r["a"], r["b"]): r["jaccard"] for r in found} == pytest.approx(want)
    assert all(r["is_duplicate"] for r in found if r["jaccard"] >= D.SAME_JACCARD)


def test_ranges_of_shingles_go_as_they_are_read(spark, monkeypatch):
    """Sets are written once, cut by ranges of their hashes, and each range is removed before the next is shuffled."""
    folder, left, real = shared_folder(spark).removeprefix("file://"), [], D.written
    before = set(os.listdir(folder))

    def watched(df, name, by=None):
        out = real(df, name, by)
        if name == "common":
            cut = [n for n in set(os.listdir(folder)) - before if n.startswith("sets-")]
            left.append(sum(p.startswith("part=") for n in cut for p in os.listdir(f"{folder}/{n}")))
        return out

    monkeypatch.setattr(D, "written", watched)
    items = spark.createDataFrame([(k, [1000 * (k // 2) + j for j in range(100)]) for k in range(40)], "key long, shingles array<bigint>")
    assert D.shingle_pairs(items, 0.5).count() == 20
    assert left == list(range(D.SLICES + 1, 1, -1))


def near_copies(spark):
    """Sets of three groups of near copies, each lacking a stretch of its group's numbers, and a few that share less."""
    rows = [(100 * g + k, [1000 * g + j for j in range(120) if not 3 * k <= j < 3 * k + 6]) for g in range(3) for k in range(36)]
    rows += [(500 + k, [1000 * (k % 3) + j for j in range(10 * k)] + [9000 + 100 * k + j for j in range(40)]) for k in range(12)] + [(600, []), (601, [9000])]
    return spark.createDataFrame(rows, "key long, shingles array<bigint>"), {k: set(x) for k, x in rows if x}


def test_large_groups_are_compared_by_cells(spark, monkeypatch):
    """The pairs of a group of near copies, which grow with its square, fetch its sets for each cell of it, not for each pair, and none is lost."""
    items, sets = near_copies(spark)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in want.items() if j >= 0.2}
    fetched = []
    for cell, dense, turns in ((128, 3, 5_000), (8, 3, 5_000), (128, 1_000, 5_000), (128, 3, 1_000_000)):
        monkeypatch.setattr(D, "CELL", cell, raising=False)
        monkeypatch.setattr(D, "DENSE", dense, raising=False)
        monkeypatch.setattr(D, "CHUNK", 50, raising=False)
        monkeypatch.setattr(D, "AT_ONCE", turns)
        seen, measured = {}, D.measured

        def counted(df, name, **measures):
            out, n = measured(df, name, **measures)
            seen[name] = n
            if name == "cell-ends":
                fetched.append((cell, out.count()))
            return out, n

        with monkeypatch.context() as inside:
            inside.setattr(D, "measured", counted)
            found = {(r["a"], r["b"]): r["jaccard"] for r in D.shingle_pairs(items, 0.2).collect()}
        assert found == pytest.approx(want) and len(want) > 1_500
        assert ("cell-ends" in seen) == (dense < 1_000 and turns < 1_000_000)
    assert fetched and max(n for cell, n in fetched if cell == 128) < len(want) / 5


def test_pairs_meet_seldom(spark, monkeypatch):
    """Near copies share most shingles of their prefixes; they are shuffled for few of them, for some ranges of keys at a time, and none is lost."""
    items, sets = near_copies(spark)
    met, parts, real = [], [], D.measured

    def counted(df, name, **measures):
        out, n = real(df, name, **measures)
        if name == "candidates":
            parts.append(n)
        return out, n

    class Seen(D.Observation):
        @property
        def get(self):
            met.append(super().get["met"] or 0)
            return super().get

    monkeypatch.setattr(D, "SLICES", 2)
    monkeypatch.setattr(D, "measured", counted)
    monkeypatch.setattr(D, "Observation", Seen)
    for at_once in (D.AT_ONCE, 3_000):
        monkeypatch.setattr(D, "AT_ONCE", at_once)
        met.clear(), parts.clear()
        for t in (0.2, 0.5):
            want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
            want = {k: v for k, v in want.items() if v >= t}
            assert {(r["a"], r["b"]): pytest.approx(r["jaccard"]) for r in D.shingle_pairs(items, t).collect()} == want and len(want) > 1800
        assert sum(met) < 8 * 2 * len(want) and len(parts) == (2 if at_once > 3_000 else 4)


def test_few_links_hang_near_copies_together(spark, monkeypatch):
    """What hangs together is found of far fewer links than there are pairs."""
    monkeypatch.setattr(D, "SLICES", 2)
    items, sets = near_copies(spark)
    ordered = D.with_set(items)
    pairs, classes = D.class_pairs(ordered, 0.5)
    links, same = D.class_pairs(ordered, 0.5, find=D.linking_sets)
    labels = [sorted(map(tuple, D.connected_components(x, "a", "b").collect())) for x in (pairs, links)]
    assert labels[0] == labels[1] and len(labels[0]) > 100
    assert sorted(map(str, classes.collect())) == sorted(map(str, same.collect()))
    assert {(r["a"], r["b"]) for r in links.collect()} <= {(r["a"], r["b"]) for r in pairs.collect()} and 3 * links.count() < pairs.count()


def test_prefixes_meet_by_ranges_of_hashes(spark, monkeypatch):
    """Disk holds the prefixes of one range of shingles at a time, and no pair or link is lost between ranges."""
    items, sets = near_copies(spark)
    folder, there, real = shared_folder(spark).removeprefix("file://"), [], D.written
    before = set(os.listdir(folder))

    def watched(df, name, by=None):
        out = real(df, name, by)
        if name == "prefix":
            there.append(sum(n.startswith("prefix-") for n in set(os.listdir(folder)) - before))
        return out

    monkeypatch.setattr(D, "written", watched)
    monkeypatch.setattr(D, "SLICES", 4)
    monkeypatch.setattr(D, "AT_ONCE", 3_000)
    pairs, links = D.shingle_pairs(items, 0.5), D.class_pairs(D.with_set(items), 0.5, find=D.linking_sets)[0]
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and {(r["a"], r["b"]) for r in links.collect()} <= want
    one, other = (sorted(map(tuple, D.connected_components(x, "a", "b").collect())) for x in (pairs, links))
    assert one == other and len(there) >= 6 and set(there) == {1}


def test_signatures_are_fetched_by_turns(spark, sf, monkeypatch):
    """Pairs fetch their signatures some at a time; each has the estimate that the two signatures give."""
    turns, asked, real = [], [], D.by_turns
    monkeypatch.setattr(D, "times", lambda n, rows: asked.append((n, rows)) or 3)
    monkeypatch.setattr(D, "by_turns", lambda *a: turns.append(a[3]) or real(*a))
    rows = q_minhash_signature(spark, sf).collect()
    keys = {k for r in rows for k in (r["a"], r["b"])}
    signed = {r["key"]: r["sig"] for r in _items(spark, sf).where(F.col("key").isin(*keys)).select("key", T.minhash(F.col("shingles")).alias("sig")).collect()}
    assert turns == [3] and asked == [(len(rows), len(keys))] and len(rows) > 10 and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    assert [r["estimate"] for r in rows] == [pytest.approx(sum(x == y for x, y in zip(signed[r["a"]], signed[r["b"]], strict=True)) / 128) for r in rows]


def test_cells_of_a_cluster_are_compared_some_at_a_time(spark, monkeypatch):
    """Blocks of texts meet in several turns, which find the mean of all pairs; rows of one text each weigh as they are many."""
    rng, seen, real = random.Random(6), [], C.written
    texts = [("c", " ".join(rng.sample("abcdefgh", rng.randint(1, 6)))) for _ in range(30)] + [("c", "a b")] * 3 + [("d", "x"), ("e", "y z")] + [("f", "")] * 2
    members = spark.createDataFrame(texts, "cluster_id string, normalized_text string")
    monkeypatch.setattr(C, "WORDS", 1)
    monkeypatch.setattr(C, "written", lambda df, name: seen.append(name) or real(df, name))
    got = {r["cluster_id"]: r["avg_fuzzy"] for r in C.average_fuzzy(members, block=8).collect()}
    own = [t for k, t in texts if k == "c"]
    ratios = [token_set_ratio(x, y) for k, x in enumerate(own) for y in own[:k]]
    assert got == {"c": pytest.approx(sum(ratios) / len(ratios)), "f": 0.0} and seen.count("cells") > 1


def test_words_meet_some_keys_at_a_time(spark, monkeypatch):
    """The pairs that share enough words are the same in many turns as in one."""
    rng, seen, real = random.Random(7), [], R.written
    base = [" ".join(rng.sample([f"w{k}" for k in range(60)], 12)) for _ in range(12)]
    rows = [(f"{k:02}", t if k < 12 else t + " more", len(t.split())) for k, t in enumerate(base * 2)]
    side = spark.createDataFrame(rows, "key string, normalized_text string, words int")
    once = {(r["a"], r["b"]) for r in R.word_pairs(side, side).collect()}
    monkeypatch.setattr(R, "MEETINGS", 100)
    monkeypatch.setattr(R, "written", lambda df, name: seen.append(name) or real(df, name))
    assert {(r["a"], r["b"]) for r in R.word_pairs(side, side).collect()} == once >= {(f"{k:02}", f"{k + 12:02}") for k in range(12)}
    assert seen.count("met") > 2
