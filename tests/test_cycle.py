"""Sources, state, cycles and streaming, end to end on small files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from oppsift.manifests import Taken
from oppsift.operators import normalize as N
from oppsift.operators import state as ST
from oppsift.operators import verify as V
from oppsift.plans.cycle import Engine
from oppsift.plans.queries import ORACLES, QUERIES
from oppsift.sources import landing
from oppsift.streaming import loop

T0 = datetime(2024, 1, 1)
GOOD = "Orbit hackathon: prizes and rewards of $5,000, sign up before the deadline"


def land(folder, source, name, posts):
    (folder / source).mkdir(parents=True, exist_ok=True)
    (folder / source / name).write_text("".join(json.dumps(p) + "\n" for p in posts))


def tweets(n, tail=""):
    return [{"id": f"t{k}", "text": f"{GOOD} {tail}{k}", "likes": 50, "author": f"u{k}", "created_at": "Sun Dec 31 23:00:00 +0000 2023", "_collector_query": "prize"} for k in range(n)]


def test_readers(spark, tmp_path):
    land(tmp_path, "twitter", "a.json", tweets(3))
    (tmp_path / "twitter" / "b.json").write_text("broken {\n")
    land(tmp_path, "hackernews", "a.json", [{"hits": [{"objectID": "1", "title": "x"}, {"objectID": "2", "title": "y"}]}])
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "f.xml").write_text("<rss><channel><item><title>One</title><link>https://f/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>Two</title></item></channel></rss>")
    rows = landing.read_landed(spark, str(tmp_path))
    assert {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"twitter": 4, "hackernews": 2, "rss": 2}
    assert rows.where("raw is null").count() == 1
    assert landing.read_landed(spark, str(tmp_path), per_query_limit=1).where("source = 'twitter' and query = 'prize'").count() == 1
    assert landing.read_landed(spark, str(tmp_path / "none")).count() == 0
    feed = landing.read_feed(spark, str(tmp_path / "rss"))
    assert sorted(json.loads(r[0])["title"] for r in feed.select(F.to_json("raw")).collect()) == ["One", "Two"]


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><id>urn:1</id><title type="html">Atom one</title><link rel="self" href="https://f/self"/><link href="https://f/a1"/><author><name>Ann</name></author><updated>2024-01-02T03:04:05Z</updated><summary type="html">&lt;b&gt;Grant&lt;/b&gt;</summary></entry>
<entry><id>urn:2</id><title>Atom two</title><link rel="alternate" href="https://f/a2"/></entry></feed>"""
RSS = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title><item><guid isPermaLink="false">g1</guid><title>Rss one</title><link>https://f/r1</link><dc:creator>Bob</dc:creator>
<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    """RSS and Atom through the registry; a feed that is broken harms no other and goes to quarantine."""
    (tmp_path / "rss").mkdir()
    for name, text in (("a.xml", ATOM), ("b.xml", RSS), ("c.xml", "<rss><channel><item><title>cut of")):
        (tmp_path / "rss" / name).write_text(text)
    rows = landing.read_landed(spark, str(tmp_path))
    assert rows.where("raw is null").count() == 1
    got = {r["title"]: r for r in N.normalize(N.raw_dedup(rows), F.lit(T0)).collect()}
    assert {t: (r["source_id"], r["url"], r["author"], r["published_at"]) for t, r in got.items()} == {
        "Atom one": ("urn:1", "https://f/a1", "Ann", "2024-01-02T03:04:05+00:00"), "Atom two": ("urn:2", "https://f/a2", "", None), "Rss one": ("g1", "https://f/r1", "Bob", "2024-01-02T03:04:05+00:00"),
    }
    assert got["Atom one"]["text"] == "Grant"


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text("# note\nA=1\n\nB = x=y\nA=2\njunk\n")
    assert {r["key"]: r["value"] for r in landing.read_settings(spark, str(tmp_path / "env")).collect()} == {"A": "2", "B": "x=y"}


def test_store(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path / "s"))
    assert store.table("signals").count() == 0
    store.record_decision("o", "ignore", 0.4, T0)
    store.record_decision("o", "done", 0.6, T0 + timedelta(1))
    assert [(r["action"], r["score_at_decision"]) for r in store.decisions().collect()] == [("done", 0.6)]
    assert store.first_seen("o") is None


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("engine")
    land(folder / "in", "twitter", "a.json", tweets(2) + [{"id": "z", "text": "Rain expected later in the north", "author": "q"}])
    sent = []
    e = Engine(spark, str(folder / "store"), str(folder / "in"), [lambda title, body: sent.append(title)])
    e.sent, e.folder = sent, folder
    e.first = e.run(T0, "r1", threshold=0.05, log=str(folder / "log"))
    return e


def test_cycle(engine):
    first = engine.first
    assert (first.raw_count, first.signal_count, first.cluster_count) == (3, 3, 2)
    assert first.alerts_sent == len(engine.sent) == 1
    assert json.loads(engine.spark.read.text(str(engine.folder / "log")).first()[0])["risk_level"] == "LOW"
    top = engine.top().collect()
    assert len(top) == 1 and top[0]["is_new"]
    assert GOOD[:20] in engine.detail(top[0]["opportunity_id"]) and "Scan terminé" in engine.summary()


def test_later_cycles(engine):
    one = engine.first.scores.where("signal_count = 2").first()["opportunity_id"]
    second = engine.run(T0 + timedelta(hours=2), "r2", threshold=0.05)
    assert second.scores.where("is_new").count() == 0
    assert second.scores.where("signal_count = 2").first()["opportunity_id"] == one
    shots = engine.store.table("snapshots").where(F.col("opportunity_id") == one).orderBy("snapshot_at").collect()
    assert [(s["signal_count"], s["new_signal_count"]) for s in shots] == [(2, 2), (2, 0)]
    assert second.alerts_sent == 0, "reported two hours ago and not moved"
    seen = engine.store.table("opportunities").where(F.col("opportunity_id") == one).first()
    assert (seen["first_seen"], seen["last_seen"]) == (T0, T0 + timedelta(hours=2))
    score = engine.last.scores.where("signal_count = 2").first()["opportunity_score"]
    engine.record_decision(one, "ignore", score, T0)
    assert engine.top().count() == 0
    assert engine.status()["decisions"] == 1


def test_streaming(spark, tmp_path):
    land(tmp_path / "in", "twitter", "a.json", tweets(2))
    engine, cycles = Engine(spark, str(tmp_path / "store"), str(tmp_path / "in")), []
    loop.start(engine, str(tmp_path / "cp"), clock=lambda: T0, on_cycle_done=cycles.append).awaitTermination(300)
    assert [c.signal_count for c in cycles] == [2]
    land(tmp_path / "in", "twitter", "b.json", tweets(2)[:1] + [{"id": "new", "text": f"{GOOD} anew", "author": "v"}])
    loop.start(engine, str(tmp_path / "cp"), clock=lambda: T0 + timedelta(hours=1), on_cycle_done=cycles.append).awaitTermination(300)
    assert [c.signal_count for c in cycles] == [2, 2]
    assert engine.store.table("signals").count() == 3


def test_streaming_of_lists_and_feeds(spark, tmp_path):
    """Posts within lists, feeds and limits are read from a stream as from a folder."""
    land(tmp_path / "in", "hackernews", "a.json", [{"hits": [{"objectID": str(k), "title": f"Story number {k} of its own"} for k in range(60)], "_collector_query": "q"}])
    land(tmp_path / "in", "youtube", "a.json", [{"entries": [{"id": "v1", "title": "Film one"}, {"id": "v2", "title": "Another film"}]}])
    (tmp_path / "in" / "rss").mkdir()
    (tmp_path / "in" / "rss" / "a.xml").write_text(ATOM)
    seen = []
    query = loop.stream_landed(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: seen.extend(loop.bronze_of(b).select("source", F.to_json("raw").alias("raw")).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = landing.read_landed(spark, str(tmp_path / "in")).select("source", F.to_json("raw").alias("raw")).collect()
    names = lambda rows: sorted((r["source"], json.loads(r["raw"])["title"]) for r in rows)
    assert names(seen) == names(batch) and [sum(r["source"] == s for r in seen) for s in ("hackernews", "youtube", "rss")] == [50, 2, 2]


def test_a_run_that_is_repeated(spark, tmp_path):
    """It takes the place of its first attempt: no snapshot, signal or opportunity twice, and new ones are new again."""
    land(tmp_path / "in", "twitter", "a.json", tweets(2))
    engine = Engine(spark, str(tmp_path / "store"), str(tmp_path / "in"))
    tables = {}
    for attempt in range(2):
        done = engine.run(T0, "r1", threshold=0.05)
        assert done.scores.where("is_new").count() == 1
        tables[attempt] = {t: sorted(map(str, engine.store.table(t).collect())) for t in ("opportunities", "signals", "snapshots")}
    assert tables[0] == tables[1] and len(tables[0]["snapshots"]) == 1


def test_two_writers(spark, tmp_path):
    """What is added while a run goes on is kept; of two runs that replace a table from one version the second fails whole."""
    a, b = (ST.Store(spark, str(tmp_path / "s")) for _ in range(2))
    rows = spark.createDataFrame([("o", T0, T0, "t", "u", [], "r")], ST.SCHEMAS["opportunities"])
    base = a.version()
    b.record_decision("o", "ignore", 0.4, T0)
    a.publish({"opportunities": ("replace", rows)}, "r1", base)
    assert a.table("decisions").count() == 1 and b.table("opportunities").count() == 1
    with pytest.raises(ST.Busy):
        b.publish({"opportunities": ("replace", rows.limit(0)), "signals": ("append", b.table("signals"))}, "r2", base)
    assert a.table("opportunities").count() == 1 and a.version()["signals"] == []
    number, version = a.versions.latest()
    with pytest.raises(Taken):
        a.versions.publish(number, version)
    engine = Engine(spark, str(tmp_path / "s"), str(tmp_path / "none"))
    with engine.lock, pytest.raises(ST.Busy):
        engine.run(T0, "r3")


def test_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "PARTS", 3)
    store = ST.Store(spark, str(tmp_path / "s"))
    for k in range(7):
        store.record_decision(f"o{k}", "ignore", 0.4, T0)
    assert store.table("decisions").count() == 7 and len(store.version()["decisions"]) <= 4


def test_verifications_are_remembered(spark, tmp_path):
    """A page is read once; a protected one is told to the channels; cards and details have what was found."""
    text = f"{GOOD} hackathon with prizes https://hack.example.org"
    land(tmp_path / "in", "twitter", "a.json", [t | {"text": f"{text} {k}", "likes": 5000} for k, t in enumerate(tweets(2))])
    told = []
    engine = Engine(spark, str(tmp_path / "store"), str(tmp_path / "in"), [lambda title, body: told.append((title, body))])
    engine.run(T0, "r1", threshold=0.05)
    top = engine.top().where("tier = 'do_now'").first()
    assert top is not None
    pages = spark.createDataFrame([("https://hack.example.org", "Deadline: 12 October 2026, $10,000 in prizes. " + "x" * 3000)], "url string, page_text string")
    row = engine.verified(pages).first()
    assert row["note"] == V.VERIFIED and "12 October 2026" in row["deadline_text"]
    assert engine.verified(pages.limit(0)).first()["note"] == V.VERIFIED
    assert "12 October 2026" in engine.detail(top["opportunity_id"]) and "Détecté depuis : 2024-01-01" in engine.detail(top["opportunity_id"])
    assert "12 October 2026" in engine.summary()
    other = Engine(spark, str(tmp_path / "store2"), str(tmp_path / "in"), [lambda title, body: told.append((title, body))])
    other.run(T0, "r1", threshold=0.05)
    told.clear()
    assert other.verified(pages.withColumn("page_text", F.lit("Checking your browser"))).first()["blocked"]
    assert len(told) == 1 and "Vérification bloquée" in told[0][1] and "🔒" in other.detail(other.top().first()["opportunity_id"])


def test_windowed_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = loop.engagement_rate(stream).writeStream.outputMode("append").format("memory").queryName("rate").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rate").count() > 0


def test_entry(spark, sf):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "events", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got, want = df.select(columns).collect(), duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got and shown(got) == shown(want)


@pytest.mark.parametrize("name", ["q_actionable", "q_cards", "q_cooldown", "q_decide", "q_opportunity_score", "q_top_alerts"])
def test_query_equals_its_sql_after_as_of(spark, sf, tmp_path, name):
    """Documents of high numbers are dated after AS_OF."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, some in (("documents", "doc_id < 60"), ("labels", "doc_id < 40")):
        con.execute(f"COPY (SELECT * REPLACE (doc_id + 44620 AS doc_id) FROM '{sf}/{t}.parquet' WHERE {some}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(df.select(columns).collect()) == shown(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
