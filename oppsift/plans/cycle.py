"""One whole cycle: from landed posts to alerts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.checkpoints import written
from oppsift.functions import text as T
from oppsift.operators import alerts as A
from oppsift.operators import state as ST
from oppsift.operators.clusters import average_fuzzy, build_clusters, cluster_summary, independence
from oppsift.operators.formatting import blocked_notice, detail, run_summary
from oppsift.operators.normalize import normalize, raw_dedup, rejected
from oppsift.operators.resolve import resolve
from oppsift.operators.scoring import actionable, decide, score
from oppsift.operators.trend import trend, velocity
from oppsift.operators.verify import verify
from oppsift.sources.landing import read_landed


@dataclass
class Cycle:
    """What a cycle found; the tables are lazy but written underneath."""

    run_id: str
    raw_count: int
    signal_count: int
    cluster_count: int
    scores: DataFrame
    evidence: DataFrame
    quarantine: DataFrame
    alerts: DataFrame
    alerts_sent: int
    elapsed: float


def score_members(members: DataFrame, growth: DataFrame, as_of) -> DataFrame:
    """Scores of clusters from their members (with cluster_id, opportunity_id, is_new) and growth (opportunity_id, velocity, trend)."""
    summary = independence(cluster_summary(members), average_fuzzy(members))
    of = members.select("cluster_id", "opportunity_id", "is_new").distinct()
    rows = summary.join(of, "cluster_id").join(growth, "opportunity_id", "left").withColumn("trend", F.coalesce("trend", F.lit("insufficient_data")))
    return score(rows, as_of)


def growth(snapshots: DataFrame) -> DataFrame:
    return velocity(snapshots).join(trend(snapshots), "opportunity_id")


def run_cycle(spark: SparkSession, bronze: DataFrame, store: ST.Store, as_of: datetime, run_id: str, threshold: float = A.THRESHOLD, limit: int = A.LIMIT, channels: list[Callable] = (), log: str | None = None) -> Cycle:
    """Cleans, clusters, resolves, stores, scores and reports the posts of ``bronze``. The clock is ``as_of`` alone, and ids
    follow from run_id. A run_id that has run before is run as if it had not: what it stored is replaced."""
    began, at, base = time.time(), F.lit(as_of), store.version()
    bronze = written(bronze.withColumn("raw", F.to_json("raw")), "bronze").withColumn("raw", F.try_parse_json("raw"))
    raw = raw_dedup(bronze)
    members, evidence = build_clusters(normalize(raw, at))
    members = written(members, "members")
    clusters = written(cluster_summary(members).select("cluster_id", "rep"), "clusters")
    known = store.table("opportunities", version=base).where(F.coalesce(F.col("first_run") != run_id, F.lit(True)))
    resolved = written(resolve(clusters, known, run_id), "resolved")
    members = written(members.join(resolved, "cluster_id"), "resolved-members")
    # stored: new identities, last_seen of the others, new signals, one snapshot for each opportunity
    entities = clusters.join(resolved.where("is_new"), "cluster_id")
    entities = entities.withColumn("first", F.min("cluster_id").over(W.partitionBy("opportunity_id"))).where("first = cluster_id")
    body = F.coalesce(F.nullif("rep.text", F.lit("")), F.col("rep.title"), F.lit(""))
    founded = entities.select(
        "opportunity_id", at.alias("first_seen"), at.alias("last_seen"), F.col("rep.normalized_text").alias("representative_text"), F.col("rep.canonical_url").alias("representative_url"),
        T.entities(body).alias("entities"), F.lit(run_id).alias("first_run"),
    )
    seen = resolved.where("not is_new").select("opportunity_id").distinct().withColumn("now", at)
    kept = known.join(seen, "opportunity_id", "left").withColumn("last_seen", F.coalesce("now", "last_seen")).drop("now")
    signals = store.table("signals", run_id, base)
    added = ST.new_signals(members, signals).withColumn("run_id", F.lit(run_id)).withColumn("engagement", F.to_json("engagement"))
    added = written(added.select([f.split()[0] for f in ST.SCHEMAS["signals"].split(", ")]), "added")
    pairs = written(ST.added_authors(added, store.table("authors", run_id, base)), "authors")
    new = written(ST.added_totals(added, pairs, run_id), "totals")
    shots = ST.snapshot(members, store.table("totals", run_id, base), new, run_id, at)
    changes = {"opportunities": ("replace", kept.unionByName(founded)), "signals": ("append", added), "snapshots": ("append", shots), "totals": ("append", new), "authors": ("append", pairs)}
    store.publish(changes, run_id, base)
    scores = written(score_members(members, growth(store.table("snapshots")), at), "scores")
    ready = A.top(A.eligible(A.cooled_down(scores, store.alert_history(), at), threshold), limit)
    ready = written(ready, "alerts")
    sent = A.notify(ready, list(channels), limit)
    if sent:
        if log:
            A.append_log(ready, log, at)
        store.mark_alerted(ready, at)
    counts = [bronze.count(), members.count(), clusters.count()]
    return Cycle(run_id, *counts, scores, evidence, rejected(bronze), ready, len(sent), time.time() - began)


class Engine:
    """The commands a user has: run, top, status, detail, verify, decide. One run at a time: a second one in this process is
    refused at once, one elsewhere when it would publish (see ``Store``)."""

    def __init__(self, spark: SparkSession, folder: str, landing: str, channels: list[Callable] = ()) -> None:
        self.spark, self.store, self.landing, self.channels = spark, ST.Store(spark, folder), landing, list(channels)
        self.last: Cycle | None = None
        self.lock = threading.Lock()

    def run(self, as_of: datetime, run_id: str, bronze: DataFrame | None = None, **options) -> Cycle:
        if not self.lock.acquire(blocking=False):
            raise ST.Busy("another run is under way")
        try:
            bronze = bronze if bronze is not None else read_landed(self.spark, self.landing)
            self.last = run_cycle(self.spark, bronze, self.store, as_of, run_id, channels=self.channels, **options)
            return self.last
        finally:
            self.lock.release()

    def _last(self) -> Cycle:
        if self.last is None:
            raise LookupError("no cycle has run yet")
        return self.last

    def top(self) -> DataFrame:
        """The opportunities to act on or watch of the last cycle, without new posts."""
        return actionable(self._last().scores, self.store.decisions())

    def top_new(self) -> DataFrame:
        return self.top().where("is_new and tier = 'do_now'")

    def verified(self, pages: DataFrame) -> DataFrame:
        """What to do now, with verifications: of those verified before what was stored, of the others what ``pages`` tell, which
        is stored. Those whose page is protected are told to the channels."""
        now = written(self.top().where("tier = 'do_now'"), "do-now")
        before = self.store.table("verifications")
        fresh = written(verify(now.join(before.select("opportunity_id"), "opportunity_id", "left_anti"), pages).where("checked"), "verified")
        rows = written(fresh.select([f.split()[0] for f in ST.SCHEMAS["verifications"].split(", ")]), "verifications")
        self.store.remember_verifications(rows)
        blocked = fresh.where("blocked").select("opportunity_id", blocked_notice().alias("notice")).limit(A.LIMIT).collect()
        for row in blocked:
            for channel in self.channels:
                channel("verification", row["notice"])
        return now.join(self.store.table("verifications"), "opportunity_id", "left")

    def detail(self, opportunity_id: str) -> str | None:
        scores = self._last().scores.where(F.col("opportunity_id") == opportunity_id)
        facts = self.store.table("verifications").where(F.col("opportunity_id") == opportunity_id).limit(1)
        first = self.store.table("opportunities").where(F.col("opportunity_id") == opportunity_id).select("opportunity_id", "first_seen")
        row = decide(scores).join(first, "opportunity_id", "left").join(facts, "opportunity_id", "left").select(detail()).first()
        return row[0] if row else None

    def record_decision(self, opportunity_id: str, action: str, score: float, at: datetime) -> None:
        self.store.record_decision(opportunity_id, action, score, at)

    def summary(self) -> str:
        rows = self.top().join(self.store.table("verifications"), "opportunity_id", "left")
        return run_summary(rows, self._last().signal_count, self._last().elapsed)

    def status(self) -> dict:
        found = {t: self.store.table(t).count() for t in ST.SCHEMAS}
        return found | ({"run_id": self.last.run_id, "alerts_sent": self.last.alerts_sent} if self.last else {})
