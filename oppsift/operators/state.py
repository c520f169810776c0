"""What is remembered between runs: tables in a folder, each version of which is written whole before it counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.manifests import Manifests, Taken
from oppsift.operators.clusters import engagement

SCHEMAS = {
    "opportunities": "opportunity_id string, first_seen timestamp, last_seen timestamp, representative_text string, representative_url string, entities array<string>, first_run string",
    "signals": "opportunity_id string, run_id string, key string, source string, source_id string, url string, canonical_url string, author string, published_at string, title string, text string, engagement string, subreddit string, content_hash string",
    "snapshots": "opportunity_id string, run_id string, snapshot_at timestamp, signal_count bigint, new_signal_count bigint, unique_authors bigint, platforms array<string>, total_engagement bigint",
    "totals": "opportunity_id string, run_id string, signals bigint, authors bigint",
    "authors": "opportunity_id string, author string",
    "alert_history": "opportunity_id string, last_alerted_at timestamp, last_alerted_score double",
    "decisions": "opportunity_id string, action string, decided_at timestamp, score_at_decision double",
    "verifications": "opportunity_id string, checked boolean, blocked boolean, official_url string, deadline_text string, prize_text string, note string",
}

#: Of a table with more parts than this, the oldest half become one when the next part comes.
PARTS = 64


class Busy(Exception):
    """Another run has changed the tables that this one read and would replace."""


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key: the last write wins."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in rows.columns if c not in (key, at))))).where("n = 1").drop("n")


def new_signals(members: DataFrame, signals: DataFrame) -> DataFrame:
    """members not yet stored, by key."""
    return members.join(signals.select("key"), "key", "left_anti")


def added_authors(added: DataFrame, authors: DataFrame) -> DataFrame:
    """The distinct (opportunity_id, author) of new signals that are not in ``authors``, which has each pair once."""
    return added.where("author is not null").select("opportunity_id", "author").distinct().join(authors, ["opportunity_id", "author"], "left_anti")


def added_totals(added: DataFrame, pairs: DataFrame, run_id: str) -> DataFrame:
    """What a run adds to the totals: for each opportunity its new signals and its new authors, ``pairs``."""
    new = added.groupBy("opportunity_id").agg(F.count("*").alias("signals"))
    seen = pairs.groupBy("opportunity_id").agg(F.count("*").alias("authors"))
    return new.join(seen, "opportunity_id", "left").select("opportunity_id", F.lit(run_id).alias("run_id"), "signals", F.coalesce("authors", F.lit(0)).cast("bigint").alias("authors"))


def snapshot(members: DataFrame, totals: DataFrame, new: DataFrame, run_id: str, at) -> DataFrame:
    """One row for each opportunity of the run: signals and authors of all runs, platforms and engagement of this one.

    members: the run's signals with opportunity_id; totals: what earlier runs have added; new: what this run adds. So what is
    counted are the run's own signals, and a row for each earlier run that added to one of its opportunities, not the
    signals stored.
    """
    now = members.groupBy("opportunity_id").agg(F.array_sort(F.collect_set("source")).alias("platforms"), F.sum(engagement()).alias("total_engagement"))
    both = totals.join(now.select("opportunity_id"), "opportunity_id", "left_semi").select("opportunity_id", "signals", "authors", F.lit(0).cast("bigint").alias("now"))
    both = both.unionByName(new.select("opportunity_id", "signals", "authors", F.col("signals").alias("now")))
    sums = both.groupBy("opportunity_id").agg(F.sum("signals").alias("signal_count"), F.sum("now").alias("new_signal_count"), F.sum("authors").alias("unique_authors"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("signal_count", "new_signal_count", "unique_authors")]
    return now.join(sums, "opportunity_id", "left").select("opportunity_id", F.lit(run_id).alias("run_id"), at.alias("snapshot_at"), *counts, "platforms", "total_engagement")


class Store:
    """Tables in a folder (a URI Spark can write). A version is a numbered manifest that names the parts of each table and the run
    that made each part; it is published whole or not at all, so a reader sees a whole run or nothing of it.

    What is added comes to whatever others have added meanwhile. What is replaced must be as it was read: of two runs that replace
    one table the second fails with Busy and leaves no trace. A run that is repeated takes the place of its first attempt.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Manifests(spark, folder)

    def version(self) -> dict[str, list[list[str]]]:
        """The parts of each table, [folder, run]."""
        found = self.versions.latest()[1]
        return {t: found.get(t, []) for t in SCHEMAS}

    def table(self, name: str, without_run: str | None = None, version: dict | None = None) -> DataFrame:
        """A table, perhaps without what one run has added."""
        parts = [p for p, run in (version or self.version())[name] if run is None or run != without_run]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder}/{p}" for p in parts))

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.select([F.col(f.split()[0]) for f in SCHEMAS[name].split(", ")]).write.parquet(f"{self.folder}/{part}")
        return part

    def publish(self, changes: dict[str, tuple[str, DataFrame]], run_id: str | None = None, base: dict | None = None) -> None:
        """changes: table to ("append" or "replace", rows). base: the version that the rows of replaced tables were made from."""
        parts = {name: (mode, self._write(name, rows)) for name, (mode, rows) in changes.items()}
        while True:
            number, now = self.versions.latest()
            version = {t: now.get(t, []) for t in SCHEMAS}
            for name, (mode, part) in parts.items():
                if mode == "replace" and base is not None and version[name] != base[name]:
                    raise Busy(f"{name} has changed since this run began")
                kept = [p for p in version[name] if run_id is None or p[1] != run_id] if mode == "append" else []
                if len(kept) > PARTS:
                    half = PARTS // 2 + 1
                    old, kept = kept[:half], kept[half:]
                    kept.insert(0, [self._write(name, self.table(name, version={name: old})), None])
                version[name] = [*kept, [part, run_id]]
            try:
                return self.versions.publish(number + 1, version)
            except Taken:  # another writer came first: look again
                continue

    def decisions(self) -> DataFrame:
        return latest(self.table("decisions"), "opportunity_id", "decided_at")

    def alert_history(self) -> DataFrame:
        return latest(self.table("alert_history"), "opportunity_id", "last_alerted_at")

    def record_decision(self, opportunity_id: str, action: str, score: float, at) -> None:
        row = self.spark.createDataFrame([(opportunity_id, action, at, float(score))], SCHEMAS["decisions"])
        self.publish({"decisions": ("append", row)})

    def mark_alerted(self, alerts: DataFrame, at) -> None:
        rows = alerts.select("opportunity_id", at.alias("last_alerted_at"), F.col("opportunity_score").alias("last_alerted_score"))
        self.publish({"alert_history": ("append", rows)})

    def remember_verifications(self, rows: DataFrame) -> None:
        self.publish({"verifications": ("append", rows)})

    def first_seen(self, opportunity_id: str):
        row = self.table("opportunities").where(F.col("opportunity_id") == opportunity_id).select("first_seen").first()
        return row[0] if row else None
