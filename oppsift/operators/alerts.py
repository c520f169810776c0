"""Which opportunities to report, and the record of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oppsift.functions.scalars import hours_between

THRESHOLD, LIMIT, COOLDOWN_HOURS, SCORE_DELTA = 0.30, 5, 24.0, 0.05


def eligible(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.where((F.col("opportunity_score") >= threshold) | (F.col("before_viral_score") >= threshold))


def cooled_down(scores: DataFrame, history: DataFrame, as_of: Column, hours: float = COOLDOWN_HOURS, delta: float = SCORE_DELTA) -> DataFrame:
    """scores never reported, reported ``hours`` ago, or moved by ``delta`` since. history: opportunity_id, last_alerted_at, last_alerted_score."""
    past = history.select("opportunity_id", "last_alerted_at", "last_alerted_score")
    free = F.col("last_alerted_at").isNull() | (hours_between(F.col("last_alerted_at"), as_of) >= hours) | (F.abs(F.col("opportunity_score") - F.col("last_alerted_score")) >= delta)
    return scores.join(past, "opportunity_id", "left").where(free).drop("last_alerted_at", "last_alerted_score")


def top(scores: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best by the greater of both scores; a report of the top ``limit`` is what it is for."""
    return scores.orderBy(F.desc(F.greatest("opportunity_score", "before_viral_score")), "cluster_id").limit(limit)


def title() -> Column:
    return F.format_string("opportunity (%s, opp_score=%s, risk=%s)", "trend", F.col("opportunity_score").cast("string"), "risk_level")


def alert_records(alerts: DataFrame, sent_at: Column) -> DataFrame:
    """One JSON object for each alert: when, title, a body of at most 180 characters and the whole score."""
    body = F.substring("representative_text", 1, 180)
    rest = [c for c in alerts.columns if c not in ("sent_at", "title", "body")]
    return alerts.select(F.to_json(F.struct(sent_at.alias("sent_at"), title().alias("title"), body.alias("body"), *rest)).alias("value"))


def append_log(alerts: DataFrame, path: str, sent_at: Column) -> None:
    alert_records(alerts, sent_at).coalesce(1).write.mode("append").text(path)


def notify(alerts: DataFrame, channels: list[Callable[[str, str], None]], limit: int = LIMIT) -> list[Row]:
    """Sends title and body of the few alerts to each channel from the driver; a channel that fails does not stop the rest."""
    sent = alerts.select("*", title().alias("title"), F.substring("representative_text", 1, 180).alias("body")).limit(limit).collect()
    for row in sent:
        for channel in channels:
            try:
                channel(row["title"], row["body"])
            except Exception as e:  # noqa: BLE001  a channel is foreign code
                print(f"notification failed: {e}")
    return sent
