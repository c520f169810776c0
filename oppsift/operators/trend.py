"""Growth of opportunities over their snapshots (opportunity_id, snapshot_at timestamp, signal_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.functions.scalars import hours_between

# Ratios of growth and lengths of series that decide.
FASTER, SLOWER, SIMPLE_FROM, SPLIT_FROM = 1.2, 0.5, 3, 5


def velocity(snapshots: DataFrame, by: str = "opportunity_id") -> DataFrame:
    """(by, velocity): signals an hour between the last two snapshots; null with fewer or without time between them."""
    w = W.partitionBy(by).orderBy("snapshot_at", "signal_count")
    steps = snapshots.select(by, "snapshot_at", "signal_count", F.lag("snapshot_at").over(w).alias("t0"), F.lag("signal_count").over(w).alias("c0"))
    last = steps.groupBy(by).agg(F.max_by(F.struct("snapshot_at", "signal_count", "t0", "c0"), F.struct("snapshot_at", "signal_count")).alias("x"))
    hours = hours_between(F.col("x.t0"), F.col("x.snapshot_at"))
    return last.select(by, F.when(hours > 0, (F.col("x.signal_count") - F.col("x.c0")) / hours).alias("velocity"))


def _kind(before: Column, after: Column) -> Column:
    ratio = F.try_divide(after.cast("double"), before.cast("double"))
    rising = F.when(after > 0, "accelerating").otherwise("steady")
    return F.when(before <= 0, rising).when(ratio >= FASTER, "accelerating").when(ratio <= SLOWER, "saturating").otherwise("steady")


def trend(snapshots: DataFrame, by: str = "opportunity_id") -> DataFrame:
    """(by, trend): accelerating, steady, saturating or insufficient_data.

    Under 3 snapshots, or with a null count, there is too little; up to 4 the last two differences are compared; from 5 on the
    slopes on both sides of the split into two level parts of least squared error, each of two points at least, the
    earliest on ties. Running sums give every split's error, so a series is one pass over its window.
    """
    order = W.partitionBy(by).orderBy("snapshot_at", "signal_count")
    run, whole = order.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(by)
    x = F.col("signal_count").cast("double")
    rows = snapshots.select(
        by, "snapshot_at", x.alias("x"), F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n"), F.count("signal_count").over(whole).alias("known"),
        F.sum(x).over(run).alias("s"), F.sum(x * x).over(run).alias("q"), F.sum(x).over(whole).alias("total"), F.sum(x * x).over(whole).alias("squares"),
        F.first(x).over(run).alias("head"), F.last(x).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("tail"),
        F.lead(x).over(order).alias("next"), F.lag(x, 1).over(order).alias("x1"), F.lag(x, 2).over(order).alias("x2"),
    )
    left, right = F.col("i"), F.col("n") - F.col("i")
    error = F.col("q") - F.col("s") * F.col("s") / left + (F.col("squares") - F.col("q")) - F.try_divide((F.col("total") - F.col("s")) * (F.col("total") - F.col("s")), right)
    rows = rows.withColumn("error", F.when((left >= 2) & (right >= 2), F.round(error, 6)))
    before = (F.col("x") - F.col("head")) / F.greatest(left - 1, F.lit(1))
    after = (F.col("tail") - F.col("next")) / F.greatest(right - 1, F.lit(1))
    found = rows.groupBy(by).agg(
        F.first("n").alias("n"), F.first("known").alias("known"),
        F.min_by(F.struct(before.alias("before"), after.alias("after")), F.when(F.col("error").isNotNull(), F.struct("error", "i"))).alias("split"),
        F.max_by(F.struct((F.col("x1") - F.col("x2")).alias("before"), (F.col("x") - F.col("x1")).alias("after")), "i").alias("last"),
    )
    few = (F.col("n") < SIMPLE_FROM) | (F.col("known") < F.col("n"))
    simple, split = _kind(F.col("last.before"), F.col("last.after")), _kind(F.col("split.before"), F.col("split.after"))
    return found.select(by, F.when(few, "insufficient_data").when(F.col("n") < SPLIT_FROM, simple).otherwise(split).alias("trend"))
