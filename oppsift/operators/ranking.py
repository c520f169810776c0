"""Ranks over whole tables, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.checkpoints import written


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their number from 1 among those of equal ``by``, in the given order, which must leave no ties.

    Rows are parted by ranges of the order and numbered in each part; only how many of each kind a part has meets in one place.
    """
    parts = written(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("part", *by).agg(F.count("*").alias("size"))
    # a row for each part and kind
    before = sizes.withColumn("before", F.sum("size").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)) if by else F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    found = parts.join(F.broadcast(before.drop("size")), ["part", *by]).withColumn(name, F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy("part", *by).orderBy(*order)))
    return found.drop("part", "before")
