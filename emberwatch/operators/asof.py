"""As-of lookup: the last change at or before each row's time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.operators.skew import join_lookup
from emberwatch.settings import DEFAULTS, Settings


def last_change(
    rows: DataFrame, time: str, changes: DataFrame, change: str, out: str, conf: Settings = DEFAULTS
) -> DataFrame:
    """``rows`` with ``out``: the latest ``change`` that is not after ``time``; null without one, or without a time.

    Up to ``conf.broadcast_rows`` distinct changes travel to the tasks, and rows are not shuffled. Otherwise
    both sides are reduced to distinct moments and merged in ranges of time. A range holds about as many moments as
    any other, wherever changes or rows crowd, and is sorted by itself; what it needs from earlier ranges is one
    moment, the last change before it. No group of changes is collected then, and equal times count once."""
    told = cut(changes.select(F.unix_micros(change).alias("moment")).where("moment IS NOT NULL").distinct())
    if told.count() <= conf.broadcast_rows:
        return rows.withColumn(out, F.timestamp_micros(_looked_up(told, F.unix_micros(time))))
    ranges = cut(
        _moments(rows, time, changes, change).repartitionByRange("moment").withColumn("range", F.spark_partition_id())
    )
    so_far = Window.partitionBy("range").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.max("changed").over(so_far), F.col("carried"))
    merged = ranges.join(F.broadcast(_carried(ranges)), "range").select("moment", "asked", found.alias(out))
    answers = cut(merged.where("asked").select(F.col("moment").alias(time), out))
    return join_lookup(rows, answers, time, "left", conf)


def _looked_up(moments: DataFrame, time: Column) -> Column:
    """The last of few ``moments`` at or before ``time``, both in microseconds."""
    known = np.sort(moments.toArrow().column("moment").to_numpy())  # few, as counted
    shared = moments.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("bigint")
    def last(at: pa.Array) -> pa.Array:
        if not len(shared.value):
            return pa.nulls(len(at), pa.int64())
        found = np.searchsorted(shared.value, at.fill_null(0).to_numpy(), "right") - 1
        none = at.is_null().to_numpy(zero_copy_only=False) | (found < 0)
        return pa.array(shared.value[np.maximum(found, 0)], mask=none)

    return last(time)


def _moments(rows: DataFrame, time: str, changes: DataFrame, change: str) -> DataFrame:
    """``(moment, asked, changed)``: every distinct time, whether a row asks about it, and itself if it is a change."""
    asked = rows.select(F.col(time).alias("moment"), F.lit(True).alias("asked"), F.lit(None).cast("timestamp").alias("changed"))
    told = changes.select(F.col(change).alias("moment"), F.lit(False).alias("asked"), F.col(change).alias("changed"))
    both = asked.unionByName(told).where("moment IS NOT NULL")
    return both.groupBy("moment").agg(F.max("asked").alias("asked"), F.max("changed").alias("changed"))


def _carried(ranges: DataFrame) -> DataFrame:
    """``(range, carried)``: the last change before each range. One row per shuffle partition, however long the history."""
    ends = ranges.groupBy("range").agg(F.min("moment").alias("start"), F.max("changed").alias("last"))
    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("range", F.max("last").over(before).alias("carried"))
