import bisect
import random

import pytest
from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.operators.asof import last_change

BASE = 1_704_067_200_000_000


def times(spark, name, micros):
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(micros)], "id bigint, m bigint")
    return frame.select("id", F.timestamp_micros(F.col("m") + BASE).alias(name))


def answers(frame):
    return {r["id"]: r["m"] for r in frame.select("id", (F.unix_micros("last") - BASE).alias("m")).collect()}


@pytest.mark.parametrize("conf", [Settings(), Settings(broadcast_rows=2)])
def test_equals_bisection(spark, conf):
    rnd = random.Random(5)
    changed = sorted(rnd.choices(range(1000), k=150)) + [None, None]
    asked = [rnd.randrange(-20, 1020) for _ in range(400)] + [7] * 200 + [None]
    got = answers(last_change(times(spark, "at", asked), "at", times(spark, "change", changed), "change", "last", conf))
    known = [c for c in changed if c is not None]

    def want(t):
        at = bisect.bisect_right(known, t) if t is not None else 0
        return known[at - 1] if at else None

    assert got == {i: want(t) for i, t in enumerate(asked)}


def test_many_changes_in_one_minute(spark):
    changes = spark.range(100_000).select(F.timestamp_micros(F.col("id") * 600 + BASE).alias("change"))
    asked = [-1, 0, 599, 600, 30_000_001, 59_999_400, 59_999_999, 10**12]
    got = answers(last_change(times(spark, "at", asked), "at", changes, "change", "last"))
    assert got == {i: min(t // 600, 99_999) * 600 if t >= 0 else None for i, t in enumerate(asked)}


def test_no_changes_and_no_rows(spark):
    some, none = times(spark, "at", [1, 2]), times(spark, "change", []).select("change")
    assert answers(last_change(some, "at", none, "change", "last")) == {0: None, 1: None}
    assert last_change(some.where("id < 0"), "at", none, "change", "last").count() == 0
