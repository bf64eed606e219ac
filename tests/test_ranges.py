"""Interval and as-of joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import catalog


def test_ranges_of_any_length(spark):
    deal = random.Random(1)
    values = [deal.uniform(-50, 1000) for _ in range(300)] + [0.0, 8.0, -1.0, None]
    ranges = [(lo := deal.choice([deal.uniform(-60, 900), float(deal.randint(-5, 20))]), lo + deal.choice([0, 0.3, 1, 2, 7.5, 64, 1500]), i) for i in range(400)] + [(5.0, 1.0, 900), (None, 3.0, 901), (3.0, None, 902)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    for unit in (1.0, 0.25, 40.0):
        got = catalog.assign_ranges(df, spark.createDataFrame(ranges, "lo double, hi double, name int"), "v", unit).select("id", "range.name").collect()
        want = [(i, n) for i, v in enumerate(values) for lo, hi, n in ranges if None not in (v, lo, hi) and lo <= v <= hi]
        assert sorted(map(tuple, got)) == sorted(want)
    assert catalog.assign_ranges(df, spark.createDataFrame([], "lo double, hi double"), "v").count() == 0


def test_very_many_ranges(spark):
    n = 100_000
    ranges = spark.range(n).select((F.col("id") * 7919 % 50_000).alias("lo"), (F.col("id") * 7919 % 50_000 + F.when(F.col("id") % 1000 == 0, 40_000).otherwise(F.col("id") % 5)).alias("hi"))
    pages = spark.range(0, 50_000, 97).withColumnRenamed("id", "page")
    got = dict(map(tuple, catalog.assign_ranges(pages, ranges).groupBy("page").count().collect()))
    ids = np.arange(n)
    lo = ids * 7919 % 50_000
    hi = lo + np.where(ids % 1000 == 0, 40_000, ids % 5)
    assert got == {p: c for p in range(0, 50_000, 97) if (c := int(((lo <= p) & (p <= hi)).sum()))}


def nearest(starts, v, slack):
    if v is None or not starts:
        return None
    left = [s for s in starts if s <= v + slack]
    return max(left) if left else min(starts, key=lambda s: (abs(s - v), s))


@pytest.mark.parametrize("slices", [1, 3, 64])
@pytest.mark.parametrize("slack", [0.0, 2.0])
def test_nearest_left_from_a_table(spark, slices, slack):
    deal = random.Random(slices)
    # one key holds most rows, one has no start, one has its starts far to the right
    items = [(i, deal.choice("hhhhhhabz"), deal.choice([None, deal.uniform(0, 100), float(deal.randint(0, 20)), 7.0])) for i in range(500)]
    starts = [("h", float(deal.randint(0, 90))) for _ in range(60)] + [("a", 5.0), ("a", 5.0), ("b", 1000.0), ("b", 900.0), ("a", None), ("y", 3.0)]
    got = catalog.assign_nearest_left(spark.createDataFrame(items, "id int, k string, v double"), spark.createDataFrame(starts, "k string, start double"), "v", "start", slack, ["k"], slices)
    want = sorted((i, k, v, nearest([s for x, s in starts if x == k and s is not None], v, slack)) for i, k, v in items if v is not None) + sorted((i, k, v, None) for i, k, v in items if v is None)
    assert sorted(map(tuple, got.where("v is not null").collect())) + sorted(map(tuple, got.where("v is null").collect())) == want
    alone = catalog.assign_nearest_left(spark.createDataFrame(items, "id int, k string, v double"), spark.createDataFrame(starts, "k string, start double"), "v", "start", slack, [], slices)
    every = [s for _, s in starts if s is not None]
    assert {r.id: r.start for r in alone.collect()} == {i: nearest(every, v, slack) for i, _, v in items}


def test_nearest_left_of_an_array(spark):
    df = spark.createDataFrame([(1.0,), (5.6,), (11.7,), (99.0,)], "v double")
    got = df.select(catalog.nearest_left("v", F.array(F.lit(5.0), F.lit(12.0), F.lit(40.0)), 0.5).alias("s")).collect()
    assert [r.s for r in got] == [5.0, 5.0, 12.0 if 11.7 + 0.5 >= 12 else 5.0, 40.0]
