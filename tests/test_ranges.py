"""Windows over hot keys equal the plain ones, spread over all ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtide.operators import ranges


@pytest.fixture(scope="module")
def data(spark):
    """A key with half of all rows, null keys, keys of one row."""
    rng = random.Random(3)
    keys = ["hot"] * 2000 + [None] * 300 + [rng.choice("abcdef") for _ in range(700)] + [f"lone{i}" for i in range(200)]
    return spark.createDataFrame([(k, i % 7 if k else None, t, rng.choice([1.0, 2.0, None])) for i, (k, t) in enumerate(zip(keys, rng.sample(range(10**6), len(keys))))], "k string, j int, t long, v double").repartition(4)


@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
@pytest.mark.parametrize("parts", [1, 5, 64])
def test_lag_equals_the_window(data, keys, parts):
    w = Window.partitionBy(*keys).orderBy("t")
    want = data.withColumns({"before": F.lag("v").over(w), "at": F.lag("t").over(w)})
    got = ranges.lagged(data, keys, ["t"], {"before": "v", "at": "t"}, parts)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_lies_in_many_ranges(data):
    rows = ranges.in_ranges(data, ["k", "t"], 16)
    sizes = {r[ranges.PART]: r["count"] for r in rows.groupBy(ranges.PART).count().collect()}
    assert rows.where("k = 'hot'").select(ranges.PART).distinct().count() >= 8 and max(sizes.values()) < 500


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_equals_the_window(data, parts):
    got = ranges.ranked(data.where("k is not null"), ["k", "t"], "place", parts)
    want = data.where("k is not null").withColumn("place", F.row_number().over(Window.orderBy("k", "t")).cast("long"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, t long")
    assert ranges.lagged(empty, ["k"], ["t"], {"b": "t"}).count() == 0 and ranges.ranked(empty, ["t"], "n").count() == 0
