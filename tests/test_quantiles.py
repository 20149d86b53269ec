"""Exact quantiles of groups of any size, and sketches within their stated errors."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowtide.operators import quantiles

PROBS = {"q0": 0.0, "q1": 0.25, "med": 0.5, "p95": 0.95, "top": 1.0}


def plain(df, keys, value):
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile(value, F.lit(p)).alias(k) for k, p in PROBS.items()])


def rows_of(df):
    return sorted(([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def data(spark):
    """One group with nearly all rows; values over 600 powers of ten, ties, one value only, nulls and a null key."""
    rng = random.Random(9)
    rows = [("hot", rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300)) for _ in range(6000)] + [("ties", float(rng.choice([1, 1, 1, 2, 5]))) for _ in range(4000)]
    rows += [("one", 7.5)] * 2500 + [("few", float(i)) for i in range(5)] + [(None, float(i % 50)) for i in range(3000)] + [("hot", None), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("gathered", [100, 700, 1 << 20])
def test_equal_to_percentile(data, gathered):
    got = quantiles.exact_quantiles(data, ["k"], "v", PROBS, gathered)
    assert rows_of(got) == rows_of(plain(data, ["k"], "v"))


def test_no_task_gathers_more_than_it_may(spark, monkeypatch):
    """One group of all rows: what is collected for sorting stays below the bound, in passes that each leave less than a fifth."""
    n, seen = 200_000, []
    real = F.collect_list
    df = spark.range(n).select(F.lit("all").alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    write = quantiles.materialized

    def watched(out, name):
        got = write(out, name)
        if name == "open-ranks":
            seen.append([r.inside for r in got.select("inside").collect()])
        return got

    monkeypatch.setattr(quantiles, "materialized", watched)
    got = quantiles.exact_quantiles(df, ["k"], "v", {"med": 0.5, "p9": 0.9}, 500).first()
    want = df.agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.9))).first()
    assert (got.med, got.p9) == tuple(want) and got.n == n
    assert max(seen[-1], default=0) <= 500 and all(max(b, default=0) <= max(a) / 5 for a, b in zip(seen, seen[1:]))
    assert real is F.collect_list


def test_median_and_mad_of_a_hot_group(spark, data):
    got = {r.k: (r.median, r.mad) for r in quantiles.exact_median_mad(data.where("k in ('ties', 'few', 'one') or k is null"), ["k"], "v", 300).collect()}
    values = {}
    for r in data.where("k in ('ties', 'few', 'one') or k is null").collect():
        values.setdefault(r.k, []).append(r.v)
    for k, v in values.items():
        m = statistics.median(v)
        assert got[k] == (m, statistics.median(abs(x - m) for x in v))


def test_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert quantiles.exact_quantiles(empty, ["k"], "v", PROBS).count() == 0


def test_merged_sketches_keep_their_error(spark):
    """A month of daily sketches, merged: ranks within the stated error of the exact ones."""
    df = spark.range(300_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("site"), (F.abs(F.xxhash64("id")) % 100_000).cast("double").alias("v"))
    daily = quantiles.quantile_sketches(df, ["site", "day"], "v")
    month = quantiles.sketched_quantiles(quantiles.merged_sketches(daily, ["site"]), {"med": 0.5, "p9": 0.9})
    for r in month.collect():
        own = df.where(F.col("site") == r.site)
        ranks = own.agg(F.count("*").alias("n"), F.count_if(F.col("v") <= r.med).alias("a"), F.count_if(F.col("v") <= r.p9).alias("b")).first()
        assert r.n == ranks.n and abs(ranks.a / ranks.n - 0.5) <= quantiles.RANK_ERROR and abs(ranks.b / ranks.n - 0.9) <= quantiles.RANK_ERROR
    assert daily.select(F.max(F.octet_length("sketch"))).first()[0] < 8_000


def test_distinct_counts_roll_up(spark):
    df = spark.range(200_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("route"), F.concat(F.lit("t"), F.col("id") % 40_000).alias("trip"))
    daily = quantiles.distinct_sketches(df, ["route", "day"], "trip")
    month = {r.route: r.trips for r in quantiles.distinct_over(daily, ["route"], "trips").collect()}
    week = {r.route: r.trips for r in quantiles.distinct_over(daily.where("day < 7"), ["route"], "trips").collect()}
    for route in (0, 1):
        own = df.where(F.col("route") == route)
        assert abs(month[route] / own.select("trip").distinct().count() - 1) <= quantiles.THETA_ERROR
        assert abs(week[route] / own.where("day < 7").select("trip").distinct().count() - 1) <= quantiles.THETA_ERROR
    few = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert {r.k: r.n for r in quantiles.distinct_over(quantiles.distinct_sketches(few, ["k"], "v"), ["k"], "n").collect()} == {1: 2, 2: 0}
