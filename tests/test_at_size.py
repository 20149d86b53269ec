"""Faults that show only on tables larger than the smallest."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtide.operators import baseline, detectors
from flowtide.plans import registry, scale

SF = "/root/testdata/sf0.001"


def test_a_median_just_below_zero_keeps_its_sign_in_the_detail(spark):
    t, keys = dt.datetime(2024, 1, 5, 8), ("c", "WEEKDAY", "BUS")
    bins = spark.createDataFrame([(*keys, t.date(), t, 500.0, 8, 3)], "CELL_ID string, DAY_TYPE string, MODE string, SERVICE_DATE date, SCHED_BIN_15MIN timestamp_ntz, MED_DELAY_SECS double, TRIPS long, ROUTES long")
    base = spark.createDataFrame([(*keys, 8, -0.25, 15.0)], "CELL_ID string, DAY_TYPE string, MODE string, BIN_HOUR int, MED_CELL_DELAY double, SIGMA_CELL double")
    assert detectors.cluster_shocks(bins, base).first().DETAIL == "cell median delay 500.0s vs baseline -0.0s across 8 trips on 3 routes"


def test_distinct_rollup_is_exact_beyond_the_entries_of_a_sketch(spark, monkeypatch):
    n = 120_000
    i = F.col("id")
    events = spark.range(n).select(F.lit("R1").alias("ROUTE_ID"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 7).cast("int")).alias("SERVICE_DATE"), (i % 60_000).cast("string").alias("TRIP_INSTANCE_ID"), (i % 30_001).cast("string").alias("STOP_ID"))
    monkeypatch.setattr(scale.A, "fact", lambda s, d: events)
    days = [(x % 7 >= 5, x % 60_000, x % 30_001) for x in range(n)]
    want = {w: (len({t for k, t, _ in days if k == w}), len({p for k, _, p in days if k == w})) for w in (False, True)}
    assert {r.is_weekend: (r.trips, r.stops) for r in registry.QUERIES["a07_distinct_rollup"](spark, "x").collect()} == want


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_every_page_of_an_array_feed_is_a_file(spark, tmp_path):
    for p in Path(SF).glob("*.parquet"):
        if p.stem != "supplier":
            (tmp_path / p.name).symlink_to(p)
    spark.range(5000).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    assert {r.feed: r.n for r in registry.QUERIES["q12_feed_counts"](spark, str(tmp_path)).collect()}["array"] == 5000


def test_baseline_of_many_groups_equals_the_plain_one(spark):
    rows = spark.range(3000).select((F.col("id") % 400).alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 2).cast("int")).alias("b"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 1000).cast("int")).alias("v"))
    got, want = (sorted(map(str, baseline.robust_baseline(rows, ["a", "b"], "v", 3, {"p": 0.95}, many=m).collect())) for m in (True, False))
    assert got == want and len(got) > 300
