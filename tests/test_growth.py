"""What a task holds, and the rows that are shuffled, do not grow with a group or a table."""

import datetime as dt

from pyspark.sql import functions as F

from flowtide.operators import detectors, quantiles, transit
from flowtide.plans import adapters


def test_summary_selects_medians_of_large_groups(spark):
    i = F.col("id")
    found = spark.range(6000).select(F.concat(F.lit("D0"), i % 2).alias("DETECTOR"), F.when(i % 2 > 0, "x").alias("DETECTOR_NAME"), F.when(i % 7 > 0, "HIGH").otherwise("NONE").alias("SEVERITY"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 14).cast("int")).alias("SERVICE_DATE"), F.when(i % 11 > 0, i % 20).cast("string").alias("ROUTE_ID"), F.when(i % 13 > 0, i * 7919 % 5003 / 100).alias("SCORE"))
    want = found.where("SEVERITY <> 'NONE'").groupBy("DETECTOR", "DETECTOR_NAME", "SEVERITY").agg(F.count("*"), F.countDistinct("SERVICE_DATE"), F.countDistinct("ROUTE_ID"), F.round(F.median("SCORE"), 2))
    assert sorted(map(tuple, detectors.anomaly_summary(found, 50).collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_a_group_are_counted_by_value(spark):
    rows = spark.range(5000).select(F.lit("BUS").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 9).alias("v"))
    got = {r.v: r.n for r in quantiles.value_counts(rows, ["k"], "v", "n").collect()}
    assert len(got) == 9 and sum(got.values()) == 4000


def test_bins_are_counted_without_a_row_for_each_count(spark):
    i, day = F.col("id"), dt.date(2024, 1, 5)
    fact = spark.range(4000).select(F.lit(day).alias("SERVICE_DATE"), F.lit("WEEKDAY").alias("DAY_TYPE"), F.when(i % 3 > 0, "BUS").alias("MODE"), F.concat(F.lit("R"), i % 7).alias("ROUTE_ID"), (i % 90).cast("string").alias("TRIP_INSTANCE_ID"), (i % 5).cast("string").alias("CELL"), F.lit(dt.datetime(2024, 1, 5, 8)).alias("SCHED_BIN_15MIN"), F.when(i % 17 > 0, (i * 7919 % 601).cast("int")).alias("ARRIVAL_DELAY_SECS"), F.lit(-41.0).alias("STOP_LAT"), F.lit(174.0).alias("STOP_LON"))
    got = transit.spatial_bins(fact, F.col("CELL"), 5)
    want = fact.where("ARRIVAL_DELAY_SECS is not null").groupBy("CELL", "MODE").agg(F.count("*"), F.countDistinct("ROUTE_ID"), F.countDistinct("TRIP_INSTANCE_ID"), F.median("ARRIVAL_DELAY_SECS"), F.percentile("ARRIVAL_DELAY_SECS", F.lit(0.9)))
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(got.select("CELL_ID", "MODE", "STOP_EVENTS", "ROUTES", "TRIPS", "MED_DELAY_SECS", "P90_DELAY_SECS").collect()) == key(want.collect())
    assert "Expand" not in got._jdf.queryExecution().toString()


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    spark.range(12_345).write.parquet(str(tmp_path / "t.parquet"))
    assert adapters.dealt(spark, str(tmp_path), "t") == 124
