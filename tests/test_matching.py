"""Counts of matched windows and tagged episodes against their rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowtide.operators import detectors, joins, transit

TRUTH = "TRUTH_ID string, EPISODE_TYPE string, ROUTE_ID string, SERVICE_DATE date, WINDOW_START_LOCAL timestamp_ntz, WINDOW_END_LOCAL timestamp_ntz, ROUTE_SHORT_NAME string, MODE string, DURATION_MINS int, MAGNITUDE double, START_HOUR int"
FOUND = "ANOMALY_ID string, DETECTOR string, DETECTOR_NAME string, SERVICE_DATE date, ROUTE_ID string, WINDOW_START timestamp_ntz, SEVERITY string"


def tables(spark):
    rng, days = random.Random(5), [dt.date(2026, 4, 1), dt.date(2026, 4, 2), None]
    at = lambda: dt.datetime(2026, 4, 1, 0) + dt.timedelta(minutes=15 * rng.randrange(0, 200))
    route = lambda: rng.choice(["R1", "R1", "R2", None])
    found = [(f"a{i % 500}", code := rng.choice(["D01", "D02", "D09"]), code.lower(), rng.choice(days), route(), rng.choice([None] + [at() for _ in range(9)]), rng.choice(["LOW", "HIGH", "NONE"])) for i in range(600)]
    truth = []
    for i in range(60):
        begin, mins = at(), rng.choice([-60, -30, 0, 30, 75, 2000])
        truth.append((rng.choice([None] + [f"t{i}"] * 5 + ["twice"]), rng.choice(["crash", "slip"]), route(), rng.choice(days), begin, begin + dt.timedelta(minutes=mins), "1", "BUS", mins, 1.0, rng.choice([None, -1, begin.hour, begin.hour])))
    return spark.createDataFrame(found, FOUND), spark.createDataFrame(truth, TRUTH)


def test_counts_equal_the_rows(spark):
    found, truth = tables(spark)
    rows = [tuple(r) for r in joins.match_windows(found, truth).select("ANOMALY_ID", "DETECTOR", "SERVICE_DATE", "ROUTE_ID", "WINDOW_START", "TRUTH_ID").collect()]
    pairs, slack = truth.collect(), dt.timedelta(minutes=15)
    brute = []
    for f in found.where("SEVERITY <> 'NONE'").collect():
        hits = [t.TRUTH_ID for t in pairs if f.SERVICE_DATE and f.WINDOW_START and t.SERVICE_DATE == f.SERVICE_DATE and (f.ROUTE_ID is None or f.ROUTE_ID == t.ROUTE_ID) and t.WINDOW_START_LOCAL - slack <= f.WINDOW_START <= t.WINDOW_END_LOCAL + slack]
        brute += [(*tuple(f)[:2], *tuple(f)[3:6], t) for t in hits or [None]]
    assert sorted(rows, key=str) == sorted(brute, key=str) and len({r[-1] for r in rows}) > 10
    matched = joins.match_windows(found, truth)
    counts, fired = joins.match_counts(found, truth)
    assert sorted(map(str, detectors.counted_scorecard(counts, fired, found, truth).collect())) == sorted(map(str, detectors.scorecard(matched, truth).collect()))
    assert sorted(map(str, detectors.recall_by_type(fired, truth).collect())) == sorted(map(str, detectors.recall_by_type(matched, truth).collect()))
    assert sorted(map(str, detectors.missed_episodes(fired, truth).collect())) == sorted(map(str, detectors.missed_episodes(matched, truth).collect()))
    assert detectors.counted_headline(counts, fired, found, truth, found, found).collect() == detectors.headline(matched, found, truth, found, found).collect()


def test_counts_make_no_row_for_each_match(spark):
    """2,000 detections in 500 windows are a million matches, and a line of 5 begins, 500 begins and 500 ends, each also without a route."""
    t = dt.datetime(2026, 4, 1, 8)
    found = spark.range(2000).select(F.col("id").cast("string").alias("ANOMALY_ID"), F.lit("D01").alias("DETECTOR"), F.lit("x").alias("DETECTOR_NAME"), F.lit(t).cast("date").alias("SERVICE_DATE"), F.lit("R1").alias("ROUTE_ID"), (F.lit(t).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 5).cast("int"))).alias("WINDOW_START"), F.lit("LOW").alias("SEVERITY"))
    truth = spark.createDataFrame([(f"t{i}", "crash", "R1", t.date(), t - dt.timedelta(seconds=i), t + dt.timedelta(minutes=9), "1", "BUS", 9, 1.0, 8) for i in range(500)], TRUTH)
    made, write = [], joins.materialized
    try:
        joins.materialized = lambda df, name: made.append(out := write(df, name)) or out
        counts, fired = joins.match_counts(found, truth)
    finally:
        joins.materialized = write
    assert [tuple(r) for r in counts.collect()] == [("D01", "x", 1_000_000, 1_000_000)] and fired.count() == 500
    assert max(m.count() for m in made) <= 1000


def test_tagged_trips_count_the_rows(spark):
    _, truth = tables(spark)
    rng = random.Random(6)
    events = spark.createDataFrame([(f"x{i % 40}", rng.choice(["R1", "R2", "R3", None]), dt.date(2026, 4, rng.choice([1, 2])), rng.choice([None, *range(24)])) for i in range(800)], "TRIP_INSTANCE_ID string, ROUTE_ID string, SERVICE_DATE date, SCHED_HOUR int")
    tagged = joins.tag_episodes(events, truth)
    pairs, brute = truth.collect(), []
    for e in events.collect():
        hits = [t.TRUTH_ID for t in pairs if e.ROUTE_ID and e.ROUTE_ID == t.ROUTE_ID and e.SERVICE_DATE == t.SERVICE_DATE and None not in (t.START_HOUR, e.SCHED_HOUR) and t.START_HOUR <= e.SCHED_HOUR < t.START_HOUR + -(-t.DURATION_MINS // 60)]
        brute += [(*e, t) for t in hits or [None]]
    assert sorted(map(str, (tuple(r) for r in tagged.select(*events.columns, "TRUTH_ID").collect()))) == sorted(map(str, brute))
    assert sorted(map(str, transit.counted_coverage(joins.tagged_trips(events, truth)).collect())) == sorted(map(str, transit.episode_coverage(tagged).collect()))
