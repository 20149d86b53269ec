"""The layer over all feeds makes only what it reads."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtide.operators import detectors, transit
from flowtide.plans import adapters, registry

SF = "/root/testdata/sf0.001"
FACT = "TRIP_INSTANCE_ID string, STOP_SEQUENCE int, SERVICE_DATE date, ROUTE_ID string, ROUTE_SHORT_NAME string, DIRECTION_ID int, MODE string, STOP_ID string, STOP_NAME string, TIME_BAND string, DAY_TYPE string, SCHED_ARRIVAL_LOCAL timestamp_ntz, ACTUAL_ARRIVAL_LOCAL timestamp_ntz, ACTUAL_DEPARTURE_LOCAL timestamp_ntz, ARRIVAL_DELAY_SECS int, DWELL_SECS int, FREQUENCY_CLASS string, IS_OBSERVED boolean, IS_REPORTED boolean"


@pytest.fixture(scope="module")
def fact(spark):
    rng, rows = random.Random(3), []
    for i in range(3000):
        route, late, at = rng.randrange(6), rng.choice([None, *[rng.randrange(-60, 2000)] * 5]), dt.datetime(2024, 1, 5 + i % 3, rng.randrange(6, 20), rng.randrange(0, 60))
        held = rng.choice([None, *[rng.randrange(0, 300)] * 5])
        seen = at + dt.timedelta(seconds=late or 0)
        rows.append((f"t{i}", i % 9, at.date(), f"R{route}", str(route), rng.choice([None, 0, 1]), "BUS" if route < 4 else "RAIL", f"P{rng.randrange(5)}" if i % 50 else None, "stop", rng.choice(["AM", "PM"]), "WEEKDAY", at, seen, seen + dt.timedelta(seconds=held or 0), late, held, "FREQUENT", True, True))
    return spark.createDataFrame(rows, FACT).cache()


def told(df, columns=detectors.COLUMNS):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def test_delays_and_dwells_from_one_shuffle_equal_the_two_detectors(fact):
    want = detectors.delay_outliers(fact, transit.delay_baseline(fact), 1.5).unionByName(detectors.dwell_outliers(fact, transit.dwell_baseline(fact), 1.2))
    assert told(detectors.stop_outliers(fact, 1.5, 1.2)) == told(want) and {r.DETECTOR for r in want.collect()} == {"D01", "D05"}
    few = detectors.stop_outliers(fact, 1.5, 1.2, parts=7, columns=adapters.LAYER)
    assert told(few, adapters.LAYER) == told(want, adapters.LAYER)
    dealt = few._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count("RepartitionByExpression") == 1 and "TRIP_INSTANCE_ID" not in dealt.split("RepartitionByExpression")[1].split("LogicalRDD")[0].split("InMemoryRelation")[0]


def test_gaps_of_both_kinds_from_one_pass_equal_the_two_detectors(fact):
    h = transit.headways(fact)
    want = detectors.bunching(h).unionByName(detectors.gapping(h))
    assert told(detectors.headway_outliers(h)) == told(want) and {r.DETECTOR for r in want.collect()} == {"D02", "D03"}


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_the_layer_makes_no_table_of_all_detections_and_reads_one_that_is_there(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).symlink_to(SF)
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    points = told(df := registry.QUERIES["d21_points"](spark, first), df.columns)
    assert not {"detections", "headways", "motion", "bins"} & {name for _, folder, name in adapters._made if folder == first}
    registry.QUERIES["u04_all_detections"](spark, second).count()
    assert told(registry.QUERIES["d21_points"](spark, second), df.columns) == points != []


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_copies_of_an_observation_without_a_site_are_none(spark, tmp_path):
    for p in Path(SF).glob("*.parquet"):
        if p.stem != "lineitem":
            (tmp_path / p.name).symlink_to(p)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.unionByName(lines.withColumns({"l_suppkey": F.lit(-7).cast("long"), "l_partkey": F.lit(-1).cast("long")})).write.parquet(str(tmp_path / "lineitem.parquet"))
    days = lambda d: told(x := registry.QUERIES["d11_site_daily"](spark, d), x.columns)
    assert days(str(tmp_path)) == days(SF) != []
