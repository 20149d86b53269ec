import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowtide.operators import snapshot
from flowtide.operators.baseline import fit_seasonal_baseline, score_observations
from flowtide.sinks import writers
from flowtide.sources import landed

OBS = "countline_id string, date date, hour int, count double, transport_class string, direction string"
TARGET = dt.date(2026, 8, 6)


def history(directions=("SW", "NE")):
    first = dt.date(2026, 5, 14)
    return [("1", first + dt.timedelta(weeks=w), 8, 100.0, "Pedestrian", d) for w in range(12) for d in directions]


def frame(spark, *extra):
    return spark.createDataFrame([*history(), *extra], OBS)


CURRENT = ("1", TARGET, 8, 20.0, "Pedestrian", "SW")
FUTURE = ("1", dt.date(2026, 8, 13), 8, 1000.0, "Pedestrian", "SW")


@pytest.mark.parametrize("target", ["2026-08-06T08:00:00", "2026-08-06T08:00:00+12:00", "2026-08-05T20:00:00+00:00"])
def test_drop_gap_and_health(spark, target):
    s = snapshot.analyze_snapshot(frame(spark, CURRENT, FUTURE), target)
    row = s.candidates.collect()
    assert len(row) == 1
    assert (row[0].expected_count, row[0].history_samples, row[0].absolute_change, row[0].relative_change, row[0].change_direction, row[0].status, row[0].data_quality) == (100.0, 12, 80.0, 0.8, "decrease", "candidate", "complete")
    gaps = s.gaps.collect()
    assert [(g.direction, g.status) for g in gaps] == [("NE", "data_gap")]
    h = s.health.first().asDict()
    assert h == {"target_at": target, "publisher_mode": "batch replay", "observed_groups": 1, "expected_groups": 2, "data_gap_groups": 1, "candidate_count": 1, "insufficient_baseline_count": 0}


def test_no_history_is_not_zero_flow(spark):
    base = fit_seasonal_baseline(frame(spark))
    row = score_observations(spark.createDataFrame([("1", TARGET, 8, 5.0, "Pedestrian", "N")], OBS), base).first()
    assert row.expected_count is None and row.robust_z is None
    assert (row.status, row.data_quality, row.change_direction) == ("insufficient_baseline", "no_matching_history", "stable")


def test_null_keys_match(spark):
    rows = [("1", r[1], 8, 100.0, "Pedestrian", None) for r in history(("x",))]
    base = fit_seasonal_baseline(spark.createDataFrame(rows, OBS))
    row = score_observations(spark.createDataFrame([("1", TARGET, 8, 100.0, "Pedestrian", None)], OBS), base).first()
    assert (row.expected_count, row.status) == (100.0, "normal")


RAW = "_COL_0 long, _COL_1 date, _COL_2 decimal(4,0), _COL_3 decimal(8,0), _COL_4 string, _COL_5 string"


def test_normalize(spark):
    from decimal import Decimal

    raw = spark.createDataFrame([(47847, TARGET, Decimal(8), Decimal(0), "Pedestrian", "SW")], RAW)
    out = snapshot.normalize_mobility(raw)
    assert out.dtypes == [("countline_id", "string"), ("date", "date"), ("hour", "int"), ("count", "double"), ("transport_class", "string"), ("direction", "string")]
    assert out.first().asDict()["count"] == 0.0
    with pytest.raises(ValueError, match="duplicate observation key"):
        snapshot.normalize_mobility(raw.union(raw))
    with pytest.raises(ValueError, match="_COL_5"):
        snapshot.normalize_mobility(raw.drop("_COL_5"))


def test_shards_and_metadata(spark, tmp_path):
    from decimal import Decimal

    paths = []
    for i, (day, n) in enumerate([(dt.date(2026, 7, 31), 10), (dt.date(2026, 8, 3), 20), (dt.date(2026, 8, 7), 30)]):
        paths.append(str(tmp_path / f"s{i}"))
        spark.createDataFrame([(1, day, Decimal(8), Decimal(n), "Pedestrian", "SW")], RAW).write.parquet(paths[-1])
    kept = landed.load_parquet_shards(spark, paths, "2026-08-01", "2026-08-06")
    assert [r["count"] for r in kept.collect()] == [20.0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(_COL_1" in plan
    with pytest.raises(ValueError, match="duplicate"):
        landed.load_parquet_shards(spark, [*paths, paths[1]])
    (tmp_path / "m.csv").write_text("VIEWPOINT_ID,COUNTLINE_ID,NAME,LATITUDE_START_LINE,LONGITUDE_START_LINE,LATITUDE_END_LINE,LONGITUDE_END_LINE,DIRECTION_IN,DIRECTION_OUT,EARLIEST,LATEST\n007,0042,Cuba St,-41.1,174.1,-41.2,174.2,N,S,2024-01-01,2024-02-01\n")
    m = landed.load_metadata(spark, str(tmp_path / "m.csv"))
    assert m.first().COUNTLINE_ID == "0042"


def test_signal_contract(spark):
    s = snapshot.analyze_snapshot(frame(spark, CURRENT), "2026-08-06T08:00:00")
    meta = spark.createDataFrame([("7", "1", "Cuba St", -41.1, 174.1, -41.2, 174.2)], "VIEWPOINT_ID string, COUNTLINE_ID string, NAME string, LATITUDE_START_LINE double, LONGITUDE_START_LINE double, LATITUDE_END_LINE double, LONGITUDE_END_LINE double")
    features = writers.signal_features(s.candidates, meta, "2026-08-06")
    f = json.loads(features.first().feature)
    assert f["id"] == "movement:1:Pedestrian:SW:2026-08-06T08:00:00"
    assert f["geometry"]["coordinates"] == [[174.1, -41.1], [174.2, -41.2]]
    assert len(f["properties"]) == 21 and f["properties"]["signal_confidence"] == {"level": "high", "history_samples": 12, "basis": "matched weekday and hour"} and f["properties"]["limitations"] == writers.LIMITATIONS
    doc = json.loads(writers.collection(features, "movement-signal-collection/v1", "2026-08-06").first().document)
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 1
    health = json.loads(writers.health_document(s.health, "2026-08-06").first().document)
    assert health["observed_groups"] == 1 and health["source"] == "Wellington City Council Transport Sensors" and len(health["limitations"]) == 5
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="too many"):
        m.setattr(writers, "MOST_FEATURES", 0)
        writers.collection(features, "movement-signal-collection/v1", "2026-08-06")


def test_split(spark):
    rows = [(dt.datetime(2025, 8, 6, 23), 1), (dt.datetime(2025, 8, 7), 2), (dt.datetime(2026, 2, 6, 12), 3), (dt.datetime(2026, 2, 7), 4), (dt.datetime(2026, 8, 6), 5)]
    parts = snapshot.chronological_split(spark.createDataFrame(rows, "date timestamp_ntz, count int"), "2025-08-06", "2026-02-06", "2026-08-06")
    assert [sorted(r["count"] for r in p.collect()) for p in parts] == [[1], [2, 3], [4, 5]]
    with pytest.raises(ValueError):
        snapshot.chronological_split(spark.range(1).withColumn("date", F.current_date()), "2026-01-01", "2026-01-01", "2026-02-01")
