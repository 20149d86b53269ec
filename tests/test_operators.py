import datetime as dt
import json
import random
import statistics

from pyspark.sql import functions as F

from flowtide.functions import columns as C
from flowtide.operators import boards, detectors, joins, rollup, transit
from flowtide.operators.baseline import leave_one_out_ratio
from flowtide.operators.nearest import nearest
from flowtide.sinks import writers
from flowtide.sources import landed
from flowtide.streaming import jobs


def ask(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first().asDict()


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_traps(spark):
    got = ask(
        spark, boundary=C.minutes_between(at("2026-01-01 00:00:59"), at("2026-01-01 00:01:01")), week=C.week_of_month(F.lit("2026-04-08").cast("date")), sunday=C.iso_dow(F.lit("2026-04-05").cast("date")),
        street=C.street_of(F.lit("S12 Cuba Street Crossing north")), bare=C.street_of(F.lit("Road")), late=C.service_seconds(F.lit("25:10:00")), bad=C.service_seconds(F.lit("x")), times=C.tolerant_utc(F.lit("2026-01-02 03:04Z")).cast("long"),
        status=C.status_name(F.lit("Canceled")), unknown=C.status_name(F.lit("")), gate=C.status_name(F.lit("Gate Closed")), incident=C.status_name(F.lit("incident")), other=C.status_name(F.lit("on-stand 2b")), grid=C.grid_id(F.lit(-41.3), F.lit(174.8052)), cell=C.cell_id(F.lit(-41.2849), F.lit(174.7)), band=C.punctuality(F.lit(-60)), quarter=F.date_format(C.quarter_hour(at("2026-01-01 10:44:59")), "HH:mm"),
    )
    assert got == {"boundary": 1, "week": 2, "sunday": 7, "street": "Cuba Street", "bare": "Road", "late": 90600, "bad": None, "times": 1767323040, "status": "Cancelled", "unknown": "Unknown", "gate": "Boarding", "incident": "Incident", "other": "On-Stand 2B", "grid": "-41.3,174.81", "cell": "-41.28_174.70", "band": "ON_TIME", "quarter": "10:30"}


TRUTH = "TRUTH_ID string, EPISODE_TYPE string, ROUTE_ID string, SERVICE_DATE date, WINDOW_START_LOCAL timestamp_ntz, WINDOW_END_LOCAL timestamp_ntz, ROUTE_SHORT_NAME string, MODE string, DURATION_MINS int, MAGNITUDE double"
FOUND = "ANOMALY_ID string, DETECTOR string, DETECTOR_NAME string, SERVICE_DATE date, ROUTE_ID string, WINDOW_START timestamp_ntz, SEVERITY string"


def test_windows_match_with_and_without_route(spark):
    day, t = dt.date(2026, 4, 1), lambda h, m=0: dt.datetime(2026, 4, 1, h, m)
    rows = [("a", "R1", t(8, 10), "LOW"), ("b", None, t(8), "HIGH"), ("c", "R3", t(8), "LOW"), ("e", "R1", t(9, 16), "LOW"), ("f", "R1", t(9, 15), "LOW"), ("g", "R1", t(8, 30), "NONE"), ("h", "R1", t(7, 44), "LOW"), ("i", "R1", None, "LOW")]
    found = spark.createDataFrame([(a, "D1", "x", day, r, w, s) for a, r, w, s in rows], FOUND)
    truth = spark.createDataFrame([("t1", "crash", "R1", day, t(8), t(9), "1", "BUS", 60, 1.256), ("t2", "storm", "R2", day, t(8), t(9), "2", "BUS", 60, 1.0), ("t3", "slip", "R9", day, t(20), t(21), "9", "RAIL", 60, 2.0)], TRUTH)
    matched = joins.match_windows(found, truth)
    got = sorted((r.ANOMALY_ID, r.TRUTH_ID or "") for r in matched.collect())
    assert got == [("a", "t1"), ("b", "t1"), ("b", "t2"), ("c", ""), ("e", ""), ("f", "t1"), ("h", ""), ("i", "")]
    card = detectors.scorecard(matched, truth).first()
    assert (card.FLAGGED, card.TRUE_POSITIVES, card.FALSE_POSITIVES, card.TRUTHS_HIT, card.DISTINCT_FLAGGED, card.TRUTHS_TOTAL) == (8, 4, 4, 2, 7, 3)
    assert [tuple(r)[:4] for r in detectors.missed_episodes(matched, truth).collect()] == [("t3", "slip", "9", "RAIL")]
    types = {r.EPISODE_TYPE: (r.EPISODES, r.EPISODES_DETECTED, r.DETECTORS_THAT_FIRED) for r in detectors.recall_by_type(matched, truth).collect()}
    assert types == {"crash": (1, 1, "D1"), "storm": (1, 1, "D1"), "slip": (1, 0, None)}
    head = detectors.headline(matched, found, truth, spark.range(4), spark.range(2)).first()
    assert (head.STOP_EVENTS, head.VEHICLE_PINGS, head.ANOMALIES_FLAGGED, head.TRUTH_EPISODES, head.TRUTH_EPISODES_HIT, head.OVERALL_RECALL_PCT, head.OVERALL_PRECISION_PCT, head.IS_SYNTHETIC_DATASET) == (4, 2, 7, 3, 2, 66.7, 50.0, True)


def test_a_ghost_trip_that_began_long_before_is_no_hit(spark):
    """The rule asks where a detection begins, not whether it overlaps; a truncation too small for a severity does not count."""
    day = dt.date(2026, 4, 1)
    found = spark.createDataFrame([("ghost", "D04", "ghost_trip", day, "R1", dt.datetime(2026, 4, 1, 7), "HIGH"), ("cut", "D08", "trip_truncation", day, "R1", dt.datetime(2026, 4, 1, 9), "NONE")], FOUND)
    truth = spark.createDataFrame([("t", "crash", "R1", day, dt.datetime(2026, 4, 1, 8), dt.datetime(2026, 4, 1, 10), "1", "BUS", 120, 1.0)], TRUTH)
    assert [(r.ANOMALY_ID, r.TRUTH_ID) for r in joins.match_windows(found, truth).collect()] == [("ghost", None)]


def test_leave_one_out(spark):
    rng = random.Random(4)
    rows = [(s, dt.date(2026, 1, 1) + dt.timedelta(days=k), float(rng.randrange(9))) for s in "ab" for k in range(60) if rng.random() < 0.8] + [("c", dt.date(2026, 1, 1), 5.0)]
    for r in leave_one_out_ratio(spark.createDataFrame(rows, "site string, day date, n double"), "site", "day", "n").collect():
        others = [n for s, d, n in rows if s == r.site and d != r.day and d.weekday() == r.day.weekday()]
        assert r.other_days == len(others) and r.other_median == (statistics.median(others) if others else None)


def test_nearest_beyond_the_first_grid(spark):
    p = spark.createDataFrame([("p", -41.0, 174.0), ("q", -20.0, 174.0)], "k string, lat double, lon double")
    t = spark.createDataFrame([("near", -41.001, 174.0), ("far", -30.0, 174.0)], "c string, lat double, lon double")
    got = {r.k: r.c for r in nearest(p, t, "k", "c").collect()}
    assert got == {"p": "near", "q": "far"}


def test_ghost_truncation_teleport_and_stale(spark):
    s = "TRIP_INSTANCE_ID string, SERVICE_DATE date, ROUTE_ID string, ROUTE_SHORT_NAME string, MODE string, IS_OBSERVED boolean, SCHED_ARRIVAL_LOCAL timestamp_ntz, ACTUAL_ARRIVAL_LOCAL timestamp_ntz"
    day, t = dt.date(2026, 4, 1), lambda m: dt.datetime(2026, 4, 1, 8, m)
    # a trip that runs but reports no stop is a ghost, and one that stops reporting is cut off
    rows = [("ghost", day, "R", "1", "BUS", True, t(i), None) for i in range(3)] + [("cut", day, "R", "1", "BUS", True, t(i), t(i + 10) if i < 4 else None) for i in range(6)] + [("fine", day, "R", "1", "BUS", True, t(i), t(i)) for i in range(6)]
    f = spark.createDataFrame(rows, s)
    assert [(r.ENTITY_ID, r.DETAIL) for r in detectors.ghost_trips(f).collect()] == [("ghost", "1 trip ghost scheduled 3 stops, none observed")]
    cut = detectors.truncations(f).collect()
    assert [(r.ENTITY_ID, round(r.SCORE, 3), r.WINDOW_START, r.WINDOW_END, r.DETAIL) for r in cut] == [("cut", 1.667, t(10), t(13), "1 reported 4 of 6 scheduled stops then stopped")]
    p = "TRIP_INSTANCE_ID string, VEHICLE_ID string, SERVICE_DATE date, ROUTE_ID string, ROUTE_SHORT_NAME string, MODE string, PING_LOCAL timestamp_ntz, DEVICE_TS_LOCAL timestamp_ntz, LATITUDE double, LONGITUDE double"
    pings = spark.createDataFrame([("t", "v", day, "R", "1", "RAIL", t(0), t(0), -41.0, 174.0), ("t", "v", day, "R", "1", "RAIL", t(2), t(2), -41.05, 174.0)], p)
    jump = detectors.teleports(transit.ping_motion(pings)).first()
    assert jump.SEVERITY == "HIGH" and jump.EXPECTED_VALUE == 110.0 and jump.DETAIL == "vehicle v implied 167.0 km/h over 5560.0m in 120s"
    late = spark.createDataFrame([("t", "v", day, "R", "1", "BUS", t(10 + i), t(5), -41.0, 174.0) for i in range(5)], p)
    stale = detectors.stale_vehicles(transit.ping_motion(late)).first()
    assert (stale.ANOMALY_ID, stale.EXPECTED_VALUE, stale.DETAIL) == ("D07|t|20260401081100", 25.0, "vehicle v telemetry stalled 540s across 4 pings")


def test_grid_keeps_missing_apart_from_zero(spark):
    df = spark.createDataFrame([("a", dt.date(2026, 1, 1), 3, 0)], "street string, date date, hour int, n long")
    g = rollup.hour_grid(df, ["street"], F.lit("2026-01-01").cast("date"), F.lit("2026-01-02").cast("date"), ["n"])
    assert g.count() == 48 and g.where("is_observed").count() == 1 and g.agg(F.sum("n")).first()[0] == 0


def test_payloads(spark):
    polls = [(dt.datetime(2026, 1, 1), json.dumps({"entity": [{"id": "e1", "vehicle": {"trip": {"routeId": "R", "directionId": 1}, "position": {"latitude": "bad", "longitude": 174.5}, "timestamp": 1767225600}}, {"id": "e2", "tripUpdate": {"trip": {"tripId": "T"}}}]}))]
    p = spark.createDataFrame(polls, "snapshot_ts timestamp, payload string")
    v = landed.vehicle_positions(p).collect()
    assert [(r.vehicle_id, r.route_id, r.direction_id, r.latitude, r.longitude) for r in v] == [("e1", "R", 1, None, 174.5)]
    u = landed.trip_updates(p).collect()
    assert [(r.trip_id, r.stop_id) for r in u] == [("T", None)]


def test_archive_and_flat_rows(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 5), 1), (dt.datetime(2026, 1, 2, 6), 2)], "ts timestamp_ntz, n int")
    writers.write_archive(df, str(tmp_path / "a"), "ts")
    assert [r.n for r in landed.load_archive(spark, str(tmp_path / "a"), "2026-01-02").collect()] == [2]
    f = writers.point_features(spark.createDataFrame([("a", None, None, ["x", "y"])], "id string, lon double, lat double, tags array<string>"), "id", "lon", "lat", ["tags"])
    assert json.loads(f.first().feature)["geometry"] is None
    assert writers.flat_rows(f, "tags array<string>").first().tags == "x | y"


def test_features_as_lines_and_an_array(spark, tmp_path):
    f = writers.point_features(spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, lon double, lat double"), "id", "lon", "lat", ["id"])
    writers.write_features(f, str(tmp_path / "lines"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]
    (tmp_path / "array.json").write_text(json.dumps([{"callsign": "x", "lastSeen": 1}, {"callsign": "y", "lastSeen": 2}], indent=1))
    assert sorted((r.callsign, r.lastSeen) for r in landed.load_json_array(spark, str(tmp_path / "array.json"), "callsign string, lastSeen long").collect()) == [("x", 1), ("y", 2)]


def test_first_frames_of_a_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    spark.createDataFrame([(t(0), "c1", "x"), (t(1), "c1", "x"), (t(2), "c1", "y"), (t(3), "c2", "x")], "ts timestamp, camera string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.landed(spark, str(tmp_path / "in"), "ts timestamp, camera string, content string")
    out = jobs.first_frames(stream, "ts", "camera", "content").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    jobs.run(out)
    assert sorted((r.camera, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("c1", "x"), ("c1", "y"), ("c2", "x")]


def test_shared_frames(spark):
    f = spark.createDataFrame([(1, c, "same", i) for i, c in enumerate("abc")] + [(1, "d", "own", 9)], "run int, camera string, content string, seq int")
    got = {r.camera: r.is_unavailable for r in boards.shared_frames(f, "run", "camera", "content").collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}
    assert {r.status for r in boards.frame_status(f.union(f), "camera", "run", "content", ["seq"]).where("camera = 'd'").collect()} == {"OK", "UNCHANGED"}


def test_camera_catalogues(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"list": [{"id": 2, "name": "old", "latitude": -41, "longitude": 174}, {"deep": {"Camera-ID": "2", "title": " new ", "lat": "-41.5", "lng": "174.5", "Region_Name": "North", "isOffline": True}}, {"id": "x3", "lat": 1, "lon": 1}, {"id": 4, "lat": 999, "lon": 1}, {"number": 5, "y": 1, "x": 2, "name": ""}]}))
    (tmp_path / "c.xml").write_text('<a:all xmlns:a="urn:x"><a:camera id="7"><a:name>Bay</a:name><lat>-41.2</lat><lon>174.9</lon><status>Offline</status></a:camera><camera><id>5</id><name>Hill</name><lat>-41.3</lat><lon>174.8</lon></camera></a:all>')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "bad.xml").write_text("<a><id>1</id>")
    (tmp_path / "mixed.xml").write_text('<l><cam id="8" name="own"><pos lat="-41" lon="174"/><name> first </name><name>last</name>tail<pos lat="0"/><view>n<b/>x</view></cam></l>')
    of = lambda name: [(r.camera_id, r.camera_name, r.lat, r.region, r.offline) for r in landed.cameras(landed.camera_records(spark, str(tmp_path / name))).collect()]
    assert of("c.json") == [("2", "new", -41.5, "North", True), ("5", "Camera 5", 1.0, "", False)]
    assert of("c.xml") == [("5", "Hill", -41.3, "", False), ("7", "Bay", -41.2, "", True)]
    assert of("bad.json") == [] and of("bad.xml") == []
    mixed = landed.camera_records(spark, str(tmp_path / "mixed.xml")).orderBy("pos").collect()
    assert [[tuple(x) for x in r.attributes] for r in mixed] == [
        [("cam_id", "8"), ("cam_name", "own")], [("id", "8"), ("name", "last"), ("pos_lat", "-41"), ("pos_lon", "174"), ("view", "n")], [("lat", "-41"), ("lon", "174")], [("lat", "0")],
    ]
    assert landed.json_records('{"b": {"y": 1, "z": null}, "a": [1, {"x": true, "b": []}], "c": "own"}') == [[("c", "own")], [("y", "1")], [("x", "True")]]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, h, m), k) for h in range(5) for m in (1, 20, 59) for k in "ab"]
    spark.createDataFrame(rows, "ts timestamp, kind string").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    jobs.run(jobs.updated_table(jobs.hourly_counts(jobs.landed(spark, str(tmp_path / "in"), batch.schema), "ts", "Pacific/Auckland", "kind"), str(tmp_path / "out"), "bin_start", "kind"))
    got = jobs.read_updated(spark, str(tmp_path / "out"), "bin_start", "kind")
    want = jobs.hourly_counts(batch, "ts", "Pacific/Auckland", "kind", streaming=False).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
