"""Queries of the transit network: staging, marts, features, detectors and scorecard."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import detectors, joins, transit
from ..sources import landed as S
from . import adapters as A
from .core import day, r4
from .oracle import SEVERITY, sql
from .registry import query


def ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
DAY = "strftime(SERVICE_DATE, '%Y-%m-%d') AS SERVICE_DATE"


@query("d31_staged_stop_events", sql("fact", f"SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, {TS.format('SCHED_ARRIVAL_LOCAL')}, strftime((fact.SCHED_ARRIVAL_LOCAL AT TIME ZONE 'Pacific/Auckland') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS SCHED_ARRIVAL_UTC, SCHED_HOUR, TIME_BAND, {TS.format('SCHED_BIN_15MIN')} FROM fact"))
def _(s, d):
    e = transit.stage_stop_events(A.stop_events(s, d))
    return e.select("TRIP_INSTANCE_ID", "STOP_SEQUENCE", ts("SCHED_ARRIVAL_LOCAL"), ts("SCHED_ARRIVAL_UTC"), "SCHED_HOUR", "TIME_BAND", ts("SCHED_BIN_15MIN"))


@query("d31_staged_pings", sql("pg", f"SELECT TRIP_INSTANCE_ID, VEHICLE_ID, {DAY}, ROUTE_ID, ROUTE_SHORT_NAME, DIRECTION_ID, MODE, {TS.format('PING_LOCAL')}, strftime((PING_LOCAL AT TIME ZONE 'Pacific/Auckland') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS PING_UTC, {TS.format('DEVICE_TS_LOCAL')}, round(LATITUDE, 6) AS LATITUDE, round(LONGITUDE, 6) AS LONGITUDE, HAS_GPS_FAULT, TRUTH_ID, true AS IS_SYNTHETIC FROM pg"))
def _(s, d):
    p = transit.stage_pings(A.pings(s, d))
    return p.withColumns({"SERVICE_DATE": day("SERVICE_DATE"), "PING_LOCAL": ts("PING_LOCAL"), "PING_UTC": ts("PING_UTC"), "DEVICE_TS_LOCAL": ts("DEVICE_TS_LOCAL"), "LATITUDE": F.round("LATITUDE", 6), "LONGITUDE": F.round("LONGITUDE", 6)})


@query("d32_route_dimension", sql("rt", "SELECT ROUTE_ID, ROUTE_SHORT_NAME, ROUTE_TYPE::INT AS ROUTE_TYPE, MODE, TRIP_INSTANCES, DISTINCT_STOPS, FREQUENCY_CLASS FROM rt"))
def _(s, d):
    return A.routes(s, d).select("ROUTE_ID", "ROUTE_SHORT_NAME", "ROUTE_TYPE", "MODE", "TRIP_INSTANCES", "DISTINCT_STOPS", "FREQUENCY_CLASS")


@query("d32_stop_dimension", sql("st", "SELECT STOP_ID, STOP_NAME, STOP_LAT, STOP_LON, ROUTES_SERVED, MATCHED_EVENTS, STOP_EVENTS, IS_CBD FROM st"))
def _(s, d):
    return A.stops(s, d).select("STOP_ID", "STOP_NAME", "STOP_LAT", "STOP_LON", "ROUTES_SERVED", "MATCHED_EVENTS", "STOP_EVENTS", "IS_CBD")


@query("d33_stop_event_fact", sql("fact", f"SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, {DAY}, ROUTE_ID, DIRECTION_ID, MODE, STOP_ID, DAY_TYPE, TIME_BAND, ARRIVAL_DELAY_SECS, DWELL_SECS, IS_OBSERVED, IS_REPORTED, STOP_NAME, IS_CBD, FREQUENCY_CLASS, PUNCTUALITY_BAND FROM fact"))
def _(s, d):
    return A.fact(s, d).select("TRIP_INSTANCE_ID", "STOP_SEQUENCE", day("SERVICE_DATE"), "ROUTE_ID", "DIRECTION_ID", "MODE", "STOP_ID", "DAY_TYPE", "TIME_BAND", "ARRIVAL_DELAY_SECS", "DWELL_SECS", "IS_OBSERVED", "IS_REPORTED", "STOP_NAME", "IS_CBD", "FREQUENCY_CLASS", "PUNCTUALITY_BAND")


@query("d34_truth", sql("tr rt", f"SELECT TRUTH_ID, EPISODE_TYPE, tr.ROUTE_ID, {DAY}, START_HOUR, DURATION_MINS, FREQUENCY_CLASS FROM tr LEFT JOIN rt ON rt.ROUTE_ID = tr.ROUTE_ID"))
def _(s, d):
    return A.truth(s, d).join(A.routes(s, d).select("ROUTE_ID", "FREQUENCY_CLASS"), "ROUTE_ID", "left").select("TRUTH_ID", "EPISODE_TYPE", "ROUTE_ID", day("SERVICE_DATE"), "START_HOUR", "DURATION_MINS", "FREQUENCY_CLASS")


@query("d35_daily_performance", sql("fact", f"SELECT {DAY}, DAY_TYPE, MODE, count(*) AS SCHEDULED_STOP_EVENTS, count(*) FILTER (WHERE IS_OBSERVED AND IS_REPORTED) AS OBSERVED_STOP_EVENTS, round(100.0 * count(*) FILTER (WHERE PUNCTUALITY_BAND = 'ON_TIME') / nullif(count(ARRIVAL_DELAY_SECS), 0), 1) AS PCT_ON_TIME, round(median(ARRIVAL_DELAY_SECS), 3) AS MEDIAN_DELAY_SECS, round(quantile_cont(ARRIVAL_DELAY_SECS, 0.95), 3) AS P95_DELAY_SECS, count(DISTINCT TRIP_INSTANCE_ID) FILTER (WHERE NOT IS_OBSERVED) AS CANCELLED_TRIPS FROM fact GROUP BY fact.SERVICE_DATE, DAY_TYPE, MODE"))
def _(s, d):
    return transit.daily_performance(A.fact(s, d), 3).withColumn("SERVICE_DATE", day("SERVICE_DATE"))


@query("d36_headways", sql("hd", "SELECT TRIP_INSTANCE_ID, STOP_ID, STOP_SEQUENCE, PREV_TRIP_INSTANCE_ID, SCHED_HEADWAY_SECS, ACTUAL_HEADWAY_SECS, round(HEADWAY_RATIO, 7) AS HEADWAY_RATIO FROM hd"))
def _(s, d):
    return A.headways(s, d).select("TRIP_INSTANCE_ID", "STOP_ID", "STOP_SEQUENCE", "PREV_TRIP_INSTANCE_ID", "SCHED_HEADWAY_SECS", "ACTUAL_HEADWAY_SECS", F.round("HEADWAY_RATIO", 7).alias("HEADWAY_RATIO"))


@query("d37_delay_baseline", sql("bd fd", """SELECT b.ROUTE_ID, b.DIRECTION_ID, b.STOP_ID, b.TIME_BAND, b.DAY_TYPE, n AS N_OBS, med AS MED_DELAY, round(q1, 4) AS Q1_DELAY, round(q3, 4) AS Q3_DELAY, round(p95, 4) AS P95_DELAY, mad AS MAD_DELAY, round(SIGMA_DELAY, 7) AS SIGMA_DELAY
  FROM bd b JOIN (SELECT ROUTE_ID, DIRECTION_ID, STOP_ID, TIME_BAND, DAY_TYPE, quantile_cont(ARRIVAL_DELAY_SECS, 0.25) AS q1, quantile_cont(ARRIVAL_DELAY_SECS, 0.75) AS q3, quantile_cont(ARRIVAL_DELAY_SECS, 0.95) AS p95 FROM fd GROUP BY ALL) q ON q.ROUTE_ID = b.ROUTE_ID AND q.DIRECTION_ID IS NOT DISTINCT FROM b.DIRECTION_ID AND q.STOP_ID = b.STOP_ID AND q.TIME_BAND = b.TIME_BAND AND q.DAY_TYPE = b.DAY_TYPE"""))
def _(s, d):
    return transit.delay_baseline(A.fact(s, d), parts=A.dealt(s, d, "lineitem")).select("ROUTE_ID", "DIRECTION_ID", "STOP_ID", "TIME_BAND", "DAY_TYPE", "N_OBS", "MED_DELAY", *r4("Q1_DELAY", "Q3_DELAY", "P95_DELAY"), "MAD_DELAY", F.round("SIGMA_DELAY", 7).alias("SIGMA_DELAY"))


@query("d38_dwell_baseline", sql("bw", "SELECT STOP_ID, TIME_BAND, DAY_TYPE, MODE, n AS N_OBS, med AS MED_DWELL, round(SIGMA_DWELL, 7) AS SIGMA_DWELL FROM bw"))
def _(s, d):
    return transit.dwell_baseline(A.fact(s, d), parts=A.dealt(s, d, "lineitem")).withColumn("SIGMA_DWELL", F.round("SIGMA_DWELL", 7))


@query("d39_ping_motion", sql("mo", "SELECT TRIP_INSTANCE_ID, strftime(PING_LOCAL, '%Y-%m-%d %H:%M:%S.%f') AS PING_LOCAL, HAS_GPS_FAULT, TRUTH_ID, SECS_SINCE_PREV, round(METRES_SINCE_PREV, 3) AS METRES_SINCE_PREV, round(IMPLIED_KMH, 3) AS IMPLIED_KMH, DEVICE_LAG_SECS FROM mo"))
def _(s, d):
    m = A.motion(s, d)
    return m.select("TRIP_INSTANCE_ID", F.date_format("PING_LOCAL", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("PING_LOCAL"), "HAS_GPS_FAULT", "TRUTH_ID", "SECS_SINCE_PREV", F.round("METRES_SINCE_PREV", 3).alias("METRES_SINCE_PREV"), F.round("IMPLIED_KMH", 3).alias("IMPLIED_KMH"), "DEVICE_LAG_SECS")


@query("d40_spatial_bins", sql("sb", f"SELECT CELL_ID, MODE, {TS.format('SCHED_BIN_15MIN')}, STOP_EVENTS, ROUTES, TRIPS, MED_DELAY_SECS, round(P90_DELAY_SECS, 4) AS P90_DELAY_SECS FROM sb"))
def _(s, d):
    return A.bins(s, d).select("CELL_ID", "MODE", ts("SCHED_BIN_15MIN"), "STOP_EVENTS", "ROUTES", "TRIPS", "MED_DELAY_SECS", *r4("P90_DELAY_SECS"))


@query("d41_spatial_baseline", sql("bs", "SELECT CELL_ID, DAY_TYPE, MODE, BIN_HOUR, n AS N_BINS, med AS MED_CELL_DELAY, round(SIGMA_CELL, 7) AS SIGMA_CELL FROM bs"))
def _(s, d):
    return transit.spatial_baseline(A.bins(s, d), A.BASE_BINS).withColumn("SIGMA_CELL", F.round("SIGMA_CELL", 7))


_OUT = ["ANOMALY_ID", "DETECTOR_NAME", "ENTITY_ID", "MODE", "STOP_ID", "DETAIL"]


def _shown(df):
    return df.select(*_OUT, ts("WINDOW_START"), ts("WINDOW_END"), *r4("OBSERVED_VALUE", "EXPECTED_VALUE", "SCORE"), "SEVERITY")


_SEV = SEVERITY.format("SCORE")


def _detector(name: str, code: str) -> None:
    body = f"SELECT {', '.join(_OUT)}, {TS.format('WINDOW_START')}, {TS.format('WINDOW_END')}, round(OBSERVED_VALUE, 4) AS OBSERVED_VALUE, round(EXPECTED_VALUE, 4) AS EXPECTED_VALUE, round(SCORE, 4) AS SCORE, SEVERITY FROM found WHERE DETECTOR = '{code}'"
    need = f"dt{int(code[1:])}"
    one = sql(need, "").rstrip() + f",\nfound AS (SELECT *, {'\'HIGH\'' if code in ('D04', 'D06') else _SEV} AS SEVERITY FROM {need})\n" + body
    query(name, one)(lambda s, d: _shown(A.DETECTORS[code](s, d)))


for _name in ("d42_delay_outlier", "d43_bunching", "d44_gapping", "d45_ghost_trip", "d46_dwell_outlier", "d47_teleport", "d48_stale_vehicle", "d49_truncation", "d50_cluster_shock"):
    _detector(_name, f"D0{int(_name[1:3]) - 41}")


@query("u04_all_detections", sql("found", "SELECT ANOMALY_ID, DETECTOR, ROUTE_ID, round(SCORE, 4) AS SCORE, SEVERITY FROM found"))
def _(s, d):
    return A.detections(s, d).select("ANOMALY_ID", "DETECTOR", "ROUTE_ID", *r4("SCORE"), "SEVERITY")


@query("d51_summary", sql("found", "SELECT DETECTOR, DETECTOR_NAME, SEVERITY, count(*) AS ANOMALIES, count(DISTINCT SERVICE_DATE) AS DATES_AFFECTED, count(DISTINCT ROUTE_ID) AS ROUTES_AFFECTED, round(median(SCORE), 2) AS MEDIAN_SCORE FROM found WHERE SEVERITY <> 'NONE' GROUP BY ALL"))
def _(s, d):
    return detectors.anomaly_summary(A.detections(s, d))


def service_days(s, d):
    """The calendar of the days with events; the first is a public holiday."""
    days = A.fact(s, d).select("SERVICE_DATE").distinct()
    holidays = S.constant(s, [(datetime.date(2024, 1, 1), "New Year")], "SERVICE_DATE date, HOLIDAY_NAME string")
    return transit.service_calendar(days, holidays, S.constant(s, [(datetime.date(2024, 1, 3), datetime.date(2024, 1, 5))], "first date, last date"))


@query("d51_worst_days", sql("found", "SELECT strftime(SERVICE_DATE, '%Y-%m-%d') AS SERVICE_DATE, CASE WHEN SERVICE_DATE = DATE '2024-01-01' THEN 'PUBLIC_HOLIDAY' WHEN isodow(SERVICE_DATE) = 7 THEN 'SUNDAY' WHEN isodow(SERVICE_DATE) = 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END AS DAY_TYPE, CASE WHEN SERVICE_DATE = DATE '2024-01-01' THEN 'New Year' END AS HOLIDAY_NAME, count(*) AS ANOMALIES, count(*) FILTER (WHERE SEVERITY = 'HIGH') AS HIGH_SEVERITY, count(DISTINCT ROUTE_ID) AS ROUTES_AFFECTED FROM found WHERE SEVERITY <> 'NONE' AND SERVICE_DATE IN (SELECT SERVICE_DATE FROM ev) GROUP BY found.SERVICE_DATE"))
def _(s, d):
    return detectors.worst_days(A.detections(s, d), service_days(s, d)).withColumn("SERVICE_DATE", day("SERVICE_DATE"))


@query("d51_hot_cells", sql("dt9 sb", "SELECT CELL_ID, round(sb.CELL_LAT, 4) AS CELL_LAT, round(sb.CELL_LON, 4) AS CELL_LON, sb.MODE, count(*) AS HOT_BINS, round(max(MED_DELAY_SECS), 1) AS WORST_MED_DELAY_SECS FROM dt9 JOIN sb ON sb.CELL_ID = ENTITY_ID AND sb.SCHED_BIN_15MIN = WINDOW_START GROUP BY CELL_ID, round(sb.CELL_LAT, 4), round(sb.CELL_LON, 4), sb.MODE"))
def _(s, d):
    b = A.bins(s, d).withColumns({"CELL_LAT": F.round("CELL_LAT", 4), "CELL_LON": F.round("CELL_LON", 4)})
    return detectors.hot_cells(A.DETECTORS["D09"](s, d), b)


@query("d52_matched", sql("mt", "SELECT ANOMALY_ID, DETECTOR, DETECTOR_NAME, strftime(SERVICE_DATE, '%Y-%m-%d') AS SERVICE_DATE, ROUTE_ID, SEVERITY, round(SCORE, 4) AS SCORE, TRUTH_ID, EPISODE_TYPE FROM mt"))
def _(s, d):
    return joins.match_windows(A.detections(s, d), A.truth(s, d)).select("ANOMALY_ID", "DETECTOR", "DETECTOR_NAME", day("SERVICE_DATE"), "ROUTE_ID", "SEVERITY", *r4("SCORE"), "TRUTH_ID", "EPISODE_TYPE")


@query("d53_scorecard", sql("mt", """SELECT DETECTOR, DETECTOR_NAME, FLAGGED, TRUE_POSITIVES, FALSE_POSITIVES, TRUTHS_HIT, DISTINCT_FLAGGED, TRUTHS_TOTAL, round(100 * p, 1) AS PRECISION_PCT, round(100 * r, 1) AS EPISODE_RECALL_PCT, round(2 * p * r / nullif(p + r, 0), 3) AS F1 FROM (SELECT *, TRUE_POSITIVES / nullif(FLAGGED, 0) AS p, TRUTHS_HIT / nullif(TRUTHS_TOTAL, 0) AS r FROM
  (SELECT DETECTOR, DETECTOR_NAME, count(*) AS FLAGGED, count(TRUTH_ID) AS TRUE_POSITIVES, count(*) FILTER (WHERE TRUTH_ID IS NULL) AS FALSE_POSITIVES, count(DISTINCT TRUTH_ID) AS TRUTHS_HIT, count(DISTINCT ANOMALY_ID) AS DISTINCT_FLAGGED, (SELECT count(*) FROM tr) AS TRUTHS_TOTAL FROM mt GROUP BY 1, 2))"""))
def _(s, d):
    return detectors.counted_scorecard(*A.match_counts(s, d), A.detections(s, d), A.truth(s, d))


@query("d54_missed_episodes", sql("mt", f"SELECT TRUTH_ID, EPISODE_TYPE, ROUTE_SHORT_NAME, MODE, {DAY}, {TS.format('WINDOW_START_LOCAL')}, DURATION_MINS, round(MAGNITUDE, 2) AS MAGNITUDE FROM tr WHERE TRUTH_ID NOT IN (SELECT TRUTH_ID FROM mt WHERE TRUTH_ID IS NOT NULL)"))
def _(s, d):
    return detectors.missed_episodes(A.match_counts(s, d)[1], A.truth(s, d)).withColumns({"SERVICE_DATE": day("SERVICE_DATE"), "WINDOW_START_LOCAL": ts("WINDOW_START_LOCAL")})


@query("d54_recall_by_type", sql("mt", "SELECT t.EPISODE_TYPE, count(DISTINCT t.TRUTH_ID) AS EPISODES, count(DISTINCT m.TRUTH_ID) AS EPISODES_DETECTED, round(100.0 * count(DISTINCT m.TRUTH_ID) / nullif(count(DISTINCT t.TRUTH_ID), 0), 1) AS RECALL_PCT, string_agg(DISTINCT m.DETECTOR, ', ' ORDER BY m.DETECTOR) AS DETECTORS_THAT_FIRED FROM tr t LEFT JOIN mt m ON m.TRUTH_ID = t.TRUTH_ID GROUP BY 1"))
def _(s, d):
    return detectors.recall_by_type(A.match_counts(s, d)[1], A.truth(s, d))


@query("d55_headline", sql("mt", "SELECT (SELECT count(*) FROM fact) AS STOP_EVENTS, (SELECT count(*) FROM pg) AS VEHICLE_PINGS, (SELECT count(*) FROM found WHERE SEVERITY <> 'NONE') AS ANOMALIES_FLAGGED, (SELECT count(*) FROM tr) AS TRUTH_EPISODES, (SELECT count(DISTINCT TRUTH_ID) FROM mt) AS TRUTH_EPISODES_HIT, (SELECT round(100.0 * count(DISTINCT TRUTH_ID) / nullif((SELECT count(*) FROM tr), 0), 1) FROM mt) AS OVERALL_RECALL_PCT, (SELECT round(100.0 * count(TRUTH_ID) / nullif(count(*), 0), 1) FROM mt) AS OVERALL_PRECISION_PCT, true AS IS_SYNTHETIC_DATASET"))
def _(s, d):
    return detectors.counted_headline(*A.match_counts(s, d), A.detections(s, d), A.truth(s, d), A.fact(s, d), A.pings(s, d))


HOTSPOTS = """hs AS (SELECT h.*, top_detector, top_detector_count, CASE WHEN high >= 20 THEN 'high' ELSE 'elevated' END AS tier, STOP_NAME, STOP_LAT, STOP_LON FROM
  (SELECT STOP_ID, count(*) AS anomalies, count(*) FILTER (WHERE SEVERITY = 'HIGH') AS high, count(*) FILTER (WHERE SEVERITY = 'MEDIUM') AS medium, count(*) FILTER (WHERE SEVERITY = 'LOW') AS low, string_agg(DISTINCT MODE, ',' ORDER BY MODE) AS modes, max(SCORE) AS worst_score, first(ANOMALY_ID ORDER BY SCORE DESC, ANOMALY_ID) AS worst_id, first(DETAIL ORDER BY SCORE DESC, ANOMALY_ID) AS worst_detail,
     first(hour(WINDOW_START)::INT ORDER BY SCORE DESC, ANOMALY_ID) AS worst_hour FROM found WHERE STOP_ID IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 OR count(*) FILTER (WHERE SEVERITY = 'HIGH') >= 10) h
  JOIN (SELECT STOP_ID, first(DETECTOR_NAME ORDER BY n DESC, DETECTOR_NAME) AS top_detector, max(n) AS top_detector_count FROM (SELECT STOP_ID, DETECTOR_NAME, count(*) AS n FROM found WHERE STOP_ID IS NOT NULL GROUP BY 1, 2) GROUP BY 1) t ON t.STOP_ID = h.STOP_ID JOIN st ON st.STOP_ID = h.STOP_ID)"""


def hotspot_sql(body: str) -> str:
    return sql("found st", "").rstrip() + ",\n" + HOTSPOTS + "\n" + body


def hotspots(s, d):
    return detectors.stop_hotspots(A.detections(s, d), A.stops(s, d, A.fact(s, d)))


@query("d27_stop_hotspots", hotspot_sql("SELECT STOP_ID, anomalies, high, medium, low, modes, top_detector, top_detector_count, tier, STOP_NAME, round(worst_score, 4) AS worst_score, worst_id, worst_detail, worst_hour FROM hs"))
def _(s, d):
    h = hotspots(s, d).withColumns({"modes": F.array_join("modes", ","), "worst_detail": F.col("worst_example.detail"), "worst_hour": F.col("worst_example.hour")})
    return h.select("STOP_ID", "anomalies", "high", "medium", "low", "modes", "top_detector", "top_detector_count", "tier", "STOP_NAME", *r4("worst_score"), "worst_id", "worst_detail", "worst_hour")


@query("d61_tagged_events", sql("ev tr", "SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, TRUTH_ID, EPISODE_TYPE AS TRUTH_EPISODE_TYPE FROM ev LEFT JOIN tr ON tr.ROUTE_ID = ev.ROUTE_ID AND tr.SERVICE_DATE = ev.SERVICE_DATE AND SCHED_HOUR >= START_HOUR AND SCHED_HOUR < START_HOUR + ceil(DURATION_MINS / 60)"))
def _(s, d):
    return joins.tag_episodes(transit.stage_stop_events(A.stop_events(s, d)), A.truth(s, d)).select("TRIP_INSTANCE_ID", "STOP_SEQUENCE", "TRUTH_ID", "TRUTH_EPISODE_TYPE")


@query("q14_episode_coverage", sql("ev tr", "SELECT EPISODE_TYPE AS TRUTH_EPISODE_TYPE, count(*) AS stop_events, count(DISTINCT TRIP_INSTANCE_ID) AS trips FROM ev JOIN tr ON tr.ROUTE_ID = ev.ROUTE_ID AND tr.SERVICE_DATE = ev.SERVICE_DATE AND SCHED_HOUR >= START_HOUR AND SCHED_HOUR < START_HOUR + ceil(DURATION_MINS / 60) GROUP BY 1"))
def _(s, d):
    return transit.counted_coverage(joins.tagged_trips(transit.stage_stop_events(A.stop_events(s, d)), A.truth(s, d)))


@query("w10_cumulative_delay", sql("ev", "SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, s AS DELAY_STEP, sum(s) OVER (PARTITION BY TRIP_INSTANCE_ID ORDER BY STOP_SEQUENCE)::BIGINT AS DELAY_GAINED FROM (SELECT *, coalesce(ARRIVAL_DELAY_SECS - lag(ARRIVAL_DELAY_SECS) OVER (PARTITION BY TRIP_INSTANCE_ID ORDER BY STOP_SEQUENCE), 0) AS s FROM ev)"))
def _(s, d):
    return transit.cumulative_delay_change(A.stop_events(s, d)).select("TRIP_INSTANCE_ID", "STOP_SEQUENCE", "DELAY_STEP", "DELAY_GAINED")
