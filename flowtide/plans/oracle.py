"""SQL of the adapters and shared steps, to be put before the checking queries."""

from __future__ import annotations

from ..functions.columns import DESCRIPTORS

DOW = "isodow({0})"
DAY_TYPE = "CASE WHEN isodow({0}) = 7 THEN 'SUNDAY' WHEN isodow({0}) = 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END"
SEVERITY = "CASE WHEN abs({0}) >= 3.5 THEN 'HIGH' WHEN abs({0}) >= 2.5 THEN 'MEDIUM' WHEN abs({0}) >= 1.5 THEN 'LOW' ELSE 'NONE' END"
METRES = "12742000 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
STREET = r"coalesce(nullif(trim(regexp_replace(regexp_replace({0}, '^S\d+\s+', '', 'i'), '[\s-]+(" + DESCRIPTORS + r").*$', '', 'i')), ''), {0})"


def _obs(n: int, count: str = "count(*)") -> str:
    return f"""SELECT (user_id % {n})::VARCHAR AS countline_id, ts::DATE AS date, hour(ts)::INT AS hour, {count}::DOUBLE AS count,
      CASE event_type WHEN 'view' THEN 'Pedestrian' WHEN 'click' THEN 'Cyclist' ELSE event_type END AS transport_class, 'ALL' AS direction FROM events GROUP BY ALL"""


def _robust(source: str, keys: str, value: str) -> str:
    """Median, MAD and n of each row's group by correlated joins."""
    k = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in k)
    return f"""SELECT m.*, d.mad FROM (SELECT {keys}, count(*) AS n, median({value}) AS med FROM {source} GROUP BY {keys}) m
      JOIN (SELECT {', '.join(f's.{x}' for x in k)}, median(abs(s.{value} - b.med)) AS mad FROM {source} s JOIN (SELECT {keys}, median({value}) AS med FROM {source} GROUP BY {keys}) b ON {on('s', 'b')} GROUP BY {', '.join(f's.{x}' for x in k)}) d ON {on('m', 'd')}"""


SEQ = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT"

#: name -> (needed names, SQL)
CTES: dict[str, tuple[str, str]] = {
    "obs": ("", _obs(25)),
    "obs2": ("", _obs(2, "sum(user_id % 50)")),
    "meta": ("", "SELECT 'V' || n_nationkey AS VIEWPOINT_ID, n_nationkey::VARCHAR AS COUNTLINE_ID, 'S' || n_nationkey || ' ' || r_name || ' Road ' || n_name AS NAME, -41.3 + n_nationkey * 0.002::DOUBLE AS LATITUDE_START_LINE, 174.75 + n_nationkey * 0.003::DOUBLE AS LONGITUDE_START_LINE, -41.299 + n_nationkey * 0.002::DOUBLE AS LATITUDE_END_LINE, 174.751 + n_nationkey * 0.003::DOUBLE AS LONGITUDE_END_LINE FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "hist": ("obs2", "SELECT *, (isodow(date) - 1)::INT AS day_of_week FROM obs2 WHERE date + to_hours(hour) >= TIMESTAMP '2024-01-01 12:00:00' AND date + to_hours(hour) < TIMESTAMP '2024-01-29 12:00:00'"),
    "base0": ("hist", _robust("hist", "countline_id, transport_class, direction, day_of_week, hour", "count")),
    "base": ("base0", "SELECT countline_id, transport_class, direction, day_of_week, hour, med AS expected_count, n AS history_samples, mad FROM base0 WHERE n >= 3"),
    "cur": ("obs2", "SELECT *, (isodow(date) - 1)::INT AS day_of_week FROM obs2 WHERE date = DATE '2024-01-29' AND hour = 12"),
    "scored": ("cur base", """SELECT c.*, expected_count, history_samples, mad, abs(count - expected_count) AS absolute_change,
        (count - expected_count) / greatest(1.4826 * mad, sqrt(expected_count + 1), 1.0) AS robust_z, abs(count - expected_count) / greatest(abs(expected_count), 10.0) AS relative_change,
        CASE WHEN count > expected_count THEN 'increase' WHEN count < expected_count THEN 'decrease' ELSE 'stable' END AS change_direction,
        CASE WHEN expected_count IS NULL THEN 'insufficient_baseline' WHEN abs((count - expected_count) / greatest(1.4826 * mad, sqrt(expected_count + 1), 1.0)) >= 1.0 AND abs(count - expected_count) >= 1 AND abs((count - expected_count) / greatest(abs(expected_count), 10.0)) >= 0.35 THEN 'candidate' ELSE 'normal' END AS status,
        CASE WHEN expected_count IS NULL THEN 'no_matching_history' ELSE 'complete' END AS data_quality
      FROM cur c LEFT JOIN base USING (countline_id, transport_class, direction, day_of_week, hour)"""),
    "gaps": ("cur base", "SELECT b.*, 'data_gap' AS status FROM base b WHERE day_of_week = 0 AND hour = 12 AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.countline_id = b.countline_id AND c.transport_class = b.transport_class AND c.direction = b.direction)"),
    "street_obs": ("obs meta", f"SELECT o.*, coalesce({STREET.format('NAME')}, 'COUNTLINE ' || o.countline_id) AS street FROM obs o LEFT JOIN meta ON meta.COUNTLINE_ID = o.countline_id"),
    "street_hourly": ("street_obs", """SELECT street, date, hour, sum(count) AS total_count, sum(count) FILTER (WHERE transport_class = 'Pedestrian') AS pedestrian_count, sum(count) FILTER (WHERE transport_class = 'Cyclist') AS cyclist_count,
        sum(count) FILTER (WHERE transport_class NOT IN ('Pedestrian', 'Cyclist')) AS vehicle_count, count(DISTINCT countline_id) AS active_countlines, isodow(date)::INT AS iso_dow, ((isodow(date) - 1) * 24 + hour)::INT AS hour_of_week, isodow(date) >= 6 AS is_weekend FROM street_obs GROUP BY street, date, hour"""),
    "class_hourly": ("obs", "SELECT transport_class, date, hour, sum(count) AS total_count, count(DISTINCT countline_id) AS active_countlines, isodow(date)::INT AS iso_dow, ((isodow(date) - 1) * 24 + hour)::INT AS hour_of_week, isodow(date) >= 6 AS is_weekend FROM obs GROUP BY transport_class, date, hour"),
    "street_z": ("street_hourly", "SELECT h.*, m, s, n, total_count - m AS residual, CASE WHEN s > 0 THEN round((total_count - m) / s, 3) END AS z FROM street_hourly h JOIN (SELECT street, hour, is_weekend, avg(total_count) AS m, stddev_samp(total_count) AS s, count(*) AS n FROM street_hourly GROUP BY ALL) b USING (street, hour, is_weekend)"),
    "class_z": ("class_hourly", "SELECT h.*, m, s, n, total_count - m AS residual, CASE WHEN s > 0 THEN round((total_count - m) / s, 3) END AS z FROM class_hourly h JOIN (SELECT transport_class, hour, is_weekend, avg(total_count) AS m, stddev_samp(total_count) AS s, count(*) AS n FROM class_hourly GROUP BY ALL) b USING (transport_class, hour, is_weekend)"),
    "hw": ("", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate, l_returnflag, l_shipdate::DATE AS date, 'X' || n_nationkey AS siteID, r_name AS SiteRef, 'Site ' || r_name AS siteDescription, CASE WHEN l_returnflag = 'R' THEN 'Heavy' ELSE 'Light' END AS classWeight, l_linenumber AS laneNumber, 1 AS flowDirection, l_quantity AS trafficCount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "hwd": ("hw", "SELECT * FROM hw QUALIFY row_number() OVER (PARTITION BY l_orderkey, laneNumber ORDER BY l_partkey, l_suppkey, trafficCount, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"),
    "hws": ("", "SELECT lower(r_name) AS siteref, 'Highway ' || r_name AS description, 'SH' || r_regionkey AS state_highway, 'loop' AS sitetype, -41.3 + r_regionkey * 0.01::DOUBLE AS lat, 174.75 + r_regionkey * 0.01::DOUBLE AS lon FROM region WHERE r_regionkey <> 4"),
    "daily": ("hwd hws", """SELECT a.*, s.description AS site_name, s.state_highway, s.sitetype, s.lat, s.lon, s.siteref IS NULL AS no_location FROM (SELECT SiteRef, date AS count_date, min(siteDescription) AS site_description, sum(trafficCount) AS total_count, sum(trafficCount) FILTER (WHERE classWeight = 'Heavy') AS heavy_count,
        sum(trafficCount) FILTER (WHERE classWeight = 'Light') AS light_count, count(DISTINCT laneNumber) AS lanes_reporting, dayname(date) AS day_name, isodow(date) >= 6 AS is_weekend FROM hwd GROUP BY SiteRef, date) a LEFT JOIN hws s ON upper(s.siteref) = upper(a.SiteRef)"""),
    "daily_base": ("daily", _robust("daily", "SiteRef, is_weekend", "total_count")),
    "dscored": ("daily daily_base", f"""SELECT d.*, med AS baseline_median, mad AS baseline_mad, n AS baseline_n, CASE WHEN med > 0 THEN round(total_count / med, 3) END AS ratio, CASE WHEN mad > 0 THEN round((total_count - med) / (1.4826 * mad), 3) END AS robust_z,
        CASE WHEN mad > 0 AND abs((total_count - med) / (1.4826 * mad)) >= 1.5 THEN {SEVERITY.format('((total_count - med) / (1.4826 * mad))')} WHEN med > 0 AND (total_count / med <= 0.5 OR total_count / med >= 1.75) THEN 'LOW' ELSE 'NONE' END AS severity,
        CASE WHEN total_count < med THEN 'DROP' ELSE 'SURGE' END AS change FROM daily d JOIN daily_base USING (SiteRef, is_weekend)"""),
    "moves": ("", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'arrival' ELSE 'departure' END AS direction, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland' AS ts_local FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events)"),
    "moves_h": ("moves", """SELECT g.event_date, g.event_hour, isodow(g.event_date) >= 6 AS is_weekend, coalesce(arrivals, 0) AS arrivals, coalesce(departures, 0) AS departures, coalesce(total_movements, 0) AS total_movements, o.event_date IS NOT NULL AS is_observed
        FROM (SELECT d::DATE AS event_date, h::INT AS event_hour FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d), generate_series(0, 23) u(h)) g
        LEFT JOIN (SELECT ts_local::DATE AS event_date, hour(ts_local)::INT AS event_hour, count(*) FILTER (WHERE direction = 'arrival') AS arrivals, count(*) FILTER (WHERE direction = 'departure') AS departures, count(*) AS total_movements FROM moves GROUP BY ALL) o USING (event_date, event_hour)"""),
    "moves_b": ("moves_h", _robust("moves_h", "event_hour, is_weekend", "total_movements")),
    "fscored": ("moves_h moves_b", f"SELECT h.*, med AS baseline_median, mad AS baseline_mad, CASE WHEN med > 0 THEN round(total_movements / med, 3) END AS ratio, CASE WHEN mad > 0 THEN round((total_movements - med) / (1.4826 * mad), 3) END AS robust_z, CASE WHEN mad > 0 THEN {SEVERITY.format('((total_movements - med) / (1.4826 * mad))')} ELSE 'NONE' END AS severity, CASE WHEN total_movements < med THEN 'DROP' ELSE 'SURGE' END AS change FROM moves_h h JOIN moves_b USING (event_hour, is_weekend) WHERE med > 0"),
    "ev0": ("", f"SELECT *, {SEQ} AS STOP_SEQUENCE, DATE '2024-01-01' + (date_diff('day', DATE '1992-01-01', o_orderdate::DATE) % 14)::INT AS SERVICE_DATE, l_returnflag <> 'R' AS seen, (date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::INT AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "ev1": ("ev0", "SELECT *, SERVICE_DATE + to_hours((5 + o_orderkey % 18)::INT) + to_minutes(STOP_SEQUENCE * 3) AS SCHED_ARRIVAL_LOCAL, CASE WHEN seen AND l_discount < 0.09 THEN d END AS ARRIVAL_DELAY_SECS, CASE WHEN seen AND l_discount < 0.09 THEN trunc(l_quantity)::INT END AS DWELL_SECS FROM ev0"),
    "ev": ("ev1", f"""SELECT l_orderkey::VARCHAR AS TRIP_INSTANCE_ID, SERVICE_DATE, 'R' || (o_custkey % 20) AS ROUTE_ID, (o_custkey % 20)::VARCHAR AS ROUTE_SHORT_NAME, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 2)::INT END AS DIRECTION_ID,
        CASE WHEN o_custkey % 20 < 14 THEN 'BUS' WHEN o_custkey % 20 < 18 THEN 'RAIL' ELSE 'FERRY' END AS MODE, 'P' || (l_partkey // 40) AS STOP_ID, STOP_SEQUENCE, {DAY_TYPE.format('SERVICE_DATE')} AS DAY_TYPE, SCHED_ARRIVAL_LOCAL, SCHED_ARRIVAL_LOCAL + to_seconds(ARRIVAL_DELAY_SECS) AS ACTUAL_ARRIVAL_LOCAL,
        SCHED_ARRIVAL_LOCAL + to_seconds(ARRIVAL_DELAY_SECS + DWELL_SECS) AS ACTUAL_DEPARTURE_LOCAL, ARRIVAL_DELAY_SECS, DWELL_SECS, seen AS IS_OBSERVED, l_discount < 0.09 AS IS_REPORTED, hour(SCHED_ARRIVAL_LOCAL)::INT AS SCHED_HOUR, time_bucket(INTERVAL 15 MINUTE, SCHED_ARRIVAL_LOCAL) AS SCHED_BIN_15MIN FROM ev1"""),
    "rt": ("ev", """SELECT 'R' || k AS ROUTE_ID, k::VARCHAR AS ROUTE_SHORT_NAME, CASE WHEN k < 14 THEN 3 WHEN k < 18 THEN 2 ELSE 4 END AS ROUTE_TYPE, CASE WHEN k < 14 THEN 'BUS' WHEN k < 18 THEN 'RAIL' ELSE 'FERRY' END AS MODE, coalesce(t, 0) AS TRIP_INSTANCES, coalesce(s, 0) AS DISTINCT_STOPS,
        CASE WHEN coalesce(t, 0) / 5.0 >= 120 THEN 'HIGH_FREQUENCY' WHEN coalesce(t, 0) / 5.0 >= 40 THEN 'FREQUENT' WHEN coalesce(t, 0) / 5.0 >= 10 THEN 'STANDARD' ELSE 'INFREQUENT' END AS FREQUENCY_CLASS
      FROM (SELECT DISTINCT c_custkey % 20 AS k FROM customer) LEFT JOIN (SELECT ROUTE_ID AS r, count(DISTINCT TRIP_INSTANCE_ID) AS t, count(DISTINCT STOP_ID) AS s FROM ev GROUP BY 1) ON r = 'R' || k"""),
    "st": ("ev", """SELECT 'P' || k AS STOP_ID, 'Stop ' || k AS STOP_NAME, round(-41.30 + (k % 50) * 0.001::DOUBLE, 3) AS STOP_LAT, round(174.765 + (k % 50) * 0.001::DOUBLE, 3) AS STOP_LON, coalesce(r, 0) AS ROUTES_SERVED, coalesce(n, 0) AS MATCHED_EVENTS, greatest(coalesce(n, 0), 1) AS STOP_EVENTS,
        round(-41.30 + (k % 50) * 0.001::DOUBLE, 3) BETWEEN -41.300 AND -41.270 AND round(174.765 + (k % 50) * 0.001::DOUBLE, 3) BETWEEN 174.765 AND 174.790 AS IS_CBD FROM (SELECT DISTINCT p_partkey // 40 AS k FROM part) LEFT JOIN (SELECT STOP_ID AS s, count(DISTINCT ROUTE_ID) AS r, count(*) AS n FROM ev GROUP BY 1) ON s = 'P' || k WHERE k <> 0"""),
    "fact": ("ev rt st", """SELECT ev.*, CASE WHEN DAY_TYPE = 'WEEKDAY' AND SCHED_HOUR BETWEEN 7 AND 8 THEN 'AM_PEAK' WHEN DAY_TYPE = 'WEEKDAY' AND SCHED_HOUR BETWEEN 16 AND 17 THEN 'PM_PEAK' WHEN SCHED_HOUR BETWEEN 9 AND 15 THEN 'INTERPEAK' WHEN SCHED_HOUR >= 19 OR SCHED_HOUR < 6 THEN 'EVENING' ELSE 'SHOULDER' END AS TIME_BAND,
        STOP_NAME, STOP_LAT, STOP_LON, IS_CBD, FREQUENCY_CLASS, CASE WHEN ARRIVAL_DELAY_SECS IS NULL THEN 'NOT_OBSERVED' WHEN ARRIVAL_DELAY_SECS < -60 THEN 'EARLY' WHEN ARRIVAL_DELAY_SECS <= 300 THEN 'ON_TIME' WHEN ARRIVAL_DELAY_SECS <= 900 THEN 'LATE' ELSE 'VERY_LATE' END AS PUNCTUALITY_BAND
      FROM ev LEFT JOIN (SELECT STOP_ID, STOP_NAME, STOP_LAT, STOP_LON, IS_CBD FROM st) USING (STOP_ID) LEFT JOIN (SELECT ROUTE_ID, FREQUENCY_CLASS FROM rt) USING (ROUTE_ID)"""),
    "hd0": ("fact", """SELECT *, lag(SCHED_ARRIVAL_LOCAL) OVER w AS PREV_SCHED_ARRIVAL, lag(ACTUAL_ARRIVAL_LOCAL) OVER w AS PREV_ACTUAL_ARRIVAL, lag(TRIP_INSTANCE_ID) OVER w AS PREV_TRIP_INSTANCE_ID FROM fact WHERE IS_OBSERVED AND IS_REPORTED WINDOW w AS (PARTITION BY ROUTE_ID, DIRECTION_ID, STOP_ID, SERVICE_DATE ORDER BY SCHED_ARRIVAL_LOCAL, TRIP_INSTANCE_ID, STOP_SEQUENCE)"""),
    "hd1": ("hd0", "SELECT *, date_diff('second', PREV_SCHED_ARRIVAL, SCHED_ARRIVAL_LOCAL) AS SCHED_HEADWAY_SECS, date_diff('second', PREV_ACTUAL_ARRIVAL, ACTUAL_ARRIVAL_LOCAL) AS ACTUAL_HEADWAY_SECS FROM hd0 WHERE PREV_SCHED_ARRIVAL IS NOT NULL"),
    "hd": ("hd1", "SELECT *, CASE WHEN SCHED_HEADWAY_SECS > 0 THEN ACTUAL_HEADWAY_SECS / SCHED_HEADWAY_SECS END AS HEADWAY_RATIO FROM hd1"),
    "fd": ("fact", "SELECT * FROM fact WHERE ARRIVAL_DELAY_SECS IS NOT NULL"),
    "bd0": ("fd", _robust("fd", "ROUTE_ID, DIRECTION_ID, STOP_ID, TIME_BAND, DAY_TYPE, MODE", "ARRIVAL_DELAY_SECS")),
    "bd": ("bd0", "SELECT *, greatest(1.4826 * mad, 20.0) AS SIGMA_DELAY FROM bd0 WHERE n >= 5"),
    "fw": ("fact", "SELECT * FROM fact WHERE DWELL_SECS IS NOT NULL"),
    "bw0": ("fw", _robust("fw", "STOP_ID, TIME_BAND, DAY_TYPE, MODE", "DWELL_SECS")),
    "bw": ("bw0", "SELECT *, greatest(1.4826 * mad, 10.0) AS SIGMA_DWELL FROM bw0 WHERE n >= 5"),
    "pg": ("", "SELECT (user_id // 10)::VARCHAR || '|' || strftime(ts, '%Y%m%d') AS TRIP_INSTANCE_ID, 'V' || (user_id // 10) AS VEHICLE_ID, ts::DATE AS SERVICE_DATE, 'R' || (user_id // 10 % 10) AS ROUTE_ID, (user_id // 10 % 10)::VARCHAR AS ROUTE_SHORT_NAME, CASE WHEN user_id // 10 % 10 < 7 THEN 'BUS' ELSE 'RAIL' END AS MODE, ts AS PING_LOCAL, ts - to_seconds((event_id * 7 % 150)::INT) AS DEVICE_TS_LOCAL, -41.3 + (event_id * 37 % 1000) / 10000.0::DOUBLE AS LATITUDE, 174.7 + (event_id * 53 % 1000) / 10000.0::DOUBLE AS LONGITUDE, (user_id // 10 % 2)::INT AS DIRECTION_ID, event_type = 'error' AS HAS_GPS_FAULT, CASE WHEN event_type = 'error' THEN event_id::VARCHAR END AS TRUTH_ID FROM events"),
    "mo0": ("pg", "SELECT *, lag(LATITUDE) OVER w AS PLAT, lag(LONGITUDE) OVER w AS PLON, lag(PING_LOCAL) OVER w AS PREV_PING_LOCAL FROM pg WINDOW w AS (PARTITION BY TRIP_INSTANCE_ID ORDER BY PING_LOCAL, LATITUDE, LONGITUDE)"),
    "mo1": ("mo0", f"SELECT *, date_diff('second', PREV_PING_LOCAL, PING_LOCAL) AS SECS_SINCE_PREV, {METRES.format('PLAT', 'PLON', 'LATITUDE', 'LONGITUDE')} AS METRES_SINCE_PREV, date_diff('second', DEVICE_TS_LOCAL, PING_LOCAL) AS DEVICE_LAG_SECS FROM mo0 WHERE PLAT IS NOT NULL"),
    "mo": ("mo1", "SELECT *, CASE WHEN SECS_SINCE_PREV > 0 THEN METRES_SINCE_PREV / SECS_SINCE_PREV * 3.6 END AS IMPLIED_KMH FROM mo1"),
    "sb": ("fact", """SELECT printf('%.3f', STOP_LAT) || '_' || printf('%.3f', STOP_LON) AS CELL_ID, SERVICE_DATE, DAY_TYPE, SCHED_BIN_15MIN, MODE, hour(SCHED_BIN_15MIN)::INT AS BIN_HOUR, count(*) AS STOP_EVENTS, count(DISTINCT ROUTE_ID) AS ROUTES, count(DISTINCT TRIP_INSTANCE_ID) AS TRIPS, median(ARRIVAL_DELAY_SECS) AS MED_DELAY_SECS,
        quantile_cont(ARRIVAL_DELAY_SECS, 0.9) AS P90_DELAY_SECS, avg(STOP_LAT) AS CELL_LAT, avg(STOP_LON) AS CELL_LON FROM fact WHERE ARRIVAL_DELAY_SECS IS NOT NULL AND STOP_LAT IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2"""),
    "bs0": ("sb", _robust("sb", "CELL_ID, DAY_TYPE, MODE, BIN_HOUR", "MED_DELAY_SECS")),
    "bs": ("bs0", "SELECT *, greatest(1.4826 * mad, 15.0) AS SIGMA_CELL FROM bs0 WHERE n >= 3"),
    "tr": ("", """SELECT event_id::VARCHAR AS TRUTH_ID, CASE user_id % 3 WHEN 0 THEN 'crash' WHEN 1 THEN 'closure' ELSE 'storm' END AS EPISODE_TYPE, 'R' || (user_id % 20) AS ROUTE_ID, (user_id % 20)::VARCHAR AS ROUTE_SHORT_NAME, CASE WHEN user_id % 20 < 14 THEN 'BUS' WHEN user_id % 20 < 18 THEN 'RAIL' ELSE 'FERRY' END AS MODE, 0.5 + (user_id % 300) / 300.0::DOUBLE AS MAGNITUDE, DATE '2024-01-01' + ((day(ts) - 1) % 14)::INT AS SERVICE_DATE, hour(ts)::INT AS START_HOUR, (30 + user_id % 60)::INT AS DURATION_MINS,
        (DATE '2024-01-01' + ((day(ts) - 1) % 14)::INT) + to_hours(hour(ts)) AS WINDOW_START_LOCAL, (DATE '2024-01-01' + ((day(ts) - 1) % 14)::INT) + to_hours(hour(ts)) + to_minutes((30 + user_id % 60)::INT) AS WINDOW_END_LOCAL FROM events WHERE event_type = 'error'"""),
    "tp": ("fact", "SELECT TRIP_INSTANCE_ID, SERVICE_DATE, ROUTE_ID, ROUTE_SHORT_NAME, MODE, count(*) AS SCHEDULED, count(*) FILTER (WHERE ACTUAL_ARRIVAL_LOCAL IS NOT NULL) AS OBSERVED, min(SCHED_ARRIVAL_LOCAL) AS FIRST, max(SCHED_ARRIVAL_LOCAL) AS LAST, min(ACTUAL_ARRIVAL_LOCAL) AS FIRST_OBSERVED, max(ACTUAL_ARRIVAL_LOCAL) AS LAST_OBSERVED FROM fact GROUP BY ALL"),
    "dt1": ("fd bd", "SELECT 'D01|' || TRIP_INSTANCE_ID || '|' || STOP_SEQUENCE AS ANOMALY_ID, 'D01' AS DETECTOR, 'delay_outlier' AS DETECTOR_NAME, SERVICE_DATE, TRIP_INSTANCE_ID || '|' || STOP_SEQUENCE AS ENTITY_ID, e.ROUTE_ID, ROUTE_SHORT_NAME, e.MODE, e.STOP_ID, SCHED_ARRIVAL_LOCAL AS WINDOW_START, SCHED_ARRIVAL_LOCAL AS WINDOW_END, ARRIVAL_DELAY_SECS::DOUBLE AS OBSERVED_VALUE, med::DOUBLE AS EXPECTED_VALUE, (ARRIVAL_DELAY_SECS - med) / SIGMA_DELAY AS SCORE, format('{} at {} ran {}s vs typical {}s', ROUTE_SHORT_NAME, STOP_NAME, round(ARRIVAL_DELAY_SECS), round(med)) AS DETAIL FROM fd e JOIN bd b ON b.ROUTE_ID = e.ROUTE_ID AND b.DIRECTION_ID IS NOT DISTINCT FROM e.DIRECTION_ID AND b.STOP_ID = e.STOP_ID AND b.TIME_BAND = e.TIME_BAND AND b.DAY_TYPE = e.DAY_TYPE WHERE abs((ARRIVAL_DELAY_SECS - med) / SIGMA_DELAY) >= 1.5"),
    "dt2": ("hd", "SELECT 'D02|' || TRIP_INSTANCE_ID || '|' || STOP_ID AS ANOMALY_ID, 'D02' AS DETECTOR, 'bunching' AS DETECTOR_NAME, SERVICE_DATE, PREV_TRIP_INSTANCE_ID || '->' || TRIP_INSTANCE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, STOP_ID, PREV_ACTUAL_ARRIVAL AS WINDOW_START, ACTUAL_ARRIVAL_LOCAL AS WINDOW_END, ACTUAL_HEADWAY_SECS::DOUBLE AS OBSERVED_VALUE, SCHED_HEADWAY_SECS::DOUBLE AS EXPECTED_VALUE, (1 - HEADWAY_RATIO) * 4 AS SCORE, format('{} bunched at {}: {}s gap vs {}s scheduled', ROUTE_SHORT_NAME, STOP_NAME, ACTUAL_HEADWAY_SECS, SCHED_HEADWAY_SECS) AS DETAIL FROM hd WHERE FREQUENCY_CLASS IN ('FREQUENT', 'HIGH_FREQUENCY') AND SCHED_HEADWAY_SECS BETWEEN 120 AND 1800 AND HEADWAY_RATIO < 0.4"),
    "dt3": ("hd", "SELECT 'D03|' || TRIP_INSTANCE_ID || '|' || STOP_ID AS ANOMALY_ID, 'D03' AS DETECTOR, 'gapping' AS DETECTOR_NAME, SERVICE_DATE, PREV_TRIP_INSTANCE_ID || '->' || TRIP_INSTANCE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, STOP_ID, PREV_ACTUAL_ARRIVAL AS WINDOW_START, ACTUAL_ARRIVAL_LOCAL AS WINDOW_END, ACTUAL_HEADWAY_SECS::DOUBLE AS OBSERVED_VALUE, SCHED_HEADWAY_SECS::DOUBLE AS EXPECTED_VALUE, least((HEADWAY_RATIO - 1) * 2, 10.0) AS SCORE, format('{} gap at {}: {}s vs {}s scheduled', ROUTE_SHORT_NAME, STOP_NAME, ACTUAL_HEADWAY_SECS, SCHED_HEADWAY_SECS) AS DETAIL FROM hd WHERE FREQUENCY_CLASS IN ('FREQUENT', 'HIGH_FREQUENCY') AND SCHED_HEADWAY_SECS BETWEEN 120 AND 1800 AND HEADWAY_RATIO > 1.8"),
    "dt4": ("tp", "SELECT 'D04|' || TRIP_INSTANCE_ID AS ANOMALY_ID, 'D04' AS DETECTOR, 'ghost_trip' AS DETECTOR_NAME, SERVICE_DATE, TRIP_INSTANCE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, NULL::VARCHAR AS STOP_ID, FIRST AS WINDOW_START, LAST AS WINDOW_END, 0::DOUBLE AS OBSERVED_VALUE, SCHEDULED::DOUBLE AS EXPECTED_VALUE, 4.0::DOUBLE AS SCORE, format('{} trip {} scheduled {} stops, none observed', ROUTE_SHORT_NAME, TRIP_INSTANCE_ID, SCHEDULED) AS DETAIL FROM tp WHERE OBSERVED = 0"),
    "dt5": ("fw bw", "SELECT 'D05|' || TRIP_INSTANCE_ID || '|' || STOP_SEQUENCE AS ANOMALY_ID, 'D05' AS DETECTOR, 'dwell_outlier' AS DETECTOR_NAME, SERVICE_DATE, TRIP_INSTANCE_ID || '|' || STOP_SEQUENCE AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, STOP_ID, ACTUAL_ARRIVAL_LOCAL AS WINDOW_START, ACTUAL_DEPARTURE_LOCAL AS WINDOW_END, DWELL_SECS::DOUBLE AS OBSERVED_VALUE, med::DOUBLE AS EXPECTED_VALUE, (DWELL_SECS - med) / SIGMA_DWELL AS SCORE, format('{} held {}s at {} vs typical {}s', ROUTE_SHORT_NAME, round(DWELL_SECS), STOP_NAME, round(med)) AS DETAIL FROM fw JOIN bw USING (STOP_ID, TIME_BAND, DAY_TYPE, MODE) WHERE (DWELL_SECS - med) / SIGMA_DWELL >= 1.2"),
    "dt6": ("mo", "SELECT 'D06|' || TRIP_INSTANCE_ID || '|' || strftime(PING_LOCAL, '%Y%m%d%H%M%S') AS ANOMALY_ID, 'D06' AS DETECTOR, 'teleport' AS DETECTOR_NAME, SERVICE_DATE, VEHICLE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, NULL::VARCHAR AS STOP_ID, PREV_PING_LOCAL AS WINDOW_START, PING_LOCAL AS WINDOW_END, IMPLIED_KMH AS OBSERVED_VALUE, CASE WHEN MODE = 'RAIL' THEN 110.0 ELSE 70.0 END::DOUBLE AS EXPECTED_VALUE, least(IMPLIED_KMH / CASE WHEN MODE = 'RAIL' THEN 55.0 ELSE 35.0 END, 12.0) AS SCORE, format('vehicle {} implied {} km/h over {}m in {}s', VEHICLE_ID, round(IMPLIED_KMH), round(METRES_SINCE_PREV), SECS_SINCE_PREV) AS DETAIL FROM mo WHERE IMPLIED_KMH > CASE WHEN MODE = 'RAIL' THEN 160 ELSE 120 END AND SECS_SINCE_PREV BETWEEN 5 AND 300"),
    "dt7": ("mo", "SELECT 'D07|' || TRIP_INSTANCE_ID || '|' || strftime(min(PING_LOCAL), '%Y%m%d%H%M%S') AS ANOMALY_ID, 'D07' AS DETECTOR, 'stale_vehicle' AS DETECTOR_NAME, SERVICE_DATE, VEHICLE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, NULL::VARCHAR AS STOP_ID, min(PING_LOCAL) AS WINDOW_START, max(PING_LOCAL) AS WINDOW_END, max(DEVICE_LAG_SECS)::DOUBLE AS OBSERVED_VALUE, 25.0::DOUBLE AS EXPECTED_VALUE, least(max(DEVICE_LAG_SECS) / 60, 12.0) AS SCORE, format('vehicle {} telemetry stalled {}s across {} pings', VEHICLE_ID, max(DEVICE_LAG_SECS), count(*)) AS DETAIL FROM mo WHERE DEVICE_LAG_SECS > 90 GROUP BY TRIP_INSTANCE_ID, VEHICLE_ID, SERVICE_DATE, ROUTE_ID, ROUTE_SHORT_NAME, MODE HAVING count(*) >= 3"),
    "dt8": ("tp", "SELECT 'D08|' || TRIP_INSTANCE_ID AS ANOMALY_ID, 'D08' AS DETECTOR, 'trip_truncation' AS DETECTOR_NAME, SERVICE_DATE, TRIP_INSTANCE_ID AS ENTITY_ID, ROUTE_ID, ROUTE_SHORT_NAME, MODE, NULL::VARCHAR AS STOP_ID, FIRST_OBSERVED AS WINDOW_START, LAST_OBSERVED AS WINDOW_END, OBSERVED::DOUBLE AS OBSERVED_VALUE, SCHEDULED::DOUBLE AS EXPECTED_VALUE, (1 - OBSERVED / SCHEDULED) * 5 AS SCORE, format('{} reported {} of {} scheduled stops then stopped', ROUTE_SHORT_NAME, OBSERVED, SCHEDULED) AS DETAIL FROM tp WHERE OBSERVED > 0 AND SCHEDULED >= 6 AND OBSERVED / SCHEDULED < 0.8"),
    "dt9": ("sb bs", "SELECT 'D09|' || CELL_ID || '|' || strftime(SCHED_BIN_15MIN, '%Y%m%d%H%M') AS ANOMALY_ID, 'D09' AS DETECTOR, 'cluster_shock' AS DETECTOR_NAME, SERVICE_DATE, CELL_ID AS ENTITY_ID, NULL::VARCHAR AS ROUTE_ID, NULL::VARCHAR AS ROUTE_SHORT_NAME, MODE, NULL::VARCHAR AS STOP_ID, SCHED_BIN_15MIN AS WINDOW_START, SCHED_BIN_15MIN + INTERVAL 15 MINUTE AS WINDOW_END, MED_DELAY_SECS::DOUBLE AS OBSERVED_VALUE, med::DOUBLE AS EXPECTED_VALUE, (MED_DELAY_SECS - med) / SIGMA_CELL AS SCORE, format('cell median delay {}s vs baseline {}s across {} trips on {} routes', round(MED_DELAY_SECS), round(med), TRIPS, ROUTES) AS DETAIL FROM sb JOIN bs USING (CELL_ID, DAY_TYPE, MODE, BIN_HOUR) WHERE TRIPS >= 2 AND (MED_DELAY_SECS - med) / SIGMA_CELL >= 1.2"),
    "found0": ("dt1 dt2 dt3 dt4 dt5 dt6 dt7 dt8 dt9", " UNION ALL BY NAME ".join(f"SELECT * FROM dt{i}" for i in range(1, 10))),
    "found": ("found0", f"SELECT *, CASE WHEN DETECTOR IN ('D04', 'D06') THEN 'HIGH' ELSE {SEVERITY.format('SCORE')} END AS SEVERITY FROM found0"),
    "mt": ("found tr", "SELECT f.*, t.TRUTH_ID, t.EPISODE_TYPE FROM found f LEFT JOIN tr t ON t.SERVICE_DATE = f.SERVICE_DATE AND (f.ROUTE_ID IS NULL OR f.ROUTE_ID = t.ROUTE_ID) AND f.WINDOW_START >= t.WINDOW_START_LOCAL - INTERVAL 15 MINUTE AND f.WINDOW_START <= t.WINDOW_END_LOCAL + INTERVAL 15 MINUTE WHERE f.SEVERITY <> 'NONE'"),
    "ssen": ("street_hourly meta", f"""SELECT 'sensors' AS source, street AS location, c.lat, c.lon, date AS event_date, hour AS event_hour, is_weekend, CASE WHEN abs(zz) >= 3.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(zz, 2) AS score, 'ped+vehicle / hr' AS metric, false AS is_synthetic
        FROM (SELECT h.*, CASE WHEN sd > 0 THEN (total_count - mu) / sd END AS zz FROM street_hourly h JOIN (SELECT street, hour, is_weekend, avg(total_count) AS mu, stddev_samp(total_count) AS sd FROM street_hourly GROUP BY ALL) b USING (street, hour, is_weekend))
        LEFT JOIN (SELECT {STREET.format('NAME')} AS street, avg((LATITUDE_START_LINE + LATITUDE_END_LINE) / 2) AS lat, avg((LONGITUDE_START_LINE + LONGITUDE_END_LINE) / 2) AS lon FROM meta GROUP BY 1) c USING (street) WHERE abs(zz) >= 2.5"""),
    "strn": ("found st", "SELECT 'metlink' AS source, STOP_NAME AS location, STOP_LAT AS lat, STOP_LON AS lon, SERVICE_DATE AS event_date, hour(WINDOW_START)::INT AS event_hour, dayofweek(SERVICE_DATE) IN (0, 6) AS is_weekend, SEVERITY AS severity, round(SCORE, 2) AS score, DETECTOR_NAME AS metric, true AS is_synthetic FROM found JOIN st ON st.STOP_ID = found.STOP_ID WHERE SEVERITY IN ('HIGH', 'MEDIUM') AND STOP_LAT IS NOT NULL"),
    "dw": ("class_hourly", "SELECT is_weekend, hour, tc / sum(tc) OVER (PARTITION BY is_weekend) AS weight FROM (SELECT is_weekend, hour, sum(total_count) AS tc FROM class_hourly WHERE transport_class NOT IN ('Pedestrian', 'Cyclist') GROUP BY 1, 2)"),
    "hwh": ("dscored dw", "SELECT SiteRef, site_name AS location, state_highway, lat, lon, count_date AS event_date, w.hour AS event_hour, n.is_weekend, total_count * weight AS observed_synth, ratio, robust_z, severity, change AS direction, true AS is_synthetic FROM dscored n JOIN dw w ON w.is_weekend = n.is_weekend WHERE lat IS NOT NULL"),
    "shwy": ("hwh", "SELECT 'nzta' AS source, location, lat, lon, event_date, event_hour, is_weekend, severity, round(robust_z, 2) AS score, 'traffic / hr (synthetic)' AS metric, true AS is_synthetic FROM hwh WHERE severity IN ('HIGH', 'MEDIUM')"),
    "sfli": ("fscored", "SELECT 'flights' AS source, 'Wellington Airport (WLG)' AS location, -41.3272::DOUBLE AS lat, 174.8052::DOUBLE AS lon, event_date, event_hour, is_weekend, severity, round(robust_z, 2) AS score, 'total movements / hr' AS metric, false AS is_synthetic FROM fscored WHERE severity IN ('HIGH', 'MEDIUM')"),
    "uni": ("ssen strn shwy sfli", "SELECT * FROM ssen UNION ALL BY NAME SELECT * FROM strn UNION ALL BY NAME SELECT * FROM shwy UNION ALL BY NAME SELECT * FROM sfli"),
    "pts": ("uni", "SELECT source, location, lat, lon, event_date, event_hour, is_weekend, min(metric) AS metric, count(*) AS hits, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::INT AS sev_rank FROM uni GROUP BY 1, 2, 3, 4, 5, 6, 7"),
    "cf": ("uni", """SELECT round(lat, 2)::VARCHAR || ',' || round(lon, 2)::VARCHAR AS cell_id, round(lat, 2) AS cell_lat, round(lon, 2) AS cell_lon, event_date, event_hour, count(*) FILTER (WHERE source = 'sensors') AS sensor_hits, count(*) FILTER (WHERE source = 'metlink') AS metlink_hits, count(*) FILTER (WHERE source = 'nzta') AS nzta_hits,
        count(*) FILTER (WHERE source = 'flights') AS flight_hits, count(*) AS total_hits, count(DISTINCT source) AS sources_hit, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::INT AS max_sev_rank, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM uni WHERE lat IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""),
    "fs": ("", "SELECT event_id, date_trunc('day', ts) AS snapshot_ts, user_id::VARCHAR AS flight_key, CASE WHEN user_id % 2 = 0 THEN 'arrival' ELSE 'departure' END AS direction, CASE event_type WHEN 'view' THEN 'Expected' WHEN 'click' THEN 'Boarding' WHEN 'purchase' THEN 'Arrived' WHEN 'error' THEN 'Cancelled' ELSE 'Diverted' END AS status, 'G' || (event_id % 7) AS gate, date_trunc('day', ts) AS scheduled_utc, CASE WHEN event_id % 3 <> 0 THEN ts END AS estimated_utc, CASE WHEN event_id % 5 = 0 THEN ts END AS actual_utc FROM events"),
}


def step_sql(needs: str) -> list[tuple[str, str]]:
    """(name, SQL) of the named steps and all they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0].split():
            add(n)
        order.append(name)

    for n in needs.split():
        add(n)
    return [(n, CTES[n][1]) for n in order]


def sql(needs: str, body: str) -> str:
    """body with the named steps, and all they need, before it."""
    # DuckDB would expand a step at each use; the deep ones are made once
    steps = step_sql(needs)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in steps) + "\n" if steps else "") + body
