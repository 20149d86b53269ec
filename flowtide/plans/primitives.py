"""Queries of single operators: projections, joins, aggregations, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import baseline, boards, joins, rollup, snapshot, transit
from ..sources import landed as S
from . import adapters as A
from .core import day, r4, site_scores, snap
from .network import ts
from .oracle import DAY_TYPE, SEVERITY, STREET, sql
from .registry import query


def events(s, d):
    return A.table(s, d, "events")


def lines(s, d):
    return A.table(s, d, "lineitem")


# projections, filters and predicates -----------------------------------------------------------------------------------------


@query("p01_renamed", "SELECT user_id::VARCHAR AS countline_id, hour(ts)::INT AS hour, value AS count FROM events")
def _(s, d):
    raw = events(s, d).select(F.col("user_id").alias("_COL_0"), F.to_date("ts").alias("_COL_1"), F.hour("ts").cast("decimal(4,0)").alias("_COL_2"), F.col("value").alias("_COL_3"), F.col("event_type").alias("_COL_4"), F.lit("N").alias("_COL_5"))
    return snapshot.normalize_mobility(raw, check=False).select("countline_id", "hour", "count")


@query("p02_tolerant_casts", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE user_id::VARCHAR END AS INT) AS n FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("user_id").cast("string")).try_cast("int").alias("n"))


@query("p03_strict_casts", "SELECT event_id, user_id::VARCHAR::DOUBLE AS n FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.col("user_id").cast("string").cast("double").alias("n"))


@query("p04_all_but_one", "SELECT * EXCLUDE (props, ts) FROM events")
def _(s, d):
    return events(s, d).drop("props", "ts")


@query("p05_route_modes", sql("rt", "SELECT ROUTE_ID, MODE FROM rt"))
def _(s, d):
    return transit.stage_routes(A.gtfs_routes(s, d)).select("ROUTE_ID", "MODE")


@query("p06_time_bands", sql("fact", "SELECT TIME_BAND, DAY_TYPE, count(*) AS n FROM fact GROUP BY 1, 2"))
def _(s, d):
    return transit.stage_stop_events(A.stop_events(s, d)).groupBy("TIME_BAND", "DAY_TYPE").agg(F.count("*").alias("n"))


@query("p07_punctuality", sql("fact", "SELECT PUNCTUALITY_BAND, count(*) AS n FROM fact GROUP BY 1"))
def _(s, d):
    return A.stop_events(s, d).groupBy(C.punctuality("ARRIVAL_DELAY_SECS").alias("PUNCTUALITY_BAND")).agg(F.count("*").alias("n"))


Z = "((value - 50) / 15)"


@query("p08_severity_x01", f"SELECT event_id, {SEVERITY.format(Z)} AS severity FROM events")
def _(s, d):
    C.register_sql(s)
    events(s, d).createOrReplaceTempView("v_events")
    return s.sql("SELECT event_id, severity_of((value - 50) / 15) AS severity FROM v_events")


@query("p09_severity_ratio", f"SELECT event_id, CASE WHEN abs{Z} >= 1.5 THEN {SEVERITY.format(Z)} WHEN value / 50 <= 0.5 OR value / 50 >= 1.75 THEN 'LOW' ELSE 'NONE' END AS severity FROM events")
def _(s, d):
    return events(s, d).select("event_id", C.severity_or_ratio((F.col("value") - 50) / 15, F.col("value") / 50).alias("severity"))


@query("p10_directions", "SELECT event_id, CASE WHEN value < 20 THEN 'DROP' ELSE 'SURGE' END AS a, CASE WHEN value > 20 THEN 'increase' WHEN value < 20 THEN 'decrease' ELSE 'stable' END AS b FROM events")
def _(s, d):
    return events(s, d).select("event_id", C.drop_or_surge("value", F.lit(20)).alias("a"), C.change_direction("value", F.lit(20)).alias("b"))


@query("p11_severity_rank", sql("dscored", "SELECT CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank, count(*) AS n FROM dscored GROUP BY 1"))
def _(s, d):
    return site_scores(s, d).groupBy(C.severity_rank("severity").alias("rank")).agg(F.count("*").alias("n"))


@query("p12_confidence", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'low' WHEN user_id % 30 >= 12 THEN 'high' ELSE 'medium' END AS level, user_id % 30 AS history_samples, 'matched weekday and hour' AS basis FROM events")
def _(s, d):
    return events(s, d).select("event_id", C.confidence(F.col("user_id") % 30, F.when(F.col("event_id") % 4 != 0, "complete").otherwise("no_matching_history")).alias("c")).select("event_id", "c.*")


@query("p13_calendar", "SELECT event_id, isodow(ts)::INT AS iso_dow, ((isodow(ts) - 1) * 24 + hour(ts))::INT AS hour_of_week, isodow(ts) >= 6 AS is_weekend FROM events")
def _(s, d):
    return events(s, d).select("event_id", C.iso_dow("ts").alias("iso_dow"), C.hour_of_week("ts", F.hour("ts")).alias("hour_of_week"), C.is_weekend("ts").alias("is_weekend"))


@query("p14_box", sql("st", "SELECT STOP_ID FROM st WHERE IS_CBD"))
def _(s, d):
    return transit.stage_stops(A.gtfs_stops(s, d)).where(C.in_box("STOP_LAT", "STOP_LON", *transit.CBD)).select("STOP_ID")


@query("p16_filters", sql("dscored", "SELECT SiteRef, strftime(count_date, '%Y-%m-%d') AS count_date FROM dscored WHERE severity IN ('HIGH', 'MEDIUM') AND count_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND abs(robust_z) >= 2.6"))
def _(s, d):
    w = C.all_of(C.one_of("severity", ["HIGH", "MEDIUM"]), C.between_dates("count_date", "1996-01-01", "1998-12-31"), F.abs("robust_z") >= 2.6, C.one_of("SiteRef", []))
    return site_scores(s, d).where(w).select("SiteRef", day("count_date"))


@query("p17_half_open", "SELECT count(*) AS n FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12'")
def _(s, d):
    return events(s, d).where("ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'").agg(F.count("*").alias("n"))


@query("p18_lookback", sql("hist cur", "SELECT (SELECT count(*) FROM hist) AS history, (SELECT count(*) FROM cur) AS current"))
def _(s, d):
    o = A.observations(s, d, 2)
    at = F.make_timestamp_ntz(F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("hour"), F.lit(0), F.lit(0))
    t = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return o.agg(F.count_if((at < t) & (at >= t - F.make_dt_interval(days=F.lit(28)))).alias("history"), F.count_if(at == t).alias("current"))


@query("p19_gates", "SELECT count(*) FILTER (WHERE abs(value / 10) >= 4.5 AND abs(value - 20) >= 10 AND abs((value - 20) / 20) >= 0.35) AS n FROM events")
def _(s, d):
    v = F.col("value")
    return events(s, d).agg(F.count_if(C.passes_gates(v / 10, v - 20, (v - 20) / 20, 4.5, 10, 0.35)).alias("n"))


@query("p20_people", sql("obs", "SELECT transport_class IN ('Pedestrian', 'Cyclist') AS people, sum(count) AS n FROM obs GROUP BY 1"))
def _(s, d):
    return A.observations(s, d).groupBy(C.is_people("transport_class").alias("people")).agg(F.sum("count").alias("n"))


#: Spelling -> name, in the order in which events take them.
SPELLINGS = [
    ("Expected", "Expected"), ("expected arrival", "Expected"), ("En-route", "EnRoute"), ("CheckIn", "Scheduled"), ("boarding", "Boarding"), ("Gate Closed", "Boarding"), ("departed", "Departed"), ("DELAYED", "Delayed"),
    ("approaching", "EnRoute"), ("Arrived", "Arrived"), ("CANCELED", "Cancelled"), ("cancelled", "Cancelled"), ("diverted", "Diverted"), ("canceledUncertain", "Cancelled"), ("unknown", "Unknown"), ("scheduled", "Scheduled"), ("active", "EnRoute"),
    ("landed", "Arrived"), ("incident", "Incident"), ("", "Unknown"), (None, "Unknown"), ("strange thing", "Strange Thing"), ("on-stand 2b", "On-Stand 2B"), ("  ", "  "),
]
_quoted = lambda x: "NULL" if x is None else f"'{x}'"


@query("p22_status_names", f"SELECT event_id, name AS status FROM events JOIN (VALUES {', '.join(f'({i}, {_quoted(n)})' for i, (_, n) in enumerate(SPELLINGS))}) t(i, name) ON event_id % {len(SPELLINGS)} = i")
def _(s, d):
    raw = F.get(F.array(*[F.lit(x).cast("string") for x, _ in SPELLINGS]), (F.col("event_id") % len(SPELLINGS)).cast("int"))
    return events(s, d).select("event_id", C.status_name(raw).alias("status"))


# joins -----------------------------------------------------------------------------------------------------------------------


@query("j01_null_safe_left_j11", sql("ev", "SELECT e.ROUTE_ID, e.DIRECTION_ID, k FROM (SELECT ROUTE_ID, DIRECTION_ID, count(*) AS n FROM ev GROUP BY 1, 2) e LEFT JOIN (SELECT ROUTE_ID, DIRECTION_ID, max(STOP_SEQUENCE) AS k FROM ev WHERE DIRECTION_ID IS NULL OR DIRECTION_ID = 1 GROUP BY 1, 2) b ON e.ROUTE_ID = b.ROUTE_ID AND e.DIRECTION_ID IS NOT DISTINCT FROM b.DIRECTION_ID"))
def _(s, d):
    e, key = A.stop_events(s, d), ["ROUTE_ID", "DIRECTION_ID"]
    right = e.where("DIRECTION_ID is null or DIRECTION_ID = 1").groupBy(*key).agg(F.max("STOP_SEQUENCE").alias("k"))
    return baseline.null_safe(e.groupBy(*key).agg(F.count("*").alias("n")), right, key, "left").select(*key, "k")


@query("j02_inner_string_ids", sql("obs meta", "SELECT NAME, sum(count) AS n FROM obs JOIN meta ON meta.COUNTLINE_ID = obs.countline_id GROUP BY 1"))
def _(s, d):
    m = A.metadata(s, d).select(F.col("COUNTLINE_ID").alias("countline_id"), "NAME")
    return A.observations(s, d).join(m, "countline_id").groupBy("NAME").agg(F.sum("count").alias("n"))


@query("j03_anti_null_safe", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 6)")
def _(s, d):
    return baseline.null_safe(A.table(s, d, "part").select("p_partkey"), lines(s, d).where("l_linenumber = 6").select(F.col("l_partkey").alias("p_partkey")).distinct(), ["p_partkey"], "left_anti")


@query("j04_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(s, d):
    return A.table(s, d, "orders").join(lines(s, d), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j06_left_keeps_facts", "SELECT s_nationkey, r_name, count(*) AS n FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2) ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(s, d):
    n = A.table(s, d, "nation").join(A.table(s, d, "region").where("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("s_nationkey", "r_name").agg(F.count("*").alias("n"))


@query("j07_share_of_group_w08", "SELECT event_type, user_id, round(sum(value) / sum(sum(value)) OVER (PARTITION BY event_type), 4) AS share FROM events GROUP BY 1, 2")
def _(s, d):
    e = events(s, d).groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return e.select("event_type", "user_id", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("event_type")), 4).alias("share"))


@query("j09_cross_grid_j08", "SELECT event_type, h, coalesce(n, 0) AS n FROM (SELECT event_type, h::INT AS h FROM (SELECT DISTINCT event_type FROM events), generate_series(0, 23) t(h)) LEFT JOIN (SELECT event_type, hour(ts)::INT AS h, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2) USING (event_type, h)")
def _(s, d):
    e = events(s, d)
    grid = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    seen = e.where("value > 50").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["event_type", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("j10_case_insensitive", sql("hwd hws", "SELECT SiteRef, siteref IS NULL AS no_location, count(*) AS n FROM (SELECT h.SiteRef AS SiteRef, w.siteref AS ref FROM hwd h LEFT JOIN hws w ON upper(w.siteref) = upper(h.SiteRef)) GROUP BY 1, 2").replace("siteref IS NULL AS no_location", "ref IS NULL AS no_location").replace("GROUP BY 1, 2", "GROUP BY 1, 2"))
def _(s, d):
    o = rollup.distinct_observations(A.highway_counts(s, d), ["l_orderkey", "laneNumber"])
    sites = A.highway_sites(s, d).select(F.upper("siteref").alias("u"), F.lit(False).alias("f"))
    return o.join(sites, F.upper("SiteRef") == F.col("u"), "left").groupBy("SiteRef", F.coalesce("f", F.lit(True)).alias("no_location")).agg(F.count("*").alias("n"))


CAL = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def gtfs_calendar(s, d):
    k = F.col("c_custkey") % 20
    flags = [F.when((k + i) % 3 != 0, "1").otherwise("0").alias(n) for i, n in enumerate(CAL)]
    return A.table(s, d, "customer").select(F.concat(F.lit("S"), k).alias("service_id"), F.lit("20240101").alias("start_date"), F.when(k % 2 == 0, "20240115").otherwise("20240131").alias("end_date"), *flags).distinct()


CAL_SQL = "SELECT DISTINCT 'S' || (c_custkey % 20) AS service_id, c_custkey % 20 AS k FROM customer"


@query("j13_calendar_containment", f"SELECT service_id, strftime(x::DATE, '%Y-%m-%d') AS service_date FROM ({CAL_SQL}), generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(x) WHERE (k % 2 <> 0 OR x <= DATE '2024-01-15') AND (k + isodow(x) - 1) % 3 <> 0")
def _(s, d):
    days = s.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("service_date"))
    return joins.services_on(days, gtfs_calendar(s, d)).select("service_id", day("service_date"))


@query("d26_service_dates", f"""WITH c AS ({CAL_SQL}), days AS (SELECT x::DATE AS dt, CASE WHEN isodow(x) = 7 THEN 'SUNDAY' WHEN isodow(x) = 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END AS pattern FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) t(x)),
exc AS (SELECT service_id, DATE '2024-01-01' + k::INT AS dt, 1 + k % 2 AS kind FROM c),
run AS (SELECT dt, service_id FROM days, c WHERE (k % 2 <> 0 OR dt <= DATE '2024-01-15') AND dt <= DATE '2024-01-31' AND (k + isodow(dt) - 1) % 3 <> 0 UNION SELECT dt, service_id FROM exc WHERE kind = 1),
dir AS (SELECT * FROM run WHERE NOT EXISTS (SELECT 1 FROM exc WHERE kind = 2 AND exc.dt = run.dt AND exc.service_id = run.service_id)),
tr AS (SELECT 'S' || (o_custkey % 20) AS service_id, count(*) AS n FROM orders GROUP BY 1),
best AS (SELECT pattern, dt AS model FROM (SELECT pattern, dir.dt, sum(n) AS n FROM dir JOIN tr USING (service_id) JOIN days ON days.dt = dir.dt GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY n DESC, dt) = 1)
SELECT strftime(dt, '%Y-%m-%d') AS service_date, service_id, is_direct FROM (SELECT dt, service_id, true AS is_direct FROM dir UNION ALL SELECT days.dt, dir.service_id, false FROM days JOIN best USING (pattern) JOIN dir ON dir.dt = best.model WHERE days.dt NOT IN (SELECT dt FROM dir))""")
def _(s, d):
    days = s.range(41).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("service_date")).withColumn("pattern", C.day_type("service_date"))
    k = F.col("c_custkey") % 20
    exc = A.table(s, d, "customer").select(F.concat(F.lit("S"), k).alias("service_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "yyyyMMdd").alias("date"), (1 + k % 2).cast("string").alias("exception_type")).distinct()
    trips = A.table(s, d, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 20).alias("service_id"))
    return transit.service_dates(days, gtfs_calendar(s, d), exc, trips).select(day("service_date"), "service_id", "is_direct")


@query("d25_service_calendar", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS SERVICE_DATE, CASE WHEN ts::DATE = DATE '2024-01-01' THEN 'PUBLIC_HOLIDAY' WHEN isodow(ts) = 7 THEN 'SUNDAY' WHEN isodow(ts) = 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END AS DAY_TYPE, ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AS IS_SCHOOL_HOLIDAY, CASE WHEN ts::DATE = DATE '2024-01-01' OR isodow(ts) = 7 THEN 'SUNDAY' WHEN isodow(ts) = 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END AS TIMETABLE_PATTERN, ((day(ts) - 1) // 7 + 1)::INT AS WEEK_OF_MONTH FROM events")
def _(s, d):
    hol = S.constant(s, [("2024-01-01", "New Year")], "d string, HOLIDAY_NAME string").select(F.to_date("d").alias("SERVICE_DATE"), "HOLIDAY_NAME")
    brk = S.constant(s, [("2024-01-08", "2024-01-12")], "a string, b string").select(F.to_date("a").alias("first"), F.to_date("b").alias("last"))
    c = transit.service_calendar(events(s, d).select(F.to_date("ts").alias("SERVICE_DATE")).distinct(), hol, brk)
    return c.select(day("SERVICE_DATE"), "DAY_TYPE", "IS_SCHOOL_HOLIDAY", "TIMETABLE_PATTERN", "WEEK_OF_MONTH")


@query("d28_schedule", "SELECT o_orderkey || '|' || strftime(dt, '%Y%m%d') AS TRIP_INSTANCE_ID, k AS STOP_ORD, (2 + o_orderkey % 3)::INT AS TRIP_STOP_COUNT, strftime(dt + to_hours((20 + o_orderkey % 8)::INT) + to_minutes((k * 10)::INT), '%Y-%m-%d %H:%M:%S') AS SCHED_ARRIVAL_LOCAL FROM orders, (VALUES (1), (2), (3), (4)) t(k), (VALUES (DATE '2024-01-01', 0), (DATE '2024-01-02', 0), (DATE '2024-01-02', 1), (DATE '2024-01-03', 2), (DATE '2024-01-03', 3)) v(dt, service) WHERE service = o_custkey % 4 AND k <= 2 + o_orderkey % 3")
def _(s, d):
    """Four services on three days, trips of two to four stops, times past midnight."""
    o = A.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.lit("R").alias("route_id"), F.concat(F.lit("S"), F.col("o_custkey") % 4).alias("service_id"), F.lit("0").alias("direction_id"), (20 + F.col("o_orderkey") % 8).alias("h"), (2 + F.col("o_orderkey") % 3).alias("stops"))
    t = o.select("trip_id", "h", F.explode(F.sequence(F.lit(1).cast("long"), "stops")).alias("k"))
    at = F.format_string("%d:%02d:00", "h", F.col("k") * 10)
    times = t.select("trip_id", (F.col("k") * 5).cast("string").alias("stop_sequence"), F.concat(F.lit("P"), "k").alias("stop_id"), at.alias("arrival_time"), at.alias("departure_time"))
    runs = S.constant(s, [("2024-01-01", "S0"), ("2024-01-02", "S0"), ("2024-01-02", "S1"), ("2024-01-03", "S2"), ("2024-01-03", "S3")], "day string, service_id string").select(F.to_date("day").alias("service_date"), "service_id")
    x = transit.schedule(runs, o.drop("h", "stops"), times)
    return x.select("TRIP_INSTANCE_ID", F.col("STOP_ORD").cast("int"), F.col("TRIP_STOP_COUNT").cast("int"), ts("SCHED_ARRIVAL_LOCAL"))


@query("d29_resampled_w03", sql("ev", """SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE AS STOP_ORD, strftime(SCHED_ARRIVAL_LOCAL + to_seconds((x * 25)::INT), '%Y-%m-%d %H:%M:%S') AS PING_LOCAL, round(la + (nla - la) * x * 25 / leg, 5) AS LATITUDE FROM (SELECT *, unnest(range(0, leg // 25 + 1)) AS x FROM
  (SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, SCHED_ARRIVAL_LOCAL, replace(STOP_ID, 'P', '')::DOUBLE AS la, lead(replace(STOP_ID, 'P', '')::DOUBLE) OVER w AS nla, date_diff('second', SCHED_ARRIVAL_LOCAL, lead(SCHED_ARRIVAL_LOCAL) OVER w) AS leg FROM ev WINDOW w AS (PARTITION BY TRIP_INSTANCE_ID ORDER BY STOP_SEQUENCE)) WHERE leg BETWEEN 1 AND 3600)"""))
def _(s, d):
    lat = F.regexp_replace("STOP_ID", "P", "").cast("double")
    e = A.stop_events(s, d).select("TRIP_INSTANCE_ID", F.col("STOP_SEQUENCE").alias("STOP_ORD"), F.col("SCHED_ARRIVAL_LOCAL").alias("DEPARTURE"), F.col("SCHED_ARRIVAL_LOCAL").alias("ARRIVAL"), lat.alias("LAT"), lat.alias("LON"))
    return transit.resample(e).select("TRIP_INSTANCE_ID", "STOP_ORD", ts("PING_LOCAL"), F.round("LATITUDE", 5).alias("LATITUDE"))


@query("j16_scalar_row", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS pct FROM events GROUP BY 1")
def _(s, d):
    e = events(s, d)
    return e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("t"))).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("t"), 2).alias("pct"))


@query("j20_snowflake", "SELECT r_name, c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(s, d):
    t = lambda n: A.table(s, d, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# aggregations ----------------------------------------------------------------------------------------------------------------


@query("a01_median_a02_mad", "SELECT event_type, count(*) AS n, round(median(value), 4) AS median, round((SELECT median(abs(x.value - (SELECT median(value) FROM events y WHERE y.event_type = e.event_type))) FROM events x WHERE x.event_type = e.event_type), 4) AS mad FROM events e GROUP BY event_type")
def _(s, d):
    b = baseline.robust_baseline(events(s, d), ["event_type"], "value")
    return b.select("event_type", "n", *r4("median", "mad"))


@query("a03_mean_deviation", "SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"))


@query("a04_quantiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.75, 0.9, 0.95)) + " FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 4).alias(f"q{int(p * 100)}") for p in (0.25, 0.75, 0.9, 0.95)])


@query("a05_filtered_sums_a06_a07", "SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) FILTER (WHERE value > 50) AS big_kinds FROM events GROUP BY 1")
def _(s, d):
    t, v = F.col("event_type"), F.col("value")
    return events(s, d).groupBy("user_id").agg(F.round(F.sum(F.when(t == "click", v)), 4).alias("clicks"), F.count_if(t == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.when(v > 50, t)).alias("big_kinds"))


@query("a08_ordered_lists_a09_a19", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 7), ',' ORDER BY left(n_name, 7)) AS heads FROM nation GROUP BY 1")
def _(s, d):
    return A.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.array_join(F.array_sort(F.collect_set(F.substring("n_name", 1, 7))), ",").alias("heads"))


@query("a10_any_value_a11_extremes", "SELECT l_orderkey, min(l_returnflag) AS flag, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def _(s, d):
    return lines(s, d).groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("a12_minimum_support", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5")
def _(s, d):
    return events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 5")


@query("a13_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return snapshot.duplicate_keys(lines(s, d), ["l_orderkey", "l_linenumber"])


@query("a14_profile", "SELECT 'events' AS name, count(*) AS n, count(DISTINCT user_id) AS entities, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def _(s, d):
    one = lambda n, k, t: A.table(s, d, n).agg(F.count("*").alias("n"), F.countDistinct(k).alias("entities"), F.date_format(F.min(t), "yyyy-MM-dd").alias("first"), F.date_format(F.max(t), "yyyy-MM-dd").alias("last")).withColumn("name", F.lit(n))
    return transit.union_all([one("events", "user_id", "ts"), one("orders", "o_custkey", "o_orderdate")])


@query("a15_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return events(s, d).select("user_id", "event_type").distinct()


@query("a16_ratio_of_aggregates", "SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 1) AS pct FROM events GROUP BY 1")
def _(s, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return events(s, d).groupBy("user_id").agg(F.round(100.0 * n("purchase") / F.nullif(n("view"), F.lit(0)), 1).alias("pct"))


@query("a17_mode_a18_worst", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS top_type, max(n) AS top_n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    p = events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return p.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("t")).select("user_id", F.col("t.event_type").alias("top_type"), (-F.col("t.m")).alias("top_n"))


@query("a18_worst_example", "SELECT event_type, first(event_id ORDER BY value DESC, event_id) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(F.min(F.struct((-F.col("value")).alias("v"), "event_id")).alias("w")).select("event_type", F.col("w.event_id").alias("event_id"))


@query("a20_extent", sql("meta", "SELECT round(min(LATITUDE_START_LINE), 4) AS south, round(max(LATITUDE_END_LINE), 4) AS north, round(min(LONGITUDE_START_LINE), 4) AS west, round(max(LONGITUDE_END_LINE), 4) AS east FROM meta"))
def _(s, d):
    p = F.explode(F.array(*[F.struct(F.col(f"LATITUDE_{e}_LINE").alias("y"), F.col(f"LONGITUDE_{e}_LINE").alias("x")) for e in ("START", "END")]))
    return A.metadata(s, d).select(p.alias("p")).agg(*[F.round(f(c), 4).alias(n) for n, f, c in (("south", F.min, "p.y"), ("north", F.max, "p.y"), ("west", F.min, "p.x"), ("east", F.max, "p.x"))])


# windows, sorts and set operations ---------------------------------------------------------------------------------------------


@query("w01_lag_w02", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(s, d).select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


@query("w04_lossless_dedup", sql("hwd", "SELECT l_orderkey, laneNumber, trafficCount, classWeight FROM hwd"))
def _(s, d):
    return rollup.distinct_observations(A.highway_counts(s, d), ["l_orderkey", "laneNumber"]).select("l_orderkey", "laneNumber", "trafficCount", "classWeight")


@query("w05_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def _(s, d):
    return boards.latest(events(s, d), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("w06_nulls_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) = 1")
def _(s, d):
    o = A.table(s, d, "orders").withColumn("k", F.nullif("o_orderstatus", F.lit("F")))
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("k"), "o_orderkey")
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey")


@query("w07_best_date", f"SELECT pattern, strftime(dt, '%Y-%m-%d') AS best FROM (SELECT {DAY_TYPE.format('ts')} AS pattern, ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY n DESC, dt) = 1")
def _(s, d):
    e = events(s, d).groupBy(C.day_type("ts").alias("pattern"), F.to_date("ts").alias("best")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("pattern").orderBy(F.desc("n"), "best")
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("pattern", day("best"))


@query("w09_ordinals", sql("ev", "SELECT TRIP_INSTANCE_ID, STOP_SEQUENCE, count(*) OVER (PARTITION BY TRIP_INSTANCE_ID) AS stops FROM ev"))
def _(s, d):
    return A.stop_events(s, d).select("TRIP_INSTANCE_ID", "STOP_SEQUENCE", F.count("*").over(Window.partitionBy("TRIP_INSTANCE_ID")).alias("stops"))


@query("t01_top_by_score", "SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY abs(value - 50) DESC, event_id) <= 100")
def _(s, d):
    return events(s, d).orderBy(F.abs(F.col("value") - 50).desc(), "event_id").limit(100).select("event_id", "value")


@query("t02_severity_order_t03", sql("dscored", "SELECT SiteRef, strftime(count_date, '%Y-%m-%d') AS count_date FROM dscored QUALIFY row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, abs(robust_z) DESC NULLS LAST, SiteRef, dscored.count_date) <= 50"))
def _(s, d):
    x = site_scores(s, d).orderBy(C.severity_rank("severity").desc(), F.abs("robust_z").desc_nulls_last(), "SiteRef", "count_date").limit(50)
    return x.select("SiteRef", day("count_date"))


@query("t04_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, user_id) <= 15")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)


@query("t05_top_of_class", sql("scored", "SELECT countline_id, transport_class, round(robust_z, 4) AS robust_z FROM scored WHERE robust_z IS NOT NULL AND change_direction = 'decrease' QUALIFY row_number() OVER (ORDER BY abs(robust_z) DESC, countline_id, transport_class) <= 5"))
def _(s, d):
    x = snap(s, d).scored.where("robust_z is not null and change_direction = 'decrease'").orderBy(F.abs("robust_z").desc(), "countline_id", "transport_class").limit(5)
    return x.select("countline_id", "transport_class", *r4("robust_z"))


@query("u01_union_by_position", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(s, d):
    return A.table(s, d, "nation").select(F.col("n_name").alias("name")).union(A.table(s, d, "region").select("r_name"))


@query("u02_union_by_name", "SELECT user_id AS id, 'e' AS src, value FROM events UNION ALL BY NAME SELECT 'o' AS src, o_totalprice AS value, o_custkey AS id FROM orders")
def _(s, d):
    o = A.table(s, d, "orders").select(F.lit("o").alias("src"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("id"))
    return events(s, d).select(F.col("user_id").alias("id"), F.lit("e").alias("src"), "value").unionByName(o)


@query("u03_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def _(s, d):
    return A.table(s, d, "orders").select(F.col("o_custkey").alias("id")).union(events(s, d).select("user_id")).distinct()


# scalar functions --------------------------------------------------------------------------------------------------------------


#: Ends of sensor names: descriptors of many kinds, several at once, none, and one that is part of a word.
ENDS = ["Street Bridge - west", "Quay Shared Path north", "Road", "Terrace Cyclelanes", "St Northbound lane", "Ave-lhs", "Hill underpass exit", "Square", "SideRoad kerb", "Parkway Entrance", "Lane", "Place Vehicle"]
_PLACE = "'S' || p_partkey || ' ' || p_name || ' ' || ([{}])[(p_partkey % {} + 1)::INT]".format(", ".join(f"'{e}'" for e in ENDS), len(ENDS))


@query("f01_text_f02_street", f"SELECT p_partkey, {STREET.format('name')} AS street FROM (SELECT p_partkey, {_PLACE} AS name FROM part)")
def _(s, d):
    C.register_sql(s)
    ends = F.get(F.array(*map(F.lit, ENDS)), (F.col("p_partkey") % len(ENDS)).cast("int"))
    A.table(s, d, "part").select("p_partkey", F.concat(F.lit("S"), "p_partkey", F.lit(" "), "p_name", F.lit(" "), ends).alias("name")).createOrReplaceTempView("v_part")
    return s.sql("SELECT p_partkey, street_of(name) AS street FROM v_part")


@query("f03_split_pad_f04_format", "SELECT c_custkey, split_part(c_name, '#', 2) AS num, lpad((c_custkey % 100)::VARCHAR, 3, '0') AS pad, length(c_mktsegment) AS len, upper(c_mktsegment) || ' at ' || c_nationkey AS txt FROM customer")
def _(s, d):
    return A.table(s, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("num"), F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0").alias("pad"), F.length("c_mktsegment").cast("long").alias("len"), F.format_string("%s at %d", F.upper("c_mktsegment"), "c_nationkey").alias("txt"))


@query("f05_dates_f06_quarter", "SELECT event_id, isodow(ts)::INT AS a, dayofweek(ts)::INT AS b, dayname(ts) AS c, day(ts)::INT AS d, minute(ts)::INT AS e, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS f, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS g FROM events")
def _(s, d):
    f = lambda x, n: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(n)
    return events(s, d).select("event_id", C.iso_dow("ts").alias("a"), C.sunday_dow("ts").alias("b"), F.date_format("ts", "EEEE").alias("c"), F.dayofmonth("ts").alias("d"), F.minute("ts").alias("e"), f(F.date_trunc("hour", "ts"), "f"), f(C.quarter_hour("ts"), "g"))


@query("f07_differences", "SELECT event_id, date_diff('minute', date_trunc('day', ts), ts) AS m, date_diff('second', TIMESTAMP '2024-01-01 00:00:00.5', ts) AS s, date_diff('minute', ts, ts + INTERVAL 122 SECOND) AS k FROM events")
def _(s, d):
    return events(s, d).select("event_id", C.minutes_between(F.date_trunc("day", "ts"), "ts").alias("m"), C.seconds_between(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"), "ts").alias("s"), C.minutes_between("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(122))).alias("k"))


@query("f08_zones", "SELECT event_id, strftime((ts AT TIME ZONE 'Pacific/Auckland') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland', '%Y-%m-%d %H:%M:%S') AS local FROM events")
def _(s, d):
    f = lambda x, n: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(n)
    return events(s, d).select("event_id", f(C.local_to_utc("ts"), "utc"), f(C.utc_to_local("ts"), "local"))


@query("f09_formats_f10_intervals", "SELECT event_id, strftime(ts, '%Y%m%d') AS a, strftime(ts + to_minutes((user_id % 90)::INT), '%H:%M') AS b, strftime(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS c FROM events")
def _(s, d):
    a = F.date_format("ts", "yyyyMMdd")
    return events(s, d).select("event_id", a.alias("a"), F.date_format(F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 90).cast("int")), "HH:mm").alias("b"), F.date_format(F.to_date(a, "yyyyMMdd"), "yyyy-MM-dd").alias("c"))


@query("f11_math_f12_haversine_f13", "SELECT event_id, round(sqrt(value), 4) AS a, greatest(value, 50) AS b, least(user_id % 7, 3) AS c, ceil(value)::BIGINT AS d, floor(value)::BIGINT AS e, round(12742000 * asin(sqrt(pow(sin(radians(0.01) / 2), 2) + cos(radians(-41.3)) * cos(radians(-41.29)) * pow(sin(radians(value / 1000) / 2), 2))), 2) AS m FROM events")
def _(s, d):
    v = F.col("value")
    return events(s, d).select("event_id", F.round(F.sqrt(v), 4).alias("a"), F.greatest(v, F.lit(50.0)).alias("b"), F.least(F.col("user_id") % 7, F.lit(3)).alias("c"), F.ceil(v).alias("d"), F.floor(v).alias("e"), F.round(C.haversine_m(F.lit(-41.3), F.lit(174.0), F.lit(-41.29), 174.0 + v / 1000), 2).alias("m"))


@query("f15_service_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 28) * 3600 + (o_orderkey % 60) * 60 + 5 END AS s FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    t = F.when(k % 9 == 0, "soon").otherwise(F.format_string("%d:%02d:05", k % 28, k % 60))
    return A.table(s, d, "orders").select("o_orderkey", C.service_seconds(t).alias("s"))


@query("f16_tolerant_times", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(CASE WHEN event_id % 4 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') END AS t FROM events")
def _(s, d):
    k, f = F.col("event_id") % 4, lambda x: F.date_format("ts", x)
    raw = F.when(k == 0, f("yyyy-MM-dd HH:mm:ss'Z'")).when(k == 1, f("yyyy-MM-dd'T'HH:mm")).when(k == 2, f("yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("nonsense")
    return events(s, d).select("event_id", F.date_format(C.tolerant_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("f17_series_f18_arrays", "SELECT n_nationkey, k::INT AS k, ['a', 'b', 'c'][(k % 3 + 1)::INT] AS x FROM nation, generate_series(0, 4) t(k)")
def _(s, d):
    return A.table(s, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("n_nationkey", "k", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("k") % 3 + 1).alias("x"))


@query("f19_json", "SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("f20_distinct_from_f21_keys", "SELECT event_id, nullif(event_type, 'error') IS DISTINCT FROM 'view' AS a, CASE WHEN user_id % 2 = 0 THEN 'arrival' ELSE 'departure' END || '|' || CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' ELSE 'NZ' || user_id END || '|' || CASE WHEN event_id % 7 = 0 THEN 'NOSCHED' ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS k, user_id || '|' || strftime(ts, '%Y%m%d') AS trip FROM events")
def _(s, d):
    e, i = events(s, d), F.col("event_id")
    key = C.flight_key(F.when(F.col("user_id") % 2 == 0, "arrival").otherwise("departure"), F.when(i % 5 != 0, F.concat(F.lit("NZ"), "user_id")), F.when(i % 7 != 0, F.col("ts")))
    return e.select("event_id", joins.changed(F.nullif("event_type", F.lit("error")), F.lit("view")).alias("a"), key.alias("k"), C.trip_instance(F.col("user_id").cast("string"), "ts").alias("trip"))


@query("f22_md5_age", "SELECT event_id, md5(props) AS h, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01') AS age FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.md5(F.col("props").cast("binary")).alias("h"), C.seconds_between("ts", F.lit("2024-02-01").cast("timestamp_ntz")).alias("age"))
