"""Public transport: calendar, schedule, staging, dimensions, facts, features and baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cell_id, day_type, frequency_class, haversine_m, in_box, local_to_utc, punctuality, quarter_hour, route_mode, seconds_between, service_seconds, speed_kmh, time_band, trip_instance, week_of_month
from .baseline import robust_baseline, sigma
from .joins import services_on
from .ranges import lagged

#: The central business district (fixed values): south, west, north, east.
CBD = (-41.300, 174.765, -41.270, 174.790)
DELAY_KEYS = ["ROUTE_ID", "DIRECTION_ID", "STOP_ID", "TIME_BAND", "DAY_TYPE"]
DWELL_KEYS = ["STOP_ID", "TIME_BAND", "DAY_TYPE", "MODE"]
CELL_KEYS = ["CELL_ID", "DAY_TYPE", "MODE", "BIN_HOUR"]


def service_calendar(days: DataFrame, holidays: DataFrame, school_breaks: DataFrame) -> DataFrame:
    """days: (SERVICE_DATE); holidays: (SERVICE_DATE, HOLIDAY_NAME); school_breaks: (first, last). A public holiday runs the Sunday timetable."""
    breaks = school_breaks.select(F.explode(F.sequence("first", "last")).alias("SERVICE_DATE")).distinct().withColumn("IS_SCHOOL_HOLIDAY", F.lit(True))
    d = days.join(holidays, "SERVICE_DATE", "left").join(breaks, "SERVICE_DATE", "left")
    kind = F.when(F.col("HOLIDAY_NAME").isNotNull(), "PUBLIC_HOLIDAY").otherwise(day_type("SERVICE_DATE"))
    d = d.withColumns({"IS_PUBLIC_HOLIDAY": F.col("HOLIDAY_NAME").isNotNull(), "IS_SCHOOL_HOLIDAY": F.coalesce("IS_SCHOOL_HOLIDAY", F.lit(False)), "DAY_TYPE": kind, "WEEK_OF_MONTH": week_of_month("SERVICE_DATE"), "DAY_NAME": F.date_format("SERVICE_DATE", "EEEE")})
    return d.withColumn("TIMETABLE_PATTERN", F.when(F.col("DAY_TYPE").isin("SUNDAY", "PUBLIC_HOLIDAY"), "SUNDAY").otherwise(F.col("DAY_TYPE")))


def service_dates(days: DataFrame, calendar: DataFrame, exceptions: DataFrame, trips: DataFrame) -> DataFrame:
    """(service_date, service_id, is_direct): the calendar plus added (type 1) minus removed (type 2) services. A day without any service
    takes those of the representative day of its pattern: the one with most trips, the earliest on a tie. days: (service_date, pattern)."""
    exc = exceptions.select("service_id", F.to_date("date", "yyyyMMdd").alias("service_date"), F.col("exception_type").cast("int").alias("kind")).join(days.select("service_date"), "service_date")
    running = services_on(days.select("service_date"), calendar).union(exc.where("kind = 1").select("service_date", "service_id")).distinct()
    direct = running.join(exc.where("kind = 2").select("service_date", "service_id"), ["service_date", "service_id"], "left_anti")
    per_service = trips.groupBy("service_id").agg(F.count("*").alias("n"))
    per_day = direct.join(per_service, "service_id").groupBy("service_date").agg(F.sum("n").alias("n")).join(days, "service_date")
    best = per_day.withColumn("place", F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("n"), "service_date"))).where("place = 1").select("pattern", F.col("service_date").alias("model"))
    empty = days.join(direct.select("service_date").distinct(), "service_date", "left_anti").join(best, "pattern")
    lent = empty.join(direct.withColumnsRenamed({"service_date": "model"}), "model").select("service_date", "service_id", F.lit(False).alias("is_direct"))
    return direct.withColumn("is_direct", F.lit(True)).unionByName(lent)


def schedule(dates: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trip instances x stop times with ordinals; seconds count from the start of the service day and may pass 24 hours."""
    runs = dates.join(trips.select("trip_id", "route_id", "service_id", "direction_id"), "service_id").withColumn("TRIP_INSTANCE_ID", trip_instance("trip_id", "service_date"))
    times = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), service_seconds("arrival_time").alias("arrival_s"), service_seconds("departure_time").alias("departure_s"))
    line = Window.partitionBy("trip_id").orderBy("stop_sequence")
    times = times.withColumns({"STOP_ORD": F.row_number().over(line), "TRIP_STOP_COUNT": F.count("*").over(Window.partitionBy("trip_id"))})
    at = lambda s: F.col("service_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(s))
    return runs.join(times, "trip_id").withColumns({"SCHED_ARRIVAL_LOCAL": at("arrival_s"), "SCHED_DEPARTURE_LOCAL": at("departure_s")})


def resample(schedule_rows: DataFrame, step_s: int = 25, least_s: int = 1, most_s: int = 3600) -> DataFrame:
    """Positions every step_s seconds on straight legs between successive stops. Input: TRIP_INSTANCE_ID, STOP_ORD, DEPARTURE, ARRIVAL (timestamps), LAT, LON."""
    line = Window.partitionBy("TRIP_INSTANCE_ID").orderBy("STOP_ORD")
    nxt = lambda x: F.lead(x).over(line)
    legs = schedule_rows.withColumns({"_lat": nxt("LAT"), "_lon": nxt("LON"), "_arrive": nxt("ARRIVAL")}).withColumn("_leg", seconds_between("DEPARTURE", "_arrive")).where(F.col("_leg").between(least_s, most_s))
    rows = legs.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_leg").cast("int"), F.lit(step_s))))
    share = F.col("_s") / F.col("_leg")
    return rows.select("TRIP_INSTANCE_ID", "STOP_ORD", (F.col("DEPARTURE") + F.make_dt_interval(secs=F.col("_s"))).alias("PING_LOCAL"), (F.col("LAT") + (F.col("_lat") - F.col("LAT")) * share).alias("LATITUDE"), (F.col("LON") + (F.col("_lon") - F.col("LON")) * share).alias("LONGITUDE"))


def stage_routes(routes: DataFrame) -> DataFrame:
    t = F.col("route_type").try_cast("int")
    return routes.select(F.col("route_id").alias("ROUTE_ID"), F.col("agency_id").alias("AGENCY_ID"), F.col("route_short_name").alias("ROUTE_SHORT_NAME"), F.col("route_long_name").alias("ROUTE_LONG_NAME"), t.alias("ROUTE_TYPE"), route_mode(t).alias("MODE"))


def stage_stops(stops: DataFrame) -> DataFrame:
    """Stops with a readable latitude."""
    num = lambda x: F.col(x).try_cast("double")
    return stops.select(F.col("stop_id").alias("STOP_ID"), F.col("stop_code").alias("STOP_CODE"), F.col("stop_name").alias("STOP_NAME"), num("stop_lat").alias("STOP_LAT"), num("stop_lon").alias("STOP_LON"), F.col("zone_id").alias("ZONE_ID"), F.col("parent_station").alias("PARENT_STATION"), F.col("location_type").try_cast("int").alias("LOCATION_TYPE")).where("STOP_LAT is not null")


def stage_stop_events(events: DataFrame) -> DataFrame:
    """Adds UTC times, the scheduled hour (of the schedule, never of the actual time), the time band and the quarter hour."""
    e = events.withColumns({"SCHED_ARRIVAL_UTC": local_to_utc("SCHED_ARRIVAL_LOCAL"), "ACTUAL_ARRIVAL_UTC": local_to_utc("ACTUAL_ARRIVAL_LOCAL"), "SCHED_HOUR": F.hour("SCHED_ARRIVAL_LOCAL"), "SCHED_BIN_15MIN": quarter_hour("SCHED_ARRIVAL_LOCAL")})
    return e.withColumn("TIME_BAND", time_band("DAY_TYPE", "SCHED_HOUR"))


def stage_pings(pings: DataFrame) -> DataFrame:
    """Pings with their UTC time, the fault flag and the episode that they carry."""
    return pings.withColumn("PING_UTC", local_to_utc("PING_LOCAL")).select(
        "TRIP_INSTANCE_ID", "VEHICLE_ID", "SERVICE_DATE", "ROUTE_ID", "ROUTE_SHORT_NAME", "DIRECTION_ID", "MODE", "PING_LOCAL", "PING_UTC", "DEVICE_TS_LOCAL", "LATITUDE", "LONGITUDE", "HAS_GPS_FAULT", "TRUTH_ID", "IS_SYNTHETIC",
    )


def route_dimension(routes: DataFrame, events: DataFrame, days: float = 30.0) -> DataFrame:
    """Routes with their trip instances, distinct stops and frequency class; routes without events have none."""
    used = events.groupBy("ROUTE_ID").agg(F.countDistinct("TRIP_INSTANCE_ID").alias("TRIP_INSTANCES"), F.countDistinct("STOP_ID").alias("DISTINCT_STOPS"))
    out = routes.join(used, "ROUTE_ID", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("TRIP_INSTANCES", "DISTINCT_STOPS")})
    return out.withColumn("FREQUENCY_CLASS", frequency_class("TRIP_INSTANCES", days))


def stop_dimension(stops: DataFrame, events: DataFrame) -> DataFrame:
    """Stops with routes served and events. STOP_EVENTS counts joined rows and so is 1 for an unused stop; MATCHED_EVENTS is 0 there."""
    used = events.groupBy("STOP_ID").agg(F.countDistinct("ROUTE_ID").alias("ROUTES_SERVED"), F.count("*").alias("MATCHED_EVENTS"))
    out = stops.join(used, "STOP_ID", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("ROUTES_SERVED", "MATCHED_EVENTS")})
    return placed_stops(out).withColumn("STOP_EVENTS", F.greatest("MATCHED_EVENTS", F.lit(1)))


def placed_stops(stops: DataFrame) -> DataFrame:
    """Stops with the flag of the business district: all that the fact takes of them, without a pass over the events."""
    return stops.withColumn("IS_CBD", in_box("STOP_LAT", "STOP_LON", *CBD))


def stop_event_fact(events: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Staged events with stop, route frequency and punctuality band. Both dimensions are joined on their keys; Spark broadcasts them if they are small."""
    s = stops.select("STOP_ID", "STOP_NAME", "STOP_LAT", "STOP_LON", "IS_CBD")
    return events.join(s, "STOP_ID", "left").join(routes.select("ROUTE_ID", "FREQUENCY_CLASS"), "ROUTE_ID", "left").withColumn("PUNCTUALITY_BAND", punctuality("ARRIVAL_DELAY_SECS"))


def daily_performance(fact: DataFrame, places: int = 1) -> DataFrame:
    on_time = 100.0 * F.count_if(F.col("PUNCTUALITY_BAND") == "ON_TIME") / F.nullif(F.count("ARRIVAL_DELAY_SECS"), F.lit(0))
    return fact.groupBy("SERVICE_DATE", "DAY_TYPE", "MODE").agg(
        F.count("*").alias("SCHEDULED_STOP_EVENTS"), F.count_if(F.col("IS_OBSERVED") & F.col("IS_REPORTED")).alias("OBSERVED_STOP_EVENTS"), F.round(on_time, 1).alias("PCT_ON_TIME"),
        F.round(F.median("ARRIVAL_DELAY_SECS"), places).alias("MEDIAN_DELAY_SECS"), F.round(F.percentile("ARRIVAL_DELAY_SECS", F.lit(0.95)), places).alias("P95_DELAY_SECS"),
        F.countDistinct(F.when(~F.col("IS_OBSERVED"), F.col("TRIP_INSTANCE_ID"))).alias("CANCELLED_TRIPS"),
    )


def headways(fact: DataFrame) -> DataFrame:
    """Scheduled and actual gap to the trip before at the same stop, route, direction and day; ties by trip."""
    seen = fact.where("IS_OBSERVED and IS_REPORTED")
    line = Window.partitionBy("ROUTE_ID", "DIRECTION_ID", "STOP_ID", "SERVICE_DATE").orderBy("SCHED_ARRIVAL_LOCAL", "TRIP_INSTANCE_ID", "STOP_SEQUENCE")
    before = lambda x: F.lag(x).over(line)
    out = seen.withColumns({"PREV_SCHED_ARRIVAL": before("SCHED_ARRIVAL_LOCAL"), "PREV_ACTUAL_ARRIVAL": before("ACTUAL_ARRIVAL_LOCAL"), "PREV_TRIP_INSTANCE_ID": before("TRIP_INSTANCE_ID")}).where("PREV_SCHED_ARRIVAL is not null")
    out = out.withColumns({"SCHED_HEADWAY_SECS": seconds_between("PREV_SCHED_ARRIVAL", "SCHED_ARRIVAL_LOCAL"), "ACTUAL_HEADWAY_SECS": seconds_between("PREV_ACTUAL_ARRIVAL", "ACTUAL_ARRIVAL_LOCAL")})
    return out.withColumn("HEADWAY_RATIO", F.when(F.col("SCHED_HEADWAY_SECS") > 0, F.col("ACTUAL_HEADWAY_SECS") / F.col("SCHED_HEADWAY_SECS")))


def delay_baseline(fact: DataFrame, min_n: int = 5, parts: int | None = None) -> DataFrame:
    base = robust_baseline(fact.where("ARRIVAL_DELAY_SECS is not null"), [*DELAY_KEYS, "MODE"], "ARRIVAL_DELAY_SECS", min_n, {"Q1_DELAY": 0.25, "Q3_DELAY": 0.75, "P95_DELAY": 0.95}, many=True, parts=parts)
    return base.select(*DELAY_KEYS, "MODE", F.col("n").alias("N_OBS"), F.col("median").alias("MED_DELAY"), "Q1_DELAY", "Q3_DELAY", "P95_DELAY", F.col("mad").alias("MAD_DELAY"), sigma("mad", 20.0).alias("SIGMA_DELAY"))


def dwell_baseline(fact: DataFrame, min_n: int = 5, parts: int | None = None) -> DataFrame:
    base = robust_baseline(fact.where("DWELL_SECS is not null"), DWELL_KEYS, "DWELL_SECS", min_n, many=True, parts=parts)
    return base.select(*DWELL_KEYS, F.col("n").alias("N_OBS"), F.col("median").alias("MED_DWELL"), sigma("mad", 10.0).alias("SIGMA_DWELL"))


def ping_motion(pings: DataFrame, spread: bool = False) -> DataFrame:
    """Metres, seconds and km/h since the ping before of the same trip, and the lag of the device clock. spread: for trips with so many pings that one task can't
    hold them, the pings of a trip lie in ranges of time."""
    order, before = ["PING_LOCAL", "LATITUDE", "LONGITUDE"], {"PREV_LATITUDE": "LATITUDE", "PREV_LONGITUDE": "LONGITUDE", "PREV_PING_LOCAL": "PING_LOCAL"}
    line = Window.partitionBy("TRIP_INSTANCE_ID").orderBy(*order)
    p = lagged(pings, ["TRIP_INSTANCE_ID"], order, before) if spread else pings.withColumns({name: F.lag(c).over(line) for name, c in before.items()})
    p = p.where("PREV_LATITUDE is not null")
    p = p.withColumns({"SECS_SINCE_PREV": seconds_between("PREV_PING_LOCAL", "PING_LOCAL"), "METRES_SINCE_PREV": haversine_m("PREV_LATITUDE", "PREV_LONGITUDE", "LATITUDE", "LONGITUDE"), "DEVICE_LAG_SECS": seconds_between("DEVICE_TS_LOCAL", "PING_LOCAL")})
    return p.withColumn("IMPLIED_KMH", speed_kmh("METRES_SINCE_PREV", "SECS_SINCE_PREV"))


def spatial_bins(fact: DataFrame, cell: Column | None = None, min_n: int = 5, parts: int | None = None) -> DataFrame:
    """Cells of about 100 m by 15 minutes with enough events. Rows are dealt by bin once; equal delays of a bin are one row with their number before quantiles are taken, and routes
    and trips are counted from their distinct values, so that no row is made once for each count. parts: the number of tasks."""
    cell = cell_id("STOP_LAT", "STOP_LON", 3) if cell is None else cell
    key = F.struct(cell.alias("CELL_ID"), "SERVICE_DATE", "DAY_TYPE", "SCHED_BIN_15MIN", "MODE").alias("_g")
    rows = fact.where("ARRIVAL_DELAY_SECS is not null and STOP_LAT is not null").select(key, "ROUTE_ID", "TRIP_INSTANCE_ID", F.col("ARRIVAL_DELAY_SECS").alias("_v"), "STOP_LAT", "STOP_LON").repartition(*([parts] if parts else []), "_g")
    n = lambda c, name: rows.select("_g", c).distinct().groupBy("_g").agg(F.count(c).alias(name))
    delays = rows.groupBy("_g", "_v").agg(F.count("*").alias("_n"), F.sum("STOP_LAT").alias("_lat"), F.sum("STOP_LON").alias("_lon"))
    out = delays.groupBy("_g").agg(F.sum("_n").alias("STOP_EVENTS"), F.percentile("_v", F.array(F.lit(0.5), F.lit(0.9)), F.col("_n")).alias("_q"), F.sum("_lat").alias("_lat"), F.sum("_lon").alias("_lon"))
    out = out.where(F.col("STOP_EVENTS") >= min_n).join(n("ROUTE_ID", "ROUTES"), "_g").join(n("TRIP_INSTANCE_ID", "TRIPS"), "_g")
    centre = [(F.col(c) / F.col("STOP_EVENTS")).alias(name) for c, name in (("_lat", "CELL_LAT"), ("_lon", "CELL_LON"))]
    return out.select("_g.*", "STOP_EVENTS", "ROUTES", "TRIPS", F.col("_q")[0].alias("MED_DELAY_SECS"), F.col("_q")[1].alias("P90_DELAY_SECS"), *centre)


def spatial_baseline(bins: DataFrame, min_n: int = 5) -> DataFrame:
    base = robust_baseline(bins.withColumn("BIN_HOUR", F.hour("SCHED_BIN_15MIN")), CELL_KEYS, "MED_DELAY_SECS", min_n)
    return base.select(*CELL_KEYS, F.col("n").alias("N_BINS"), F.col("median").alias("MED_CELL_DELAY"), sigma("mad", 15.0).alias("SIGMA_CELL"))


def cumulative_delay_change(fact: DataFrame) -> DataFrame:
    """Running sum along a trip of the change in delay from stop to stop."""
    line = Window.partitionBy("TRIP_INSTANCE_ID").orderBy("STOP_SEQUENCE")
    step = F.col("ARRIVAL_DELAY_SECS") - F.lag("ARRIVAL_DELAY_SECS").over(line)
    return fact.withColumn("DELAY_STEP", F.coalesce(step, F.lit(0))).withColumn("DELAY_GAINED", F.sum("DELAY_STEP").over(line.rowsBetween(Window.unboundedPreceding, 0)))


def episode_coverage(tagged: DataFrame) -> DataFrame:
    """(TRUTH_EPISODE_TYPE, stop_events, trips) of tagged stop events."""
    return tagged.where("TRUTH_EPISODE_TYPE is not null").groupBy("TRUTH_EPISODE_TYPE").agg(F.count("*").alias("stop_events"), F.countDistinct("TRIP_INSTANCE_ID").alias("trips"))


def counted_coverage(trips: DataFrame) -> DataFrame:
    """episode_coverage() from the rows of joins.tagged_trips(), one for each type and trip."""
    return trips.where("TRUTH_EPISODE_TYPE is not null").groupBy("TRUTH_EPISODE_TYPE").agg(F.sum("stop_events").alias("stop_events"), F.count("TRIP_INSTANCE_ID").alias("trips"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


