"""The nine transit detectors, the table that unites them, and their scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import grid_id, is_weekend, severity, severity_rank
from .baseline import null_safe, sigma
from .quantiles import GATHERED, exact_quantiles
from .transit import CELL_KEYS, DELAY_KEYS, DWELL_KEYS, union_all

COLUMNS = ["ANOMALY_ID", "DETECTOR", "DETECTOR_NAME", "SERVICE_DATE", "ENTITY_TYPE", "ENTITY_ID", "ROUTE_ID", "ROUTE_SHORT_NAME", "MODE", "STOP_ID", "WINDOW_START", "WINDOW_END", "OBSERVED_VALUE", "EXPECTED_VALUE", "SCORE", "SEVERITY", "DETAIL"]


def _fields(have: list[str], code: str | Column, name: str | Column, kind: str, entity: Column, start: Column | str, end: Column | str, observed: Column | str, expected: Column | str, score: Column, detail: Column, anomaly_id: Column | None = None, band: Column | None = None) -> dict[str, Column]:
    """The columns of a detection. have: the columns of its source."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    of = lambda x: F.col(x) if x in have else F.lit(None).cast("string")
    return {
        "ANOMALY_ID": F.concat_ws("|", lit(code), entity if anomaly_id is None else anomaly_id), "DETECTOR": lit(code), "DETECTOR_NAME": lit(name), "SERVICE_DATE": F.col("SERVICE_DATE"), "ENTITY_TYPE": F.lit(kind), "ENTITY_ID": entity,
        "ROUTE_ID": of("ROUTE_ID"), "ROUTE_SHORT_NAME": of("ROUTE_SHORT_NAME"), "MODE": F.col("MODE"), "STOP_ID": of("STOP_ID"), "WINDOW_START": col(start), "WINDOW_END": col(end), "OBSERVED_VALUE": col(observed).cast("double"), "EXPECTED_VALUE": col(expected).cast("double"),
        "SCORE": score, "SEVERITY": severity(score) if band is None else band, "DETAIL": detail,
    }


def _row(df: DataFrame, code: str | Column, name: str | Column, kind: str, entity: Column, start: Column | str, end: Column | str, observed: Column | str, expected: Column | str, score: Column, detail: Column, anomaly_id: Column | None = None, band: Column | None = None) -> DataFrame:
    out = df.withColumns({"SCORE": score, "_entity": entity})
    fields = _fields(df.columns, code, name, kind, F.col("_entity"), start, end, observed, expected, F.col("SCORE"), detail, anomaly_id, band)
    return out.select(*[c.alias(n) for n, c in fields.items()])


def _say(template: str, *values: Column | str) -> Column:
    """The template with the values in place of {}; doubles keep their decimal point."""
    parts = template.split("{}")
    values = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.concat(F.lit(parts[0]), *[x for v, t in zip(values, parts[1:]) for x in (v.cast("string"), F.lit(t))])


def _whole(name: str) -> Column:
    """Rounded to a whole number, as text in a detail: a value just below zero keeps its sign (-0.0), as in the reference."""
    x = F.round(name)
    return F.when((x == 0) & (F.col(name) < 0), F.lit(-0.0)).otherwise(x)


def _late(have: list[str], score: Column) -> dict[str, Column]:
    detail = _say("{} at {} ran {}s vs typical {}s", "ROUTE_SHORT_NAME", "STOP_NAME", "ARRIVAL_DELAY_SECS", _whole("MED_DELAY"))
    return _fields(have, "D01", "delay_outlier", "STOP_EVENT", F.concat_ws("|", "TRIP_INSTANCE_ID", "STOP_SEQUENCE"), "SCHED_ARRIVAL_LOCAL", "SCHED_ARRIVAL_LOCAL", "ARRIVAL_DELAY_SECS", "MED_DELAY", score, detail)


def _held(have: list[str], score: Column) -> dict[str, Column]:
    detail = _say("{} held {}s at {} vs typical {}s", "ROUTE_SHORT_NAME", "DWELL_SECS", "STOP_NAME", _whole("MED_DWELL"))
    return _fields(have, "D05", "dwell_outlier", "STOP_EVENT", F.concat_ws("|", "TRIP_INSTANCE_ID", "STOP_SEQUENCE"), "ACTUAL_ARRIVAL_LOCAL", "ACTUAL_DEPARTURE_LOCAL", "DWELL_SECS", "MED_DWELL", score, detail)


def _scores() -> tuple[Column, Column]:
    """Of the delay and of the dwell."""
    return (F.col("ARRIVAL_DELAY_SECS") - F.col("MED_DELAY")) / F.col("SIGMA_DELAY"), (F.col("DWELL_SECS") - F.col("MED_DWELL")) / F.col("SIGMA_DWELL")


def delay_outliers(fact: DataFrame, base: DataFrame, z: float = 2.5) -> DataFrame:
    e = null_safe(fact.where("ARRIVAL_DELAY_SECS is not null"), base.drop("MODE"), DELAY_KEYS).withColumn("SCORE", _scores()[0]).where(F.abs("SCORE") >= z)
    return e.select(*[c.alias(n) for n, c in _late(e.columns, F.col("SCORE")).items()])


def stop_outliers(fact: DataFrame, delay_z: float = 2.5, dwell_z: float = 3.0, min_n: int = 5, parts: int | None = None, columns: list[str] = COLUMNS) -> DataFrame:
    """The given columns of delay_outliers() and dwell_outliers() with their baselines, from one shuffle of the events, for routes of one mode each.

    Events are dealt by the keys that both baselines have, stop, band and kind of day, and sorted once by all of them; each event gets the median, MAD and number of its
    groups in place. Only the columns that the wanted ones need are shuffled. A group is a stop's events of one band and kind of day; Spark spills its rows if they are too many.
    """
    rows = fact.where("ARRIVAL_DELAY_SECS is not null or DWELL_SECS is not null").repartition(*([parts] if parts else []), "STOP_ID", "TIME_BAND", "DAY_TYPE")
    for keys, value, name, floor in (([*DWELL_KEYS, "ROUTE_ID", "DIRECTION_ID"], "ARRIVAL_DELAY_SECS", "DELAY", 20.0), (DWELL_KEYS, "DWELL_SECS", "DWELL", 10.0)):
        group = Window.partitionBy(*keys)
        rows = rows.withColumns({f"N_{name}": F.count(value).over(group), f"MED_{name}": F.median(value).over(group)})
        rows = rows.withColumn(f"SIGMA_{name}", sigma(F.median(F.abs(F.col(value) - F.col(f"MED_{name}"))).over(group), floor))
    delay, dwell = _scores()
    late, held = (F.col("N_DELAY") >= min_n) & (F.abs(delay) >= delay_z), (F.col("N_DWELL") >= min_n) & (dwell >= dwell_z)
    one = lambda wanted, fields: F.when(wanted, F.struct(*[fields[c].alias(c) for c in columns]))
    both = F.array_compact(F.array(one(late, _late(fact.columns, delay)), one(held, _held(fact.columns, dwell))))
    return rows.where(late | held).select(F.explode(both).alias("_d")).select("_d.*")


def _headway(h: DataFrame, code: str | Column, name: str | Column, wanted: Column, score: Column, detail: Column) -> DataFrame:
    h = h.where(F.col("FREQUENCY_CLASS").isin("FREQUENT", "HIGH_FREQUENCY") & F.col("SCHED_HEADWAY_SECS").between(120, 1800) & wanted)
    return _row(h, code, name, "HEADWAY", F.concat_ws("->", "PREV_TRIP_INSTANCE_ID", "TRIP_INSTANCE_ID"), "PREV_ACTUAL_ARRIVAL", "ACTUAL_ARRIVAL_LOCAL", "ACTUAL_HEADWAY_SECS", "SCHED_HEADWAY_SECS", score, detail, F.concat_ws("|", "TRIP_INSTANCE_ID", "STOP_ID"))


def _bunched() -> tuple:
    """(code, name, wanted, score, detail) of a detector of headways; none is wanted by both."""
    return "D02", "bunching", F.col("HEADWAY_RATIO") < 0.4, (1 - F.col("HEADWAY_RATIO")) * 4, _gap("{} bunched at {}: {}s gap vs {}s scheduled")


def _gapped() -> tuple:
    return "D03", "gapping", F.col("HEADWAY_RATIO") > 1.8, F.least((F.col("HEADWAY_RATIO") - 1) * 2, F.lit(10.0)), _gap("{} gap at {}: {}s vs {}s scheduled")


def _gap(template: str) -> Column:
    return _say(template, "ROUTE_SHORT_NAME", "STOP_NAME", "ACTUAL_HEADWAY_SECS", "SCHED_HEADWAY_SECS")


def bunching(h: DataFrame) -> DataFrame:
    return _headway(h, *_bunched())


def gapping(h: DataFrame) -> DataFrame:
    return _headway(h, *_gapped())


def headway_outliers(h: DataFrame) -> DataFrame:
    """bunching() and gapping() in one pass over the headways."""
    near, far = _bunched(), _gapped()
    either = [F.when(near[2], F.lit(x) if isinstance(x, str) else x).otherwise(F.lit(y) if isinstance(y, str) else y) for x, y in zip(near, far)]
    return _headway(h, either[0], either[1], near[2] | far[2], either[3], either[4])


def trips_seen(fact: DataFrame) -> DataFrame:
    """Each trip's scheduled stops and those with an actual arrival: how many, the first and the last."""
    return fact.groupBy("TRIP_INSTANCE_ID", "SERVICE_DATE", "ROUTE_ID", "ROUTE_SHORT_NAME", "MODE").agg(
        F.count("*").alias("SCHEDULED"), F.count("ACTUAL_ARRIVAL_LOCAL").alias("OBSERVED"), F.min("SCHED_ARRIVAL_LOCAL").alias("FIRST"), F.max("SCHED_ARRIVAL_LOCAL").alias("LAST"),
        F.min("ACTUAL_ARRIVAL_LOCAL").alias("FIRST_OBSERVED"), F.max("ACTUAL_ARRIVAL_LOCAL").alias("LAST_OBSERVED"),
    )


def ghost_trips(fact: DataFrame) -> DataFrame:
    """Trips of which no stop has an actual arrival."""
    detail = _say("{} trip {} scheduled {} stops, none observed", "ROUTE_SHORT_NAME", "TRIP_INSTANCE_ID", "SCHEDULED")
    return _row(trips_seen(fact).where("OBSERVED = 0"), "D04", "ghost_trip", "TRIP_INSTANCE", F.col("TRIP_INSTANCE_ID"), "FIRST", "LAST", F.lit(0), "SCHEDULED", F.lit(4.0), detail, band=F.lit("HIGH"))


def dwell_outliers(fact: DataFrame, base: DataFrame, z: float = 3.0) -> DataFrame:
    """Only stops that take longer than usual."""
    e = null_safe(fact.where("DWELL_SECS is not null"), base, DWELL_KEYS).withColumn("SCORE", _scores()[1]).where(F.col("SCORE") >= z)
    return e.select(*[c.alias(n) for n, c in _held(e.columns, F.col("SCORE")).items()])


def teleports(motion: DataFrame) -> DataFrame:
    """Always HIGH; expected is what a vehicle of the mode can do."""
    rail = F.col("MODE") == "RAIL"
    of = lambda train, bus: F.when(rail, train).otherwise(bus)
    hit = motion.where((F.col("IMPLIED_KMH") > of(160.0, 120.0)) & F.col("SECS_SINCE_PREV").between(5, 300))
    detail = _say("vehicle {} implied {} km/h over {}m in {}s", "VEHICLE_ID", _whole("IMPLIED_KMH"), _whole("METRES_SINCE_PREV"), "SECS_SINCE_PREV")
    entity = F.concat_ws("|", "TRIP_INSTANCE_ID", F.date_format("PING_LOCAL", "yyyyMMddHHmmss"))
    return _row(hit, "D06", "teleport", "VEHICLE", F.col("VEHICLE_ID"), "PREV_PING_LOCAL", "PING_LOCAL", "IMPLIED_KMH", of(110.0, 70.0), F.least(F.col("IMPLIED_KMH") / of(55.0, 35.0), F.lit(12.0)), detail, entity, band=F.lit("HIGH"))


def stale_vehicles(motion: DataFrame) -> DataFrame:
    """Device clocks that lag more than 90 s on at least three pings of a trip. The usual lag is 25 s."""
    late = motion.where("DEVICE_LAG_SECS > 90").groupBy("TRIP_INSTANCE_ID", "VEHICLE_ID", "SERVICE_DATE", "ROUTE_ID", "ROUTE_SHORT_NAME", "MODE")
    late = late.agg(F.count("*").alias("PINGS"), F.max("DEVICE_LAG_SECS").alias("LAG"), F.min("PING_LOCAL").alias("FIRST"), F.max("PING_LOCAL").alias("LAST")).where("PINGS >= 3")
    detail = _say("vehicle {} telemetry stalled {}s across {} pings", "VEHICLE_ID", "LAG", "PINGS")
    entity = F.concat_ws("|", "TRIP_INSTANCE_ID", F.date_format("FIRST", "yyyyMMddHHmmss"))
    return _row(late, "D07", "stale_vehicle", "VEHICLE", F.col("VEHICLE_ID"), "FIRST", "LAST", "LAG", F.lit(25.0), F.least(F.col("LAG") / 60, F.lit(12.0)), detail, entity)


def truncations(fact: DataFrame) -> DataFrame:
    """Trips of at least six stops of which some, but less than 80 %, have an actual arrival; the window is from the first to the last of those."""
    share = F.col("OBSERVED") / F.col("SCHEDULED")
    detail = _say("{} reported {} of {} scheduled stops then stopped", "ROUTE_SHORT_NAME", "OBSERVED", "SCHEDULED")
    hit = trips_seen(fact).where((F.col("OBSERVED") > 0) & (F.col("SCHEDULED") >= 6) & (share < 0.8))
    return _row(hit, "D08", "trip_truncation", "TRIP_INSTANCE", F.col("TRIP_INSTANCE_ID"), "FIRST_OBSERVED", "LAST_OBSERVED", "OBSERVED", "SCHEDULED", (1 - share) * 5, detail)


def cluster_shocks(bins: DataFrame, base: DataFrame, z: float = 2.5, min_trips: int = 3) -> DataFrame:
    """Cells whose quarter hour is late as a whole. The id carries no mode."""
    b = null_safe(bins.withColumn("BIN_HOUR", F.hour("SCHED_BIN_15MIN")), base, CELL_KEYS)
    score = (F.col("MED_DELAY_SECS") - F.col("MED_CELL_DELAY")) / F.col("SIGMA_CELL")
    entity = F.concat_ws("|", "CELL_ID", F.date_format("SCHED_BIN_15MIN", "yyyyMMddHHmm"))
    detail = _say("cell median delay {}s vs baseline {}s across {} trips on {} routes", _whole("MED_DELAY_SECS"), _whole("MED_CELL_DELAY"), "TRIPS", "ROUTES")
    end = F.col("SCHED_BIN_15MIN") + F.make_dt_interval(mins=F.lit(15))
    return _row(b.where((F.col("TRIPS") >= min_trips) & (score >= z)), "D09", "cluster_shock", "CELL", F.col("CELL_ID"), "SCHED_BIN_15MIN", end, "MED_DELAY_SECS", "MED_CELL_DELAY", score, detail, entity)


def all_detections(frames: list[DataFrame]) -> DataFrame:
    """One table of all detectors, as one plan."""
    return union_all([f.select(*COLUMNS) for f in frames])


def anomaly_summary(found: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Detections by detector and severity. Groups are few and hold most rows: days and routes are taken from counts by both, and the median is selected by counting, with at most
    ``gathered`` scores of a group in a task."""
    kind = ["DETECTOR", "DETECTOR_NAME", "SEVERITY"]
    rows = found.where("SEVERITY <> 'NONE'")
    per = rows.groupBy(*kind, "SERVICE_DATE", "ROUTE_ID").agg(F.count("*").alias("_n"))
    per = per.groupBy(*kind).agg(F.sum("_n").alias("ANOMALIES"), F.countDistinct("SERVICE_DATE").alias("DATES_AFFECTED"), F.countDistinct("ROUTE_ID").alias("ROUTES_AFFECTED"))
    middle = exact_quantiles(rows, kind, "SCORE", {"MEDIAN_SCORE": 0.5}, gathered).select(*kind, F.round("MEDIAN_SCORE", 2).alias("MEDIAN_SCORE"))
    return null_safe(per, middle, kind, "left")


def worst_days(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """Detections by service day. calendar: (SERVICE_DATE, DAY_TYPE, HOLIDAY_NAME)."""
    days = found.where("SEVERITY <> 'NONE'").groupBy("SERVICE_DATE").agg(F.count("*").alias("ANOMALIES"), F.count_if(F.col("SEVERITY") == "HIGH").alias("HIGH_SEVERITY"), F.countDistinct("ROUTE_ID").alias("ROUTES_AFFECTED"))
    return days.join(calendar.select("SERVICE_DATE", "DAY_TYPE", "HOLIDAY_NAME"), "SERVICE_DATE")


def hot_cells(found: DataFrame, bins: DataFrame) -> DataFrame:
    """Cells and modes by their shocks. A shock's id has no mode, so it counts for each mode of its cell and quarter hour."""
    shocks = found.where("DETECTOR = 'D09'").select(F.col("ENTITY_ID").alias("CELL_ID"), F.col("WINDOW_START").alias("SCHED_BIN_15MIN"))
    return bins.join(shocks, ["CELL_ID", "SCHED_BIN_15MIN"]).groupBy("CELL_ID", "CELL_LAT", "CELL_LON", "MODE").agg(F.count("*").alias("HOT_BINS"), F.round(F.max("MED_DELAY_SECS"), 1).alias("WORST_MED_DELAY_SECS"))


def scorecard(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Per detector, from the rows of match_windows(): rows flagged, true and false ones, episodes hit, precision of rows, recall of episodes, and the F1 of
    the two; also distinct detections, as a detection in two windows is two rows."""
    hit = F.col("TRUTH_ID").isNotNull()
    per = matched.groupBy("DETECTOR", "DETECTOR_NAME").agg(F.count("*").alias("FLAGGED"), F.count_if(hit).alias("TRUE_POSITIVES"), F.count_if(~hit).alias("FALSE_POSITIVES"), F.countDistinct("TRUTH_ID").alias("TRUTHS_HIT"), F.countDistinct("ANOMALY_ID").alias("DISTINCT_FLAGGED"))
    return _card(per, truth)


def counted_scorecard(counts: DataFrame, fired: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """scorecard() from the results of joins.match_counts(), without a row for each match."""
    kind = ["DETECTOR", "DETECTOR_NAME"]
    hits = fired.groupBy(*kind).agg(F.countDistinct("TRUTH_ID").alias("TRUTHS_HIT"))
    ids = found.where("SEVERITY <> 'NONE'").groupBy(*kind).agg(F.countDistinct("ANOMALY_ID").alias("DISTINCT_FLAGGED"))
    per = null_safe(null_safe(counts, hits, kind, "left"), ids, kind).withColumn("TRUTHS_HIT", F.coalesce("TRUTHS_HIT", F.lit(0)))
    per = per.select(*kind, "FLAGGED", "TRUE_POSITIVES", (F.col("FLAGGED") - F.col("TRUE_POSITIVES")).alias("FALSE_POSITIVES"), "TRUTHS_HIT", "DISTINCT_FLAGGED")
    return _card(per, truth)


def _card(per: DataFrame, truth: DataFrame) -> DataFrame:
    per = per.crossJoin(truth.agg(F.count("*").alias("TRUTHS_TOTAL")))
    p, r = F.col("TRUE_POSITIVES") / F.nullif("FLAGGED", F.lit(0)), F.col("TRUTHS_HIT") / F.nullif("TRUTHS_TOTAL", F.lit(0))
    return per.withColumns({"PRECISION_PCT": F.round(100 * p, 1), "EPISODE_RECALL_PCT": F.round(100 * r, 1), "F1": F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 3)})


def missed_episodes(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Episodes in which no detection of a severity begins."""
    missed = truth.join(matched.where("TRUTH_ID is not null").select("TRUTH_ID").distinct(), "TRUTH_ID", "left_anti")
    return missed.select("TRUTH_ID", "EPISODE_TYPE", "ROUTE_SHORT_NAME", "MODE", "SERVICE_DATE", "WINDOW_START_LOCAL", "DURATION_MINS", F.round("MAGNITUDE", 2).alias("MAGNITUDE"))


def recall_by_type(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Episodes and those detected by type, with the codes of the detectors that fired (null: none)."""
    fired = matched.where("TRUTH_ID is not null").select("TRUTH_ID", "DETECTOR").distinct()
    rows = truth.select("TRUTH_ID", "EPISODE_TYPE").join(fired.withColumn("_hit", F.col("TRUTH_ID")), "TRUTH_ID", "left")
    out = rows.groupBy("EPISODE_TYPE").agg(F.countDistinct("TRUTH_ID").alias("EPISODES"), F.countDistinct("_hit").alias("EPISODES_DETECTED"), F.array_sort(F.collect_set("DETECTOR")).alias("_codes"))
    return out.select("EPISODE_TYPE", "EPISODES", "EPISODES_DETECTED", F.round(100 * F.col("EPISODES_DETECTED") / F.col("EPISODES"), 1).alias("RECALL_PCT"), F.when(F.size("_codes") > 0, F.array_join("_codes", ", ")).alias("DETECTORS_THAT_FIRED"))


def headline(matched: DataFrame, found: DataFrame, truth: DataFrame, fact: DataFrame, pings: DataFrame, synthetic: bool = True) -> DataFrame:
    """One row: sizes of the inputs, anomalies of a severity, episodes and those hit, recall of episodes and precision of matched rows."""
    m = matched.agg(F.countDistinct("TRUTH_ID").alias("TRUTH_EPISODES_HIT"), F.round(100.0 * F.count("TRUTH_ID") / F.nullif(F.count("*"), F.lit(0)), 1).alias("OVERALL_PRECISION_PCT"))
    return _headline(m, found, truth, fact, pings, synthetic)


def counted_headline(counts: DataFrame, fired: DataFrame, found: DataFrame, truth: DataFrame, fact: DataFrame, pings: DataFrame, synthetic: bool = True) -> DataFrame:
    """headline() from the results of joins.match_counts(), without a row for each match."""
    precision = F.round(100.0 * F.coalesce(F.sum("TRUE_POSITIVES"), F.lit(0)) / F.nullif(F.sum("FLAGGED"), F.lit(0)), 1)
    m = fired.agg(F.countDistinct("TRUTH_ID").alias("TRUTH_EPISODES_HIT")).crossJoin(counts.agg(precision.alias("OVERALL_PRECISION_PCT")))
    return _headline(m, found, truth, fact, pings, synthetic)


def _headline(m: DataFrame, found: DataFrame, truth: DataFrame, fact: DataFrame, pings: DataFrame, synthetic: bool) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(fact, "STOP_EVENTS").crossJoin(n(pings, "VEHICLE_PINGS")).crossJoin(n(found.where("SEVERITY <> 'NONE'"), "ANOMALIES_FLAGGED")).crossJoin(n(truth, "TRUTH_EPISODES")).crossJoin(m)
    return out.withColumns({"OVERALL_RECALL_PCT": F.round(100.0 * F.col("TRUTH_EPISODES_HIT") / F.nullif("TRUTH_EPISODES", F.lit(0)), 1), "IS_SYNTHETIC_DATASET": F.lit(synthetic)})


# stop hotspots --------------------------------------------------------------------------------------------------------------


def stop_hotspots(found: DataFrame, stops: DataFrame, least: int = 50, least_high: int = 10, tier_high: int = 20) -> DataFrame:
    """Stops with a place and many anomalies, or many high ones: counts by severity, tier, modes, top detector (ties by name) and worst example: the greatest signed score (ties by id)."""
    rows = found.where("STOP_ID is not null")
    per_detector = rows.groupBy("STOP_ID", "DETECTOR_NAME").agg(F.count("*").alias("n"))
    top = per_detector.groupBy("STOP_ID").agg(F.min(F.struct((-F.col("n")).alias("m"), "DETECTOR_NAME")).alias("t")).select("STOP_ID", F.col("t.DETECTOR_NAME").alias("top_detector"), (-F.col("t.m")).alias("top_detector_count"))
    n = lambda s: F.count_if(F.col("SEVERITY") == s)
    worst = F.min(F.struct((-F.col("SCORE")).alias("s"), "ANOMALY_ID", F.struct(F.date_format("SERVICE_DATE", "yyyy-MM-dd").alias("date"), F.hour("WINDOW_START").alias("hour"), F.col("SEVERITY").alias("severity"), F.col("SCORE").alias("score"), F.col("DETAIL").alias("detail")).alias("example")))
    out = rows.groupBy("STOP_ID").agg(F.count("*").alias("anomalies"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.array_sort(F.collect_set("MODE")).alias("modes"), F.array_sort(F.collect_set("ROUTE_SHORT_NAME")).alias("routes"), worst.alias("w"))
    out = out.where((F.col("anomalies") >= least) | (F.col("high") >= least_high)).join(top, "STOP_ID").join(stops.select("STOP_ID", "STOP_NAME", "STOP_LAT", "STOP_LON"), "STOP_ID")
    return out.withColumns({"tier": F.when(F.col("high") >= tier_high, "high").otherwise("elevated"), "worst_id": F.col("w.ANOMALY_ID"), "worst_score": -F.col("w.s"), "worst_example": F.col("w.example")}).drop("w")


# the layer over all feeds -----------------------------------------------------------------------------------------------------

#: What the feeds of the layer measure (fixed values).
METRICS = {"sensors": "ped+vehicle / hr", "nzta": "traffic / hr (synthetic)", "flights": "total movements / hr"}
UNIFIED = ["source", "location", "lat", "lon", "event_date", "event_hour", "is_weekend", "severity", "score", "metric", "is_synthetic"]


def _feed(df: DataFrame, source: str, location: str, score: str, metric: Column, synthetic: bool) -> DataFrame:
    return df.select(F.lit(source).alias("source"), F.col(location).alias("location"), "lat", "lon", "event_date", "event_hour", "is_weekend", "severity", (F.round(F.col(score) * 100) / 100).alias("score"), metric.alias("metric"), F.lit(synthetic).alias("is_synthetic"))


def sensor_feed(hourly: DataFrame, streets: DataFrame, z: float = 2.5) -> DataFrame:
    """Street hours far from the mean of their hour and kind of day. streets: (street, centroid_lat, centroid_lon)."""
    base = hourly.groupBy("street", "hour", "is_weekend").agg(F.avg("total_count").alias("_m"), F.stddev_samp("total_count").alias("_s"))
    rows = null_safe(hourly, base, ["street", "hour", "is_weekend"]).withColumn("z", F.when(F.col("_s") > 0, (F.col("total_count") - F.col("_m")) / F.col("_s"))).where(F.abs("z") >= z)
    rows = rows.join(streets.select("street", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon")), "street", "left")
    rows = rows.withColumns({"event_date": F.col("date"), "event_hour": F.col("hour"), "severity": F.when(F.abs("z") >= 3.5, "HIGH").when(F.abs("z") >= 2.5, "MEDIUM")})
    return _feed(rows, "sensors", "street", "z", F.lit(METRICS["sensors"]), False)


def transit_feed(found: DataFrame, stops: DataFrame) -> DataFrame:
    """Detections at a stop with a place, by the hour in which their window begins."""
    rows = found.join(stops.select("STOP_ID", "STOP_NAME", F.col("STOP_LAT").alias("lat"), F.col("STOP_LON").alias("lon")), "STOP_ID").where("lat is not null")
    rows = rows.withColumns({"event_date": F.col("SERVICE_DATE"), "event_hour": F.hour("WINDOW_START"), "is_weekend": is_weekend("SERVICE_DATE"), "severity": F.col("SEVERITY"), "score": F.col("SCORE")})
    return _feed(rows, "metlink", "STOP_NAME", "score", F.col("DETECTOR_NAME"), True)


def highway_feed(disaggregated: DataFrame) -> DataFrame:
    """Hours of the days of rollup.disaggregate(), which carry the day's score and severity."""
    return _feed(disaggregated, "nzta", "location", "robust_z", F.lit(METRICS["nzta"]), True)


def flight_feed(scored: DataFrame, name: str, lat: float, lon: float) -> DataFrame:
    """Hours of one airport."""
    rows = scored.withColumns({"location": F.lit(name), "lat": F.lit(lat), "lon": F.lit(lon)})
    return _feed(rows, "flights", "location", "robust_z", F.lit(METRICS["flights"]), False)


def unify_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Rows of UNIFIED columns of all feeds, MEDIUM and above, by column name."""
    return union_all([df.select(*UNIFIED).where("severity in ('HIGH', 'MEDIUM')") for df in feeds])


def anomaly_points(unified: DataFrame) -> DataFrame:
    """Hits and greatest severity rank by source, place, day and hour; the metric is any of theirs (the least)."""
    return unified.groupBy("source", "location", "lat", "lon", "event_date", "event_hour", "is_weekend").agg(F.min("metric").alias("metric"), F.count("*").alias("hits"), F.max(severity_rank("severity")).alias("sev_rank"))


#: Source -> its column of hits in the conformed layer (fixed values).
HITS = {"sensors": "sensor_hits", "metlink": "metlink_hits", "nzta": "nzta_hits", "flights": "flight_hits"}


def conform(unified: DataFrame, places: int = 2) -> DataFrame:
    """One row for each cell, day and hour: hits by source, their total, the number and names of the sources that agree."""
    rows = unified.where("lat is not null").withColumns({"cell_lat": F.round("lat", places), "cell_lon": F.round("lon", places), "cell_id": grid_id("lat", "lon", places)})
    by = [F.count_if(F.col("source") == s).alias(name) for s, name in HITS.items()]
    return rows.groupBy("cell_id", "cell_lat", "cell_lon", "event_date", "event_hour").agg(*by, F.count("*").alias("total_hits"), F.countDistinct("source").alias("sources_hit"), F.max(severity_rank("severity")).alias("max_sev_rank"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


def source_totals(unified: DataFrame) -> DataFrame:
    return unified.groupBy("source").agg(F.count("*").alias("anomaly_records"), F.countDistinct("location").alias("locations"), F.countDistinct("event_date").alias("dates"))


def corroboration(conformed: DataFrame) -> DataFrame:
    """How many cell-hours so many sources agree on, in how many cells and on how many days."""
    return conformed.groupBy("sources_hit").agg(F.count("*").alias("cell_hours"), F.countDistinct("cell_id").alias("cells"), F.countDistinct("event_date").alias("dates"))


def top_cells(conformed: DataFrame, least: int = 2, n: int = 100) -> DataFrame:
    return conformed.where(F.col("sources_hit") >= least).orderBy(F.desc("sources_hit"), F.desc("total_hits"), "cell_id", "event_date", "event_hour").limit(n)


def cell_summary(conformed: DataFrame) -> DataFrame:
    return conformed.groupBy("cell_id").agg(F.count("*").alias("cell_hours"), F.max("sources_hit").alias("max_sources"), F.sum("total_hits").alias("total_hits"))


def camera_layer(cameras: DataFrame, meta: DataFrame) -> DataFrame:
    """Cameras, flagged if they lie within the extent of all countlines."""
    ends = F.explode(F.array(*[F.struct(F.col(f"LATITUDE_{e}_LINE").alias("lat"), F.col(f"LONGITUDE_{e}_LINE").alias("lon")) for e in ("START", "END")]))
    box = meta.select(ends.alias("p")).agg(F.min("p.lat").alias("south"), F.max("p.lat").alias("north"), F.min("p.lon").alias("west"), F.max("p.lon").alias("east"))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return cameras.crossJoin(box).withColumn("within_countline_frame", F.coalesce(inside, F.lit(False))).drop("south", "north", "west", "east")
