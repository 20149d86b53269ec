"""Reports: filters, groups and top lists over the layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import all_of, between_dates, is_people, one_of
from .baseline import mean_score


def filtered(df: DataFrame, dates: tuple[str, str | None, str | None] | None = None, **values) -> DataFrame:
    """Rows whose columns are in the given lists; an empty list is no condition."""
    return df.where(all_of(between_dates(*dates) if dates else None, *[one_of(k, v) for k, v in values.items()]))


def anomalies_above(hourly: DataFrame, by: str, z: float, first: str | None = None, last: str | None = None) -> DataFrame:
    scored = mean_score(hourly, [by, "hour", "is_weekend"], "total_count")
    return scored.where(all_of(F.abs("z") >= z, between_dates("date", first, last)))


def street_map(hourly: DataFrame, z: float) -> DataFrame:
    scored = mean_score(hourly, ["street", "hour", "is_weekend"], "total_count")
    return scored.groupBy("street").agg(F.count_if(F.abs("z") >= z).alias("anomaly_hours"), F.max(F.abs("z")).alias("peak_z"), F.max("total_count").alias("peak_total"))


def class_series(hourly: DataFrame, kind: str) -> DataFrame:
    return mean_score(hourly.where(F.col("transport_class") == kind), ["transport_class", "hour", "is_weekend"], "total_count")


def heatmap(events: DataFrame, place: str, hour: str, n: int) -> DataFrame:
    """Counts of the n busiest places (ties by place) by hour, all 24 columns."""
    top = events.groupBy(place).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), place).limit(n).select(place)
    wide = events.join(top, place, "left_semi").groupBy(place).pivot(hour, list(range(24))).count().na.fill(0)
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


def highway_filter(scored: DataFrame, dates: tuple[str | None, str | None] = (None, None), severities=(), directions=(), highways=()) -> DataFrame:
    """Flagged site-days of a period; an empty list is no condition."""
    return scored.where(all_of(F.col("severity") != "NONE", between_dates("count_date", *dates), one_of("severity", severities), one_of("change", directions), one_of("state_highway", highways)))


def highway_metrics(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count("*").alias("site_days"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.countDistinct("SiteRef").alias("sites"), F.min("ratio").alias("low_ratio"))


def highway_top(chosen: DataFrame, n: int = 400) -> DataFrame:
    """The n strongest site-days, ties by site and day."""
    return chosen.withColumn("baseline", F.round("baseline_median")).orderBy(F.abs(F.coalesce("robust_z", F.lit(0.0))).desc(), "SiteRef", "count_date").limit(n)


def highway_points(chosen: DataFrame) -> DataFrame:
    """Sites with a place: their flagged and high days and lowest ratio."""
    return chosen.where("lat is not null").groupBy("SiteRef").agg(F.min("site_name").alias("site_name"), F.min("state_highway").alias("state_highway"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("anomaly_days"), F.count_if(F.col("severity") == "HIGH").alias("high_days"), F.min("ratio").alias("lowest_ratio"))


def highway_no_location(chosen: DataFrame) -> DataFrame:
    return chosen.where("no_location")


def highway_heatmap(scored: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The ratio of every day of the n sites with most chosen days, ties by site."""
    top = chosen.groupBy("SiteRef").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "SiteRef").limit(n).select("SiteRef")
    return scored.where("ratio is not null").join(top, "SiteRef", "left_semi")


def combined_points(points: DataFrame, sources: list[str], least_rank: int, dates: tuple[str | None, str | None] = (None, None), hour: int | None = None) -> DataFrame:
    """Points of the layer over all feeds by source, severity and time."""
    chosen = points.where(all_of(F.col("source").isin(sources), F.col("sev_rank") >= least_rank, F.col("lat").isNotNull(), between_dates("event_date", *dates), None if hour is None else F.col("event_hour") == hour))
    return chosen.groupBy("source", "location", "lat", "lon", "event_date", "event_hour", "metric").agg(F.sum("hits").alias("hits"), F.max("sev_rank").alias("sev_rank"))


def playback(conformed: DataFrame, first: str, last: str) -> DataFrame:
    """A frame for every hour of the period, empty ones too."""
    spark = conformed.sparkSession
    hours = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("event_date")).select("event_date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("event_hour"))
    return hours.join(conformed, ["event_date", "event_hour"], "left").groupBy("event_date", "event_hour").agg(F.count("cell_id").alias("cells"), F.coalesce(F.sum("total_hits"), F.lit(0)).alias("hits"))


def top_signals(hourly: DataFrame, k: int, people: bool | None = None, drops: bool | None = None) -> DataFrame:
    """The k strongest signals, of people or vehicles, drops or rises if asked for."""
    z = mean_score(hourly, ["transport_class", "hour", "is_weekend"], "total_count").where("z is not null")
    kind = None if people is None else is_people("transport_class") if people else ~is_people("transport_class")
    way = None if drops is None else F.col("z") < 0 if drops else F.col("z") > 0
    return z.where(all_of(kind, way)).orderBy(F.abs("z").desc(), "transport_class", "date", "hour").limit(k)


#: Classes that the brief counts as people, and the guardrails of its context (fixed values).
BRIEF_PEOPLE = ["Pedestrian", "Cyclist", "E-scooter"]
GUARDRAILS = [
    "Signals mean investigate. Do not diagnose disruption, evacuation or loss of access.",
    "Missing records are data gaps, never zero movement.",
    "Public transport anomalies are a labelled synthetic replay.",
    "Not live emergency information. In an emergency, call 111.",
]


def named_signals(signals: DataFrame, meta: DataFrame) -> DataFrame:
    """Signals whose countline is known, with its name."""
    m = meta.select(F.col("COUNTLINE_ID").cast("string").alias("countline_id"), F.col("NAME").alias("name"))
    return signals.join(m, "countline_id").withColumn("observed_count", F.col("count"))


def brief(signals: DataFrame, k: int | None = None, people: bool | None = None, way: str | None = None) -> DataFrame:
    """Signals by absolute score, of people or vehicles, increases or decreases if asked for; the first k, or all if None."""
    kind = None if people is None else F.col("transport_class").isin(BRIEF_PEOPLE) == people
    chosen = signals.where(all_of(F.col("robust_z").isNotNull(), kind, None if way is None else F.col("change_direction") == way))
    return chosen if k is None else chosen.orderBy(F.abs("robust_z").desc(), "countline_id", "transport_class", "direction").limit(k)


def brief_quality(health: DataFrame, signals: DataFrame, limitations: int) -> DataFrame:
    """One row: gaps, groups without baseline, signals, those of low confidence, published limitations."""
    low = signals.agg(F.count("*").alias("signals"), F.count_if(F.col("data_quality") != "complete").alias("low_confidence"))
    return health.crossJoin(low).withColumn("limitations", F.lit(limitations))


def brief_cameras(layer: DataFrame) -> DataFrame:
    """One row: cameras of detectors.camera_layer(), those inside the countline frame and those flagged offline."""
    return layer.agg(F.count("*").alias("cameras"), F.count_if("within_countline_frame").alias("within"), F.count_if("offline").alias("offline"))


def grounding(health: DataFrame, signals: DataFrame, cameras: DataFrame, hotspots: DataFrame, n: int = 40) -> DataFrame:
    """One JSON record for an agent: health, all signals (of one hour), the first n cameras and hotspots, guardrails."""
    s = signals.agg(F.sort_array(F.collect_list(F.struct("countline_id", "transport_class", "direction", "name", "status", "observed_count", "expected_count", "robust_z"))).alias("signals"))
    c = cameras.orderBy("camera_id").limit(n).agg(F.sort_array(F.collect_list(F.struct("camera_id", F.col("camera_id").cast("string").alias("id"), F.col("camera_name").alias("name"), F.array("lon", "lat").alias("coordinates")))).alias("cameras"))
    order = F.struct((-F.col("anomalies")).alias("_o"), F.col("STOP_ID").alias("id"), F.col("STOP_NAME").alias("stop_name"), F.col("anomalies").alias("anomaly_count"), F.col("high").alias("high_count"), "top_detector", F.lit(True).alias("synthetic"))
    h = hotspots.orderBy(F.desc("anomalies"), "STOP_ID").limit(n).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.dropFields("_o")).alias("transit_hotspots"))
    whole = health.select(F.struct("*").alias("health")).crossJoin(s).crossJoin(c).crossJoin(h)
    return whole.select(F.to_json(F.struct(F.lit("agent-context/v1").alias("schema"), "health", "signals", "cameras", "transit_hotspots", F.array(*map(F.lit, GUARDRAILS)).alias("guardrails"))).alias("context"))


def records_of(path_rows: DataFrame, kind: str) -> DataFrame:
    """(n) of landed files by format: csv (rows below the header), ndjson (lines) or json: the features of a collection, the length of an array, 1 for another document; null if it can't be read. path_rows: (value), lines for csv and ndjson, whole documents for json."""
    rows = path_rows.where("trim(value) <> ''")
    if kind == "csv":
        n = F.count("*") - F.count_distinct("file")
        return rows.agg(F.when(n > 0, n).alias("n"))
    parsed = F.try_parse_json("value")
    if kind == "ndjson":
        return rows.agg(F.when(F.count_if(parsed.isNull()) == 0, F.count("*")).alias("n"))
    features = F.try_variant_get(parsed, "$.features", "array<variant>")
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return rows.agg(F.sum(F.when(parsed.isNotNull(), F.coalesce(F.size(features), F.size(items), F.lit(1)))).alias("n"))


def feed_counts(spark: SparkSession, feeds: dict[str, tuple[str, str]]) -> DataFrame:
    """feeds: name -> (path of landed files, format). (feed, n)."""
    read = lambda path, kind: spark.read.text(path, wholetext=kind == "json").select("value", F.col("_metadata.file_path").alias("file"))
    return reduce(lambda a, b: a.unionByName(b), [records_of(read(path, kind), kind).select(F.lit(name).alias("feed"), F.col("n").cast("long").alias("n")) for name, (path, kind) in feeds.items()])


def filter_metadata(df: DataFrame, day: str, **distinct: str) -> DataFrame:
    """First and last day, and the distinct values of columns, sorted. distinct: column=name."""
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"), *[F.array_sort(F.collect_set(k)).alias(v) for k, v in distinct.items()])


def class_by_name(obs: DataFrame, meta: DataFrame, kind: str) -> DataFrame:
    m = meta.select(F.col("COUNTLINE_ID").cast("string").alias("countline_id"), "NAME")
    return obs.where(F.col("transport_class") == kind).join(m, "countline_id").groupBy("NAME", "hour").agg(F.sum("count").alias("volume"))
