"""Rollups of sensor, highway and flight feeds, and grids without holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hour_of_week, is_people, is_weekend, iso_dow, street_of, sunday_dow, utc_to_local

COUNT_KEY = ["date", "siteID", "laneNumber", "flowDirection", "classWeight"]


def street_dimension(meta: DataFrame) -> DataFrame:
    """(street, n_countlines, countline_ids in order, centroid of the line midpoints)."""
    mid = lambda x: F.avg((F.col(f"{x}_START_LINE") + F.col(f"{x}_END_LINE")) / 2)
    return meta.groupBy(street_of("NAME").alias("street")).agg(F.count("*").alias("n_countlines"), F.array_sort(F.collect_list("COUNTLINE_ID")).alias("countline_ids"), mid("LATITUDE").alias("centroid_lat"), mid("LONGITUDE").alias("centroid_lon"))


def hourly_rollup(obs: DataFrame, by: list[str], split: bool = False) -> DataFrame:
    """Sums of counts by the given columns, date and hour, with calendar features and the number of active countlines; split: by kind of mover."""
    kinds = []
    if split:
        of = lambda cond: F.sum(F.when(cond, F.col("count")))
        k = F.col("transport_class")
        kinds = [of(k == "Pedestrian").alias("pedestrian_count"), of(k == "Cyclist").alias("cyclist_count"), of(~k.isin("Pedestrian", "Cyclist")).alias("vehicle_count")]
    out = obs.groupBy(*by, "date", "hour").agg(F.sum("count").alias("total_count"), *kinds, F.countDistinct("countline_id").alias("active_countlines"))
    return out.withColumns({"iso_dow": iso_dow("date"), "hour_of_week": hour_of_week("date", "hour"), "is_weekend": is_weekend("date")})


def with_street(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds street; a countline without metadata is its own street."""
    names = meta.select(F.col("COUNTLINE_ID").cast("string").alias("countline_id"), street_of("NAME").alias("street"))
    return obs.join(names, "countline_id", "left").withColumn("street", F.coalesce("street", F.concat(F.lit("COUNTLINE "), "countline_id")))


def hour_grid(df: DataFrame, by: list[str], first: Column, last: Column, fill: list[str], day: str = "date", hour: str = "hour") -> DataFrame:
    """All days from first to last, all hours, for each distinct ``by``: zeros where nothing was seen, told apart by is_observed."""
    days = F.explode(F.sequence(first, last)).alias(day)
    names = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = names.select("*", days).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour))
    seen = df.select(*by, day, hour, *fill).withColumn("is_observed", F.lit(True))
    out = grid.join(seen, [*by, day, hour], "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in fill} | {"is_observed": F.coalesce("is_observed", F.lit(False))})


def distinct_observations(counts: DataFrame, key: list[str] = COUNT_KEY, order: str = "OBJECTID") -> DataFrame:
    """One row for each observation that was published several times, the one with the least order; the order column goes."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return counts.withColumn("_n", first).where("_n = 1").drop("_n", order)


def site_daily(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """Daily totals of each site, heavy and light, with its location; references match whatever their case, a site without one is flagged."""
    of = lambda k: F.sum(F.when(F.col("classWeight") == k, F.col("trafficCount")))
    daily = observations.groupBy("SiteRef", F.col("date").alias("count_date")).agg(F.min("siteDescription").alias("site_description"), F.sum("trafficCount").alias("total_count"), of("Heavy").alias("heavy_count"), of("Light").alias("light_count"), F.countDistinct("laneNumber").alias("lanes_reporting"))
    daily = daily.withColumns({"day_name": F.date_format("count_date", "EEEE"), "is_weekend": sunday_dow("count_date").isin(0, 6), "_ref": F.upper("SiteRef")})
    one = Window.partitionBy(F.upper("siteref")).orderBy("siteref")
    known = sites.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(F.upper("siteref").alias("_ref"), F.col("description").alias("site_name"), "state_highway", "sitetype", "lat", "lon", F.lit(False).alias("no_location"))
    return daily.join(known, "_ref", "left").drop("_ref").withColumn("no_location", F.coalesce("no_location", F.lit(True)))


def coverage_by_date(daily: DataFrame) -> DataFrame:
    """Sites that reported on each day; the total is not a trend, as sites come and go."""
    return daily.groupBy("count_date", "day_name", "is_weekend").agg(F.countDistinct("SiteRef").alias("reporting_sites"), F.round(F.sum("total_count")).alias("total_count_all_sites"))


def flagged(scored: DataFrame) -> DataFrame:
    """Rows with a severity, most severe first."""
    rank = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    return scored.where("severity <> 'NONE'").orderBy(rank.desc(), F.abs(F.coalesce("robust_z", F.lit(0))).desc())


def site_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("SiteRef").agg(
        F.min("site_name").alias("site_name"), F.min("state_highway").alias("state_highway"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.count_if(F.col("severity") != "NONE").alias("anomaly_days"), F.count_if(F.col("severity") == "HIGH").alias("high_days"), F.min("ratio").alias("lowest_ratio"), F.max("ratio").alias("highest_ratio"),
    )


def movements(arrivals: DataFrame, departures: DataFrame, zone: str = "Pacific/Auckland") -> DataFrame:
    """(direction, callsign, icao24, ts_local): arrivals by when they were last seen, departures by when first."""
    one = lambda df, name, at: df.select(F.lit(name).alias("direction"), F.trim("callsign").alias("callsign"), "icao24", utc_to_local(F.timestamp_seconds(at), zone).alias("ts_local"))
    return one(arrivals, "arrival", "lastSeen").union(one(departures, "departure", "firstSeen"))


def hourly_movements(moves: DataFrame, first: Column, last: Column) -> DataFrame:
    """Arrivals, departures and total of each hour of the period, zero where nothing moved."""
    n = lambda d: F.count_if(F.col("direction") == d)
    seen = moves.groupBy(F.to_date("ts_local").alias("event_date"), F.hour("ts_local").alias("event_hour")).agg(n("arrival").alias("arrivals"), n("departure").alias("departures"), F.count("*").alias("total_movements"))
    grid = hour_grid(seen, [], first, last, ["arrivals", "departures", "total_movements"], "event_date", "event_hour")
    return grid.withColumn("is_weekend", is_weekend("event_date"))


def diurnal_weights(hourly: DataFrame, value: str = "total_count") -> DataFrame:
    """(is_weekend, hour, weight): the share of each hour in its kind of day, learned from vehicles only; the weights of a kind sum to 1. hourly: by transport_class and date."""
    vehicles = hourly.where(~is_people("transport_class"))
    sums = vehicles.groupBy(is_weekend("date").alias("is_weekend"), "hour").agg(F.sum(value).alias("n"))
    return sums.select("is_weekend", "hour", (F.col("n") / F.sum("n").over(Window.partitionBy("is_weekend"))).alias("weight"))


def disaggregate(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """The days of sites with a place, spread over their hours by weight and marked as synthetic; ratio, score and severity of the day go to every hour."""
    hours = scored.where("lat is not null").join(F.broadcast(weights), "is_weekend")  # 24 weights for each kind of day
    return hours.select(
        "SiteRef", F.col("site_name").alias("location"), "state_highway", "lat", "lon", F.col("count_date").alias("event_date"), F.col("hour").alias("event_hour"), "is_weekend",
        (F.col("total_count") * F.col("weight")).alias("observed_synth"), "ratio", "robust_z", "severity", F.col("change").alias("direction"), F.lit(True).alias("is_synthetic"),
    )
