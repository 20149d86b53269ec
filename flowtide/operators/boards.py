"""Flight boards, corridors, camera frames and feed quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import minutes_between, utc_to_local


def latest(df: DataFrame, key: list[str], order: str, *ties: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def flight_board(current: DataFrame) -> DataFrame:
    """Best known time (actual, else estimated, else scheduled), delay in minutes and local times."""
    best = F.coalesce("actual_utc", "estimated_utc", "scheduled_utc")
    return current.withColumns({"scheduled_local": utc_to_local("scheduled_utc"), "best_local": utc_to_local(best), "delay_minutes": minutes_between("scheduled_utc", best)})


def daily_disruption(current: DataFrame) -> DataFrame:
    delay = minutes_between("scheduled_utc", F.coalesce("actual_utc", "estimated_utc", "scheduled_utc"))
    n = lambda s: F.count_if(F.col("status") == s)
    return current.groupBy(F.to_date("scheduled_utc").alias("flight_date"), "direction").agg(F.count("*").alias("flights"), n("Cancelled").alias("cancelled"), n("Diverted").alias("diverted"), n("Arrived").alias("arrived"), F.count_if(delay > 15).alias("delayed_15m"), F.round(F.avg(delay), 1).alias("avg_delay_minutes"))


def corridor_latest(polls: DataFrame) -> DataFrame:
    """The last poll of each corridor with its congestion: travel time over undisturbed time, null if either is missing or 0."""
    ratio = F.when((F.col("duration_s") != 0) & (F.col("static_duration_s") != 0), F.round(F.col("duration_s") / F.col("static_duration_s"), 3))
    return latest(polls, ["corridor"], "snapshot_ts", "duration_s").withColumn("congestion_ratio", ratio)


def feed_quality(rows: DataFrame, key: list[str], value: str, site: str, sites: DataFrame, expected: int | None = None) -> DataFrame:
    """One row: rows, distinct observations, greatest number of copies, observations whose copies disagree, sites without a reference, and pass flags."""
    per = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.countDistinct(value).alias("values"))
    base = per.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count("*").alias("observations"), F.max("copies").alias("max_copies"), F.count_if(F.col("values") > 1).alias("conflicting"))
    lost = rows.select(F.upper(site).alias("_s")).distinct().join(sites.select(F.upper("siteref").alias("_s")).distinct(), "_s", "left_anti").agg(F.count("*").alias("unmatched_sites"))
    out = base.crossJoin(lost)
    return out.withColumns({"rows_as_expected": (F.col("rows") == expected) if expected is not None else F.lit(None).cast("boolean"), "copies_agree": F.col("conflicting") == 0, "sites_resolve": F.col("unmatched_sites") == 0})


def copies_by_date(rows: DataFrame, key: list[str], day: str) -> DataFrame:
    """Mean number of copies of an observation by date."""
    per = rows.groupBy(*key, day).agg(F.count("*").alias("copies"))
    return per.groupBy(day).agg(F.count("*").alias("observations"), F.round(F.avg("copies"), 4).alias("mean_copies"))


def shared_frames(frames: DataFrame, run: str, camera: str, content: str, least: int = 3) -> DataFrame:
    """Frames of a run whose content came from at least that many cameras are flagged as unavailable."""
    shared = frames.groupBy(run, content).agg(F.countDistinct(camera).alias("cameras_with_content"))
    return frames.join(shared, [run, content]).withColumn("is_unavailable", F.col("cameras_with_content") >= least)


def frame_status(frames: DataFrame, camera: str, modified: str, content: str, order: list[str]) -> DataFrame:
    """OK for the first frame of a camera, capture time and content, UNCHANGED for its repeats."""
    w = Window.partitionBy(camera, modified, content).orderBy(*order)
    return frames.withColumn("status", F.when(F.row_number().over(w) == 1, "OK").otherwise("UNCHANGED"))


def run_history(frames: DataFrame, run: str, camera: str) -> DataFrame:
    return frames.groupBy(run).agg(F.count("*").alias("frames"), F.countDistinct(camera).alias("cameras"), F.count_if(F.col("status") == "UNCHANGED").alias("unchanged"))
