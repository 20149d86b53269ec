"""Baselines: what is usual for a group, by median and MAD or by mean and deviation, and scores against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAD_SIGMA, change_direction, drop_or_surge, passes_gates, severity, severity_or_ratio
from .config import Thresholds

SEASON = ["countline_id", "transport_class", "direction", "day_of_week", "hour"]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys appear once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]), how).drop(*[f"_r_{k}" for k in keys])


def robust_baseline(df: DataFrame, keys: list[str], value: str, min_n: int = 1, quantiles: dict[str, float] | None = None, many: bool = False, parts: int | None = None) -> DataFrame:
    """(keys, n, median, mad, quantiles) of each group with at least min_n rows.

    Two aggregations on one partitioning: deviations are taken by a join to the medians, not by a window, so that rows are never
    buffered by group; groups without enough rows are dropped before the join. many: groups are many and small, so nothing is gained by aggregating before
    the shuffle; keys and values are dealt by group once, and both aggregations and joins stay on that partitioning. parts: its number of tasks;
    a row takes some fifty times its shuffled bytes while it is sorted by group, so partitions of equal bytes would spill.
    """
    probs = {"median": 0.5} | (quantiles or {})  # all from one table of the group's values
    group = [F.struct(*keys).alias("_g")] if many else keys
    rows = df.select(*group, value)
    join = lambda a, b: a.join(b, "_g") if many else null_safe(a, b, keys)
    group = ["_g"] if many else keys
    rows = rows.repartition(*([parts] if parts else []), "_g") if many else rows
    middle = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile(value, F.array(*map(F.lit, probs.values()))).alias("_q")).where(F.col("n") >= min_n)
    middle = middle.select(*group, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    spread = join(rows, middle.select(*group, "median")).groupBy(*group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    out = join(middle, spread)
    return out.select("_g.*", *[c for c in out.columns if c != "_g"]) if many else out


def sigma(mad: Column | str, floor: float) -> Column:
    return F.greatest(MAD_SIGMA * (F.col(mad) if isinstance(mad, str) else mad), F.lit(floor))


def robust_score(df: DataFrame, keys: list[str], value: str, only_active: bool = False, ratio_fallback: bool = True) -> DataFrame:
    """Every row against the median and MAD of its own group, itself included: ratio, robust_z, severity, change."""
    base = robust_baseline(df, keys, value).withColumnsRenamed({"n": "baseline_n", "median": "baseline_median", "mad": "baseline_mad"})
    out = null_safe(df, base, keys)
    z = F.when(F.col("baseline_mad") > 0, (F.col(value) - F.col("baseline_median")) / (MAD_SIGMA * F.col("baseline_mad")))
    ratio = F.when(F.col("baseline_median") > 0, F.col(value) / F.col("baseline_median"))
    out = out.withColumns({"_z": z, "_ratio": ratio})
    band = severity_or_ratio("_z", "_ratio") if ratio_fallback else severity("_z")
    out = out.withColumns({"ratio": F.round("_ratio", 3), "robust_z": F.round("_z", 3), "severity": band, "change": drop_or_surge(value, "baseline_median")}).drop("_z", "_ratio")
    return out.where("baseline_median > 0") if only_active else out


def mean_score(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row against the mean and sample deviation of its own group: residual and z (null if the deviation is not above 0)."""
    base = df.groupBy(*keys).agg(F.avg(value).alias("baseline_mean"), F.stddev_samp(value).alias("baseline_sd"), F.count("*").alias("baseline_n"))
    out = null_safe(df, base, keys)
    residual = F.col(value) - F.col("baseline_mean")
    return out.withColumns({"residual": residual, "z": F.when(F.col("baseline_sd") > 0, F.round(residual / F.col("baseline_sd"), 3))})


def fit_seasonal_baseline(history: DataFrame, min_samples: int = 8) -> DataFrame:
    """Median, number and MAD of counts by countline, class, direction, weekday (Monday 0) and hour."""
    rows = history.withColumn("day_of_week", F.weekday("date"))
    return robust_baseline(rows, SEASON, "count", min_samples).select(*SEASON, F.col("median").alias("expected_count"), F.col("n").alias("history_samples"), "mad")


def score_observations(current: DataFrame, baseline: DataFrame, config: Thresholds = Thresholds()) -> DataFrame:
    """Adds expected_count, history_samples, mad, robust_z, absolute_change and relative_change (both without sign), change_direction, status and data_quality."""
    rows = null_safe(current.withColumn("day_of_week", F.weekday("date")), baseline, SEASON, "left")
    change = F.col("count") - F.col("expected_count")
    scale = F.greatest(MAD_SIGMA * F.col("mad"), F.sqrt(F.col("expected_count") + 1), F.lit(1.0))
    known = F.col("expected_count").isNotNull()
    rows = rows.withColumns({"absolute_change": F.abs(change), "robust_z": F.when(known, change / scale), "relative_change": F.when(known, F.abs(change) / F.greatest(F.abs("expected_count"), F.lit(10.0)))})
    gate = passes_gates("robust_z", "absolute_change", "relative_change", config.z, config.absolute, config.relative)
    return rows.withColumns({
        "change_direction": change_direction("count", "expected_count"),
        "status": F.when(~known, "insufficient_baseline").when(gate, "candidate").otherwise("normal"),
        "data_quality": F.when(known, "complete").otherwise("no_matching_history"),
    })


def backtest(history: DataFrame, held: DataFrame, min_samples: int = 8) -> DataFrame:
    """Mean absolute error of the seasonal median on held-out rows: (rows, matched, mae)."""
    scored = null_safe(held.withColumn("day_of_week", F.weekday("date")), fit_seasonal_baseline(history, min_samples), SEASON, "left")
    return scored.agg(F.count("*").alias("rows"), F.count("expected_count").alias("matched"), F.avg(F.abs(F.col("count") - F.col("expected_count"))).alias("mae"))


def leave_one_out_ratio(daily: DataFrame, site: str, day: str, value: str) -> DataFrame:
    """A site's day over the median of its other days of the same weekday.

    A day's rank r among the n values of its group says where the middle of the others lies: the value of 0-based rank k among the others is that
    of rank k among all if k is below r, of rank k + 1 otherwise. So the sorted values of a group are gathered once, not once for each row.
    """
    rows = daily.withColumn("_dow", F.weekday(day))
    rank = F.row_number().over(Window.partitionBy(site, "_dow").orderBy(value, day)) - 1
    lists = rows.groupBy(site, "_dow").agg(F.sort_array(F.collect_list(value)).alias("_all"))
    rows = null_safe(rows.withColumn("_r", rank), lists, [site, "_dow"]).withColumn("other_days", F.size("_all") - 1)
    n = F.col("other_days")
    at = lambda k: F.get("_all", (k + F.when(k >= F.col("_r"), 1).otherwise(0)).cast("int"))
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    rows = rows.withColumn("other_median", F.when(n > 0, (at(low) + at(high)) / 2))
    return rows.withColumn("loo_ratio", F.when(F.col("other_median") > 0, F.col(value) / F.col("other_median"))).drop("_dow", "_all", "_r")
