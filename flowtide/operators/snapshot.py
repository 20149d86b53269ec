"""The snapshot detector: normalised observations, one target hour against its history, gaps and health."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .baseline import fit_seasonal_baseline, null_safe, score_observations
from .config import Thresholds

#: Positional source columns and their names (fixed values).
RAW_COLUMNS = {"_COL_0": "countline_id", "_COL_1": "date", "_COL_2": "hour", "_COL_3": "count", "_COL_4": "transport_class", "_COL_5": "direction"}
KEY = ["countline_id", "date", "hour", "transport_class", "direction"]
LOCAL_ZONE = "Pacific/Auckland"


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """The natural keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def checked_unique(df: DataFrame, key: list[str], message: str = "duplicate observation key") -> DataFrame:
    """df; raises ValueError if a key occurs twice. Stops at the first one found."""
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(message)
    return df


def normalize_mobility(df: DataFrame, check: bool = True) -> DataFrame:
    """Positional columns -> typed observations; missing columns raise ValueError, values that can't be cast raise in the action."""
    missing = [x for x in RAW_COLUMNS if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*[F.col(a).alias(b) for a, b in RAW_COLUMNS.items()]).select(
        F.col("countline_id").cast("string"), F.to_date("date").alias("date"), F.col("hour").cast("int"), F.col("count").cast("double"), "transport_class", "direction"
    )
    return checked_unique(out, KEY) if check else out


@dataclass(frozen=True)
class Snapshot:
    """scored, candidates and gaps are lazy; health is one row."""

    scored: DataFrame
    candidates: DataFrame
    gaps: DataFrame
    health: DataFrame
    baseline: DataFrame


def local_hour(target: str | datetime) -> tuple[date, int]:
    """Date and hour of a target; a zoned one is converted to local time first."""
    at = datetime.fromisoformat(target) if isinstance(target, str) else target
    if at.tzinfo:
        at = at.astimezone(ZoneInfo(LOCAL_ZONE))
    return at.date(), at.hour


def data_gaps(baseline: DataFrame, current: DataFrame, day: date, hour: int) -> DataFrame:
    """Groups that are expected at the target's weekday and hour but were not observed; a missing row is not a zero."""
    expected = baseline.where((F.col("day_of_week") == day.weekday()) & (F.col("hour") == hour))
    group = ["countline_id", "transport_class", "direction"]
    return null_safe(expected, current.select(*group).distinct(), group, "left_anti").withColumn("status", F.lit("data_gap"))


def analyze_snapshot(frame: DataFrame, target: str | datetime, lookback_weeks: int = 12, config: Thresholds = Thresholds(), min_samples: int = 8, fitted: DataFrame | None = None) -> Snapshot:
    """Score the observations of the target hour against the weeks before it. Rows after the target are never read. fitted: the baseline of these weeks, if there is one."""
    day, hour = local_hour(target)
    requested = datetime.fromisoformat(target) if isinstance(target, str) else target
    at = datetime(day.year, day.month, day.day, hour)
    moment = F.make_timestamp_ntz(F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("hour"), F.lit(0), F.lit(0))
    first = at - timedelta(weeks=lookback_weeks)
    history = frame.where((F.col("date") >= F.lit(first.date())) & (F.col("date") <= F.lit(day))).where((moment >= F.lit(first).cast("timestamp_ntz")) & (moment < F.lit(at).cast("timestamp_ntz")))
    current = frame.where((F.col("date") == F.lit(day)) & (F.col("hour") == hour))
    # read by the scores, the gaps and the health row
    baseline = materialized(fit_seasonal_baseline(history, min_samples), "baseline") if fitted is None else fitted
    scored = score_observations(current, baseline, config)
    gaps = data_gaps(baseline, current, day, hour)
    expected = baseline.where((F.col("day_of_week") == day.weekday()) & (F.col("hour") == hour)).agg(F.count("*").alias("expected_groups"))
    seen = scored.agg(F.count("*").alias("observed_groups"), F.count_if(F.col("status") == "candidate").alias("candidate_count"), F.count_if(F.col("status") == "insufficient_baseline").alias("insufficient_baseline_count"))
    health = seen.crossJoin(expected).crossJoin(gaps.agg(F.count("*").alias("data_gap_groups"))).select(
        F.lit(requested.isoformat()).alias("target_at"), F.lit("batch replay").alias("publisher_mode"), "observed_groups", "expected_groups", "data_gap_groups", "candidate_count", "insufficient_baseline_count"
    )
    return Snapshot(scored, scored.where("status = 'candidate'"), gaps, health, baseline)


def chronological_split(df: DataFrame, train_end: str, validation_end: str, test_end: str, column: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole days up to train_end, then up to validation_end, then up to test_end; the bounds must ascend."""
    a, b, z = (date.fromisoformat(x) for x in (train_end, validation_end, test_end))
    if not a < b < z:
        raise ValueError("the ends must be strictly ascending")
    d = F.to_date(column)
    return df.where(d <= F.lit(a)), df.where((d > F.lit(a)) & (d <= F.lit(b))), df.where((d > F.lit(b)) & (d <= F.lit(z)))
