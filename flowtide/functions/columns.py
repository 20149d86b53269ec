"""Column functions: calendar, bands, text, geometry, time and keys. All are built-in expressions and stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6_371_000
#: A robust standard deviation is this many times the median absolute deviation.
MAD_SIGMA = 1.4826

#: Words that end the street part of a sensor's name (fixed values, in the order they are tried).
DESCRIPTORS = (
    "road|crossing|cyclelanes?|cyclepath|cycleway|cycles?|shared\\s*path|footpath|path|walkway|laneway|lane|ln|ramp|slip|bridge|"
    "underpass|overbridge|approach|exit|entry|entrance|sideroad|kerb|park|northbound|southbound|eastbound|westbound|southwestbound|"
    "northwestbound|southeastbound|northeastbound|lhs|rhs|left|right|upper|lower|vehicle"
)

#: Vendor flight status, letters only and lower case -> status shown (fixed values).
STATUS = {
    "expected": "Expected", "expectedarrival": "Expected", "enroute": "EnRoute", "checkin": "Scheduled", "boarding": "Boarding", "gateclosed": "Boarding", "departed": "Departed",
    "delayed": "Delayed", "approaching": "EnRoute", "arrived": "Arrived", "canceled": "Cancelled", "cancelled": "Cancelled", "diverted": "Diverted", "canceleduncertain": "Cancelled",
    "unknown": "Unknown", "scheduled": "Scheduled", "active": "EnRoute", "landed": "Arrived", "incident": "Incident",
}

PEOPLE = ("Pedestrian", "Cyclist")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# calendar -----------------------------------------------------------------------------------------------------------------


def iso_dow(d: Column | str) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c(d)) + 1


def sunday_dow(d: Column | str) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(c(d)) - 1


def is_weekend(d: Column | str) -> Column:
    return iso_dow(d) >= 6


def hour_of_week(d: Column | str, hour: Column | str) -> Column:
    return (iso_dow(d) - 1) * 24 + c(hour)


def day_type(d: Column | str) -> Column:
    return F.when(iso_dow(d) == 7, "SUNDAY").when(iso_dow(d) == 6, "SATURDAY").otherwise("WEEKDAY")


def week_of_month(d: Column | str) -> Column:
    """1 for the first seven days, then 2, ...; a whole number."""
    return F.floor((F.dayofmonth(c(d)) - 1) / 7).cast("int") + 1


def quarter_hour(ts: Column | str) -> Column:
    """The start of the 15 minutes that hold a timestamp."""
    m = F.date_trunc("minute", c(ts))
    return m - F.make_dt_interval(mins=F.minute(m) % 15)


# bands --------------------------------------------------------------------------------------------------------------------


def time_band(kind: Column | str, hour: Column | str) -> Column:
    """Peaks are for weekdays only; EVENING from 19 to 6."""
    h, weekday = c(hour), c(kind) == "WEEKDAY"
    return F.when(weekday & h.between(7, 8), "AM_PEAK").when(weekday & h.between(16, 17), "PM_PEAK").when(h.between(9, 15), "INTERPEAK").when((h >= 19) | (h < 6), "EVENING").otherwise("SHOULDER")


def punctuality(delay_s: Column | str) -> Column:
    d = c(delay_s)
    return F.when(d.isNull(), "NOT_OBSERVED").when(d < -60, "EARLY").when(d <= 300, "ON_TIME").when(d <= 900, "LATE").otherwise("VERY_LATE")


def severity(z: Column | str) -> Column:
    a = F.abs(c(z))
    return F.when(a >= 3.5, "HIGH").when(a >= 2.5, "MEDIUM").when(a >= 1.5, "LOW").otherwise("NONE")


def severity_or_ratio(z: Column | str, ratio: Column | str) -> Column:
    """severity(); where that is NONE, LOW for a ratio of at most 0.5 or at least 1.75."""
    by_z, r = severity(z), c(ratio)
    return F.when(by_z != "NONE", by_z).when((r <= 0.5) | (r >= 1.75), "LOW").otherwise("NONE")


def severity_rank(s: Column | str) -> Column:
    return F.when(c(s) == "HIGH", 3).when(c(s) == "MEDIUM", 2).otherwise(1)


def drop_or_surge(value: Column | str, usual: Column | str) -> Column:
    """SURGE also if they are equal or one is missing."""
    return F.when(c(value) < c(usual), "DROP").otherwise("SURGE")


def change_direction(value: Column | str, usual: Column | str) -> Column:
    return F.when(c(value) > c(usual), "increase").when(c(value) < c(usual), "decrease").otherwise("stable")


def frequency_class(trips: Column | str, days: float = 30.0) -> Column:
    per_day = c(trips) / F.lit(days)
    return F.when(per_day >= 120, "HIGH_FREQUENCY").when(per_day >= 40, "FREQUENT").when(per_day >= 10, "STANDARD").otherwise("INFREQUENT")


def route_mode(route_type: Column | str) -> Column:
    t = c(route_type)
    return F.when(t == 0, "TRAM").when(t == 2, "RAIL").when(t == 3, "BUS").when(t == 4, "FERRY").when(t == 5, "CABLE_CAR").otherwise("OTHER")


def confidence(samples: Column | str, quality: Column | str) -> Column:
    """Struct(level, history_samples, basis) of a signal."""
    complete = F.coalesce(c(quality) == "complete", F.lit(False))
    level = F.when(~complete, "low").when(c(samples) >= 12, "high").otherwise("medium")
    return F.struct(level.alias("level"), c(samples).cast("long").alias("history_samples"), F.lit("matched weekday and hour").alias("basis"))


# predicates ---------------------------------------------------------------------------------------------------------------


def in_box(lat: Column | str, lon: Column | str, south: float | Column, west: float | Column, north: float | Column, east: float | Column) -> Column:
    return c(lat).between(south, north) & c(lon).between(west, east)


def all_of(*conditions: Column | None) -> Column:
    """The given conditions together; None is no condition."""
    return reduce(lambda a, b: a & b, [x for x in conditions if x is not None], F.lit(True))


def one_of(column: str, values) -> Column | None:
    """Membership in a list; an empty or missing list is no condition."""
    return F.col(column).isin(list(values)) if values else None


def between_dates(column: str, first=None, last=None) -> Column | None:
    """Both ends included, either may be missing."""
    parts = [F.col(column) >= F.lit(first).cast("date") if first else None, F.col(column) <= F.lit(last).cast("date") if last else None]
    return all_of(*parts) if any(p is not None for p in parts) else None


def passes_gates(score: Column | str, change: Column | str, relative: Column | str, z: float, absolute: float, share: float) -> Column:
    return (F.abs(c(score)) >= z) & (F.abs(c(change)) >= absolute) & (F.abs(c(relative)) >= share)


def is_people(kind: Column | str) -> Column:
    return c(kind).isin(*PEOPLE)


def text_matches(words: list[str], *columns: str) -> Column:
    """Whether any word occurs in any column, whatever the case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(x)).contains(w.lower()), F.lit(False)) for x in columns for w in words], F.lit(False))


def title_case(text: Column | str) -> Column:
    """Each run of letters with a capital first and small letters after."""
    return F.array_join(F.transform(F.regexp_extract_all(c(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def status_name(raw: Column | str) -> Column:
    """The known name of a vendor's status; others in title case; Unknown if there is none."""
    key = F.regexp_replace(F.lower(c(raw)), "[^a-z]", "")
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(F.coalesce(c(raw), F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(known, key), title_case(raw)))


# text and keys ------------------------------------------------------------------------------------------------------------


def street_of(name: Column | str) -> Column:
    """A sensor name without its leading site number and without what follows the first descriptor; the name itself if nothing is left."""
    bare = F.regexp_replace(c(name), r"(?i)^s\d+\s+", "")
    street = F.trim(F.regexp_replace(bare, rf"(?i)[\s-]+({DESCRIPTORS}).*$", ""))
    return F.coalesce(F.nullif(street, F.lit("")), c(name))


def trip_instance(trip: Column | str, day: Column | str) -> Column:
    return F.concat(c(trip), F.lit("|"), F.date_format(c(day), "yyyyMMdd"))


def flight_key(direction: Column | str, number: Column | str, scheduled: Column | str) -> Column:
    return F.concat_ws("|", c(direction), F.coalesce(F.nullif(c(number), F.lit("")), F.lit("UNKNOWN")), F.coalesce(F.date_format(c(scheduled), "yyyy-MM-dd'T'HH:mm"), F.lit("NOSCHED")))


def cell_id(lat: Column | str, lon: Column | str, places: int = 2) -> Column:
    """A rounding grid as a text key: 2 places are about 1 km, 3 about 100 m."""
    return F.concat_ws("_", *(F.format_string(f"%.{places}f", F.round(c(x), places)) for x in (lat, lon)))


def grid_id(lat: Column | str, lon: Column | str, places: int = 2) -> Column:
    """The rounding grid of the layer over all feeds as a text key: plain numbers and a comma."""
    return F.concat_ws(",", *(F.round(c(x), places).cast("string") for x in (lat, lon)))


# geometry -----------------------------------------------------------------------------------------------------------------


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    half = lambda a, b: F.sin(F.radians(c(a) - c(b)) / 2)
    h = half(lat2, lat1) * half(lat2, lat1) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * half(lon2, lon1) * half(lon2, lon1)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def flat_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Distance on a plane around the mean latitude."""
    x = F.radians(c(lon2) - c(lon1)) * F.cos(F.radians((c(lat1) + c(lat2)) / 2))
    y = F.radians(c(lat2) - c(lat1))
    return EARTH_M * F.sqrt(x * x + y * y)


def speed_kmh(metres: Column | str, seconds: Column | str) -> Column:
    return F.when(c(seconds) > 0, c(metres) / c(seconds) * 3.6)


# time ---------------------------------------------------------------------------------------------------------------------


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Second boundaries from a to b."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", c(a)), F.date_trunc("second", c(b)))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Minute boundaries from a to b: 00:00:59 to 00:01:01 is one."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", c(a)), F.date_trunc("minute", c(b)))


def local_to_utc(ts: Column | str, zone: str = "Pacific/Auckland") -> Column:
    """An hour that occurs twice is read as its first occurrence."""
    return F.to_utc_timestamp(c(ts), zone)


def utc_to_local(ts: Column | str, zone: str = "Pacific/Auckland") -> Column:
    return F.from_utc_timestamp(c(ts), zone)


def service_seconds(text: Column | str) -> Column:
    """H:MM:SS, also beyond 24 hours, as seconds; null if it is not such a text."""
    p = F.split(F.trim(c(text)), ":")
    return F.when(F.size(p) == 3, F.expr("0") + F.try_element_at(p, F.lit(1)).try_cast("long") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("long") * 60 + F.try_element_at(p, F.lit(3)).try_cast("long"))


def tolerant_utc(text: Column | str) -> Column:
    """A timestamp written with a blank or T, with or without seconds and Z; without a zone it is UTC; null if it can't be read."""
    t = F.regexp_replace(F.trim(c(text)), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$", "$1T$2|$3|$4")
    p = F.split(t, r"\|")
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(""))
    whole = F.concat(part(1), F.when(part(2) == "", ":00").otherwise(part(2)), F.when(part(3) == "", "Z").otherwise(part(3)))
    return F.when(F.size(p) == 3, F.try_to_timestamp(whole))


def register_sql(spark: SparkSession) -> None:
    """severity_of and street_of as temporary functions for SQL users."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION severity_of(z DOUBLE) RETURNS STRING RETURN CASE WHEN abs(z) >= 3.5 THEN 'HIGH' WHEN abs(z) >= 2.5 THEN 'MEDIUM' WHEN abs(z) >= 1.5 THEN 'LOW' ELSE 'NONE' END")
    words = DESCRIPTORS.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION street_of(name STRING) RETURNS STRING RETURN coalesce(nullif(trim(regexp_replace(regexp_replace(name, '(?i)^s\\\\d+\\\\s+', ''), '(?i)[\\\\s-]+({words}).*$', '')), ''), name)")
