"""The sorted sweep against all pairs."""

import datetime as dt
import random

import pytest

from flowtide.operators import intervals, joins

POINTS, SPANS = "k string, day date, t int, name string", "k string, day date, lo int, hi int, id int"


def brute(points, spans):
    return sorted({(*p, *s[2:]) for p in set(points) for s in spans if p[2] is not None and s[2] is not None and s[3] is not None and p[0] == s[0] and p[1] == s[1] and s[2] <= p[2] <= s[3]} , key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_against_all_pairs_over_many_ranges(spark, parts):
    """One hot key over many ranges, long intervals, equal times, null keys and times, intervals that end before they begin."""
    rng, days = random.Random(parts), [dt.date(2026, 4, 1), dt.date(2026, 4, 2), None]
    key = lambda: (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(days))
    points = [(*key(), rng.randrange(300), rng.choice("xy")) for _ in range(1500)] + [("hot", days[0], None, "x"), points_twice := ("a", days[0], 5, "x"), points_twice]
    spans = [(*key(), lo := rng.randrange(300), lo + rng.choice([0, 1, 5, 40, 299]), i) for i in range(200)]
    spans += [("hot", days[0], 0, 299, 900), ("hot", days[0], 10, 9, 901), ("hot", days[0], None, 9, 902), ("hot", days[0], 4, None, 903), ("only", days[0], 1, 2, 904)]
    out = intervals.points_in_intervals(spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(spans, SPANS), ["k", "day"], "t", "lo", "hi", parts)
    assert sorted([tuple(r) for r in out.select("k", "day", "t", "name", "lo", "hi", "id").collect()], key=str) == brute(points, spans)


def test_an_interval_is_one_row_and_one_for_each_range_it_crosses(spark):
    """A hundred years and every day in it: the line has a row for each day and one for the interval; no bins."""
    days = spark.range(3000).selectExpr("date_add(date'2026-01-01', cast(id as int)) as service_date")
    flags = {d: 1 for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")}
    calendar = spark.createDataFrame([{"service_id": "long", "start_date": "19700101", "end_date": "20691231", **flags}, {"service_id": "sundays", "start_date": "20260101", "end_date": "20260131", **{**{d: 0 for d in flags}, "sunday": 1}}])
    made, write = [], intervals.materialized
    try:
        intervals.materialized = lambda df, name: made.append(out := write(df, name)) or out
        got = joins.services_on(days, calendar)
    finally:
        intervals.materialized = write
    assert made[0].count() == 3000 + 2
    assert {r.service_id: r["count"] for r in got.groupBy("service_id").count().collect()} == {"long": 3000, "sundays": 4}


def test_nothing_on_either_side(spark):
    none = spark.createDataFrame([], POINTS), spark.createDataFrame([], SPANS)
    some = spark.createDataFrame([("a", None, 1, "x")], POINTS), spark.createDataFrame([("a", None, 0, 2, 7)], SPANS)
    count = lambda p, s: intervals.points_in_intervals(p, s, ["k", "day"], "t", "lo", "hi").count()
    assert (count(none[0], some[1]), count(some[0], none[1]), count(none[0], none[1]), count(*some)) == (0, 0, 0, 1)
