"""Quantiles: exact ones of groups of any size, and mergeable sketches of them; distinct counts that can be rolled up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

#: Values of a group that one task may gather; a group of more is cut down to so many by counting.
GATHERED = 1 << 20
#: Cuts of a pass; groups whose cuts may be broadcast.
CUTS, BROADCAST = 32, 100_000
#: Size of a KLL sketch: the rank of what it says is wrong by RANK_ERROR at most, 99 times of 100.
KLL_K, RANK_ERROR = 200, 0.0133
#: Nominal entries (as a power of two) of a theta sketch: exact up to so many, then THETA_ERROR at most 95 times of 100.
THETA_LG, THETA_ERROR = 14, 2 / 2**7


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys where null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys], F.lit(True))
    return left.join(F.broadcast(renamed) if small else renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _plain(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("_v").alias("n"), *[F.percentile("_v", F.lit(p)).alias(name) for name, p in probs.items()])


def _selected(rows: DataFrame, wanted: DataFrame, small: bool, gathered: int) -> DataFrame:
    """(_g, k, x): the value of each 0-based rank k of group _g. rows: (_g, _v); wanted: (_g, k, inside) with the number of the group's values.

    Each pass cuts the values between two known ones by a sketch of them and counts, exactly, what lies between the cuts and on them. A rank on a
    cut is found; any other goes on with the values of its interval, less than a tenth of those before, until they are few enough to be sorted.
    """
    span = ["_g", "lo", "hi"]
    none = F.lit(None).cast("double")
    open_ = wanted.select("_g", "k", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), "inside")
    found = []
    held = lambda spans: _same(rows, spans, ["_g"], small=small).where("(lo is null or _v > lo) and (hi is null or _v < hi)")
    while True:
        open_ = materialized(open_, "open-ranks")
        large = open_.where(F.col("inside") > gathered)
        if large.isEmpty():
            break
        inside = held(large.select(*span).distinct())
        sketch = inside.groupBy(*span).agg(F.kll_sketch_agg_double("_v", F.lit(KLL_K)).alias("_s"))
        cuts = F.array_sort(F.array_distinct(F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(i / CUTS)) for i in range(1, CUTS)])))
        cuts = materialized(sketch.select(*span, cuts.alias("cuts")), "cuts")
        # 2 i: between the cuts i - 1 and i; 2 i + 1: on cut i
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("_v"))) + F.array_contains("cuts", F.col("_v")).cast("int")
        counts = _same(inside, cuts, span, small=small).groupBy(*span, place.alias("place")).agg(F.count("*").alias("n"))
        line = Window.partitionBy(*span).orderBy("place")
        counts = counts.withColumn("upto", F.sum("n").over(line))
        hit = _same(large.drop("inside"), _same(counts, cuts, span), span).where((F.col("k") - F.col("below") < F.col("upto")) & (F.col("k") - F.col("below") >= F.col("upto") - F.col("n")))
        hit = materialized(hit, "ranks")
        found.append(hit.where("place % 2 = 1").select("_g", "k", F.get("cuts", F.expr("cast(place div 2 as int)")).alias("x")))
        i = F.expr("cast(place div 2 as int)")
        lo, hi = F.coalesce(F.get("cuts", i - 1), "lo"), F.coalesce(F.get("cuts", i), "hi")
        rest = hit.where("place % 2 = 0").select("_g", "k", lo.alias("lo"), hi.alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))
        open_ = open_.where(F.col("inside") <= gathered).unionByName(rest)
    lists = held(open_.select(*span).distinct()).groupBy(*span).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    found.append(_same(open_, lists, span).select("_g", "k", F.get("_all", (F.col("k") - F.col("below")).cast("int")).alias("x")))
    return reduce(DataFrame.unionByName, found)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], gathered: int = GATHERED) -> DataFrame:
    """(keys, n, one column for each of probs) of the values that are neither null nor NaN: percentiles with interpolation, as F.percentile() gives them.

    percentile() keeps all distinct values of a group in one task. Here groups of more than ``gathered`` values are found by a count, and their ranks
    are selected by counting between cuts over several readings of their rows; no task holds more than ``gathered`` values of a group, and no more than
    CUTS counts of each are shuffled from a task. Of large groups there are at most (rows / gathered).
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    sizes = materialized(rows.groupBy(*keys).agg(F.count("*").alias("inside")), "sizes")
    large = sizes.where(F.col("inside") > gathered)
    if large.isEmpty():
        return _plain(rows, keys, probs)
    large = materialized(large.withColumn("_g", F.monotonically_increasing_id()), "large-groups")
    small = large.count() <= BROADCAST
    few = _plain(_same(rows, sizes.where(F.col("inside") <= gathered), keys).drop("inside"), keys, probs)
    own = materialized(_same(rows, large.select(*keys, "_g"), keys, small=small).select("_g", "_v"), "large-values")
    position = {name: p * (F.col("inside") - 1) for name, p in probs.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in position.values()])))
    wanted = large.select("_g", "inside", F.explode(ranks).alias("k"))
    found = materialized(_selected(own, wanted, small, gathered), "rank-values")
    maps = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("_x"))
    out = large.join(maps, "_g")
    at = lambda k: F.element_at("_x", k)

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        return F.when((low == high) | (at(low) == at(high)), at(low)).otherwise((high - x) * at(low) + (x - low) * at(high))

    return few.unionByName(out.select(*keys, F.col("inside").alias("n"), *[between(x).alias(name) for name, x in position.items()]))


def exact_median_mad(df: DataFrame, keys: list[str], value: str, gathered: int = GATHERED) -> DataFrame:
    """(keys, n, median, mad), for groups of any size."""
    middle = materialized(exact_quantiles(df, keys, value, {"median": 0.5}, gathered), "medians")
    apart = _same(df.select(*keys, value), middle.select(*keys, "median"), keys).withColumn("_apart", F.abs(F.col(value) - F.col("median")))
    return _same(middle, exact_quantiles(apart, keys, "_apart", {"mad": 0.5}, gathered).drop("n"), keys)


# sketches ----------------------------------------------------------------------------------------------------------------------


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """(keys, n, sketch): a KLL sketch of each group's values. Its size is bounded, and sketches of parts of a group can be merged."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, sketch) over coarser keys, from stored sketches alone."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Values of the data whose ranks are those asked for, give or take RANK_ERROR."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for name, p in probs.items()}).drop("sketch")


def value_counts(df: DataFrame, keys: list[str], value: str, name: str = "count") -> DataFrame:
    """(keys, value, name): how often each value occurs in a group, nulls left out. Rows of a large group are dealt by value, so they may be compared with what is known of the group without meeting in one task."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(name))


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg: int = THETA_LG) -> DataFrame:
    """(keys, sketch): a theta sketch of the distinct values of each group, to be stored by day and rolled up. Nulls do not count."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(lg)).alias("sketch"))


def distinct_over(sketches: DataFrame, keys: list[str], name: str, lg: int = THETA_LG) -> DataFrame:
    """(keys, name): distinct values over coarser keys or a chosen period, from stored sketches alone."""
    return sketches.groupBy(*keys).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", F.lit(lg))).alias(name))


def distinct_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the distinct values of each group, to be stored by day and rolled up where counts have to be exact."""
    return df.select(*keys, value).distinct()


def exact_distinct_over(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): distinct values over coarser keys or a chosen period, from distinct_values() alone. Nulls do not count."""
    return values.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(name))
