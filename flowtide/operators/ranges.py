"""Windows over keys of any size: rows in ranges of their order, and an exchange of the rows at the edges.

A window function gathers all rows of its key in one task. Here rows are dealt into ranges of (key, order), so a key with most of the rows
lies in many tasks; what a row needs from before its range is carried by one row for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

PART = "_part"


def in_ranges(df: DataFrame, order: list[str], partitions: int | None = None, name: str = "ranges") -> DataFrame:
    """df with PART, the number of the range of ``order`` in which a row lies (nulls first), written once so that all readers see the same ranges. Rows equal in order share a range."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), name)


def ranked(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with its row number (from 1) in ``order``, without a task that sees all rows. Equal rows are numbered in any order."""
    rows = in_ranges(df, order, partitions, "ranked")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = rows.groupBy(PART).agg(F.count("*").alias("_n")).select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return rows.withColumn("_nth", inside).join(F.broadcast(base), PART).withColumn(name, F.col("_base") + F.col("_nth")).drop(PART, "_nth", "_base")


def _equal(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs], F.lit(True))


def lagged(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], partitions: int | None = None) -> DataFrame:
    """df with, for each name -> column of ``columns``, the column's value in the row before, of the same key in ``order``; null in the first row of a key.

    The same as lag() over (keys, order), which should be unique in a key. Ranges end between rows of equal (keys, order) never, so of each range only
    the last row is needed by the next: that is the exchange, one row for each range.
    """
    rows = in_ranges(df, [*keys, *order], partitions, "lagged")
    line = Window.partitionBy(PART, *keys).orderBy(*order)
    rows = rows.withColumns({name: F.lag(c).over(line) for name, c in columns.items()} | {"_nth": F.row_number().over(line)})
    whole = F.struct(*keys, *order)
    last = rows.groupBy(PART).agg(F.max_by(F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())]), whole).alias("_last"))
    # the range that follows, empty ones left out: a row for each range
    edge = last.select(F.lead(PART).over(Window.orderBy(PART)).alias("_next"), "_last.*").where("_next is not null")
    small = F.broadcast(edge)
    on = (rows[PART] == edge["_next"]) & (rows["_nth"] == 1) & _equal(rows, edge, [(k, f"_k{i}") for i, k in enumerate(keys)])
    out = rows.join(small, on, "left")
    first = F.col("_nth") == 1
    taken = {name: F.when(first, F.col(f"_v{i}")).otherwise(F.col(name)) for i, name in enumerate(columns)}
    return out.withColumns(taken).drop(PART, "_nth", "_next", *[f"_k{i}" for i in range(len(keys))], *[f"_v{i}" for i in range(len(columns))])
