"""Points in intervals by a sorted sweep over ranges of time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized

#: Kinds of rows in the order of the sweep: an interval that began in an earlier range, one that begins, a point.
CARRIED, BEGIN, POINT = -1, 0, 1
#: Rows of a result batch.
BATCH = 10_000


def _numbers(column: pa.Array) -> list:
    """Times as numbers, other values as they are."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    elif pa.types.is_temporal(column.type):
        column = column.cast(pa.int64())
    return column.to_pylist()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (range, key, time, kind) -> (point, load) for each interval that is open at a point."""
    at, open_, n = None, [], 0
    for batch in batches:
        out_point, out_load = [], []
        time, until = _numbers(batch.column("_t")), _numbers(batch.column("_until"))
        part, key, kind = (batch.column(c).to_pylist() for c in ("_part", "_key", "_kind"))
        point, load = batch.column("_point"), batch.column("_load")
        points, loads = point.to_pylist(), load.to_pylist()
        for i in range(batch.num_rows):
            if (part[i], key[i]) != at:
                at, open_ = (part[i], key[i]), []
            if kind[i] != POINT:
                n += 1
                heapq.heappush(open_, (until[i], n, loads[i]))
                continue
            while open_ and open_[0][0] < time[i]:
                heapq.heappop(open_)
            out_point += [points[i]] * len(open_)
            out_load += [x[2] for x in open_]
            if len(out_point) >= BATCH:
                yield pa.record_batch([pa.array(out_point, point.type), pa.array(out_load, load.type)], names=["_point", "_load"])
                out_point, out_load = [], []
        yield pa.record_batch([pa.array(out_point, point.type), pa.array(out_load, load.type)], names=["_point", "_load"])


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: list[str], at: str, begin: str, end: str, partitions: int | None = None) -> DataFrame:
    """Each distinct point with each interval of its key that holds it: all columns of both, the key once. Keys are equal or both null; both ends count.

    Points and begins of intervals are one line, ordered by key and time and cut into ranges, so a key with most of the rows is spread over
    many tasks. An interval is one row, however long it is, and one more for each range that begins while it is open. A task sweeps its ranges
    and holds the intervals that are open. points: (key, at, ...); intervals: (key, begin, end, ...) with other names than those of points, but for the
    key. A null time is in no interval; an interval that ends before it begins holds nothing.
    """
    spark = points.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    load = [c for c in intervals.columns if c not in key]
    schema = F.to_json(F.struct(*(F.col(c).cast("string") for c in key)), {"ignoreNullFields": "false"}) if key else F.lit("")
    p = points.distinct().where(F.col(at).isNotNull())
    i = intervals.where(F.col(begin) <= F.col(end))
    time, whole, loaded = (points.schema[at].dataType, p.select(F.struct(*points.columns)).schema[0].dataType, i.select(F.struct(*load)).schema[0].dataType)
    rows = p.select(schema.alias("_key"), F.col(at).alias("_t"), F.lit(POINT).alias("_kind"), F.lit(None).cast(time).alias("_until"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(loaded).alias("_load"))
    begins = i.select(schema.alias("_key"), F.col(begin).cast(time).alias("_t"), F.lit(BEGIN).alias("_kind"), F.col(end).cast(time).alias("_until"), F.lit(None).cast(whole).alias("_point"), F.struct(*load).alias("_load"))
    line = rows.unionByName(begins).withColumn("_tie", F.xxhash64("_point", "_load"))
    order = ["_key", "_t", "_kind", "_tie"]
    line = materialized(line.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "sweep-line")
    # the first row of each range: as many as there are ranges
    first = F.struct(*order)
    edges = line.groupBy("_part").agg(F.min(first).alias("_edge")).select("_part", "_edge", F.col("_edge._key").alias("_key"))
    began = line.where(F.col("_kind") == BEGIN).drop("_part")
    carried = began.join(F.broadcast(edges), "_key").where((first < F.col("_edge")) & (F.col("_until") >= F.col("_edge._t")))
    carried = carried.withColumns({"_t": F.col("_edge._t"), "_kind": F.lit(CARRIED)}).select(*line.columns)
    swept = line.unionByName(carried).repartition(n, "_part").sortWithinPartitions("_part", *order)
    out = swept.drop("_tie").mapInArrow(_sweep, f"_point {whole.simpleString()}, _load {loaded.simpleString()}")
    return out.select("_point.*", "_load.*")
