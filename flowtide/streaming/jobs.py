"""Structured Streaming jobs over landed polls, with batch twins that share the transformation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import cell_id
from ..operators.quantiles import KLL_K, merged_sketches, sketched_quantiles
from ..session import folder

WATERMARK = "1 hour"
WATCHED = ["status", "estimated_utc", "actual_utc", "gate"]


def landed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder; event times become instants, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = reader.parquet(path)
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in out.schema if f.dataType.typeName() == "timestamp_ntz"})


def most_complete(df: DataFrame, key: str, best: list[str], order: str, *ties: str) -> DataFrame:
    """One row of each key in a batch: the greatest by the columns of ``best``, of which unknown values come last, then the latest."""
    w = Window.partitionBy(key).orderBy(*map(F.desc_nulls_last, [*best, order]), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changes(previous: DataFrame, batch: DataFrame, key: str, watched: list[str] = WATCHED) -> DataFrame:
    """Rows of the batch whose key is new or of which a watched column differs from the state before it."""
    old = previous.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in watched])
    j = batch.join(old, F.col(key) == F.col("_key"), "left")
    moved = F.col("_key").isNull()
    for c in watched:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.where(moved).select(F.col("snapshot_ts").alias("changed_ts"), key, F.col(f"_{watched[0]}").alias(f"previous_{watched[0]}"), *watched)


def merged(previous: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The state after a batch: last row of each key, with when it was first and last seen."""
    seen = batch.withColumns({"first_seen_ts": F.col("snapshot_ts"), "last_seen_ts": F.col("snapshot_ts")})
    w = Window.partitionBy(key)
    both = previous.withColumn("_new", F.lit(0)).unionByName(seen.withColumn("_new", F.lit(1)))
    both = both.withColumns({"first_seen_ts": F.min("first_seen_ts").over(w), "last_seen_ts": F.max("last_seen_ts").over(w), "_n": F.row_number().over(w.orderBy(F.desc("_new"), F.desc("snapshot_ts")))})
    return both.where("_n = 1").drop("_new", "_n")


def change_log(snapshots: DataFrame, key: str, order: list[str], watched: list[str] = WATCHED) -> DataFrame:
    """The batch twin of changes(): every row that differs from the one before it of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = F.row_number().over(w) == 1
    for c in watched:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return snapshots.withColumns({f"previous_{watched[0]}": F.lag(watched[0]).over(w), "_moved": moved}).where("_moved").drop("_moved")


def hourly_counts(events: DataFrame, ts: str, zone: str, *by: str, streaming: bool = True) -> DataFrame:
    """Tumbling counts by local hour; rows later than the watermark are dropped."""
    e = events.withWatermark(ts, WATERMARK) if streaming else events
    out = e.groupBy(F.window(ts, "1 hour").alias("w"), *by).agg(F.count("*").alias("n"))
    local = F.from_utc_timestamp(F.col("w.start"), zone)
    return out.select(F.col("w.start").alias("bin_start"), F.to_date(local).alias("event_date"), F.hour(local).alias("event_hour"), *by, "n")


def cell_bins(events: DataFrame, ts: str, lat: str, lon: str, value: str, min_n: int = 5, streaming: bool = True, exact: bool = False) -> DataFrame:
    """Quarter-hour aggregates of cells with at least min_n events: count, a mergeable sketch of the values (cell_quantiles() reads and merges them), and its median
    and 90th percentile, whose ranks are right up to quantiles.RANK_ERROR. The state of a window is one sketch, whatever its number of events. exact: percentiles of all
    values, which the state then keeps, and no sketch."""
    e = events.withWatermark(ts, WATERMARK) if streaming else events
    groups = e.groupBy(F.window(ts, "15 minutes").alias("w"), cell_id(lat, lon, 2).alias("cell_id"))
    bins = [F.col("w.start").alias("bin_start"), "cell_id", "n"]
    if exact:
        out = groups.agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median_value"), F.percentile(value, F.lit(0.9)).alias("p90_value"))
        return out.where(F.col("n") >= min_n).select(*bins, "median_value", "p90_value")
    out = groups.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("sketch")).where(F.col("n") >= min_n)
    return out.select(*bins, "sketch", *[F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in (("median_value", 0.5), ("p90_value", 0.9))])


def cell_quantiles(bins: DataFrame, *by: str, **probs: float) -> DataFrame:
    """Sketches of cell_bins() merged over coarser groups, such as a cell's day: (by, n, one column for each of probs)."""
    return sketched_quantiles(merged_sketches(bins, list(by)), probs)


#: Batches whose rows are merged into one version.
COMPACT_EVERY = 16


@dataclass(frozen=True)
class UpdatedTable:
    """The groups of a streaming aggregation, as each batch changes them, under a root: rows/batch=n, and versions/upto=n with the last row of each group after a
    batch n. A version is made of the one before it and the batches since, so no batch opens more than these. What lies two versions back is removed, so a reader that
    began with the version before still finds its files. A repeated batch or version writes the same again."""

    root: str
    key: tuple[str, ...]
    every: int = COMPACT_EVERY

    def _numbers(self, spark: SparkSession, kind: str, name: str, done: bool) -> list[int]:
        path, fs = folder(spark, f"{self.root}/{kind}")
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if not done or fs.exists(folder(spark, f"{p.toString()}/_SUCCESS")[0]))

    def _read(self, spark: SparkSession, upto: int | None) -> DataFrame | None:
        """The last row of each group after a batch (the last one, if None), with the batch that wrote it."""
        versions = [v for v in self._numbers(spark, "versions", "upto", True) if upto is None or v < upto]
        base = versions[-1] if versions else -1
        batches = [b for b in self._numbers(spark, "rows", "batch", True) if b > base and (upto is None or b <= upto)]
        parts = [spark.read.parquet(f"{self.root}/versions/upto={v}") for v in versions[-1:]] + [spark.read.parquet(f"{self.root}/rows/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in batches]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        whole = F.struct(*[c for c in rows.columns if c not in (*self.key, "batch")])
        last = rows.groupBy(*self.key).agg(F.max_by(whole, "batch").alias("_last"), F.max("batch").alias("batch"))
        return last.select(*self.key, "_last.*", "batch")

    def save(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
        if (batch + 1) % self.every == 0:
            self._read(spark, batch).write.mode("overwrite").parquet(f"{self.root}/versions/upto={batch}")
            versions = self._numbers(spark, "versions", "upto", True)
            old = versions[-2] if len(versions) > 1 else -1
            for kind, name, last in (("versions", "upto", old - 1), ("rows", "batch", old)):
                for n in self._numbers(spark, kind, name, False):
                    if n <= last:
                        path, fs = folder(spark, f"{self.root}/{kind}/{name}={n}")
                        fs.delete(path, True)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return stream.writeStream.outputMode("update").foreachBatch(self.save).option("checkpointLocation", f"{self.root}/progress").trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self._read(spark, None)
        if rows is None:
            raise ValueError(f"no batch has been written under {self.root}")
        return rows.drop("batch")


def updated_table(stream: DataFrame, root: str, *key: str) -> StreamingQuery:
    """Start to write the groups of a streaming aggregation as an UpdatedTable. State goes with the watermark."""
    return UpdatedTable(root, key).start(stream)


def read_updated(spark: SparkSession, root: str, *key: str) -> DataFrame:
    return UpdatedTable(root, key).read(spark)


def archive(stream: DataFrame, path: str, progress: str, ts: str, zone: str) -> StreamingQuery:
    """Append to Parquet folders by local day and hour."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    out = stream.withColumns({"service_date": F.to_date(local), "hour": F.hour(local)})
    return out.writeStream.partitionBy("service_date", "hour").option("compression", "zstd").format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()


def first_frames(stream: DataFrame, ts: str, *key: str) -> DataFrame:
    """The first frame of each camera, capture time and content within the watermark."""
    return stream.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark(list(key))


def active_vehicles(state: DataFrame, route: str, since: Column) -> DataFrame:
    return state.where(F.col("last_seen_ts") >= since).groupBy(route).agg(F.count("*").alias("vehicles"))


def run(query: StreamingQuery, seconds: int = 600) -> StreamingQuery:
    """Wait for a query that ends by itself."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not end in time")
    return query
