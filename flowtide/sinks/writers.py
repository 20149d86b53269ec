"""Sinks: GeoJSON features, JSON, CSV and Parquet. Features are written as lines; a collection is assembled only of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence
from ..operators.ranges import ranked

#: The published limitations and the other fixed values of the documents.
LIMITATIONS = [
    "Fixed sensors do not represent every city journey.",
    "A counted vehicle is not a passenger count.",
    "Nearby countlines may count the same traveller more than once.",
    "Missing records are data gaps, not zero movement.",
    "Publisher data is batch refreshed, not a live emergency feed.",
]
CADENCE, SOURCE = "at least monthly", "Wellington City Council Transport Sensors"
METHOD = "12-week matched-weekday/hour median and MAD"
TRANSIT_ATTRIBUTION = "Metlink GTFS timetable © Greater Wellington Regional Council; running is a labelled synthetic replay"
TRANSIT_LIMITATIONS = [
    "Synthetic data: the real Metlink timetable replayed with simulated running and injected anomalies. No figure describes an actual April 2026 event.",
    "An anomaly hotspot is a modelled statistic, not a live disruption report.",
    "April 2026 replay, not the 6 August 2026 snapshot the countline layer shows.",
    "PT anomalies corroborate a countline signal; they do not measure one.",
    "Only stops with >= 50 anomalies or >= 10 high-severity anomalies are published; the full event set is in {events}.",
]
#: Most features that are assembled into one collection value.
MOST_FEATURES = 100_000


def _feature(ident: Column, geometry: Column, properties: list[Column]) -> Column:
    return F.struct(F.lit("Feature").alias("type"), ident.alias("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))


def _point(lon: str, lat: str) -> Column:
    p = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), p)


def signal_features(signals: DataFrame, meta: DataFrame, data_as_of: str) -> DataFrame:
    """One GeoJSON feature line for each signal whose countline is known: a LineString of [lon, lat] pairs and 21 properties."""
    m = meta.select(F.col("COUNTLINE_ID").cast("string").alias("countline_id"), "VIEWPOINT_ID", "NAME", *[f"{a}_{e}_LINE" for a in ("LATITUDE", "LONGITUDE") for e in ("START", "END")])
    at = F.date_format(F.make_timestamp_ntz(F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("hour"), F.lit(0), F.lit(0)), "yyyy-MM-dd'T'HH:mm:ss")
    j = signals.withColumn("countline_id", F.col("countline_id").cast("string")).join(m, "countline_id").withColumn("observed_at", at)
    line = F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(F.col(f"LONGITUDE_{e}_LINE"), F.col(f"LATITUDE_{e}_LINE")) for e in ("START", "END")]).alias("coordinates"))
    ident = F.concat_ws(":", F.lit("movement"), "countline_id", "transport_class", "direction", "observed_at")
    fixed = lambda **kv: [F.lit(v).alias(k) for k, v in kv.items()]
    props = [
        *fixed(schema="movement-signal/v1", signal_type="classified_count_change"), F.col("status"), *fixed(attention="investigate"), F.col("countline_id"), F.col("VIEWPOINT_ID").cast("string").alias("viewpoint_id"), F.col("NAME").alias("name"), F.col("transport_class"), F.col("direction"), F.col("change_direction"),
        F.col("count").alias("observed_count"), F.col("expected_count"), F.col("robust_z"), F.col("observed_at"), *fixed(data_as_of=data_as_of, publisher_cadence=CADENCE), F.col("data_quality"), confidence("history_samples", "data_quality").alias("signal_confidence"),
        *fixed(location_confidence="metadata coordinates"), F.array(*map(F.lit, LIMITATIONS)).alias("limitations"), *fixed(attribution=SOURCE),
    ]
    return j.select(ident.alias("id"), F.to_json(_feature(ident, line, props), {"ignoreNullFields": "false"}).alias("feature"))


def coverage_features(meta: DataFrame) -> DataFrame:
    """Every countline; missing directions and dates are null and kept."""
    line = F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(F.col(f"LONGITUDE_{e}_LINE"), F.col(f"LATITUDE_{e}_LINE")) for e in ("START", "END")]).alias("coordinates"))
    have = lambda c: (F.col(c) if c in meta.columns else F.lit(None).cast("string")).alias(c.lower())
    props = [F.col("COUNTLINE_ID").cast("string").alias("countline_id"), F.col("VIEWPOINT_ID").cast("string").alias("viewpoint_id"), F.col("NAME").alias("name"), have("EARLIEST"), have("LATEST"), have("DIRECTION_IN"), have("DIRECTION_OUT")]
    ident = F.concat(F.lit("countline:"), F.col("COUNTLINE_ID"))
    return meta.select(ident.alias("id"), F.to_json(_feature(ident, line, props), {"ignoreNullFields": "false"}).alias("feature"))


def hotspot_features(hotspots: DataFrame, attribution: str = TRANSIT_ATTRIBUTION, events: str = "the table of detections") -> DataFrame:
    """One GeoJSON feature line for each row of detectors.stop_hotspots(), with rank: the place by count and stop id. attribution and events (where all detections are) are the publisher's."""
    fixed = lambda **kv: [F.lit(v).alias(k) for k, v in kv.items()]
    props = [
        *fixed(schema="transit-anomaly/v1", source_type="public_transport"), F.col("STOP_ID").alias("stop_id"), F.col("STOP_NAME").alias("stop_name"), F.col("modes"), F.col("anomalies").alias("anomaly_count"), F.col("high").alias("high_count"), F.col("medium").alias("medium_count"), F.col("low").alias("low_count"),
        F.col("tier").alias("severity_tier"), F.col("top_detector"), F.col("top_detector_count"), F.col("worst_example"), F.lit(True).alias("synthetic"), *fixed(attribution=attribution), F.array(*[F.lit(x.format(events=events)) for x in TRANSIT_LIMITATIONS]).alias("limitations"),
    ]
    placed = hotspots.withColumns({"_lon": F.round("STOP_LON", 6), "_lat": F.round("STOP_LAT", 6), "_less": -F.col("anomalies")})
    f = _feature(F.concat(F.lit("transit-stop:"), "STOP_ID"), _point("_lon", "_lat"), props)
    lines = placed.select(F.col("STOP_ID").cast("string").alias("id"), F.to_json(f, {"ignoreNullFields": "false"}).alias("feature"), "_less", "STOP_ID")
    return ranked(lines, ["_less", "STOP_ID"], "rank").select(F.col("rank").cast("int").alias("rank"), "id", "feature")


def point_features(df: DataFrame, ident: str, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """Point features, null geometry included: hotspots, cameras and sites."""
    f = _feature(F.col(ident), _point(lon, lat), [F.col(p) for p in properties])
    return df.select(F.col(ident).cast("string").alias("id"), F.to_json(f, {"ignoreNullFields": "false"}).alias("feature"))


def collection(features: DataFrame, schema: str, data_as_of: str, order: str = "id", **header: Column) -> DataFrame:
    """One row: the collection of features in order, with header values (aggregates over the features). For at most MOST_FEATURES, which are counted before any is gathered."""
    n = features.count()
    if n > MOST_FEATURES:
        raise ValueError(f"{n} features are too many for one collection; write them as lines")
    body = features.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, "feature"))).alias("f"), *[v.alias(k) for k, v in header.items()])
    head = F.concat(F.lit(f'{{"type":"FeatureCollection","schema":"{schema}","data_as_of":"{data_as_of}",'), *[F.concat(F.lit(f'"{k}":'), F.col(k).cast("string"), F.lit(",")) for k in header], F.lit('"features":['))
    return body.select("n", F.concat(head, F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("document"))


def health_document(health: DataFrame, data_as_of: str) -> DataFrame:
    return health.select(F.to_json(F.struct("*", F.lit(data_as_of).alias("data_as_of"), F.lit(CADENCE).alias("publisher_cadence"), F.lit(SOURCE).alias("source"), F.lit(METHOD).alias("method"), F.array(*map(F.lit, LIMITATIONS)).alias("limitations"))).alias("document"))


def write_archive(df: DataFrame, path: str, local_ts: str) -> None:
    """zstd Parquet under service_date=/hour= folders of local time; rows of an hour meet in one task, so that files are few."""
    out = df.withColumns({"service_date": F.to_date(local_ts), "hour": F.hour(local_ts)})
    out.repartition("service_date", "hour").write.mode("append").partitionBy("service_date", "hour").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON."""
    features.select("feature").write.mode("overwrite").text(path)


def flat_rows(features: DataFrame, schema: str) -> DataFrame:
    """Feature lines -> flat rows: id, geometry_type, first coordinate, properties one level down as k_inner, arrays joined by " | ". schema: of the properties."""
    f = features.select(F.from_json("feature", f"id string, geometry struct<type:string,coordinates:string>, properties struct<{schema}>").alias("f"))
    numbers = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))
    cols = [F.col("f.id").alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.get(numbers, F.lit(0)).cast("double").alias("lon"), F.get(numbers, F.lit(1)).cast("double").alias("lat")]
    for p in f.schema["f"].dataType["properties"].dataType:
        kind = p.dataType.typeName()
        if kind == "struct":
            cols += [F.col(f"f.properties.{p.name}.{x.name}").alias(f"{p.name}_{x.name}") for x in p.dataType]
        elif kind == "array":
            cols.append(F.array_join(F.col(f"f.properties.{p.name}").cast("array<string>"), " | ").alias(p.name))
        else:
            cols.append(F.col(f"f.properties.{p.name}").alias(p.name))
    return f.select(*cols)
