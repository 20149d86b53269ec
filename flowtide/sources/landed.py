"""Sources: files that feeds have landed, as typed rows. Payload parsers work on batches and streams alike."""

from __future__ import annotations

import json
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, between_dates, flight_key, status_name, tolerant_utc
from ..operators.snapshot import normalize_mobility

#: Names of camera attributes, lower-case letters and digits only (fixed values).
CAMERA_KEYS = {
    "camera_id": ["id", "cameraid", "camid", "camerano", "number", "siteid"], "camera_name": ["name", "description", "title", "sitename", "location", "desc", "cameraname"], "lat": ["lat", "latitude", "y"], "lon": ["long", "lon", "lng", "longitude", "x"],
    "region": ["region", "regionname", "area", "district"], "direction": ["direction", "view", "bearing", "orientation", "facing"], "offline": ["offline", "isoffline", "status", "online"],
}
OFFLINE = ["true", "1", "yes", "offline", "y"]

#: The airport of the flight feed: name, latitude, longitude (fixed values).
AIRPORT = ("Wellington Airport (WLG)", -41.3272, 174.8052)
#: Public holidays and the school holidays of the replayed month (fixed values).
PUBLIC_HOLIDAYS = [("2026-04-03", "Good Friday"), ("2026-04-06", "Easter Monday"), ("2026-04-25", "ANZAC Day"), ("2026-04-27", "ANZAC Day (observed)")]
SCHOOL_HOLIDAYS = [("2026-04-03", "2026-04-26")]


def load_parquet_shards(spark: SparkSession, paths: list[str], start_date: str | None = None, end_date: str | None = None, check: bool = True) -> DataFrame:
    """Normalised observations of many Parquet files; both dates are included and either may be missing. The bounds reach the scan."""
    wanted = between_dates("_COL_1", start_date, end_date)
    return normalize_mobility(spark.read.parquet(*paths).where(all_of(wanted)), check)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Countline metadata with ids as text."""
    schema = "VIEWPOINT_ID string, COUNTLINE_ID string, NAME string, LATITUDE_START_LINE double, LONGITUDE_START_LINE double, LATITUDE_END_LINE double, LONGITUDE_END_LINE double, DIRECTION_IN string, DIRECTION_OUT string, EARLIEST date, LATEST date"
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds filename (the whole path) and source_file (its last part)."""
    return df.withColumn("filename", F.col("_metadata.file_path")).withColumn("source_file", F.regexp_replace("filename", "^.*/", ""))


def load_csv_set(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files whose headers may differ, one path (or glob of equal headers) at a time, united by column name, with lineage."""
    out = None
    for p in paths:
        one = with_lineage(spark.read.csv(p, header=True, inferSchema=True))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def load_gtfs(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A GTFS text file, all columns text; rows with another number of fields are skipped."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), mode="DROPMALFORMED")


def load_archive(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Parquet captures under service_date=/hour= folders; the dates prune folders."""
    return spark.read.option("basePath", path).parquet(path).where(all_of(between_dates("service_date", first, last)))


def load_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def load_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def load_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row for each point feature of GeoJSON collections: feature_id, lon, lat and the properties (a schema string)."""
    schema = f"features array<struct<id:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<{properties}>>>"
    f = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    return f.select(F.col("f.id").alias("feature_id"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), "f.properties.*")


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table given in the code."""
    return spark.createDataFrame(rows, schema)


#: Where tables come from (fixed values).
PROVENANCE = [
    ("fct_stop_event", "REPLAY_SIMULATION", True, "Real Metlink timetable expanded across April 2026 service dates; arrival, departure and dwell simulated; anomalies injected and labelled."),
    ("fct_vehicle_ping", "REPLAY_SIMULATION", True, "Linear interpolation between simulated stop events at 25 s cadence. Not route geometry - swap in shapes.txt for accurate paths."),
    ("fct_anomaly_truth", "REPLAY_SIMULATION", True, "Ground-truth episodes injected by scripts/03. The scoring key."),
    ("dim_route", "GTFS_STATIC", False, "Real Metlink GTFS routes.txt."),
    ("dim_stop", "GTFS_STATIC", False, "Real Metlink GTFS stops.txt."),
    ("dim_service_date", "DERIVED", False, "April 2026 calendar with NZ public holidays and school terms."),
]


# payloads -------------------------------------------------------------------------------------------------------------------

_TRIP = "struct<trip_id:string,tripId:string,route_id:string,routeId:string,direction_id:string,directionId:string,start_date:string,startDate:string>"
_POS = "struct<latitude:string,longitude:string,bearing:string,speed:string>"
_VEHICLE = f"struct<trip:{_TRIP},position:{_POS},vehicle:struct<id:string>,timestamp:string,occupancy_status:string,occupancyStatus:string>"
_TIME = "struct<delay:string,time:string>"
_UPDATE = f"struct<trip:{_TRIP},stop_time_update:array<struct<stop_sequence:string,stopSequence:string,stop_id:string,stopId:string,arrival:{_TIME},departure:{_TIME}>>,stopTimeUpdate:array<struct<stop_sequence:string,stopSequence:string,stop_id:string,stopId:string,arrival:{_TIME},departure:{_TIME}>>,timestamp:string>"
_TEXT = "struct<translation:array<struct<text:string,language:string>>>"
_ENTITY = "struct<route_id:string,routeId:string,stop_id:string,stopId:string,trip:struct<trip_id:string,tripId:string>>"
_PERIOD = "struct<start:string,end:string>"
_ALERT = f"struct<active_period:array<{_PERIOD}>,activePeriod:array<{_PERIOD}>,informed_entity:array<{_ENTITY}>,informedEntity:array<{_ENTITY}>,cause:string,effect:string,header_text:{_TEXT},headerText:{_TEXT}>"


def _entities(polls: DataFrame, kind: str) -> DataFrame:
    schema = f"entity array<struct<id:string,{kind}>>"
    return polls.withColumn("_p", F.from_json("payload", schema)).select("snapshot_ts", F.explode("_p.entity").alias("e"))


def _either(snake: str, camel: str) -> Column:
    return F.coalesce(F.col(snake), F.col(camel))


def _num(x: Column, kind: str = "double") -> Column:
    return x.try_cast(kind)


def vehicle_positions(polls: DataFrame) -> DataFrame:
    """polls: (snapshot_ts, payload). One row for each vehicle entity; keys in either spelling; values that can't be read are null; a vehicle without an id takes its entity's."""
    e = _entities(polls, f"vehicle:{_VEHICLE}").where("e.vehicle is not null")
    v = "e.vehicle."
    return e.select(
        "snapshot_ts", F.coalesce(F.col(f"{v}vehicle.id"), F.col("e.id")).alias("vehicle_id"), _either(f"{v}trip.route_id", f"{v}trip.routeId").alias("route_id"), _either(f"{v}trip.trip_id", f"{v}trip.tripId").alias("trip_id"), _num(_either(f"{v}trip.direction_id", f"{v}trip.directionId"), "int").alias("direction_id"),
        _num(F.col(f"{v}position.latitude")).alias("latitude"), _num(F.col(f"{v}position.longitude")).alias("longitude"), _num(F.col(f"{v}position.bearing")).alias("bearing"), _num(F.col(f"{v}position.speed")).alias("speed"), _either(f"{v}occupancy_status", f"{v}occupancyStatus").alias("occupancy"),
        F.timestamp_seconds(_num(F.col(f"{v}timestamp"), "long")).alias("vehicle_ts"), F.to_json(F.col("e.vehicle")).alias("payload"),
    )


def trip_updates(polls: DataFrame) -> DataFrame:
    """One row for each stop time update; a trip without any gives one row of nulls."""
    e = _entities(polls, f"trip_update:{_UPDATE},tripUpdate:{_UPDATE}").select("snapshot_ts", F.col("e.id").alias("entity_id"), _either("e.trip_update", "e.tripUpdate").alias("t")).where("t is not null")
    e = e.select("snapshot_ts", "entity_id", "t", F.explode_outer(_either("t.stop_time_update", "t.stopTimeUpdate")).alias("u"))
    return e.select("snapshot_ts", "entity_id", _either("t.trip.trip_id", "t.trip.tripId").alias("trip_id"), _either("t.trip.route_id", "t.trip.routeId").alias("route_id"), _num(_either("u.stop_sequence", "u.stopSequence"), "int").alias("stop_sequence"), _either("u.stop_id", "u.stopId").alias("stop_id"), _num(F.col("u.arrival.delay"), "int").alias("arrival_delay"), F.timestamp_seconds(_num(F.col("u.arrival.time"), "long")).alias("arrival_ts"), _num(F.col("u.departure.delay"), "int").alias("departure_delay"))


def service_alerts(polls: DataFrame) -> DataFrame:
    """One row for each period and informed entity of each alert; either may be missing."""
    e = _entities(polls, f"alert:{_ALERT}").where("e.alert is not null").select("snapshot_ts", F.col("e.id").alias("alert_id"), F.col("e.alert").alias("a"))
    e = e.select("snapshot_ts", "alert_id", "a", F.explode_outer(_either("a.active_period", "a.activePeriod")).alias("p"))
    e = e.select("snapshot_ts", "alert_id", "a", "p", F.explode_outer(_either("a.informed_entity", "a.informedEntity")).alias("i"))
    at = lambda x: F.timestamp_seconds(_num(F.col(x), "long"))
    header = F.get(F.coalesce(F.col("a.header_text.translation"), F.col("a.headerText.translation")), F.lit(0))["text"]
    return e.select("snapshot_ts", "alert_id", "a.cause", "a.effect", header.alias("header"), at("p.start").alias("active_from"), at("p.end").alias("active_to"), _either("i.route_id", "i.routeId").alias("route_id"), _either("i.stop_id", "i.stopId").alias("stop_id"), _either("i.trip.trip_id", "i.trip.tripId").alias("trip_id"))


_LEG_A = "struct<number:string,status:string,airline:struct<name:string>,aircraft:struct<model:string,reg:string>,movement:struct<airport:struct<name:string,iata:string>,scheduledTime:struct<utc:string>,revisedTime:struct<utc:string>,runwayTime:struct<utc:string>,terminal:string,gate:string,baggageBelt:string>>"
_END_B = "struct<airport:string,iata:string,scheduled:string,estimated:string,actual:string,terminal:string,gate:string,baggage:string>"
_ROW_B = f"struct<flight:struct<iata:string,number:string>,flight_status:string,airline:struct<name:string>,aircraft:struct<iata:string,registration:string>,departure:{_END_B},arrival:{_END_B}>"

BOARD = ["snapshot_ts", "source", "flight_key", "direction", "flight_no", "airline", "other_airport", "other_airport_iata", "scheduled_utc", "estimated_utc", "actual_utc", "status", "raw_status", "terminal", "gate", "baggage_belt", "aircraft_model", "aircraft_reg", "payload"]


def _board(df: DataFrame, source: str) -> DataFrame:
    clean = F.upper(F.regexp_replace("flight_no", r"\s+", ""))
    return df.withColumns({"flight_no": clean, "source": F.lit(source), "status": status_name("raw_status")}).withColumn("flight_key", flight_key("direction", "flight_no", "scheduled_utc")).select(*BOARD)


def flight_boards(polls: DataFrame) -> DataFrame:
    """polls: (snapshot_ts, payload, vendor a or b). The rows of both vendors' shapes as one 19-column table."""
    a = polls.where("vendor = 'a'").withColumn("_p", F.from_json("payload", f"arrivals array<{_LEG_A}>, departures array<{_LEG_A}>"))
    legs = [a.select("snapshot_ts", F.lit(d).alias("direction"), F.explode(f"_p.{d}s").alias("x")) for d in ("arrival", "departure")]
    m = "x.movement."
    rows_a = legs[0].union(legs[1]).select(
        "snapshot_ts", "direction", F.col("x.number").alias("flight_no"), F.col("x.airline.name").alias("airline"), F.col(f"{m}airport.name").alias("other_airport"), F.col(f"{m}airport.iata").alias("other_airport_iata"),
        tolerant_utc(f"{m}scheduledTime.utc").alias("scheduled_utc"), tolerant_utc(f"{m}revisedTime.utc").alias("estimated_utc"), tolerant_utc(f"{m}runwayTime.utc").alias("actual_utc"), F.col("x.status").alias("raw_status"), F.col(f"{m}terminal").alias("terminal"), F.col(f"{m}gate").alias("gate"),
        F.col(f"{m}baggageBelt").alias("baggage_belt"), F.col("x.aircraft.model").alias("aircraft_model"), F.col("x.aircraft.reg").alias("aircraft_reg"), F.to_json("x").alias("payload"),
    )
    b = polls.where("vendor = 'b'").withColumn("_p", F.from_json("payload", f"direction string, data array<{_ROW_B}>")).select("snapshot_ts", F.col("_p.direction").alias("direction"), F.explode("_p.data").alias("x"))
    arriving = F.col("direction") == "arrival"
    own, other = F.when(arriving, F.col("x.arrival")).otherwise(F.col("x.departure")), F.when(arriving, F.col("x.departure")).otherwise(F.col("x.arrival"))
    b = b.withColumns({"own": own, "other": other})
    rows_b = b.select(
        "snapshot_ts", "direction", F.coalesce("x.flight.iata", "x.flight.number").alias("flight_no"), F.col("x.airline.name").alias("airline"), F.col("other.airport").alias("other_airport"), F.col("other.iata").alias("other_airport_iata"), tolerant_utc("own.scheduled").alias("scheduled_utc"), tolerant_utc("own.estimated").alias("estimated_utc"), tolerant_utc("own.actual").alias("actual_utc"),
        F.col("x.flight_status").alias("raw_status"), F.col("own.terminal").alias("terminal"), F.col("own.gate").alias("gate"), F.col("own.baggage").alias("baggage_belt"), F.col("x.aircraft.iata").alias("aircraft_model"), F.col("x.aircraft.registration").alias("aircraft_reg"), F.to_json("x").alias("payload"),
    )
    return _board(rows_a, "vendor_a").unionByName(_board(rows_b, "vendor_b"))


def corridors(polls: DataFrame) -> DataFrame:
    """polls: (snapshot_ts, corridor, payload). Durations such as "123s" as seconds; the ratio is null if one is missing or 0."""
    p = F.from_json("payload", "routes array<struct<duration:string,staticDuration:string,distanceMeters:string>>")
    r = F.get(p["routes"], F.lit(0))
    secs = lambda x: F.rtrim(x, F.lit("s")).try_cast("int")
    out = polls.select("snapshot_ts", "corridor", secs(r["duration"]).alias("duration_s"), secs(r["staticDuration"]).alias("static_duration_s"), r["distanceMeters"].try_cast("int").alias("distance_m"), "payload")
    return out.withColumn("congestion_ratio", F.when((F.col("duration_s") != 0) & (F.col("static_duration_s") != 0), F.round(F.col("duration_s") / F.col("static_duration_s"), 3)))


def arcgis_rows(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pages: (payload). Attribute rows of feature pages, names whatever their case; adds date, the UTC day of startDate (epoch ms). columns: name -> type."""
    rows = pages.select(F.explode(F.from_json("payload", "features array<struct<attributes:map<string,string>>>")["features"]).alias("f"))
    lower = F.transform_keys("f.attributes", lambda k, _: F.lower(k))
    rows = rows.select(lower.alias("a"))
    return rows.select(*[F.try_element_at("a", F.lit(n.lower())).try_cast(t).alias(n) for n, t in columns.items()]).withColumn("date", F.to_date(F.timestamp_millis("startDate")))


class _Records(list):
    """The records inside a JSON value that is read already."""


def _members(pairs: list[tuple]) -> _Records:
    """An object that the decoder has read, inmost ones first: its own plain members as one record, then those of its other members."""
    last = dict(pairs)
    own = [(k, str(v)) for k, v in last.items() if v is not None and not isinstance(v, list)]
    return _Records([own] * bool(own) + [r for v in last.values() for r in _inside(v)])


def _inside(value) -> list:
    """Records in a member or an array of a JSON document."""
    if isinstance(value, _Records):
        return value
    return [r for v in value for r in _inside(v)] if isinstance(value, list) else []


def json_records(document: str) -> list[list[tuple[str, str]]]:
    """Each object's plain members that are not null, as (name, text), outer objects first; nothing if the document can't be read."""
    try:
        return list(_inside(json.loads(document, object_pairs_hook=_members)))
    except (ValueError, RecursionError):
        return []


def xml_elements(document: str) -> list[tuple[int, int | None, str, str, list[tuple[str, str]]]]:
    """(number, number of its parent, name, text before its first child, attributes) of each element, in the order in which they begin; names without their namespace. Nothing if the document can't be read."""
    rows: list[list] = []
    inside: list[int] = []
    open_text: list[str] | None = None
    bare = lambda name: name.rpartition(":")[2]

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal open_text
        named = [(bare(k), v) for k, v in attributes.items() if not k.startswith("xmlns")]
        open_text = []
        rows.append([len(rows), inside[-1] if inside else None, bare(name), open_text, named])
        inside.append(len(rows) - 1)
        parser.CharacterDataHandler = open_text.append

    def end(name: str) -> None:
        inside.pop()
        parser.CharacterDataHandler = None  # what follows a child is no text of its parent

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = begin, end
    try:
        parser.Parse(document, True)
    except expat.ExpatError:
        return []
    return [(n, up, name, "".join(text).strip(), named) for n, up, name, text, named in rows]


#: Most bytes of a catalogue document, which is read as one value.
MOST_DOCUMENT_BYTES = 64 << 20


def camera_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, attributes: array of (name, value)): the records of catalogue documents, JSON or XML, one document a file, in the order in which they stand.

    A record of XML is an element: its attributes and its children's texts, of which the last of a name counts, and its children's attributes as child_name where
    nothing else has that name. Elements come as rows from the parser, and Spark puts the records together.
    """
    large = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > MOST_DOCUMENT_BYTES).first()
    if large:
        raise ValueError(f"{large.path} has {large.length} bytes; catalogues of more than {MOST_DOCUMENT_BYTES} bytes are to be cut")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r\n")).alias("value"))
    pair = "array<struct<name:string,value:string>>"
    is_json = F.substring("value", 1, 1).isin("[", "{")

    def from_json(frames):
        import pandas as pd

        for f in frames:
            rows = [(file, pos, [{"name": k, "value": v} for k, v in record]) for file, value in zip(f.file, f.value) for pos, record in enumerate(json_records(value))]
            yield pd.DataFrame(rows, columns=["file", "pos", "attributes"])

    def from_xml(frames):
        import pandas as pd

        for f in frames:
            rows = [(file, n, up, name, text, [{"name": k, "value": v} for k, v in named]) for file, value in zip(f.file, f.value) for n, up, name, text, named in xml_elements(value)]
            out = pd.DataFrame(rows, columns=["file", "n", "up", "name", "text", "attributes"])
            yield out.astype({"up": "Int64"})

    e = files.where(~is_json).mapInPandas(from_xml, f"file string, n long, up long, name string, text string, attributes {pair}")
    row = lambda of, name, value, kind, at: (F.col(of).alias("pos"), name.alias("name"), value.alias("value"), F.lit(kind).alias("kind"), F.struct("n", at).alias("at"))
    named = e.select("file", "n", "up", "name", F.posexplode("attributes").alias("i", "a"))
    own = named.select("file", *row("n", F.col("a.name"), F.col("a.value"), "own", F.lit(-1).alias("i")))
    texts = e.where("up is not null and text <> ''").select("file", *row("up", F.col("name"), F.col("text"), "text", F.lit(-1).alias("i")))
    lent = named.where("up is not null").select("file", *row("up", F.concat_ws("_", "name", "a.name"), F.col("a.value"), "lent", F.col("i")))
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("value")), "at")
    members = own.unionByName(texts).unionByName(lent).groupBy("file", "pos", "name").agg(F.min(F.struct((F.col("kind") != "own").alias("o"), "at")).alias("at"), F.coalesce(of("text", F.max_by), of("own", F.min_by), of("lent", F.min_by)).alias("value"))
    records = members.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "name", "value"))).alias("_all"))
    xml = records.select("file", "pos", F.transform("_all", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias("attributes"))
    return files.where(is_json).mapInPandas(from_json, f"file string, pos long, attributes {pair}").unionByName(xml)


def cameras(records: DataFrame, image_url: str = "https://www.trafficnz.info/camera/{}.jpg", view_url: str = "https://www.journeys.nzta.govt.nz/traffic-cameras/wellington/{}") -> DataFrame:
    """records: of camera_records(). Cameras with valid coordinates and ids of digits only; the last record of an id counts; sorted by id."""
    plain = lambda x: F.regexp_replace(F.lower(x["name"]), "[^a-z0-9]", "")
    pick = lambda names: F.get(F.filter("attributes", lambda x: plain(x).isin(names) & (x["value"] != "")), F.lit(0))["value"]
    c = records.select("file", "pos", *[pick(names).alias(k) for k, names in CAMERA_KEYS.items()])
    c = c.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "camera_id": F.trim("camera_id")})
    c = c.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("camera_id").rlike(r"^\d+$"))
    last = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("file"), F.desc("pos")))
    c = c.withColumn("_n", last).where("_n = 1")
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    link = lambda template: F.concat(*[x for i, t in enumerate(template.split("{}")) for x in ([F.col("camera_id")] if i else []) + [F.lit(t)]])
    return c.select(
        "camera_id", F.trim(F.coalesce("camera_name", F.concat(F.lit("Camera "), "camera_id"))).alias("camera_name"), text("region").alias("region"), text("direction").alias("direction"), "lat", "lon",
        F.lower(text("offline")).isin(OFFLINE).alias("offline"), link(image_url).alias("image_url"), link(view_url).alias("view_url"),
    ).orderBy(F.col("camera_id").cast("decimal(38,0)"))


def in_region(cams: DataFrame, text: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Cameras whose region holds the text; if none is labelled so, those in the box."""
    labelled = F.coalesce(F.lower("region").contains(text.lower()), F.lit(False))
    any_ = cams.agg(F.coalesce(F.max(labelled), F.lit(False)).alias("_any"))
    boxed = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return cams.crossJoin(any_).where(F.when(F.col("_any"), labelled).otherwise(boxed)).drop("_any")
