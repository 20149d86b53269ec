"""Queries of landed feeds, sinks, boards, streams and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import boards, detectors, reports
from ..operators.nearest import nearest
from ..operators.quantiles import RANK_ERROR
from ..session import shared_folder
from ..sinks import writers as K
from ..sources import landed as S
from ..streaming import jobs as M
from ..streaming.state import StateStorePolls as State
from . import adapters as A
from .core import cameras, class_hourly, conformed, day, points, r4, site_scores, snap, street_hourly
from .network import hotspot_sql, hotspots, ts
from .oracle import sql, step_sql
from .registry import query

# sources and sinks: derived rows are written by a sink and read by a source


@query("s01_parquet_shards", sql("obs", "SELECT countline_id, sum(count) AS total, count(*) AS n FROM obs WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1"))
def _(s, d):
    path = shared_folder(s, "shards")
    raw = A.observations(s, d).select(*[F.col(b).alias(a) for a, b in zip(["_COL_0", "_COL_1", "_COL_2", "_COL_3", "_COL_4", "_COL_5"], ["countline_id", "date", "hour", "count", "transport_class", "direction"])])
    K.write_table(raw, path)
    return S.load_parquet_shards(s, [path], "2024-01-10", "2024-01-20", check=False).groupBy("countline_id").agg(F.sum("count").alias("total"), F.count("*").alias("n"))


@query("s02_metadata_csv", sql("meta", "SELECT COUNTLINE_ID, NAME, round(LATITUDE_START_LINE, 4) AS lat FROM meta"))
def _(s, d):
    path = shared_folder(s, "meta")
    blank = {c: F.lit(None).cast("string") for c in ("DIRECTION_IN", "DIRECTION_OUT", "EARLIEST", "LATEST")}
    K.write_csv(A.metadata(s, d).withColumns(blank).select("VIEWPOINT_ID", "COUNTLINE_ID", "NAME", "LATITUDE_START_LINE", "LONGITUDE_START_LINE", "LATITUDE_END_LINE", "LONGITUDE_END_LINE", *blank), path)
    return S.load_metadata(s, path).select("COUNTLINE_ID", "NAME", F.round("LATITUDE_START_LINE", 4).alias("lat"))


@query("s03_csv_set_k09", "SELECT 1 AS part, n_nationkey AS id, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 2, s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    a, b = shared_folder(s, "set"), shared_folder(s, "set")
    K.write_csv(A.table(s, d, "nation").select(F.lit(1).alias("part"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), a)
    K.write_csv(A.table(s, d, "supplier").select(F.lit(2).alias("part"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), b)
    return S.load_csv_set(s, a, b).select(F.col("part").cast("int"), F.col("id").cast("long"), "name", F.col("balance").cast("double"))


@query("s04_csv_lineage", "SELECT count(*) AS n, count(*) AS with_file FROM customer")
def _(s, d):
    path = shared_folder(s, "lineage")
    K.write_csv(A.table(s, d, "customer"), path)
    return S.load_csv_set(s, path).agg(F.count("*").alias("n"), F.count_if(F.col("source_file").startswith("part-")).alias("with_file"))


@query("s05_gtfs_text", sql("rt", "SELECT ROUTE_ID AS route_id, ROUTE_SHORT_NAME AS route_short_name, ROUTE_TYPE::VARCHAR AS route_type FROM rt"))
def _(s, d):
    path = shared_folder(s, "gtfs")
    r = A.gtfs_routes(s, d)
    K.write_csv(r, path)
    return S.load_gtfs(s, path, r.columns).select("route_id", "route_short_name", "route_type")


@query("s06_parquet_tables", "SELECT count(*) AS n FROM lineitem")
def _(s, d):
    return A.table(s, d, "lineitem").agg(F.count("*").alias("n"))


@query("s07_archive_k07", "SELECT strftime(ts, '%Y-%m-%d') AS service_date, hour(ts)::INT AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1, 2")
def _(s, d):
    path = shared_folder(s, "archive")
    K.write_archive(A.table(s, d, "events"), path, "ts")
    return S.load_archive(s, path, "2024-01-05", "2024-01-09").groupBy(day("service_date"), "hour").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s08_json_lines_k10", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def _(s, d):
    path = shared_folder(s, "lines")
    K.write_json_lines(A.table(s, d, "events").select("event_type", "user_id"), path)
    return S.load_json_lines(s, path, "event_type string, user_id long").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("s09_geojson_sites_k06", sql("hws", "SELECT siteref AS feature_id, round(lon, 4) AS lon, round(lat, 4) AS lat, state_highway AS sh FROM hws"))
def _(s, d):
    path = shared_folder(s, "sites")
    sites = A.highway_sites(s, d).withColumn("sh", F.col("state_highway"))
    doc = K.collection(K.point_features(sites, "siteref", "lon", "lat", ["sh", "description"]), "site-collection/v1", "2024-01-31")
    doc.select("document").write.text(path)
    return S.load_features(s, path, "sh:string,description:string").select("feature_id", *r4("lon", "lat"), "sh")


@query("s10_json_array", "SELECT user_id::VARCHAR AS callsign, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def _(s, d):
    path = shared_folder(s, "array")
    rows = A.table(s, d, "events").where("event_type = 'view'").groupBy(chunk()).agg(F.collect_list(F.struct(F.col("user_id").cast("string").alias("callsign"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("lastSeen"))).alias("a"))
    rows.select(F.to_json("a")).write.text(path)
    return S.load_json_lines(s, path, "callsign string, lastSeen long").groupBy("callsign").agg(F.count("*").alias("n"))


@query("s11_views", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    S.register_views({"v_supplier": A.table(s, d, "supplier"), "v_nation": A.table(s, d, "nation")})
    return s.sql("SELECT n_name, count(*) AS n FROM v_supplier JOIN v_nation ON s_nationkey = n_nationkey GROUP BY n_name")


@query("s12_constants", sql("fact pg tr rt st", """SELECT * FROM (VALUES ('fct_stop_event', true, (SELECT count(*) FROM fact)), ('fct_vehicle_ping', true, (SELECT count(*) FROM pg)), ('fct_anomaly_truth', true, (SELECT count(*) FROM tr)), ('dim_route', false, (SELECT count(*) FROM rt)), ('dim_stop', false, (SELECT count(*) FROM st)), ('dim_service_date', false, (SELECT count(DISTINCT SERVICE_DATE) FROM fact))) t(name, is_synthetic, n)
  UNION ALL SELECT holiday, NULL, (SELECT count(*) FROM pg WHERE day(SERVICE_DATE) = d) FROM (VALUES ('Good Friday', 3), ('Easter Monday', 6), ('ANZAC Day', 25), ('ANZAC Day (observed)', 27)) h(holiday, d) UNION ALL SELECT 'Wellington Airport (WLG)', NULL, count(*) FROM pg WHERE LATITUDE > -41.3272 AND LONGITUDE < 174.8052"""))
def _(s, d):
    """Constants at work: the tables with their provenance and rows, pings on the days of the month of the holidays, and pings north-west of the airport."""
    tables = {"fct_stop_event": A.fact(s, d), "fct_vehicle_ping": A.pings(s, d), "fct_anomaly_truth": A.truth(s, d), "dim_route": A.routes(s, d), "dim_stop": A.stops(s, d), "dim_service_date": A.fact(s, d).select("SERVICE_DATE").distinct()}
    rows = reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("TABLE_NAME"), "n") for name, t in tables.items()])
    kept = S.constant(s, S.PROVENANCE, "TABLE_NAME string, SOURCE_KIND string, IS_SYNTHETIC boolean, NOTES string").join(rows, "TABLE_NAME").select(F.col("TABLE_NAME").alias("name"), F.col("IS_SYNTHETIC").alias("is_synthetic"), "n")
    days = S.constant(s, S.PUBLIC_HOLIDAYS, "a string, name string").select("name", F.dayofmonth(F.to_date("a")).alias("d"))
    on_days = days.join(A.pings(s, d).groupBy(F.dayofmonth("SERVICE_DATE").alias("d")).agg(F.count("*").alias("n")), "d", "left").select("name", F.lit(None).cast("boolean").alias("is_synthetic"), F.coalesce("n", F.lit(0)).alias("n"))
    name, lat, lon = S.AIRPORT
    near = A.pings(s, d).where((F.col("LATITUDE") > lat) & (F.col("LONGITUDE") < lon)).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(None).cast("boolean").alias("is_synthetic"), "n")
    return kept.unionByName(on_days).unionByName(near)


def chunk():
    """1,000 events: a payload is of bounded size, whatever the size of the table."""
    return F.floor(F.col("event_id") / 1000).alias("chunk")


def polls(s, d, *cols):
    """Polls of at most 1,000 entities as JSON."""
    return polled(A.table(s, d, "events"), F.struct(F.collect_list(F.struct(*cols)).alias("entity")))


def polled(events, payload, **more):
    return events.groupBy(chunk()).agg(F.to_timestamp(F.min(F.to_date("ts"))).alias("snapshot_ts"), F.to_json(payload).alias("payload"), *[v.alias(k) for k, v in more.items()]).drop("chunk")


SECS = 1704067200


@query("s13_vehicle_positions", "SELECT event_id::VARCHAR AS id, 'V' || user_id AS vehicle_id, user_id::VARCHAR AS route_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS latitude, strftime(to_timestamp(1704067200 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS vehicle_ts FROM events")
def _(s, d):
    trip = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").cast("string").alias("route_id"), F.lit(None).cast("string").alias("routeId"))).otherwise(F.struct(F.lit(None).cast("string").alias("route_id"), F.col("user_id").cast("string").alias("routeId")))
    lat = F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("value").cast("string"))
    v = F.struct(trip.alias("trip"), F.struct(lat.alias("latitude")).alias("position"), F.struct(F.concat(F.lit("V"), "user_id").alias("id")).alias("vehicle"), (F.col("event_id") + SECS).alias("timestamp"))
    out = S.vehicle_positions(polls(s, d, F.col("event_id").cast("string").alias("id"), v.alias("vehicle")))
    return out.select((F.unix_timestamp("vehicle_ts") - 1704067200).cast("string").alias("id"), "vehicle_id", "route_id", "latitude", ts("vehicle_ts"))


@query("s14_trip_updates", "SELECT event_id::VARCHAR AS entity_id, user_id::VARCHAR AS trip_id, CASE WHEN event_id % 4 <> 0 THEN k END AS stop_sequence, CASE WHEN event_id % 4 <> 0 THEN (event_id % 100)::INT END AS arrival_delay FROM events, (VALUES (1), (2)) t(k) WHERE event_id % 4 <> 0 OR k = 1")
def _(s, d):
    one = lambda k: F.struct(F.lit(k).alias("stopSequence"), F.struct((F.col("event_id") % 100).alias("delay")).alias("arrival"))
    t = F.struct(F.struct(F.col("user_id").cast("string").alias("tripId")).alias("trip"), F.when(F.col("event_id") % 4 != 0, F.array(one(1), one(2))).alias("stopTimeUpdate"))
    return S.trip_updates(polls(s, d, F.col("event_id").cast("string").alias("id"), t.alias("tripUpdate"))).select("entity_id", "trip_id", "stop_sequence", "arrival_delay")


@query("s15_service_alerts", "SELECT event_id::VARCHAR AS alert_id, event_type AS effect, 'about ' || user_id AS header, user_id::VARCHAR AS route_id, k AS n FROM events, (VALUES (1), (2)) t(k)")
def _(s, d):
    period = lambda k: F.struct(F.lit(SECS + k).alias("start"), F.lit(SECS + k + 60).alias("end"))
    a = F.struct(F.array(period(1), period(2)).alias("activePeriod"), F.array(F.struct(F.col("user_id").cast("string").alias("routeId"))).alias("informedEntity"), F.col("event_type").alias("effect"), F.struct(F.array(F.struct(F.concat(F.lit("about "), "user_id").alias("text"))).alias("translation")).alias("headerText"))
    out = S.service_alerts(polls(s, d, F.col("event_id").cast("string").alias("id"), a.alias("alert")))
    return out.select("alert_id", "effect", "header", "route_id", (F.unix_timestamp("active_from") - 1704067200).cast("int").alias("n"))


@query("s16_flight_boards", """SELECT CASE WHEN event_id % 2 = 0 THEN 'vendor_a' ELSE 'vendor_b' END AS source, CASE WHEN event_id % 2 = 0 THEN 'arrival' ELSE 'departure' END AS direction, 'NZ' || user_id AS flight_no, CASE event_type WHEN 'view' THEN 'Expected' WHEN 'click' THEN 'Boarding' WHEN 'purchase' THEN 'Arrived' WHEN 'error' THEN 'Cancelled' ELSE 'Diverted' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'arrival' ELSE 'departure' END || '|NZ' || user_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M') AS flight_key FROM events""")
def _(s, d):
    raw = F.col("event_type")
    for k, v in {"view": "Expected", "click": "Boarding", "purchase": "landed", "error": "Canceled", "signup": "diverted"}.items():
        raw = F.when(F.col("event_type") == k, v).otherwise(raw)
    e = A.table(s, d, "events").withColumns({"raw": raw, "at": F.date_format("ts", "yyyy-MM-dd HH:mm'Z'"), "fno": F.concat(F.lit("NZ "), "user_id"), "day": F.to_timestamp(F.to_date("ts"))})
    leg = F.struct(F.col("fno").alias("number"), F.col("raw").alias("status"), F.struct(F.struct(F.col("at").alias("utc")).alias("scheduledTime")).alias("movement"))
    a = polled(e.where("event_id % 2 = 0"), F.struct(F.collect_list(leg).alias("arrivals")), vendor=F.lit("a"))
    row = F.struct(F.struct(F.col("fno").alias("iata")).alias("flight"), F.col("raw").alias("flight_status"), F.struct(F.col("at").alias("scheduled")).alias("departure"))
    b = polled(e.where("event_id % 2 = 1"), F.struct(F.lit("departure").alias("direction"), F.collect_list(row).alias("data")), vendor=F.lit("b"))
    return S.flight_boards(a.unionByName(b)).select("source", "direction", "flight_no", "status", "flight_key")


@query("s17_vehicle_fallback_id", "SELECT event_id::VARCHAR AS vehicle_id, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    v = F.struct(F.struct(F.col("value").alias("latitude")).alias("position"))
    return S.vehicle_positions(polls(s, d, F.col("event_id").cast("string").alias("id"), v.alias("vehicle"))).groupBy("vehicle_id").agg(F.count("*").alias("n"))


def corridor_polls(s, d):
    r = F.struct(F.concat(F.col("event_id") % 300, F.lit("s")).alias("duration"), F.concat(F.col("event_id") % 50, F.lit("s")).alias("staticDuration"), F.lit("1000").alias("distanceMeters"))
    return A.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("snapshot_ts"), F.concat(F.lit("C"), F.col("user_id") % 20).alias("corridor"), F.to_json(F.struct(F.array(r).alias("routes"))).alias("payload"))


CORRIDOR = "SELECT 'C' || (user_id % 20) AS corridor, ts, (event_id % 300)::INT AS duration_s, (event_id % 50)::INT AS static_duration_s, CASE WHEN event_id % 300 <> 0 AND event_id % 50 <> 0 THEN round((event_id % 300) / (event_id % 50), 3) END AS congestion_ratio FROM events"


@query("s18_corridors", f"SELECT corridor, duration_s, static_duration_s, congestion_ratio FROM ({CORRIDOR})")
def _(s, d):
    return S.corridors(corridor_polls(s, d)).select("corridor", "duration_s", "static_duration_s", "congestion_ratio")


@query("d58_corridor_latest", f"SELECT corridor, duration_s, congestion_ratio FROM ({CORRIDOR}) QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY ts DESC, duration_s) = 1")
def _(s, d):
    return boards.corridor_latest(S.corridors(corridor_polls(s, d))).select("corridor", "duration_s", "congestion_ratio")


@query("s19_arcgis_rows", "SELECT event_id AS OBJECTID, event_type AS SiteRef, strftime(date_trunc('second', ts), '%Y-%m-%d') AS date FROM events")
def _(s, d):
    e = A.table(s, d, "events")
    f = F.struct(F.struct(F.col("event_id").cast("string").alias("objectid"), F.col("event_type").alias("SITEREF"), (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("StartDate")).alias("attributes"))
    pages = e.groupBy(F.floor(F.col("event_id") / 1000)).agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("payload"))
    return S.arcgis_rows(pages, {"OBJECTID": "bigint", "SiteRef": "string", "startDate": "bigint"}).select("OBJECTID", "SiteRef", day())


@query("s20_camera_catalogue", "SELECT s_suppkey::VARCHAR AS camera_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Camera ' || s_suppkey ELSE s_name END AS camera_name, s_nationkey::DOUBLE AS lat, CASE WHEN s_suppkey % 2 = 0 THEN 'North' ELSE '' END AS region, s_suppkey % 3 = 0 AS offline, 'https://www.trafficnz.info/camera/' || s_suppkey || '.jpg' AS image_url FROM supplier WHERE s_suppkey % 7 <> 0")
def _(s, d):
    """Catalogues of at most 1,000 cameras: even ones as nested JSON, odd ones as XML with a namespace; each lists its cameras twice, the last time rightly."""
    k = F.col("s_suppkey")
    sup = A.table(s, d, "supplier").withColumns({"chunk": F.floor(k / 1000), "ident": F.when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")), "title": F.when(k % 5 != 0, F.col("s_name")), "off": F.when(k % 3 == 0, "Yes").otherwise("no")})
    old = F.struct(F.col("ident").alias("id"), F.lit("old").alias("name"), F.lit("1").alias("lat"), F.lit("1").alias("lon"))
    new = F.struct(F.col("ident").alias("Camera-ID"), F.col("title").alias("Site Name"), F.col("s_nationkey").alias("Y"), F.lit(170.5).alias("LNG"), F.lit("North").alias("Region_Name"), F.col("off").alias("isOffline"), F.struct(F.lit(0).alias("frames")).alias("nested"))
    json_docs = sup.where(k % 2 == 0).groupBy("chunk").agg(F.to_json(F.struct(F.struct(F.collect_list(old).alias("before"), F.struct(F.collect_list(new).alias("cameras")).alias("now")).alias("response"))).alias("doc"))
    tag = F.concat(F.lit('<c:camera id="'), "ident", F.lit('"><c:latitude>'), "s_nationkey", F.lit("</c:latitude><c:x>170.5</c:x>"), F.coalesce(F.concat(F.lit("<c:description> "), "title", F.lit(" </c:description>")), F.lit("")), F.lit("<c:offline>"), "off", F.lit("</c:offline></c:camera>"))
    xml_docs = sup.where(k % 2 == 1).groupBy("chunk").agg(F.concat(F.lit('<c:list xmlns:c="urn:cameras">'), F.array_join(F.collect_list(tag), ""), F.lit("</c:list>")).alias("doc"))
    path = shared_folder(s, "cameras")
    docs = json_docs.unionByName(xml_docs).select(F.monotonically_increasing_id().alias("n"), "doc")
    docs.write.partitionBy("n").text(path)
    return S.cameras(S.camera_records(s, f"{path}/*/")).select("camera_id", "camera_name", "lat", "region", "offline", "image_url")


@query("p15_region_filter", "SELECT s_suppkey AS camera_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name LIKE '%1%'")
def _(s, d):
    n = A.table(s, d, "supplier").join(A.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return S.in_region(n.select(F.col("s_suppkey").alias("camera_id"), F.col("n_name").alias("region"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), "1", 0, 0, 1, 1).select("camera_id")


@query("k01_signal_features", sql("scored meta", "SELECT 'movement:' || s.countline_id || ':' || transport_class || ':ALL:2024-01-29T12:00:00' AS id, status, NAME AS name, round(robust_z, 4) AS robust_z, CASE WHEN data_quality <> 'complete' THEN 'low' WHEN history_samples >= 12 THEN 'high' ELSE 'medium' END AS level, history_samples, 'matched weekday and hour' AS basis, 'Fixed sensors do not represent every city journey.' AS first_limitation, 5 AS limitations, round(LONGITUDE_START_LINE, 4) AS lon FROM scored s JOIN meta ON meta.COUNTLINE_ID = s.countline_id"))
def _(s, d):
    f = K.signal_features(snap(s, d).scored, A.metadata(s, d), "2024-01-31")
    p = F.from_json("feature", "geometry struct<coordinates:array<array<double>>>, properties struct<status:string,name:string,robust_z:double,signal_confidence:struct<level:string,history_samples:long,basis:string>,limitations:array<string>>")
    x = f.select("id", p.alias("p")).select("id", "p.properties.*", F.round(F.col("p.geometry.coordinates")[0][0], 4).alias("lon"))
    return x.select("id", "status", "name", F.round("robust_z", 4).alias("robust_z"), "signal_confidence.*", F.col("limitations")[0].alias("first_limitation"), F.size("limitations").alias("limitations"), "lon")


@query("k02_coverage", sql("meta", "SELECT 'countline:' || COUNTLINE_ID AS id, NAME AS name, round(LONGITUDE_END_LINE, 4) AS lon, round(LATITUDE_END_LINE, 4) AS lat FROM meta"))
def _(s, d):
    f = K.coverage_features(A.metadata(s, d))
    p = F.from_json("feature", "geometry struct<coordinates:array<array<double>>>, properties struct<name:string>")
    return f.select("id", p.alias("p")).select("id", "p.properties.name", F.round(F.col("p.geometry.coordinates")[1][0], 4).alias("lon"), F.round(F.col("p.geometry.coordinates")[1][1], 4).alias("lat"))


@query("k03_health_document", sql("scored gaps", "SELECT '2024-01-29T12:00:00' AS target_at, 'batch replay' AS publisher_mode, (SELECT count(*) FROM scored) AS observed_groups, (SELECT count(*) FROM gaps) AS data_gap_groups, '2024-01-31' AS data_as_of, 'at least monthly' AS publisher_cadence, 'Wellington City Council Transport Sensors' AS source, '12-week matched-weekday/hour median and MAD' AS method, 'Publisher data is batch refreshed, not a live emergency feed.' AS last_limitation"))
def _(s, d):
    doc = K.health_document(snap(s, d).health, "2024-01-31")
    h = doc.select(F.from_json("document", "target_at string, publisher_mode string, observed_groups long, data_gap_groups long, data_as_of string, publisher_cadence string, source string, method string, limitations array<string>").alias("h")).select("h.*")
    return h.withColumn("last_limitation", F.element_at("limitations", -1)).drop("limitations")


@query("k05_camera_layer", sql("meta", "SELECT s_suppkey::VARCHAR AS id, s_name AS camera_name, round(lon, 4) AS lon, lat BETWEEN south AND north AND lon BETWEEN west AND east AS within_countline_frame FROM (SELECT *, -41.3 + (s_suppkey % 100) * 0.001::DOUBLE AS lat, 174.75 + (s_suppkey % 90) * 0.001::DOUBLE AS lon FROM supplier), (SELECT min(LATITUDE_START_LINE) AS south, max(LATITUDE_END_LINE) AS north, min(LONGITUDE_START_LINE) AS west, max(LONGITUDE_END_LINE) AS east FROM meta)"))
def _(s, d):
    cams = detectors.camera_layer(cameras(s, d), A.metadata(s, d))
    f = K.point_features(cams, "camera_id", "lon", "lat", ["camera_name", "within_countline_frame"])
    p = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<camera_name:string,within_countline_frame:boolean>")
    return f.select("id", p.alias("f")).select("id", "f.properties.camera_name", F.round(F.col("f.geometry.coordinates")[0], 4).alias("lon"), "f.properties.within_countline_frame")


@query("k04_hotspot_features", hotspot_sql("SELECT STOP_ID AS id, row_number() OVER (ORDER BY anomalies DESC, STOP_ID)::INT AS rank, 'transit-stop:' || STOP_ID AS feature_id, anomalies AS anomaly_count, medium AS medium_count, low AS low_count, modes, tier AS severity_tier, worst_detail, worst_hour, round(STOP_LON, 6) AS lon, 5 AS limitations FROM hs"))
def _(s, d):
    p = F.from_json("feature", "id string, geometry struct<coordinates:array<double>>, properties struct<anomaly_count:long,medium_count:long,low_count:long,modes:array<string>,severity_tier:string,worst_example:struct<hour:int,detail:string>,limitations:array<string>>")
    f = K.hotspot_features(hotspots(s, d)).select("id", "rank", p.alias("f")).select("id", "rank", F.col("f.id").alias("feature_id"), "f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"))
    return f.withColumns({"modes": F.array_join("modes", ","), "worst_detail": F.col("worst_example.detail"), "worst_hour": F.col("worst_example.hour"), "limitations": F.size("limitations")}).drop("worst_example")


@query("k04_hotspot_collection", hotspot_sql("SELECT count(*) AS features, (SELECT count(*) FROM st) AS stop_count, first(STOP_ID ORDER BY anomalies DESC, STOP_ID) AS first_stop FROM hs"))
def _(s, d):
    stops = A.stops(s, d, A.fact(s, d)).count()
    doc = K.collection(K.hotspot_features(hotspots(s, d)), "transit-anomaly-collection/v1", "2024-01-31", "rank", stop_count=F.lit(stops), hotspot_count=F.count("*"))
    c = doc.select(F.from_json("document", "stop_count long, hotspot_count long, features array<struct<id:string>>").alias("c"))
    return c.select(F.col("c.hotspot_count").alias("features"), "c.stop_count", F.regexp_replace(F.get("c.features", F.lit(0))["id"], "transit-stop:", "").alias("first_stop"))


@query("k11_flat_rows", "SELECT s_suppkey::VARCHAR AS id, 'Point' AS geometry_type, round(174.75 + (s_suppkey % 90) * 0.001::DOUBLE, 4) AS lon, s_name AS who_name, s_nationkey AS who_nation, 'a | b' AS tags FROM supplier")
def _(s, d):
    c = A.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (174.75 + F.col("s_suppkey") % 90 * 0.001).alias("lon"), F.lit(-41.3).alias("lat"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("who"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return K.flat_rows(K.point_features(c, "id", "lon", "lat", ["who", "tags"]), "who struct<name:string,nation:int>, tags array<string>").select("id", "geometry_type", *r4("lon"), "who_name", "who_nation", "tags")


@query("k08_parquet_export", sql("dscored", "SELECT severity, count(*) AS n FROM dscored GROUP BY 1"))
def _(s, d):
    path = shared_folder(s, "export")
    K.write_table(site_scores(s, d), path)
    return s.read.parquet(path).groupBy("severity").agg(F.count("*").alias("n"))


# streams ---------------------------------------------------------------------------------------------------------------------

FILLED = ("actual_utc", "estimated_utc")
DEDUP = "SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY flight_key ORDER BY actual_utc DESC NULLS LAST, estimated_utc DESC NULLS LAST, snapshot_ts DESC, event_id) = 1"


def board(s, d):
    x = A.statuses(s, d)
    return x.withColumn("status", C.status_name("raw_status"))


def stream_of(s, d, build):
    """The rows of a batch query landed as files, as a stream of them."""
    path = shared_folder(s, "landing")
    build.write.parquet(path)
    return M.landed(s, path, s.read.parquet(path).schema)


def board_polls(s, d):
    """One poll of the flight board."""
    store = State(shared_folder(s, "polls"), "flight_key", FILLED, ties=("event_id",))
    M.run(store.start(stream_of(s, d, board(s, d))))
    return store


@query("m01_snapshots", sql("fs", f"SELECT flight_key, event_id, status FROM ({DEDUP})"))
def _(s, d):
    store = board_polls(s, d)
    return store.snapshots(s).select("flight_key", "event_id", "status")


@query("m02_latest_state", sql("fs", f"SELECT flight_key, status, gate, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS last_seen_ts FROM ({DEDUP})"))
def _(s, d):
    return board_polls(s, d).latest(s).select("flight_key", "status", "gate", ts("last_seen_ts"))


@query("m03_change_log", sql("fs", """SELECT event_id, flight_key, previous_status, status FROM (SELECT *, lag(status) OVER w AS previous_status, row_number() OVER w AS n, lag(estimated_utc) OVER w AS e, lag(actual_utc) OVER w AS a, lag(gate) OVER w AS g FROM fs WINDOW w AS (PARTITION BY flight_key ORDER BY snapshot_ts, event_id))
  WHERE n = 1 OR status IS DISTINCT FROM previous_status OR estimated_utc IS DISTINCT FROM e OR actual_utc IS DISTINCT FROM a OR gate IS DISTINCT FROM g"""))
def _(s, d):
    return M.change_log(board(s, d), "flight_key", ["snapshot_ts", "event_id"]).select("event_id", "flight_key", "previous_status", "status")


@query("m04_most_complete", sql("fs", f"SELECT flight_key, event_id, status FROM ({DEDUP})"))
def _(s, d):
    return M.most_complete(board(s, d), "flight_key", list(FILLED), "snapshot_ts", "event_id").select("flight_key", "event_id", "status")


@query("m05_ingest_log", "SELECT count(*) AS rows_fetched, count(DISTINCT user_id) AS rows_changed, true AS ok FROM events")
def _(s, d):
    return board_polls(s, d).ingest_log(s).select("rows_fetched", "rows_changed", "ok")


@query("m06_stream_hourly", "SELECT event_type, strftime(t, '%Y-%m-%d') AS event_date, hour(t)::INT AS event_hour, count(*) AS n FROM (SELECT event_type, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland' AS t FROM events) GROUP BY 1, 2, 3")
def _(s, d):
    root = shared_folder(s, "hourly")
    M.run(M.updated_table(M.hourly_counts(stream_of(s, d, A.table(s, d, "events")), "ts", "Pacific/Auckland", "event_type"), root, "bin_start", "event_type"))
    return M.read_updated(s, root, "bin_start", "event_type").drop("bin_start").withColumn("event_date", day("event_date"))


CELLS = "printf('%.2f', round(-41.3 + (event_id * 37 % 30) / 1000.0::DOUBLE + 0.0003, 2)) || '_' || printf('%.2f', round(174.7 + (event_id * 53 % 30) / 1000.0::DOUBLE + 0.0003, 2))"


@query("m07_stream_cells", f"SELECT {CELLS} AS cell_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bin_start, count(*) AS n, round(median(value), 4) AS median_value, round(quantile_cont(value, 0.9), 4) AS p90_value FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    i = F.col("event_id")
    e = A.table(s, d, "events").select("ts", "value", (-41.3 + i * 37 % 30 / 1000.0 + 0.0003).alias("lat"), (174.7 + i * 53 % 30 / 1000.0 + 0.0003).alias("lon"))
    root = shared_folder(s, "cells")
    M.run(M.updated_table(M.cell_bins(stream_of(s, d, e), "ts", "lat", "lon", "value", 2, exact=True), root, "bin_start", "cell_id"))
    return M.read_updated(s, root, "bin_start", "cell_id").select("cell_id", ts("bin_start"), "n", *r4("median_value", "p90_value"))


@query("m07_sketched_cells", f"SELECT {CELLS} AS cell_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, true AS median_is_near, true AS p90_is_near FROM events GROUP BY 1, 2")
def _(s, d):
    """Quarter-hour sketches of a stream, merged into days without a second reading; the ranks of their quantiles among all values of the day are within the stated error, and half a value."""
    i = F.col("event_id")
    e = A.table(s, d, "events").select("ts", "value", (-41.3 + i * 37 % 30 / 1000.0 + 0.0003).alias("lat"), (174.7 + i * 53 % 30 / 1000.0 + 0.0003).alias("lon"))
    root = shared_folder(s, "sketches")
    M.run(M.updated_table(M.cell_bins(stream_of(s, d, e), "ts", "lat", "lon", "value", 1), root, "bin_start", "cell_id"))
    bins = M.read_updated(s, root, "bin_start", "cell_id").withColumn("day", day("bin_start"))
    days = M.cell_quantiles(bins, "cell_id", "day", median=0.5, p90=0.9)
    all_ = e.select(C.cell_id("lat", "lon", 2).alias("cell_id"), day("ts").alias("day"), "value").join(days, ["cell_id", "day"])
    rank = lambda q, p: (F.count_if(F.col("value") < F.col(q)) <= (p + RANK_ERROR) * F.count("*") + 0.5) & (F.count_if(F.col("value") <= F.col(q)) >= (p - RANK_ERROR) * F.count("*") - 0.5)
    return all_.groupBy("cell_id", "day").agg(F.first("n").alias("n"), rank("median", 0.5).alias("median_is_near"), rank("p90", 0.9).alias("p90_is_near"))


@query("m08_stream_archive", "SELECT strftime(t, '%Y-%m-%d') AS service_date, hour(t)::INT AS hour, count(*) AS n FROM (SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland' AS t FROM events) GROUP BY 1, 2")
def _(s, d):
    path, progress = shared_folder(s, "stream-archive"), shared_folder(s, "progress")
    e = A.table(s, d, "events").repartition(F.to_date("ts"))
    M.run(M.archive(stream_of(s, d, e), path, progress, "ts", "Pacific/Auckland"))
    return S.load_archive(s, path).groupBy(day("service_date"), "hour").agg(F.count("*").alias("n"))


def frames(s, d):
    return A.table(s, d, "events").select("event_id", "ts", F.to_date("ts").alias("run"), F.col("user_id").alias("camera"), F.md5(F.col("props").cast("binary")).alias("content"))


@query("m09_frame_status", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, ts::DATE, md5(props) ORDER BY ts, event_id) = 1 THEN 'OK' ELSE 'UNCHANGED' END AS status FROM events")
def _(s, d):
    return boards.frame_status(frames(s, d), "camera", "run", "content", ["ts", "event_id"]).select("event_id", "status")


@query("m10_active_vehicles", sql("fs", f"SELECT gate AS route, count(*) AS vehicles FROM ({DEDUP}) WHERE snapshot_ts >= TIMESTAMP '2024-01-10' GROUP BY 1"))
def _(s, d):
    state = M.merged(M.most_complete(board(s, d), "flight_key", list(FILLED), "snapshot_ts", "event_id").withColumns({"first_seen_ts": F.col("snapshot_ts"), "last_seen_ts": F.col("snapshot_ts")}).where("false"), M.most_complete(board(s, d), "flight_key", list(FILLED), "snapshot_ts", "event_id"), "flight_key")
    return M.active_vehicles(state.withColumn("route", F.col("gate")), "route", F.lit("2024-01-10").cast("timestamp"))


# boards ----------------------------------------------------------------------------------------------------------------------

BEST = "coalesce(actual_utc, estimated_utc, scheduled_utc)"


@query("d56_flight_board", sql("fs", f"SELECT event_id, date_diff('minute', scheduled_utc, {BEST}) AS delay_minutes, strftime(({BEST} AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland', '%Y-%m-%d %H:%M:%S') AS best_local FROM fs"))
def _(s, d):
    return boards.flight_board(board(s, d)).select("event_id", "delay_minutes", ts("best_local"))


@query("d57_disruption", sql("fs", f"SELECT strftime(scheduled_utc, '%Y-%m-%d') AS flight_date, direction, count(*) AS flights, count(*) FILTER (WHERE status = 'Cancelled') AS cancelled, count(*) FILTER (WHERE status = 'Diverted') AS diverted, count(*) FILTER (WHERE status = 'Arrived') AS arrived, count(*) FILTER (WHERE date_diff('minute', scheduled_utc, {BEST}) > 15) AS delayed_15m, round(avg(date_diff('minute', scheduled_utc, {BEST})), 1) AS avg_delay_minutes FROM fs GROUP BY fs.scheduled_utc, direction"))
def _(s, d):
    return boards.daily_disruption(board(s, d)).withColumn("flight_date", day("flight_date"))


@query("d60_shared_frames_a22", "SELECT event_id, k AS cameras_with_content, k >= 3 AS is_unavailable FROM (SELECT event_id, ts::DATE AS r, md5(props) AS c FROM events) JOIN (SELECT ts::DATE AS r, md5(props) AS c, count(DISTINCT user_id) AS k FROM events GROUP BY 1, 2) USING (r, c)")
def _(s, d):
    return boards.shared_frames(frames(s, d), "run", "camera", "content").select("event_id", "cameras_with_content", "is_unavailable")


@query("d60_run_history", "SELECT strftime(r, '%Y-%m-%d') AS run, count(*) AS frames, count(DISTINCT user_id) AS cameras, count(*) FILTER (WHERE n > 1) AS unchanged FROM (SELECT ts::DATE AS r, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE, md5(props) ORDER BY ts, event_id) AS n FROM events) GROUP BY 1")
def _(s, d):
    f = boards.frame_status(frames(s, d), "camera", "run", "content", ["ts", "event_id"])
    return boards.run_history(f, "run", "camera").withColumn("run", day("run"))


@query("d60_latest_frame", "SELECT user_id AS camera, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def _(s, d):
    return boards.latest(frames(s, d), ["camera"], "ts", "event_id").select("camera", "event_id")


# reports ---------------------------------------------------------------------------------------------------------------------


@query("q01_anomalies_above", sql("street_z", "SELECT street, strftime(date, '%Y-%m-%d') AS date, hour, z FROM street_z WHERE abs(z) >= 2 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"))
def _(s, d):
    return reports.anomalies_above(street_hourly(s, d), "street", 2.0, "2024-01-05", "2024-01-25").select("street", day(), "hour", "z")


@query("q02_street_map", sql("street_z", "SELECT street, count(*) FILTER (WHERE abs(z) >= 2) AS anomaly_hours, max(abs(z)) AS peak_z, max(total_count) AS peak_total FROM street_z GROUP BY 1"))
def _(s, d):
    return reports.street_map(street_hourly(s, d), 2.0)


@query("q03_class_series", sql("class_z", "SELECT strftime(date, '%Y-%m-%d') AS date, hour, total_count, round(m, 4) AS baseline_mean FROM class_z WHERE transport_class = 'Pedestrian'"))
def _(s, d):
    return reports.class_series(class_hourly(s, d), "Pedestrian").select(day(), "hour", "total_count", *r4("baseline_mean"))


@query("q04_detector_severity", sql("found", "SELECT DETECTOR_NAME, SEVERITY, count(*) AS n, round(avg(abs(SCORE)), 4) AS mean_score FROM found WHERE MODE = 'BUS' AND SEVERITY IN ('HIGH', 'MEDIUM') GROUP BY 1, 2"))
def _(s, d):
    x = reports.filtered(A.detections(s, d), MODE=["BUS"], SEVERITY=["HIGH", "MEDIUM"])
    return x.groupBy("DETECTOR_NAME", "SEVERITY").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("SCORE")), 4).alias("mean_score"))


@query("q04_top_events", sql("found", "SELECT ANOMALY_ID, round(SCORE, 4) AS SCORE FROM (SELECT * FROM found ORDER BY abs(SCORE) DESC, ANOMALY_ID LIMIT 50)"))
def _(s, d):
    return A.detections(s, d).orderBy(F.abs("SCORE").desc(), "ANOMALY_ID").limit(50).select("ANOMALY_ID", *r4("SCORE"))


HOURS = ", ".join(f"coalesce(sum(n) FILTER (WHERE h = {h}), 0)::BIGINT AS h{h}" for h in range(24))


@query("q05_heatmap_a21_j05", f"WITH c AS (SELECT user_id, hour(ts)::INT AS h, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 15) SELECT user_id, {HOURS} FROM c WHERE user_id IN (SELECT user_id FROM t) GROUP BY 1")
def _(s, d):
    e = A.table(s, d, "events").select("user_id", F.hour("ts").alias("h"))
    return reports.heatmap(e, "user_id", "h", 15)


HIGHWAY = "severity IN ('HIGH', 'MEDIUM', 'LOW') AND change IN ('DROP', 'SURGE') AND count_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'"


def highways(s, d):
    return reports.highway_filter(site_scores(s, d), ("1993-01-01", "1997-12-31"), ["HIGH", "MEDIUM", "LOW"], ["DROP", "SURGE"])


@query("q06_highway_metrics", sql("dscored", f"SELECT count(*) AS site_days, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(DISTINCT SiteRef) AS sites, min(ratio) AS low_ratio FROM dscored WHERE {HIGHWAY}"))
def _(s, d):
    return reports.highway_metrics(highways(s, d))


@query("q06_highway_top", sql("dscored", f"SELECT SiteRef, strftime(count_date, '%Y-%m-%d') AS count_date, total_count, round(baseline_median) AS baseline, ratio, robust_z, severity, no_location FROM dscored WHERE {HIGHWAY} QUALIFY row_number() OVER (ORDER BY abs(coalesce(robust_z, 0)) DESC, SiteRef, dscored.count_date) <= 400"))
def _(s, d):
    return reports.highway_top(highways(s, d), 400).select("SiteRef", day("count_date"), "total_count", "baseline", "ratio", "robust_z", "severity", "no_location")


@query("q06_highway_points", sql("dscored", f"SELECT SiteRef, min(site_name) AS site_name, min(state_highway) AS state_highway, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*) AS anomaly_days, count(*) FILTER (WHERE severity = 'HIGH') AS high_days, min(ratio) AS lowest_ratio FROM dscored WHERE {HIGHWAY} AND lat IS NOT NULL GROUP BY 1"))
def _(s, d):
    return reports.highway_points(highways(s, d)).withColumns({"lat": F.round("lat", 4), "lon": F.round("lon", 4)})


@query("q06_highway_no_location", sql("dscored", f"SELECT SiteRef, strftime(count_date, '%Y-%m-%d') AS count_date, total_count, ratio, severity FROM dscored WHERE {HIGHWAY} AND no_location"))
def _(s, d):
    return reports.highway_no_location(highways(s, d)).select("SiteRef", day("count_date"), "total_count", "ratio", "severity")


@query("q06_highway_heatmap", sql("dscored", f"SELECT SiteRef, strftime(count_date, '%Y-%m-%d') AS count_date, ratio FROM dscored WHERE ratio IS NOT NULL AND SiteRef IN (SELECT SiteRef FROM dscored WHERE {HIGHWAY} GROUP BY 1 ORDER BY count(*) DESC, SiteRef LIMIT 2)"))
def _(s, d):
    return reports.highway_heatmap(site_scores(s, d), highways(s, d), 2).select("SiteRef", day("count_date"), "ratio")


@query("q07_site_day_ratios", sql("dscored", "SELECT SiteRef, isodow(count_date)::INT AS dow, min(ratio) AS lowest FROM dscored GROUP BY 1, 2"))
def _(s, d):
    return site_scores(s, d).groupBy("SiteRef", C.iso_dow("count_date").alias("dow")).agg(F.min("ratio").alias("lowest"))


@query("q08_corroborated", sql("cf", "SELECT cell_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_hour, sources_hit FROM cf WHERE sources_hit >= 1 AND event_hour BETWEEN 6 AND 20"))
def _(s, d):
    return conformed(s, d).where("sources_hit >= 1 and event_hour between 6 and 20").select("cell_id", day("event_date"), "event_hour", "sources_hit")


@query("q08_points", sql("pts", "SELECT source, location, strftime(event_date, '%Y-%m-%d') AS event_date, event_hour, metric, sum(hits)::BIGINT AS hits, max(sev_rank) AS sev_rank FROM pts WHERE source IN ('sensors', 'metlink', 'flights') AND sev_rank >= 3 AND event_hour = 12 AND lat IS NOT NULL GROUP BY source, location, lat, lon, pts.event_date, event_hour, metric"))
def _(s, d):
    return reports.combined_points(points(s, d), ["sensors", "metlink", "flights"], 3, hour=12).select("source", "location", day("event_date"), "event_hour", "metric", "hits", "sev_rank")


@query("q09_playback", sql("cf", "SELECT strftime(x::DATE, '%Y-%m-%d') AS event_date, y::INT AS event_hour, count(cell_id) AS cells, coalesce(sum(total_hits), 0)::BIGINT AS hits FROM generate_series(DATE '2024-01-01', DATE '2024-01-07', INTERVAL 1 DAY) a(x) CROSS JOIN generate_series(0, 23) b(y) LEFT JOIN cf ON cf.event_date = x::DATE AND cf.event_hour = y GROUP BY 1, 2"))
def _(s, d):
    return reports.playback(conformed(s, d), "2024-01-01", "2024-01-07").withColumn("event_date", day("event_date"))


SIGNALS = "sg AS (SELECT s.countline_id, NAME AS name, transport_class, direction, count AS observed_count, expected_count, round(robust_z, 4) AS robust_z, change_direction, data_quality, history_samples FROM scored s JOIN meta ON meta.COUNTLINE_ID = s.countline_id WHERE robust_z IS NOT NULL)"


def signal_sql(body: str) -> str:
    return sql("scored meta gaps", "").rstrip() + ",\n" + SIGNALS + "\n" + body


def brief_signals(s, d):
    return reports.named_signals(snap(s, d).scored, A.metadata(s, d)).withColumn("robust_z", F.round("robust_z", 4))


LINE = ["countline_id", "name", "transport_class", "observed_count", "expected_count", "robust_z"]


def _brief(name: str, condition: str, k: int | None, **kw) -> None:
    top = f" QUALIFY row_number() OVER (ORDER BY abs(robust_z) DESC, countline_id, transport_class, direction) <= {k}" if k else ""
    query(name, signal_sql(f"SELECT {', '.join(LINE)} FROM sg WHERE {condition}{top}"))(lambda s, d: reports.brief(brief_signals(s, d), k, **kw).select(*LINE))


_brief("q10_brief_top", "true", 5)
_brief("q10_brief_drops", "change_direction = 'decrease'", 5, way="decrease")
_brief("q10_brief_rises", "change_direction = 'increase'", 5, way="increase")
_brief("q10_brief_people", "transport_class IN ('Pedestrian', 'Cyclist', 'E-scooter')", None, people=True)
_brief("q10_brief_vehicles", "transport_class NOT IN ('Pedestrian', 'Cyclist', 'E-scooter')", None, people=False)


@query("q10_brief_quality", signal_sql("SELECT (SELECT count(*) FROM gaps) AS data_gap_groups, (SELECT count(*) FROM scored WHERE status = 'insufficient_baseline') AS insufficient_baseline_count, (SELECT count(*) FROM scored s JOIN meta ON meta.COUNTLINE_ID = s.countline_id) AS signals, (SELECT count(*) FROM scored s JOIN meta ON meta.COUNTLINE_ID = s.countline_id WHERE data_quality <> 'complete') AS low_confidence, 5 AS limitations"))
def _(s, d):
    x = snap(s, d)
    return reports.brief_quality(x.health, reports.named_signals(x.scored, A.metadata(s, d)), len(K.LIMITATIONS)).select("data_gap_groups", "insufficient_baseline_count", "signals", "low_confidence", "limitations")


@query("q10_brief_cameras", sql("meta", "SELECT count(*) AS cameras, count(*) FILTER (WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east) AS within, count(*) FILTER (WHERE off) AS offline FROM (SELECT -41.3 + (s_suppkey % 100) * 0.001::DOUBLE AS lat, 174.75 + (s_suppkey % 90) * 0.001::DOUBLE AS lon, s_suppkey % 3 = 0 AS off FROM supplier), (SELECT min(LATITUDE_START_LINE) AS south, max(LATITUDE_END_LINE) AS north, min(LONGITUDE_START_LINE) AS west, max(LONGITUDE_END_LINE) AS east FROM meta)"))
def _(s, d):
    layer = detectors.camera_layer(cameras(s, d).withColumn("offline", F.col("camera_id") % 3 == 0), A.metadata(s, d))
    return reports.brief_cameras(layer)


@query("q10_brief_hotspots", hotspot_sql("SELECT STOP_NAME, anomalies, high, top_detector, worst_detail FROM hs QUALIFY row_number() OVER (ORDER BY anomalies DESC, STOP_ID) <= 3"))
def _(s, d):
    h = hotspots(s, d).orderBy(F.desc("anomalies"), "STOP_ID").limit(3)
    return h.select("STOP_NAME", "anomalies", "high", "top_detector", F.col("worst_example.detail").alias("worst_detail"))


@query("q10_brief_people_drops", sql("street_obs", f"SELECT transport_class, strftime(date, '%Y-%m-%d') AS date, hour, z FROM (SELECT transport_class, date, hour, total, round((total - avg(total) OVER w) / nullif(stddev_samp(total) OVER w, 0), 3) AS z FROM (SELECT transport_class, date, hour, sum(count) AS total FROM street_obs GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY transport_class, hour, isodow(date) >= 6)) WHERE transport_class IN ('Pedestrian', 'Cyclist') AND z < 0 ORDER BY abs(z) DESC, transport_class, date, hour LIMIT 10").replace("ORDER BY abs(z) DESC, transport_class, date, hour LIMIT 10", "QUALIFY row_number() OVER (ORDER BY abs(z) DESC, transport_class, date, hour) <= 10"))
def _(s, d):
    return reports.top_signals(class_hourly(s, d), 10, people=True, drops=True).select("transport_class", day(), "hour", "z")


@query("q10_nearest_camera_j18", sql("meta", "SELECT COUNTLINE_ID, camera_id, round(m, 2) AS metres FROM (SELECT COUNTLINE_ID, s_suppkey AS camera_id, 6371000 * sqrt(pow(radians(lon - LONGITUDE_START_LINE) * cos(radians((lat + LATITUDE_START_LINE) / 2)), 2) + pow(radians(lat - LATITUDE_START_LINE), 2)) AS m FROM meta, (SELECT s_suppkey, -41.3 + (s_suppkey % 100) * 0.001::DOUBLE AS lat, 174.75 + (s_suppkey % 90) * 0.001::DOUBLE AS lon FROM supplier)) QUALIFY row_number() OVER (PARTITION BY COUNTLINE_ID ORDER BY m, camera_id) = 1"))
def _(s, d):
    p = A.metadata(s, d).select("COUNTLINE_ID", F.col("LATITUDE_START_LINE").alias("lat"), F.col("LONGITUDE_START_LINE").alias("lon"))
    return nearest(p, cameras(s, d), "COUNTLINE_ID", "camera_id").select("COUNTLINE_ID", "camera_id", F.round("metres", 2).alias("metres"))


@query("q10_name_lookup_p21", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%widget%'")
def _(s, d):
    return A.table(s, d, "part").where(C.text_matches(["Ring", "WIDGET"], "p_name")).select("p_partkey", "p_name")


@query("q11_grounding", hotspot_sql("SELECT 'signals' AS part, s.countline_id || '|' || transport_class AS id, status AS note FROM scored s JOIN meta ON meta.COUNTLINE_ID = s.countline_id UNION ALL SELECT 'cameras', s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 40) UNION ALL SELECT 'hotspots', STOP_ID, top_detector FROM (SELECT * FROM hs ORDER BY anomalies DESC, STOP_ID LIMIT 40) UNION ALL SELECT 'health', target, 'batch replay' FROM (SELECT '2024-01-29T12:00:00' AS target)").replace("WITH ", "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in step_sql("scored meta")) + ",\n", 1))
def _(s, d):
    x = snap(s, d)
    g = reports.grounding(x.health, reports.named_signals(x.scored, A.metadata(s, d)), cameras(s, d), hotspots(s, d))
    parts = "health struct<target_at:string,publisher_mode:string>, signals array<struct<countline_id:string,transport_class:string,status:string>>, cameras array<struct<id:string,name:string>>, transit_hotspots array<struct<id:string,top_detector:string>>, guardrails array<string>"
    c = g.select(F.from_json("context", parts).alias("c"))
    row = lambda part, ident, note: c.select(F.lit(part).alias("part"), F.explode(f"c.{part}").alias("x")).select("part", ident.alias("id"), F.col(note).alias("note"))
    rows = row("signals", F.concat_ws("|", "x.countline_id", "x.transport_class"), "x.status").union(row("cameras", F.col("x.id"), "x.name")).union(row("transit_hotspots", F.col("x.id"), "x.top_detector").withColumn("part", F.lit("hotspots")))
    return rows.union(c.select(F.lit("health"), "c.health.target_at", "c.health.publisher_mode"))


@query("q12_feed_counts", "SELECT 'features' AS feed, count(*) AS n FROM nation UNION ALL SELECT 'lines', count(*) FROM events UNION ALL SELECT 'array', count(*) FROM supplier UNION ALL SELECT 'csv', count(*) FROM customer UNION ALL SELECT 'document', 1 UNION ALL SELECT 'broken', NULL")
def _(s, d):
    """Every format landed as files and counted from them."""
    f, l, a, c, o, b = (shared_folder(s, f"feed-{k}") for k in ("features", "lines", "array", "csv", "document", "broken"))
    K.collection(K.point_features(A.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), "n_name"), "id", "lon", "lat", ["n_name"]), "nations/v1", "2024-01-31").select("document").write.text(f)
    K.write_json_lines(A.table(s, d, "events").select("event_id", "event_type"), l)
    A.table(s, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000).alias("page")).agg(F.to_json(F.collect_list(F.struct("s_suppkey"))).alias("j")).write.partitionBy("page").text(a)  # a file is one document, so each page is a file
    K.write_csv(A.table(s, d, "customer").select("c_custkey", "c_name"), c)
    A.table(s, d, "region").agg(F.to_json(F.struct(F.count("*").alias("regions"))).alias("j")).write.text(o)
    A.table(s, d, "region").agg(F.concat(F.lit("{"), F.max("r_name"))).write.text(b)
    return reports.feed_counts(s, {"features": (f, "json"), "lines": (l, "ndjson"), "array": (a, "json"), "csv": (c, "csv"), "document": (o, "json"), "broken": (b, "json")})


@query("q13_filter_metadata", sql("obs found dscored", "SELECT (SELECT strftime(min(date), '%Y-%m-%d') FROM obs) AS first, (SELECT strftime(max(date), '%Y-%m-%d') FROM obs) AS last, (SELECT string_agg(DISTINCT transport_class, ',' ORDER BY transport_class) FROM obs) AS classes, (SELECT string_agg(DISTINCT DETECTOR || ' ' || DETECTOR_NAME, ',' ORDER BY DETECTOR || ' ' || DETECTOR_NAME) FROM found) AS detectors, (SELECT string_agg(DISTINCT MODE, ',' ORDER BY MODE) FROM found) AS modes, (SELECT string_agg(DISTINCT state_highway, ',' ORDER BY state_highway) FROM dscored) AS highways"))
def _(s, d):
    found = A.detections(s, d).withColumn("detector", F.concat_ws(" ", "DETECTOR", "DETECTOR_NAME"))
    out = reports.filter_metadata(A.observations(s, d), "date", transport_class="classes").crossJoin(reports.filter_metadata(found, "SERVICE_DATE", detector="detectors", MODE="modes").select("detectors", "modes"))
    out = out.crossJoin(reports.filter_metadata(site_scores(s, d), "count_date", state_highway="highways").select("highways"))
    return out.select(day("first"), day("last"), *[F.array_join(c, ",").alias(c) for c in ("classes", "detectors", "modes", "highways")])


@query("q15_class_by_name", sql("obs meta", "SELECT NAME, hour, sum(count) AS volume FROM obs JOIN meta ON meta.COUNTLINE_ID = obs.countline_id WHERE transport_class = 'Pedestrian' GROUP BY 1, 2"))
def _(s, d):
    return reports.class_by_name(A.observations(s, d), A.metadata(s, d), "Pedestrian")
