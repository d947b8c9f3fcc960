"""Route-planning request documents: reading into tables with explicit defaults, and writing routes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darb.functions.geo import haversine_m
from darb.functions.scalars import stage

_STUDENT = "id string, latitude double, longitude double, home_latitude double, home_longitude double, age int, school_stage string, fee double, assignment string, valid_from string, valid_until string, physically_mentally_disabled boolean, walk_radius_override double, walk_distance double"

#: Everything that a request may hold; node and bus ids are text, for some exceed 64 bits.
SCHEMA = (
    "meta struct<mode:string,student_id:string,change_type:string,valid_from:string,valid_until:string,new_location:struct<latitude:double,longitude:double,reason:string>,algorithm:struct<method:string,iterations:int>,"
    "constraints:struct<enabled:boolean,ride_time_multiplier:double,floor_minutes:double,ceiling_minutes:double,acceptable_offset_minutes:double,bidirectional_check:boolean,mrt_enabled:boolean,`mrt enabled`:boolean,mrt:double,route_tmax:double,daily_detour_budget_minutes:double>>, "
    "data struct<school:struct<name:string,latitude:double,longitude:double>,buses:array<struct<id:string,type:string,capacity:int,fixed_cost:double,var_cost_km:double>>,"
    f"students:array<struct<{_STUDENT.replace(', ', ',').replace(' ', ':')}>>,"
    f"routes:array<struct<id:string,bus_id:string,route_tmax:double,detour_time_used_today:double,total_distance_km:double,total_time_minutes:double,path:array<struct<node_id:string,latitude:double,longitude:double,type:string,students:array<struct<{_STUDENT.replace(', ', ',').replace(' ', ':')}>>>>>>>, "
    "broken string"
)

#: Defaults of a request's constraints.
DEFAULTS = {"enabled": True, "ride_time_multiplier": 2.5, "floor_minutes": 45.0, "ceiling_minutes": 60.0, "acceptable_offset_minutes": 30.0, "bidirectional_check": True, "daily_detour_budget_minutes": 5.0}


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request documents (one JSON per file) with their file as `request`; documents without meta or data raise.

    The check is an expression of the plan, so a bad file fails the job that reads it and no other.
    """
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    complete = F.when(F.col("meta").isNull() | F.col("data").isNull(), F.raise_error(F.concat(F.lit("no meta or data in "), F.col("_metadata.file_path")))).otherwise(F.col("_metadata.file_path"))
    return docs.select(complete.alias("request"), "meta", "data")


def constraints(requests: DataFrame) -> DataFrame:
    """(request, ...): constraints with their defaults; the route limit is the ride maximum where that is on, else its own, else the ceiling."""
    c = lambda name: F.col(f"meta.constraints.{name}")
    known = [F.coalesce(c(n), F.lit(v)).alias(n) for n, v in DEFAULTS.items()]
    mrt_on = F.coalesce(c("mrt_enabled"), c("`mrt enabled`"), F.lit(False))
    tmax = F.when(mrt_on & (c("mrt") > 0), c("mrt")).otherwise(F.coalesce(c("route_tmax"), c("ceiling_minutes"), F.lit(DEFAULTS["ceiling_minutes"])))
    return requests.select("request", *known, mrt_on.alias("mrt_enabled"), c("mrt").alias("mrt"), tmax.alias("route_tmax"))


def _items(requests: DataFrame, column: str) -> DataFrame:
    return requests.select("request", F.posexplode(column).alias("pos", "x")).where("x IS NOT NULL")


def buses(requests: DataFrame) -> DataFrame:
    """(request, pos, bus_id, ...): of buses with one id the last counts."""
    rows = _items(requests, "data.buses").select("request", "pos", "x.*")
    last = rows.groupBy("request", "id").agg(F.max_by(F.struct("pos", "type", "capacity", "fixed_cost", "var_cost_km"), "pos").alias("b"))
    return last.select("request", F.col("id").alias("bus_id"), "b.*")


def _student(x: str) -> list[Column]:
    f = lambda n: F.col(f"{x}.{n}")
    return [
        f("id").alias("student_id"), F.coalesce(f("home_latitude"), f("latitude")).alias("lat"), F.coalesce(f("home_longitude"), f("longitude")).alias("lon"), f("age").alias("age"), stage(f("school_stage")).alias("stage"),
        F.coalesce(f("physically_mentally_disabled"), F.lit(False)).alias("disabled"), F.coalesce(f("fee"), F.lit(100.0)).alias("fee"), F.coalesce(f("assignment"), F.lit("permanent")).alias("assignment"),
        f("valid_from").try_cast("date").alias("valid_from"), f("valid_until").try_cast("date").alias("valid_until"), f("walk_radius_override").alias("walk_radius_override"), f("walk_distance").alias("walk_m"),
    ]


def students(requests: DataFrame) -> DataFrame:
    """(request, pos, student_id, ...) with defaults for what a record lacks."""
    return _items(requests, "data.students").select("request", "pos", *_student("x"))


def routes(requests: DataFrame) -> DataFrame:
    """(request, pos, route_id, bus_id, ...) of the routes whose bus is known."""
    rows = _items(requests, "data.routes").select("request", "pos", F.col("x.id").alias("route_id"), "x.bus_id", F.coalesce("x.route_tmax", F.lit(75.0)).alias("route_tmax"), F.coalesce("x.detour_time_used_today", F.lit(0.0)).alias("detour_used"))
    return rows.join(buses(requests).select("request", "bus_id"), ["request", "bus_id"], "left_semi")


def empty_routes(requests: DataFrame) -> DataFrame:
    """(request, route_id, bus_id, seq, stop_type): a route from school to school for every bus, named R1, R2, ..."""
    rows = buses(requests).select("request", F.concat(F.lit("R"), (F.col("pos") + 1).cast("string")).alias("route_id"), "bus_id")
    return rows.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("stop_type", F.lit("school"))


def route_stops(requests: DataFrame) -> DataFrame:
    """(request, route_id, seq, node_id, lat, lon, stop_type) of all routes."""
    rows = _items(requests, "data.routes").select("request", F.col("x.id").alias("route_id"), F.posexplode("x.path").alias("seq", "s")).where("s IS NOT NULL")
    return rows.select("request", "route_id", "seq", "s.node_id", F.col("s.latitude").alias("lat"), F.col("s.longitude").alias("lon"), F.col("s.type").alias("stop_type"))


def boarded(requests: DataFrame) -> DataFrame:
    """(request, route_id, seq, student_id, ...): who boards where."""
    stops = _items(requests, "data.routes").select("request", F.col("x.id").alias("route_id"), F.posexplode("x.path").alias("seq", "s"))
    return stops.select("request", "route_id", "seq", F.explode("s.students").alias("x")).where("x IS NOT NULL").select("request", "route_id", "seq", *_student("x"))


def route_documents(stops: DataFrame, riders: DataFrame, totals: DataFrame) -> DataFrame:
    """(route_id, document): each route that has a pickup as one JSON text, stops and students in order.

    stops: (route_id, seq, node_id, lat, lon, stop_type), riders: (route_id, seq, student_id, lat, lon),
    totals: (route_id, total_km, total_min). Walks are great-circle metres to 1 place, totals have 2.
    """
    at = riders.join(stops.select("route_id", "seq", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), ["route_id", "seq"])
    people = at.withColumn("walk_distance", F.round(haversine_m("lat", "lon", "s_lat", "s_lon"), 1)).groupBy("route_id", "seq").agg(F.sort_array(F.collect_list(F.struct(F.col("student_id").alias("id"), "walk_distance"))).alias("students"))
    none = F.array().cast("array<struct<id:string,walk_distance:double>>")
    stop = F.struct("seq", "node_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("stop_type").alias("type"), F.coalesce(F.col("students").cast("array<struct<id:string,walk_distance:double>>"), none).alias("students"))
    paths = stops.join(people, ["route_id", "seq"], "left").groupBy("route_id").agg(F.sort_array(F.collect_list(stop)).alias("p"), F.bool_or(F.col("stop_type") != "school").alias("any"))
    path = F.transform("p", lambda s: s.dropFields("seq"))
    whole = paths.where("any").join(totals, "route_id")
    document = F.to_json(F.struct(F.col("route_id").alias("id"), F.round("total_km", 2).alias("total_distance_km"), F.round("total_min", 2).alias("total_time_minutes"), path.alias("path")))
    return whole.select("route_id", document.alias("document"))
