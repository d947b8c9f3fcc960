"""Whole runs put together from the operators: routes from students and stops, changed homes in a plan, modes beside each other, artefacts, benchmarks.

Each takes and gives DataFrames, so a run is one plan for all its zones, requests, modes or instances at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.operators import insertions, metrics, routes, solver, spatial
from darb.session import durable, shuffle_partitions, small_side
from darb.sources import requests as request_documents


def generate(students: DataFrame, stops: DataFrame, fleets: DataFrame, capacity: int, iterations: int, seed: int = 42, cap: Column | None = None, metres_per_min: float = 400.0, tail: int = 10) -> dict[str, DataFrame]:
    """Routes for the students (zone, student_id, lat, lon) of every zone with its number of buses (zone, fleet).

    Gives 'stops' (zone, route, seq from 0, node_id, lat, lon, stop_type, load, arrive_min) with the school at both ends,
    'riders' (zone, route, seq, student_id, lat, lon, walk_m, ride_min), 'totals' (zone, route, total_min, total_km, load),
    'meta' (zone, students_total, students_served, routes_created, objective) and 'documents' (route_id, document).
    Students of a stop fill its units in order of their ids. A zone without stops has no routes; students of zones
    that `fleets` lacks are not in the result.
    """
    people = students.withColumn("zone", F.col("zone").cast("bigint")).join(fleets.select(F.col("zone").cast("bigint").alias("zone")), "zone", "left_semi")
    tasks = fleets.select("zone", F.lit(seed).alias("seed"), F.col("fleet").cast("int").alias("fleet"))
    solved = durable(solver.solve_routes(people, stops, tasks, capacity, iterations, metres_per_min, tail, cap))
    places = stops.select(F.col("zone").cast("bigint").alias("zone"), F.col("node_id").cast("bigint").alias("node_id"), "lat", "lon")
    school = places.groupBy("zone").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    ends = solved.where("node_id IS NULL")
    pickups = solved.where("node_id IS NOT NULL").join(places, ["zone", "node_id"]).withColumn("stop_type", F.lit("pickup"))
    at_school = lambda d, seq, time: d.join(school, "zone").withColumn("seq", seq).withColumn("arrive_min", time).withColumn("stop_type", F.lit("school"))
    every = pickups.unionByName(at_school(ends, F.col("seq"), F.col("arrive_min"))).unionByName(at_school(ends, F.lit(0), F.lit(0.0)))
    columns = ["zone", "route", "seq", "node_id", "lat", "lon", "stop_type", "load", "arrive_min"]
    total = ends.select("zone", "route", F.col("arrive_min").alias("total_min"))
    place = solver.assigned(people, stops).where("node_id IS NOT NULL")
    # a stop's students are few by nature
    part = F.floor((F.row_number().over(Window.partitionBy("zone", "node_id").orderBy("student_id")) - 1) / capacity).cast("int")
    boards = pickups.select("zone", "node_id", "part", "route", "seq", "arrive_min")
    riders = place.withColumn("part", part).join(boards, ["zone", "node_id", "part"]).join(total, ["zone", "route"]).join(people.select("zone", "student_id", "lat", "lon"), ["zone", "student_id"])
    riders = durable(riders.select("zone", "route", "seq", "student_id", "lat", "lon", "walk_m", (F.col("total_min") - F.col("arrive_min")).alias("ride_min")))
    loads = pickups.groupBy("zone", "route").agg(F.sum("load").alias("load"))
    totals = total.join(loads, ["zone", "route"]).select("zone", "route", "total_min", (F.col("total_min") * metres_per_min / 1000.0).alias("total_km"), "load")
    per_zone = totals.groupBy("zone").agg(F.sum("load").alias("served"), F.count("*").alias("routes"), F.sum("total_min").alias("minutes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    meta = people.groupBy("zone").agg(F.count("*").alias("students_total")).join(per_zone, "zone", "left").select(
        "zone", "students_total", zero("served").alias("students_served"), zero("routes").alias("routes_created"), (solver.SERVED * zero("served") - solver.ROUTE * zero("routes") - zero("minutes")).alias("objective")
    )
    name = F.concat_ws("-", "zone", F.concat(F.lit("R"), F.col("route").cast("string"))).alias("route_id")
    node = F.coalesce(F.col("node_id").cast("string"), F.lit("school")).alias("node_id")
    documents = request_documents.route_documents(every.select(name, "seq", node, "lat", "lon", "stop_type"), riders.select(name, "seq", "student_id", "lat", "lon"), totals.select(name, "total_km", "total_min"))
    return {"stops": every.select(columns), "riders": riders, "totals": totals, "meta": meta, "documents": documents}


def change(asked: DataFrame, places: DataFrame, stops: DataFrame, od: DataFrame, riders: DataFrame, capacity: int, price: Callable[[np.ndarray, np.ndarray], np.ndarray], cap_min: float, budget_min: float = 5.0, used: DataFrame | None = None) -> DataFrame:
    """(key, change_type, status, route_id, seq, node_id, delta, reason): where each request (key, student_id, change_type, lat, lon, radius) can board in the plan.

    Those who ask are taken from their old routes first (an emptied stop stays on its route), then each is offered
    the cheapest position at its nearest stop or any within its radius, independently of the others: a 'permanent'
    one where everyone's cap holds in the morning or on the way back, a 'temporary' one where the route's detours stay
    within the day's budget less what is `used` (route_id, used_min). `places`: (target, lat, lon); `stops`, `od`: the
    plan's routes and matrix; `riders`: (route_id, seq, student_id, cap_min). Other change types count as permanent.
    """
    own, moved = _asked(asked)
    staying = riders.join(moved, "student_id", "left_anti")
    loads = stops.select("route_id").distinct().join(staying.groupBy("route_id").agg(F.count("*").alias("load")), "route_id", "left").select("route_id", F.coalesce("load", F.lit(0)).alias("load"), F.lit(capacity).alias("capacity"))
    caps = staying.groupBy("route_id", "seq").agg(F.min("cap_min").alias("cap"))
    legs = durable(routes.legs_both_ways(stops.select("route_id", "seq", "node_id").join(caps, ["route_id", "seq"], "left"), od, ("cap",)))
    spent = (used if used is not None else stops.select("route_id").distinct().withColumn("used_min", F.lit(0.0))).select("route_id", (F.lit(budget_min) - F.col("used_min")).alias("most"))
    budgets = stops.select("route_id").distinct().join(spent, "route_id", "left").select("route_id", F.coalesce("most", F.lit(budget_min)).alias("most"))
    return _offered(own, places, insertions.route_rows(legs, F.col("cap"), loads), insertions.route_rows(legs, None, None, budgets), price, cap_min)


def change_lines(asked: DataFrame, places: DataFrame, lines: DataFrame, school: int, capacity: int, price: Callable[[np.ndarray, np.ndarray], np.ndarray], minutes: Callable[[Column, Column], Column], cap_min: float, budget_min: float = 5.0, used: Column | None = None) -> DataFrame:
    """As change(), of a plan with a row per pickup: `lines` (route_id, place, node_id, student_id, cap_min), with the school at both ends of each route.

    `place` orders a route's pickups, which are numbered from 1; pickups of equal place are to be equal in all but the
    row. `minutes` is `price` as an expression, `used` the spent minutes of a route_id. A route is put together where its pickups meet: they are shuffled
    once, for both kinds of requests, and no leg is looked up in a table.
    """
    own, moved = _asked(asked)
    marked = lines.join(small_side(moved.withColumn("moved", F.lit(True))), "student_id", "left")
    cap = F.when(F.col("moved").isNull(), F.col("cap_min").cast("double"))
    pickup = F.struct("place", F.col("node_id").cast("bigint").alias("node"), cap.alias("cap"), F.col("moved").isNotNull().alias("moved"))
    spread = marked.select("route_id", pickup.alias("p")).repartition(shuffle_partitions(lines.sparkSession), "route_id")
    each = spread.groupBy("route_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    end = F.array(F.lit(school).cast("bigint"))
    each = each.select("route_id", F.concat(end, F.col("p.node"), end).alias("nodes"), F.concat(F.array(F.lit(None).cast("double")), F.col("p.cap")).alias("caps"), F.size(F.filter("p", lambda x: ~x["moved"])).alias("load"))
    # a leg's way back is from its end to its start, as a route ends where it begins
    leg = F.sequence(F.lit(1), F.size("nodes") - 1)
    node = lambda i: F.element_at("nodes", i)
    there, back = F.transform(leg, lambda i: minutes(node(i), node(i + 1))), F.transform(leg, lambda i: minutes(node(i + 1), node(i)))
    rows = lambda kept, most: kept.select("route_id", "nodes", there.alias("minutes"), back.alias("back"), "caps", F.transform(leg, lambda i: i - 1).alias("seqs"), most.cast("double").alias("most"))
    left = F.coalesce(F.lit(budget_min) - used, F.lit(budget_min)) if used is not None else F.lit(budget_min)
    return _offered(own, places, rows(each.where(F.col("load") < capacity), F.lit(float("inf"))), rows(each, left), price, cap_min)


def _asked(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests, and the students who ask."""
    own = durable(asked.select("key", "student_id", F.when(F.lower(F.trim("change_type")) == "temporary", "temporary").otherwise("permanent").alias("change_type"), "lat", "lon", "radius"))
    return own, own.select("student_id").where("student_id IS NOT NULL").distinct()


def _offered(own: DataFrame, places: DataFrame, seats: DataFrame, budgets: DataFrame, price: Callable[[np.ndarray, np.ndarray], np.ndarray], cap_min: float) -> DataFrame:
    """The result of change() for the plan as route_rows(), of routes with a free seat and of all with their budgets.

    A node's best position is the same for all requests of a type, and so is that of all the nodes at a location; a
    request meets locations, never their nodes, of which there may be many.
    """
    kind = own.select("key", "change_type")
    lone = durable(spatial.nearest(own.select("key", "lat", "lon"), places).select("key", F.col("target").cast("bigint").alias("node_id")).join(kind, "key"))
    around = durable(spatial.within_places(own.select("key", "lat", "lon", "radius"), places).select("key", "t_lat", "t_lon").join(kind, "key"))
    at = places.select(F.col("target").cast("bigint").alias("node_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).where("node_id IS NOT NULL").distinct()
    there = durable(around.select("change_type", "t_lat", "t_lon").distinct().join(at, ["t_lat", "t_lon"]))
    items = durable(there.select("change_type", "node_id").unionByName(lone.select("change_type", "node_id")).distinct())

    def best(rows: DataFrame, change_type: str, cap: float, rule: str) -> DataFrame:
        asked_for = items.where(F.col("change_type") == change_type).select("node_id", F.lit(cap).alias("cap_min"))
        return insertions.best_positions(rows, asked_for, price, rule).select(F.lit(change_type).alias("change_type"), "node_id", F.struct("delta", "route_id", "seq", "node_id").alias("b"))

    found = durable(best(seats, "permanent", cap_min, "either").unionByName(best(budgets, "temporary", float("inf"), "free")))
    spots = durable(there.join(found, ["change_type", "node_id"]).groupBy("change_type", "t_lat", "t_lon").agg(F.min("b").alias("b")))
    offers = around.join(small_side(spots), ["change_type", "t_lat", "t_lon"]).select("key", "b").unionByName(lone.join(small_side(found), ["change_type", "node_id"]).select("key", "b"))
    first = offers.groupBy("key").agg(F.min("b").alias("b")).select("key", "b.*")
    reason = F.when(F.col("change_type") == "temporary", "no route within its budget").otherwise("no position keeps seats and caps")
    return own.join(first, "key", "left").select("key", "change_type", F.when(F.col("route_id").isNull(), "failed").otherwise("success").alias("status"), "route_id", "seq", "node_id", "delta", F.when(F.col("route_id").isNull(), reason).alias("reason"))


def compare(students: DataFrame, stops: DataFrame, fleets: DataFrame, capacity: int, iterations: int, modes: dict[str, Column | None], seed: int = 42, metres_per_min: float = 400.0) -> DataFrame:
    """One row per mode, a name with an expression of each student's longest ride: metrics.mode_bundle() of its routes.

    `students` have stage, radius and (for the ratio) their way straight to school is the great circle at the
    vehicle's speed.
    """
    school = stops.groupBy(F.col("zone").cast("bigint").alias("zone")).agg(F.avg("lat").alias("s_lat"), F.avg("lon").alias("s_lon"))
    from darb.functions.geo import haversine_m

    people = students.withColumn("zone", F.col("zone").cast("bigint")).join(school, "zone", "left").withColumn("direct_min", haversine_m("lat", "lon", "s_lat", "s_lon") / metres_per_min)
    riders, totals = {}, {}
    for mode, cap in modes.items():
        run = generate(people, stops, fleets, capacity, iterations, seed, cap, metres_per_min)
        cap_min = cap if cap is not None else F.lit(float("inf"))
        facts = people.select("zone", "student_id", "direct_min", "radius", cap_min.cast("double").alias("cap_min"))
        served = run["riders"].select("zone", "student_id", "walk_m", "ride_min", F.lit(True).alias("served"))
        riders[mode] = facts.join(served, ["zone", "student_id"], "left").select(F.coalesce("served", F.lit(False)).alias("served"), "ride_min", "direct_min", "cap_min", "walk_m", F.col("radius").alias("walk_limit_m"))
        totals[mode] = run["totals"].select("load", F.lit(capacity).alias("capacity"), "total_min", "total_km")
    return metrics.mode_bundle(metrics.tagged_union(riders, "mode"), metrics.tagged_union(totals, "mode"))


def artefacts(runs: DataFrame, path: str) -> DataFrame:
    """Writes the tables of a set of runs (cohort, mode, seed, ...) under `path`, and gives their manifest (name, rows).

    Tables: 'table1' (means and spreads by cohort and mode), 'distribution' of the walks by mode, 'gains' over Mode C,
    'cells' (seeds and rows by cohort and mode). A table that is there is replaced.
    """
    per = runs.groupBy("cohort", "mode").agg(F.avg("minutes").alias("v"))
    tables = {
        "table1": metrics.mean_and_spread(runs, ["cohort", "mode"], ["walk", "minutes", "served_rate_pct", "routes_created"], "seed"),
        "distribution": metrics.distribution(runs, ["mode"], "walk"),
        "gains": metrics.mode_gains(per, "cohort", "Mode C", ["Mode A", "Mode B"], "v"),
        "cells": metrics.manifest(runs, ["cohort", "mode"], "seed"),
    }
    rows = []
    for name, df in tables.items():
        df = df.select(*(F.col(c).alias(c.replace(" ", "_")) for c in df.columns))
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, runs.sparkSession.read.parquet(f"{path}/{name}").count()))
    manifest = runs.sparkSession.createDataFrame(rows, "name string, rows bigint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def benchmark(instance: dict[str, DataFrame], capacity: int, iterations: int, published: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(instance, students, served, routes, stops_used, seconds[, best, gap_pct]) of benchmark instances (files.bus_instance), all solved at once.

    A bus for every `capacity` pupils and one more; seconds count 15 a stop and 5 a pupil beside the drive. `published`:
    (instance, best) in seconds.
    """
    from darb.functions.scalars import benchmark_seconds, relative_change

    names = instance["stops"].select("instance").distinct().withColumn("zone", F.xxhash64("instance"))
    stops = instance["stops"].join(names, "instance").select("zone", F.col("stop").alias("node_id"), "lat", "lon")
    pupils = instance["addresses"].where("pupils > 0").join(names, "instance").select("zone", "address", "lat", "lon", F.explode(F.sequence(F.lit(1), F.col("pupils"))).alias("n"))
    people = pupils.select("zone", (F.col("address").cast("bigint") * 1_000_000 + F.col("n")).alias("student_id"), "lat", "lon")
    fleets = people.groupBy("zone").agg((F.ceil(F.count("*") / capacity) + 1).cast("int").alias("fleet"))
    run = generate(people, stops, fleets, capacity, iterations, seed)
    used = run["stops"].where("stop_type = 'pickup'").groupBy("zone").agg(F.count_distinct("node_id").alias("stops_used"), F.count("*").alias("pickups"))
    drive = run["totals"].groupBy("zone").agg(F.sum("total_min").alias("minutes"))
    out = names.join(run["meta"], "zone").join(used, "zone", "left").join(drive, "zone", "left")
    out = out.select("instance", F.col("students_total").alias("students"), F.col("students_served").alias("served"), F.col("routes_created").alias("routes"), "stops_used", benchmark_seconds("minutes", "pickups", "students_served").alias("seconds"))
    return out if published is None else out.join(published, "instance", "left").withColumn("gap_pct", relative_change("best", "seconds"))
