"""Ordered computations over routes: legs, riding times, positions, insertions.

A route is rows (route_id, seq, node_id, ...) with seq from 0, the school first and last. Windows are
partitioned by route, which are short by nature (a vehicle's stops in a day), so no window grows with the data;
all of them share one shuffle on route_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.functions.scalars import UNREACHABLE_MIN


def _by(route: str = "route_id", *order: Column | str):
    w = Window.partitionBy(route)
    return w.orderBy(*order) if order else w


def with_sequence(rows: DataFrame, route: str, order: list[str]) -> DataFrame:
    """Adds seq = 1, 2, ... in `order`, which must be total for the result to be defined."""
    return rows.withColumn("seq", F.row_number().over(_by(route, *order)))


def legs(stops: DataFrame, od: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, seq, src, dst, minutes, metres) with the stop's columns named in `carried`: consecutive stops with their travel; a pair that the matrix lacks has nulls."""
    pairs = stops.select("route_id", "seq", F.col("node_id").alias("src"), F.lead("node_id").over(_by("route_id", "seq")).alias("dst"), *carried).where("dst IS NOT NULL")
    return pairs.join(od.select("src", "dst", "minutes", "metres"), ["src", "dst"], "left").select("route_id", "seq", "src", "dst", "minutes", "metres", *carried)


def legs_both_ways(stops: DataFrame, od: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, seq, src, dst, minutes, back_min) with `carried`: each leg with its minutes there and backwards.

    Backwards a vehicle starts at the route's first stop (the school), so the last leg's way back begins there.
    """
    w = _by("route_id", "seq")
    ends = _by("route_id", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = stops.select("route_id", "seq", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.lead("node_id", 2).over(w).alias("__next"), F.first("node_id").over(ends).alias("__first"), *carried).where("dst IS NOT NULL")
    there = pairs.withColumn("__from", F.when(F.col("__next").isNull(), F.col("__first")).otherwise(F.col("dst"))).join(od.select("src", "dst", "minutes"), ["src", "dst"], "left")
    back = od.select(F.col("src").alias("__from"), F.col("dst").alias("src"), F.col("minutes").alias("back_min"))
    return there.join(back, ["__from", "src"], "left").select("route_id", "seq", "src", "dst", "minutes", "back_min", *carried)


def rides_both_ways(stops: DataFrame, od: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, seq, node_id, ride_min, pm_min) with `carried`: the rides of morning_rides() and evening_rides() of each stop but the last, from one set of legs."""
    rest = _by("route_id", "seq").rowsBetween(0, Window.unboundedFollowing)
    back = _by("route_id", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)  # added up in the order of the ride
    total = lambda c, w: F.when(F.sum(F.col(c).isNull().cast("int")).over(w) == 0, F.sum(c).over(w))
    return legs_both_ways(stops, od, carried).select("route_id", "seq", F.col("src").alias("node_id"), total("minutes", rest).alias("ride_min"), total("back_min", back).alias("pm_min"), *carried)


def route_totals(legs_df: DataFrame) -> DataFrame:
    """(route_id, total_min, total_km): 9999.0 and 0.0 for a route with an unreachable leg, null with an unknown one."""
    unreachable = F.bool_or(F.col("minutes") == float("inf"))
    unknown = F.bool_or(F.col("minutes").isNull())
    minutes = F.sum(F.when(F.col("minutes") < float("inf"), F.col("minutes")))
    km = F.sum(F.when(F.col("metres") < float("inf"), F.col("metres"))) / 1000.0
    return legs_df.groupBy("route_id").agg(F.when(unreachable, UNREACHABLE_MIN).when(unknown, None).otherwise(minutes).alias("total_min"), F.when(unreachable, 0.0).when(unknown, None).otherwise(km).alias("total_km"))


def morning_rides(legs_df: DataFrame) -> DataFrame:
    """Adds ride_min and ride_m to each stop's leg: from the stop to the route's end (a suffix sum); null behind an unknown leg."""
    rest = _by("route_id", "seq").rowsBetween(0, Window.unboundedFollowing)
    known = F.sum(F.col("minutes").isNull().cast("int")).over(rest) == 0
    return legs_df.withColumn("ride_min", F.when(known, F.sum("minutes").over(rest))).withColumn("ride_m", F.when(known, F.sum("metres").over(rest)))


def evening_rides(stops: DataFrame, od: DataFrame) -> DataFrame:
    """(route_id, seq, node_id, ride_min) of pickups when the route is run backwards from the school.

    The order is school, last pickup, ..., first pickup; legs are directed, hence looked up anew. `stops` has the
    school at both ends; a stop is a pickup if is_pickup.
    """
    interior = stops.where("is_pickup").select("route_id", "seq", "node_id")
    school = stops.groupBy("route_id").agg(F.min_by("node_id", "seq").alias("school"))
    back = _by("route_id", F.desc("seq"))
    ordered = interior.join(school, "route_id").withColumn("before", F.coalesce(F.lag("node_id").over(back), F.col("school")))
    travelled = ordered.join(od.select(F.col("src").alias("before"), F.col("dst").alias("node_id"), "minutes"), ["before", "node_id"], "left")
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    known = F.sum(F.col("minutes").isNull().cast("int")).over(so_far) == 0
    return travelled.select("route_id", "seq", "node_id", F.when(known, F.sum("minutes").over(so_far)).alias("ride_min"))


def pickup_order(stops: DataFrame) -> DataFrame:
    """Adds pickup_order: how many pickups the route has made up to and with this stop."""
    running = _by("route_id", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return stops.withColumn("pickup_order", F.sum(F.col("is_pickup").cast("int")).over(running))


def first_boarding(stops: DataFrame, boarded: str) -> DataFrame:
    """(route_id, first_seq): the first stop at which anyone boards; null if none does."""
    return stops.groupBy("route_id").agg(F.min(F.when(F.col(boarded) > 0, F.col("seq"))).alias("first_seq"))


def insertion_costs(routes_legs: DataFrame, candidates: DataFrame, od: DataFrame, prune: Column | None = None) -> DataFrame:
    """(student_id, route_id, seq, node_id, delta): cost of inserting each candidate node into each leg of its routes.

    delta = t(u, c) + t(c, v) - t(u, v). `candidates` are (student_id, route_id, node_id): the routes worth
    looking at are chosen before (a grid or box join), so that nobody is paired with every route; a pair that
    the matrix lacks, or that is unreachable, drops the position. The matrix is joined on its keys twice.
    """
    legs_df = routes_legs.select("route_id", "seq", "src", "dst", F.col("minutes").alias("t_uv")).where("t_uv < double('infinity')")
    met = candidates.join(legs_df, "route_id")
    if prune is not None:
        met = met.where(prune)
    first = od.select(F.col("src"), F.col("dst").alias("node_id"), F.col("minutes").alias("t_uc")).where("t_uc < double('infinity')")
    second = od.select(F.col("src").alias("node_id"), F.col("dst"), F.col("minutes").alias("t_cv")).where("t_cv < double('infinity')")
    both = met.join(first, ["src", "node_id"]).join(second, ["node_id", "dst"])
    return both.select("student_id", "route_id", "seq", "node_id", (F.col("t_uc") + F.col("t_cv") - F.col("t_uv")).alias("delta"))


def with_slack(rides: DataFrame, riders: DataFrame) -> DataFrame:
    """Legs (route_id, seq, src, dst, t_uv) with rest_min, the ride from dst on, and slack, the least of those on board; see feasible_insertions."""
    slack = riders.groupBy("route_id", "seq").agg(F.min(F.col("cap_min") - F.col("ride_min")).alias("slack"))
    upto = _by("route_id", "seq").rowsBetween(Window.unboundedPreceding, 0)
    legs_df = rides.select("route_id", "seq", "src", "dst", F.col("minutes").alias("t_uv"), (F.col("ride_min") - F.col("minutes")).alias("rest_min"))
    return legs_df.join(slack, ["route_id", "seq"], "left").withColumn("slack", F.min("slack").over(upto))


def feasible_insertions(insertions: DataFrame, rides: DataFrame, riders: DataFrame, loads: DataFrame, caps: DataFrame, od: DataFrame) -> DataFrame:
    """The insertions (with cap checks passed) of insertion_costs: seats left, the new rider's and all earlier riders' caps kept.

    `rides`: legs with ride_min from each stop (morning_rides), `riders`: (route_id, seq, ride_min, cap_min) of those
    on board, `loads`: (route_id, load, capacity), `caps`: (student_id, cap_min). Riders who board before the
    new stop ride `delta` longer; whether all may is one running minimum of their slack per route, not a check
    per pair. Later riders don't notice.
    """
    legs_slack = with_slack(rides, riders).select("route_id", "seq", "dst", "rest_min", "slack")
    onward = od.select(F.col("src").alias("node_id"), "dst", F.col("minutes").alias("t_cv"))
    met = insertions.join(legs_slack, ["route_id", "seq"]).join(onward, ["node_id", "dst"]).join(loads.where("load < capacity").select("route_id"), "route_id", "left_semi").join(caps.select("student_id", F.col("cap_min").alias("own_cap")), "student_id")
    return met.where("(slack IS NULL OR delta <= slack) AND t_cv + rest_min <= own_cap").select(*insertions.columns)


def pairs_within(stops: DataFrame) -> DataFrame:
    """(src, dst): the pairs of nodes of one route, which two_opt() asks for."""
    sources = stops.select("route_id", F.col("node_id").alias("src")).distinct()
    return sources.join(stops.select("route_id", F.col("node_id").alias("dst")).distinct(), "route_id").select("src", "dst").distinct()


def pairs_around(stops: DataFrame) -> DataFrame:
    """(src, dst): the neighbours of each interior stop, which removal_savings() asks for."""
    w = _by("route_id", "seq")
    return stops.select(F.lag("node_id").over(w).alias("src"), F.lead("node_id").over(w).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def removal_savings(routes_legs: DataFrame, od: DataFrame) -> DataFrame:
    """(route_id, seq, node_id, saved_min): minutes saved by skipping each interior stop; null if the way round is unknown."""
    w = _by("route_id", "seq")
    around = routes_legs.select("route_id", "seq", F.lag("src").over(w).alias("before"), F.col("src").alias("node_id"), F.col("dst").alias("after"), (F.lag("minutes").over(w) + F.col("minutes")).alias("through")).where("before IS NOT NULL")
    direct = od.select(F.col("src").alias("before"), F.col("dst").alias("after"), F.col("minutes").alias("t"))
    same = F.when(F.col("before") == F.col("after"), 0.0)
    return around.join(direct, ["before", "after"], "left").select("route_id", "seq", "node_id", (F.col("through") - F.coalesce("t", same)).alias("saved_min"))


def axis_positions(points: DataFrame) -> DataFrame:
    """Adds axis_m and axis_rank: where (name, side, x, y, bearing) lies along its road's mean bearing through its centroid."""
    road = Window.partitionBy("name")
    angle = F.radians(F.avg("bearing").over(road))
    along = (F.col("x") - F.avg("x").over(road)) * F.sin(angle) + (F.col("y") - F.avg("y").over(road)) * F.cos(angle)
    return points.withColumn("axis_m", along).withColumn("axis_rank", F.row_number().over(Window.partitionBy("name", "side").orderBy("axis_m", "x", "y")))


def route_legend(stops: DataFrame, riders: DataFrame, rides: DataFrame) -> DataFrame:
    """(route_id, stops, students, first_ride_min): pickups, riders, and the ride from the first stop where anyone boards."""
    people = riders.groupBy("route_id").agg(F.count_distinct("student_id").alias("students"), F.min("seq").alias("first"))
    pickups = stops.groupBy("route_id").agg(F.count_if("is_pickup").alias("stops"))
    first = rides.select("route_id", F.col("seq").alias("first"), F.col("ride_min").alias("first_ride_min"))
    return pickups.join(people, "route_id", "left").join(first, ["route_id", "first"], "left").select("route_id", "stops", F.coalesce("students", F.lit(0)).alias("students"), "first_ride_min")


def cheapest(insertions: DataFrame, cost: str = "delta") -> DataFrame:
    """The best insertion of each student; ties go to the smallest (route, seq, node)."""
    order = F.struct(F.col(cost), F.col("route_id"), F.col("seq"), F.col("node_id"))
    best = insertions.groupBy("student_id").agg(F.min(order).alias("b"))
    return best.select("student_id", "b.route_id", "b.seq", "b.node_id", F.col(f"b.{cost}").alias(cost))


def regret(insertions: DataFrame, k: int = 2, big: float = 2000.0, cost: str = "delta") -> DataFrame:
    """(student_id, best, regret): k-th best route's cost less the best one's; `big` less the best for fewer than k routes.

    A route's cost is its best position's. Only the k smallest costs per student are kept by the window.
    """
    per_route = insertions.groupBy("student_id", "route_id").agg(F.min(cost).alias("c"))
    ranked = per_route.withColumn("r", F.row_number().over(Window.partitionBy("student_id").orderBy("c", "route_id"))).where(F.col("r") <= k)
    both = ranked.groupBy("student_id").agg(F.min("c").alias("best"), F.max(F.when(F.col("r") == k, F.col("c"))).alias("kth"))
    return both.select("student_id", "best", F.coalesce(F.col("kth") - F.col("best"), F.lit(big) - F.col("best")).alias("regret"))


def apply_insertions(stops: DataFrame, chosen: DataFrame) -> DataFrame:
    """Routes with the chosen nodes put behind position seq and renumbered; several behind one position come in student order."""
    old = stops.select("route_id", "node_id", F.struct(F.col("seq").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("k"))
    new = chosen.select("route_id", "node_id", F.struct(F.col("seq").alias("a"), F.lit(1).alias("b"), F.col("student_id").cast("string").alias("c")).alias("k"))
    rows = old.unionByName(new)
    return rows.select("route_id", (F.row_number().over(_by("route_id", "k")) - 1).alias("seq"), "node_id")


def dangerous_runs(edges: DataFrame, max_m: float = 150.0) -> DataFrame:
    """(path_id, run, first_seq, last_seq, metres, marker_seq) of maximal runs of dangerous edges shorter than max_m.

    `edges`: (path_id, seq, metres, dangerous), seq without gaps; the marker is the edge at which half of the
    run's length is reached. Gaps and islands: among dangerous edges, seq minus row number is constant in a run.
    """
    bad = edges.where("dangerous")
    island = bad.withColumn("island", F.col("seq") - F.row_number().over(Window.partitionBy("path_id").orderBy("seq")))
    key = Window.partitionBy("path_id", "island")
    so_far = key.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = island.withColumn("total", F.sum("metres").over(key)).withColumn("cumulative", F.sum("metres").over(so_far))
    runs = marked.groupBy("path_id", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("total").alias("metres"), F.min(F.when(F.col("cumulative") >= F.col("total") / 2, F.col("seq"))).alias("marker_seq"))
    return runs.where(F.col("metres") < max_m).select("path_id", "first_seq", "last_seq", "metres", "marker_seq")


def best_so_far(log: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds best (running maximum) and stalled (rows since it last rose) to a log."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rises = F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True))
    out = log.withColumn("best", F.max(value).over(w)).withColumn("__up", rises).withColumn("__era", F.sum(F.col("__up").cast("int")).over(w))
    return out.withColumn("stalled", F.row_number().over(Window.partitionBy(group, "__era").orderBy(order)) - 1).drop("__up", "__era")


def _improved(order: list, cost: dict, epsilon: float) -> tuple[list, float, float]:
    """First-improvement 2-opt of the interior: (order, minutes, saved).

    Legs are directed, so a reversed segment is priced by prefix sums of its legs run backwards. Infinite legs count
    as a large number there, since sums of infinities can't be compared; the minutes returned are infinite with one.
    """
    far = 1e9
    price = lambda a, b: min(far, cost.get((a, b), 0.0 if a == b else far))
    blocked = lambda seq: sum(cost.get(x) == float("inf") for x in zip(seq, seq[1:]))
    n, saved, start = len(order), 0.0, blocked(order)
    while True:
        forth = [0.0, *accumulate(price(a, b) for a, b in zip(order, order[1:]))]
        back = [0.0, *accumulate(price(b, a) for a, b in zip(order, order[1:]))]
        for i in range(1, n - 2):
            for j in range(i + 1, n - 1):
                old = forth[j + 1] - forth[i - 1]
                new = price(order[i - 1], order[j]) + back[j] - back[i] + price(order[i], order[j + 1])
                if new < old - epsilon:
                    break
            else:
                continue
            break
        else:
            left = blocked(order)
            return order, float("inf") if left else forth[-1], float("inf") if left < start else saved
        order = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
        saved += old - new


def _two_opt_rows(epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, totals, saved = [], [], []
            for nodes, src, dst, minutes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                order, best, gain = _improved(nodes, dict(zip(zip(src or (), dst or ()), minutes or ())), epsilon)
                orders.append(order)
                totals.append(best)
                saved.append(gain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(orders, batch.column(1).type), pa.array(totals, pa.float64()), pa.array(saved, pa.float64())], names=["route_id", "nodes", "total_min", "saved_min"])

    return run


def two_opt(stops: DataFrame, od: DataFrame | Callable[[Column, Column], Column], epsilon: float = 0.01) -> DataFrame:
    """(route_id, seq, node_id, total_min, saved_min): interior segments reversed while that saves over `epsilon` minutes.

    `od` is a matrix (src, dst, minutes), or a function that prices two columns of nodes; the latter needs no join.

    The moves depend on each other, so a route is worked on as a whole: one row holds its stops and the pairs of
    its own stops (a route's length bounds both), and rows go through Python in Arrow batches. Pairs that the
    matrix lacks are unreachable.
    """
    ordered = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("s")).select("route_id", F.col("s.node_id").alias("nodes"))
    if callable(od):
        own = F.array_distinct("nodes")
        pairs = F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: F.struct(a.alias("src"), b.alias("dst"), od(a, b).alias("minutes")))))
        rows = ordered.withColumn("c", pairs)
    else:
        sources = stops.select(F.col("route_id").alias("pair_route"), F.col("node_id").alias("src")).distinct()
        targets = stops.select(F.col("route_id").alias("pair_route"), F.col("node_id").alias("dst")).distinct()
        priced = sources.join(targets, "pair_route").join(od.select("src", "dst", "minutes"), ["src", "dst"])
        costs = priced.groupBy("pair_route").agg(F.collect_list(F.struct("src", "dst", "minutes")).alias("c"))
        rows = ordered.join(costs, F.col("route_id") == F.col("pair_route"), "left")
    rows = rows.select("route_id", "nodes", F.col("c.src").alias("src"), F.col("c.dst").alias("dst"), F.col("c.minutes").alias("minutes"))
    kind = dict(stops.dtypes)
    done = rows.mapInArrow(_two_opt_rows(epsilon), f"route_id {kind['route_id']}, nodes array<{kind['node_id']}>, total_min double, saved_min double")
    return done.select("route_id", F.posexplode("nodes").alias("seq", "node_id"), "total_min", "saved_min")


def without_students(riders: DataFrame, stops: DataFrame, gone: DataFrame) -> DataFrame:
    """Stops (route_id, seq, node_id) of routes whose riders (route_id, seq, student_id) lose the students in `gone` (student_id).

    A pickup at which nobody is left is dropped and the rest renumbered; the ends of a route stay, and so do pickups
    at which nobody boarded before.
    """
    left = riders.join(gone.select("student_id").distinct(), "student_id", "left_anti").select("route_id", "seq").distinct()
    had = riders.select("route_id", "seq").distinct()
    empty = had.join(left, ["route_id", "seq"], "left_anti")
    return stops.join(empty, ["route_id", "seq"], "left_anti").select("route_id", (F.row_number().over(_by("route_id", "seq")) - 1).alias("seq"), "node_id")


def stops_used(stops: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, stops_used): distinct nodes with a pickup of routes that are in use."""
    return stops.where("is_pickup").groupBy(*groups).agg(F.count_distinct("node_id").alias("stops_used"))
