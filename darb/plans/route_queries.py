"""Queries over routes, riders and requests, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from darb.functions import scalars
from darb.functions.geo import angle_difference, bbox_radius_m, bearing_deg, crossing_angle_ok, equirectangular_m, haversine_m, segment_distance
from darb.operators import insertions, metrics, routes, spatial
from darb.plans import views
from darb.plans.views import with_views
from darb.session import durable, table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Great-circle metres between p and t in DuckDB SQL.
HAVERSINE = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2))))"


def r6(name: str):
    return F.round(name, 6).alias(name)


# ---------------------------------------------------------------- rides and routes


@query(with_views("rides") + "SELECT route_id, seq, round(ride_min, 6) AS ride_min, round(ride_m, 6) AS ride_m FROM rides WHERE seq > 0")
def q_am_ride_suffix(spark, sf):
    return views.rides(spark, sf).where("seq > 0").select("route_id", "seq", r6("ride_min"), r6("ride_m"))


@query(
    with_views("od")
    + """, back AS (
  SELECT route_id, seq, node_id, coalesce(lag(node_id) OVER (PARTITION BY route_id ORDER BY seq DESC), 0) AS prev FROM route_stops WHERE is_pickup)
SELECT route_id, seq, node_id, round(sum(minutes) OVER (PARTITION BY route_id ORDER BY seq DESC), 6) AS ride_min
FROM back LEFT JOIN od ON prev = src AND node_id = dst"""
)
def q_pm_ride_prefix(spark, sf):
    return routes.evening_rides(views.route_stops(spark, sf), views.od_matrix(spark, sf)).withColumn("ride_min", F.round("ride_min", 6))


@query(with_views("route_stops") + "SELECT route_id, seq, sum(is_pickup::INT) OVER (PARTITION BY route_id ORDER BY seq)::BIGINT AS pickup_order FROM route_stops")
def q_pickup_order(spark, sf):
    return routes.pickup_order(views.route_stops(spark, sf)).select("route_id", "seq", "pickup_order")


@query(
    with_views("legs")
    + """SELECT route_id, CASE WHEN bool_or(isinf(minutes)) THEN 9999.0 ELSE round(sum(minutes), 6) END AS total_min,
  CASE WHEN bool_or(isinf(minutes)) THEN 0.0 ELSE round(sum(metres) / 1000, 6) END AS total_km FROM legs GROUP BY route_id"""
)
def q_route_totals(spark, sf):
    return routes.route_totals(routes.legs(views.route_stops(spark, sf), views.od_matrix(spark, sf))).select("route_id", r6("total_min"), r6("total_km"))


@query(with_views("visits") + "SELECT route_id, min(CASE WHEN walk_m > 200 THEN seq END) AS first_seq FROM visits GROUP BY route_id")
def q_first_boarding(spark, sf):
    return routes.first_boarding(views.visits(spark, sf).withColumn("boards", F.greatest(F.col("walk_m") - 200, F.lit(0))), "boards")


@query(with_views("visits") + "SELECT route_id, seq, direct_min, CASE WHEN direct_min <= 0 THEN 45.0 ELSE greatest(45.0, direct_min + 30) END AS cap_min, greatest(45.0, least(2.5 * direct_min, direct_min + 60)) AS old_cap_min FROM visits")
def q_ride_caps(spark, sf):
    return views.visits(spark, sf).select("route_id", "seq", "direct_min", scalars.ride_cap("direct_min", 45.0, 30.0).alias("cap_min"), scalars.stretched_cap("direct_min", 2.5, 45.0, 60.0).alias("old_cap_min"))


_CAP = "CASE WHEN direct_min <= 0 THEN 10.0 ELSE greatest(10.0, direct_min + 5) END"


@query(
    with_views("riders")
    + f"""SELECT mode, count(CASE WHEN ride_min IS NOT NULL THEN 1 END) AS checked, count(CASE WHEN ride_min > {_CAP} THEN 1 END) AS violations,
  round(count(CASE WHEN ride_min > {_CAP} THEN 1 END) * 100.0 / count(CASE WHEN ride_min IS NOT NULL THEN 1 END), 6) AS violation_pct FROM riders GROUP BY mode"""
)
def q_cap_violations(spark, sf):
    capped = views.riders(spark, sf, ("mode", "direct_min")).withColumn("cap_min", scalars.ride_cap("direct_min", 10.0, 5.0))
    return metrics.cap_violations(capped, ["mode"]).withColumn("violation_pct", F.round("violation_pct", 6))


@query(
    with_views("riders", "od")
    + f""", back AS (
  SELECT route_id, seq, node_id, coalesce(lag(node_id) OVER (PARTITION BY route_id ORDER BY seq DESC), 0) AS prev FROM route_stops WHERE is_pickup),
pm AS (SELECT route_id, seq, sum(minutes) OVER (PARTITION BY route_id ORDER BY seq DESC) AS pm_min FROM back LEFT JOIN od ON prev = src AND node_id = dst)
SELECT route_id, count(CASE WHEN ride_min <= {_CAP} OR pm_min <= {_CAP} THEN 1 END) AS lenient, count(CASE WHEN ride_min <= {_CAP} THEN 1 END) AS strict
FROM riders JOIN pm USING (route_id, seq) GROUP BY route_id"""
)
def q_satisfied_per_route(spark, sf):
    both = views.riders_both_ways(spark, sf, ("direct_min",))
    cap = scalars.ride_cap("direct_min", 10.0, 5.0)
    return both.groupBy("route_id").agg(F.count_if((F.col("ride_min") <= cap) | (F.col("pm_min") <= cap)).alias("lenient"), F.count_if(F.col("ride_min") <= cap).alias("strict"))


@query(
    with_views("riders")
    + """SELECT mode, round(avg(x), 6) AS mean_ratio, round(stddev_pop(x), 6) AS std_ratio, round(max(x), 6) AS max_ratio, count(*) - count(x) AS missing
FROM (SELECT mode, CASE WHEN direct_min > 0 AND NOT isinf(ride_min) THEN ride_min / direct_min END AS x FROM riders) GROUP BY mode"""
)
def q_ride_ratio(spark, sf):
    return metrics.ride_ratio(views.riders(spark, sf, ("mode", "direct_min")), ["mode"]).select("mode", r6("mean_ratio"), r6("std_ratio"), r6("max_ratio"), "missing")


@query(
    with_views("visits")
    + """SELECT mode, round(avg(walk_m), 6) AS avg_m, median(walk_m) AS median_m, max(walk_m) AS max_m, min(walk_m) AS min_m, round(avg(walk_m) / 80, 6) AS avg_min,
  round(avg(CASE WHEN lim > 0 THEN least(walk_m / lim, 1.0) * 100 END), 6) AS used_pct FROM (SELECT *, ((student_id % 4) * 150)::DOUBLE AS lim FROM visits) GROUP BY mode"""
)
def q_walk_stats(spark, sf):
    v = views.visits(spark, sf).withColumn("walk_limit_m", ((F.col("student_id") % 4) * 150).cast("double"))
    return metrics.walk_statistics(v, ["mode"]).select("mode", r6("avg_m"), "median_m", "max_m", "min_m", r6("avg_min"), r6("used_pct"))


@query(with_views("visits") + "SELECT mode, count(CASE WHEN walk_m < 300 THEN 1 END)::BIGINT AS served, count(*) AS total, round(avg((walk_m < 300)::INT), 6) AS rate FROM visits GROUP BY mode")
def q_service_rate(spark, sf):
    return metrics.service_rate(views.visits(spark, sf).withColumn("served", F.col("walk_m") < 300), ["mode"]).withColumn("rate", F.round("rate", 6))


@query(with_views("visits") + "SELECT status, round(avg(n / cap), 6) AS utilisation FROM (SELECT route_id, min(status) AS status, count(*) AS n, (5 + route_id % 4)::DOUBLE AS cap FROM visits GROUP BY route_id) GROUP BY status")
def q_fleet_utilisation(spark, sf):
    loads = views.visits(spark, sf).groupBy("route_id").agg(F.min("status").alias("status"), F.count("*").alias("load")).withColumn("capacity", (5 + F.col("route_id") % 4).cast("double"))
    return metrics.utilisation(loads, ["status"]).withColumn("utilisation", F.round("utilisation", 6))


@query(
    with_views("riders")
    + """, t AS (SELECT route_id, CASE WHEN bool_or(isinf(ride_min)) THEN 9999.0 ELSE max(ride_min) END AS m FROM riders GROUP BY route_id)
SELECT (SELECT count(*) FROM riders WHERE walk_m < 300) AS served, (SELECT count(*) FROM t) AS routes,
  round(10000.0 * (SELECT count(*) FROM riders WHERE walk_m < 300) - 5000.0 * (SELECT count(*) FROM t) - (SELECT sum(m) FROM t)
    - (SELECT sum(CASE WHEN walk_m <= 100 THEN 0 WHEN walk_m > 300 THEN 5000 ELSE (walk_m - 100) / 100 * 2 END) FROM riders WHERE walk_m < 300), 4) AS objective"""
)
def q_objective(spark, sf):
    r = views.riders(spark, sf, ("walk_m",))
    served = F.col("walk_m") < 300
    penalty = F.when(served, scalars.walk_penalty("walk_m", 100.0))
    per = r.groupBy("route_id").agg(F.count_if(served).alias("served"), F.when(F.max("ride_min") == float("inf"), scalars.UNREACHABLE_MIN).otherwise(F.max("ride_min")).alias("m"), F.sum(F.when(penalty == float("inf"), 5000.0).otherwise(penalty)).alias("p"))
    return per.agg(F.sum("served").alias("served"), F.count("*").alias("routes"), F.round(10000.0 * F.sum("served") - 5000.0 * F.count("*") - F.sum("m") - F.sum("p"), 4).alias("objective"))


@query(
    with_views("visits", "students")
    + """, t AS (SELECT s.stage, CASE WHEN tier IN ('none','tertiary','secondary','primary_plus') THEN tier ELSE 'unknown' END AS tier FROM visits v JOIN students s ON s.student_id = v.student_id),
c AS (SELECT coalesce(stage, '(all)') AS stage, count(*) AS served, """
    + ", ".join(f"count(CASE WHEN tier = '{t}' THEN 1 END) AS n_{t}" for t in scalars.TIERS)
    + " FROM t GROUP BY ROLLUP (stage)) SELECT *, "
    + ", ".join(f"round(n_{t} / served, 4) AS share_{t}" for t in scalars.TIERS)
    + " FROM c"
)
def q_crossing_tier_share_rollup(spark, sf):
    joined = views.visits(spark, sf).join(views.students(spark, sf).select("student_id", "stage"), "student_id")
    return metrics.tier_shares(joined)


@query(
    with_views("visits")
    + """SELECT student_id, CASE max(CASE tier WHEN 'none' THEN 0 WHEN 'tertiary' THEN 1 WHEN 'secondary' THEN 2 WHEN 'primary_plus' THEN 3 ELSE 4 END)
  WHEN 0 THEN 'none' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'primary_plus' ELSE 'unknown' END AS tier FROM visits GROUP BY student_id"""
)
def q_tier_max_by(spark, sf):
    return metrics.highest_tier(views.visits(spark, sf))


@query(with_views("route_stops") + ", e AS (SELECT route_id, node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS v FROM route_stops) SELECT least(u, v) AS lo, greatest(u, v) AS hi, count(DISTINCT route_id) AS students, count(DISTINCT route_id % 7) AS homes, count(*) AS uses FROM e WHERE v IS NOT NULL GROUP BY 1, 2")
def q_edge_usage_distinct(spark, sf):
    s = views.route_stops(spark, sf)
    e = s.select(F.col("route_id").alias("student_id"), F.col("node_id").alias("u"), F.lead("node_id").over(Window.partitionBy("route_id").orderBy("seq")).alias("v"), (F.col("route_id") % 7).alias("home")).where("v IS NOT NULL")
    return metrics.edge_usage(e)


@query(with_views("visits") + "SELECT mode, round(100.0 * count(CASE WHEN walk_m > 400 THEN 1 END) / count(CASE WHEN student_id % 3 > 0 THEN 1 END), 6) AS used_pct, round(100.0 * least(count(CASE WHEN walk_m > 400 OR student_id % 5 = 0 THEN 1 END), count(CASE WHEN student_id % 3 > 0 THEN 1 END)) / count(CASE WHEN student_id % 3 > 0 THEN 1 END), 6) AS considered_pct FROM visits GROUP BY mode")
def q_used_crossing_pct(spark, sf):
    v = views.visits(spark, sf).select("mode", (F.col("walk_m") > 400).alias("used"), (F.col("student_id") % 5 == 0).alias("considered"), (F.col("student_id") % 3 > 0).alias("eligible"))
    return metrics.used_and_considered(v, ["mode"]).select("mode", r6("used_pct"), r6("considered_pct"))


# ---------------------------------------------------------------- insertions


def _candidates(spark, sf):
    """(student_id, node_id, walk_m, radius): the stop nearest to a student's home, and all others within the student's walk."""
    s = views.students(spark, sf).withColumnRenamed("student_id", "key")
    at = views.stops(spark, sf).select(F.col("node_id").cast("bigint").alias("target"), "lat", "lon")
    both = spatial.nearest(s, at).select("key", "target", "metres").unionByName(spatial.within(s, at).select("key", "target", "metres"))
    once = both.groupBy("key", "target").agg(F.min("metres").alias("walk_m"))
    # asked for twice, for the nodes and for the students that take over their sums
    return durable(once.join(s.select("key", "radius"), "key").select(F.col("key").alias("student_id"), F.col("target").alias("node_id"), "walk_m", "radius"))


def _rows(spark, sf):
    return insertions.route_rows(routes.legs(views.route_stops(spark, sf), views.od_matrix(spark, sf)))


def minutes_sql(a: str, b: str) -> str:
    """views.travel_minutes in DuckDB SQL."""
    return f"CASE WHEN ({a} * 13 + {b} * 7) % 97 = 0 THEN 'Infinity'::DOUBLE ELSE (({a} * 31 + {b} * 17) % 600) / 100.0::DOUBLE + 1.0 END"


#: A student's nearest stop and those within the walk (cand), and these stops against every leg of every route (ins).
INSERTIONS = with_views("students", "stops", "legs") + f""", far AS (
  SELECT p.student_id, p.radius, t.node_id, {HAVERSINE} AS walk_m FROM students p, stops t),
cand AS (
  SELECT student_id, node_id, radius, walk_m FROM far WHERE walk_m <= radius
  UNION SELECT student_id, arg_min(node_id, (walk_m, node_id)), min(radius), min(walk_m) FROM far GROUP BY 1),
pos AS (
  SELECT n.node_id, l.route_id, l.seq, l.src, l.dst, l.minutes AS uv, {minutes_sql("l.src", "n.node_id")} AS uc, {minutes_sql("n.node_id", "l.dst")} AS cv
  FROM (SELECT DISTINCT node_id FROM cand) n, legs l),
ins AS (SELECT *, uc + cv - uv AS delta FROM pos WHERE NOT isinf(uc) AND NOT isinf(cv) AND NOT isinf(uv))
"""


@query(
    INSERTIONS
    + """, n AS (SELECT node_id, count(*) AS options, min(delta) AS delta FROM ins GROUP BY 1)
SELECT student_id, sum(options)::BIGINT AS options, round(min(delta), 6) AS delta FROM cand JOIN n USING (node_id) GROUP BY 1"""
)
def q_insertion_argmin(spark, sf):
    c = _candidates(spark, sf).select("student_id", "node_id", F.lit(float("inf")).alias("cap_min"))
    found = insertions.student_insertions(insertions.best_positions(_rows(spark, sf), c, views.travel_minutes_of, "free"), c)
    options = found.groupBy("student_id").agg(F.sum("options").alias("options"))
    return routes.cheapest(found).join(options, "student_id").select("student_id", "options", r6("delta"))


@query(
    INSERTIONS
    + """, pr AS (SELECT node_id, route_id, min(delta) AS c FROM ins GROUP BY 1, 2),
two AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY c, route_id) AS n FROM pr),
r AS (SELECT student_id, route_id, min(c) AS c FROM cand JOIN two USING (node_id) WHERE n <= 2 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY c, route_id) AS n FROM r)
SELECT student_id, round(min(c), 6) AS best, round(coalesce(max(CASE WHEN n = 2 THEN c END) - min(c), 2000 - min(c)), 6) AS regret FROM k GROUP BY student_id"""
)
def q_regret_k(spark, sf):
    return routes.regret(insertions.cheapest_routes(_rows(spark, sf), _candidates(spark, sf).select("student_id", "node_id"), views.travel_minutes_of)).select("student_id", r6("best"), r6("regret"))


@query()
def q_two_opt(spark, sf):
    return routes.two_opt(views.route_stops(spark, sf), views.travel_minutes)


@query(
    with_views("visits")
    + """, e AS (SELECT route_id AS path_id, seq, walk_m / 5 AS metres, node_id % 3 > 0 AS dangerous FROM visits),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY path_id ORDER BY seq) AS island FROM e WHERE dangerous),
m AS (SELECT *, sum(metres) OVER (PARTITION BY path_id, island) AS total, sum(metres) OVER (PARTITION BY path_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM i)
SELECT path_id, min(seq) AS first_seq, max(seq) AS last_seq, round(max(total), 6) AS metres, min(CASE WHEN cum >= total / 2 THEN seq END) AS marker_seq FROM m GROUP BY path_id, island HAVING max(total) < 150"""
)
def q_dangerous_runs(spark, sf):
    v = views.visits(spark, sf).select(F.col("route_id").alias("path_id"), "seq", (F.col("walk_m") / 5).alias("metres"), (F.col("node_id") % 3 > 0).alias("dangerous"))
    return routes.dangerous_runs(v).withColumn("metres", F.round("metres", 6))


@query(
    """WITH l AS (SELECT user_id, event_id, value FROM events),
b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l),
e AS (SELECT *, sum(CASE WHEN prev IS NULL OR value > prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS era FROM b)
SELECT user_id, event_id, best, (row_number() OVER (PARTITION BY user_id, era ORDER BY event_id) - 1)::INT AS stalled FROM e"""
)
def q_convergence_best(spark, sf):
    return routes.best_so_far(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", "stalled")


@query(
    with_views("visits")
    + """, c AS (SELECT student_id, node_id, min(walk_m) AS walk_m, max(seq % 3) AS points FROM visits GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY points DESC, walk_m, node_id)::INT AS rank FROM c) SELECT student_id, node_id, points, walk_m, rank FROM t WHERE rank <= 15"""
)
def q_candidate_topk(spark, sf):
    c = views.visits(spark, sf).groupBy("student_id", "node_id").agg(F.min("walk_m").alias("walk_m"), F.max(F.col("seq") % 3).alias("points"))
    return metrics.top_k(c, ["student_id"], [F.desc("points"), F.asc("walk_m"), F.asc("node_id")], 15).select("student_id", "node_id", "points", "walk_m", "rank")


@query(
    with_views("visits")
    + """, c AS (SELECT student_id, node_id, min(seq) AS rank FROM visits GROUP BY 1, 2), p AS (SELECT node_id, count(DISTINCT student_id) AS popularity FROM c GROUP BY 1)
SELECT student_id, node_id, popularity, row_number() OVER (PARTITION BY student_id ORDER BY (popularity >= 2) DESC, popularity DESC, rank, node_id)::INT AS new_rank FROM c JOIN p USING (node_id)"""
)
def q_shared_boost(spark, sf):
    return metrics.shared_boost(views.visits(spark, sf).groupBy("student_id", "node_id").agg(F.min("seq").alias("rank")))


# ---------------------------------------------------------------- scalars and geometry


@query(
    with_views("students", "stops")
    + """SELECT student_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(30 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30)) * pow(sin(radians(31.2 - lon) / 2), 2))), 4) AS metres,
  round(sqrt(pow((30 - lat) * 111000, 2) + pow((31.2 - lon) * 111000 * cos(radians(lat)), 2)), 4) AS flat_m,
  CASE WHEN lat = 30.0 AND lon = 31.2 THEN NULL ELSE round((degrees(atan2(31.2::DOUBLE - lon, 30.0::DOUBLE - lat)) + 360) - 360 * floor((degrees(atan2(31.2::DOUBLE - lon, 30.0::DOUBLE - lat)) + 360) / 360), 4) END AS bearing FROM students"""
)
def q_geo_scalars(spark, sf):
    s = views.students(spark, sf)
    return s.select("student_id", F.round(haversine_m("lat", "lon", 30.0, 31.2), 4).alias("metres"), F.round(equirectangular_m("lat", "lon", 30.0, 31.2), 4).alias("flat_m"), F.round(bearing_deg("lat", "lon", 30.0, 31.2), 4).alias("bearing"))


@query(
    """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 360)::DOUBLE AS x, (l_suppkey * 7 % 360)::DOUBLE AS y FROM lineitem),
d AS (SELECT *, abs((x - y + 180) - 360 * floor((x - y + 180) / 360) - 180) AS d FROM a)
SELECT d AS difference, count(*) AS n, count(CASE WHEN abs(least(d, 180 - d) - 90) <= 30 THEN 1 END) AS crossing FROM d GROUP BY d"""
)
def q_angles(spark, sf):
    x, y = (F.col("l_partkey") % 360).cast("double"), (F.col("l_suppkey") * 7 % 360).cast("double")
    a = table(spark, sf, "lineitem").select(angle_difference(x, y).alias("difference"), crossing_angle_ok(x, y).alias("ok"))
    return a.groupBy("difference").agg(F.count("*").alias("n"), F.count_if("ok").alias("crossing"))


@query(
    with_views("students")
    + """, s AS (SELECT student_id, lon AS px, lat AS py, 31.1::DOUBLE AS ax, 29.9::DOUBLE AS ay, 31.3::DOUBLE AS bx, 30.05::DOUBLE AS b_y FROM students),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM s)
SELECT student_id, round(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (b_y - ay)), 2)), 8) AS degrees FROM t"""
)
def q_segment_distance(spark, sf):
    return views.students(spark, sf).select("student_id", F.round(segment_distance("lon", "lat", 31.1, 29.9, 31.3, 30.05), 8).alias("degrees"))


@query("SELECT c_custkey, round(greatest(0, walk) / 80, 6) AS minutes, CASE WHEN walk <= r THEN 0.0 WHEN walk > (CASE WHEN r <= 0 THEN 500 ELSE least(3 * r, 500) END) THEN 'Infinity'::DOUBLE ELSE round((walk - r) / (CASE WHEN r > 0 THEN r ELSE 50 END) * 2, 6) END AS penalty FROM (SELECT c_custkey, (c_custkey % 700)::DOUBLE AS walk, ((c_custkey % 4) * 100)::DOUBLE AS r FROM customer)")
def q_walk_penalty(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 700).cast("double").alias("walk"), ((F.col("c_custkey") % 4) * 100).cast("double").alias("r"))
    return c.select("c_custkey", F.round(F.greatest(F.lit(0.0), "walk") / scalars.WALK_M_PER_MIN, 6).alias("minutes"), F.round(scalars.walk_penalty("walk", "r"), 6).alias("penalty"))


@query("SELECT p_partkey, trim(regexp_replace(translate(lower(trim(p_name)), '-_/', '   '), ' +', ' ', 'g')) AS name, length(p_name) AS n FROM part")
def q_road_name_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.road_name("p_name").alias("name"), F.length("p_name").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS total, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS numbers FROM events GROUP BY event_type""")
def q_props_json(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(k), 6).alias("total"), F.count(k).alias("numbers"))


@query("SELECT output_id, CAST(try_strptime(upper(trim(generated_at)), '%d/%m/%y %I:%M %p') AS TIMESTAMP) AS at FROM (SELECT DISTINCT output_id, generated_at FROM run_output)")
def q_run_timestamps(spark, sf):
    return table(spark, sf, "run_output").select("output_id", "generated_at").distinct().select("output_id", scalars.run_timestamp("generated_at").cast("timestamp_ntz").alias("at"))


@query("""SELECT CASE WHEN lower(trim(mode_key)) = 'constrained' THEN 'strictly_constrained' WHEN lower(trim(mode_key)) = 'unconstrained' THEN 'weakly_constrained' ELSE coalesce(nullif(lower(trim(mode_key)), ''), 'unknown') END AS mode_key, count(*) AS n FROM raw_metrics_tidy GROUP BY 1""")
def q_mode_keys(spark, sf):
    return table(spark, sf, "raw_metrics_tidy").groupBy(scalars.mode_key("mode_key").alias("mode_key")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, round(greatest(a, b), 3) AS radius_m FROM (SELECT n_nationkey, 2 * 6371000 * asin(sqrt(pow(sin(radians(0.1 + n_nationkey / 100.0) / 2), 2) + cos(radians(30)) * cos(radians(29.9 - n_nationkey / 100.0)) * pow(sin(radians(0.2) / 2), 2))) AS a, 2 * 6371000 * asin(sqrt(pow(sin(radians(0.1 + n_nationkey / 100.0) / 2), 2) + cos(radians(30)) * cos(radians(30.1 + n_nationkey / 100.0)) * pow(sin(radians(0.2) / 2), 2))) AS b FROM nation)")
def q_bbox_radius(spark, sf):
    half = F.lit(0.1) + F.col("n_nationkey") / 100.0
    return table(spark, sf, "nation").select("n_nationkey", F.round(bbox_radius_m(30.0 - half, 31.0, 30.0 + half, 31.4), 3).alias("radius_m"))
