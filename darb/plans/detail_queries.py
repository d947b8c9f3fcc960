"""Further queries of the routing domain: feasibility, savings, boxes, quartiles, bundles, counts; with DuckDB twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from darb.functions import scalars
from darb.operators import graph, insertions, metrics, population, routes, shred, spatial
from darb.plans import views
from darb.plans.route_queries import INSERTIONS, _candidates, minutes_sql, r6
from darb.plans.run_queries import _M, _ROAD, _streets, metrics_table
from darb.plans.views import with_views
from darb.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Rides both ways (inf where a leg is unreachable), and the riders on board before each position: their ride as it is, and what lies between the position and them on the way back.
_RIDES = INSERTIONS + f""", way AS (
  SELECT *, {minutes_sql("dst", "src")} AS back_min FROM legs),
rides AS (
  SELECT *, sum(minutes) OVER w AS ride_min, sum(back_min) OVER w AS pm_min, coalesce(sum(minutes) OVER x, 0) AS rest, coalesce(sum(back_min) OVER x, 0) AS rest_back FROM way
  WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), x AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
board AS (
  SELECT l.route_id, l.seq, r.seq AS boards, 25 + v.student_id % 20 AS cap, any_value(r.ride_min) AS ride_min, coalesce(sum(b.back_min), 0) AS between_min
  FROM rides l JOIN rides r ON r.route_id = l.route_id AND r.seq BETWEEN 1 AND l.seq JOIN visits v ON v.route_id = r.route_id AND v.seq = r.seq
  LEFT JOIN rides b ON b.route_id = l.route_id AND b.seq >= r.seq AND b.seq < l.seq GROUP BY ALL),
open_ AS (SELECT route_id FROM visits GROUP BY 1 HAVING count(*) < 6),
full_pos AS (
  SELECT i.node_id, i.route_id, i.seq, i.delta, cv + rest AS am, {minutes_sql("i.dst", "i.node_id")} + rest_back AS pm, {minutes_sql("i.dst", "i.node_id")} + rest_back + {minutes_sql("i.node_id", "i.src")} AS detour
  FROM ins i JOIN rides USING (route_id, seq) WHERE i.route_id IN (SELECT route_id FROM open_))
"""


def _feasible(riders: str, own: str) -> str:
    """Options and least minutes per student; `riders` is when an earlier rider's cap breaks, `own` when the student's own holds."""
    return f""", broken AS (SELECT DISTINCT p.node_id, p.route_id, p.seq FROM full_pos p JOIN board USING (route_id, seq) WHERE {riders}),
good AS (SELECT * FROM full_pos ANTI JOIN broken USING (node_id, route_id, seq)),
per AS (SELECT node_id, cap_min, count(*) AS options, min(delta) AS delta FROM good JOIN (SELECT DISTINCT node_id, 30 + student_id % 10 AS cap_min FROM cand) USING (node_id) WHERE {own} GROUP BY 1, 2)
"""


_E = "+ 1e-9"
_EITHER = _RIDES + _feasible(f"ride_min + delta > cap {_E} AND detour + between_min > cap {_E}", f"am <= cap_min {_E} OR pm <= cap_min {_E}")
_BOTH = _RIDES.replace("25 + v.student_id % 20 AS cap", "40 AS cap") + _feasible(f"ride_min + delta > cap {_E} OR detour + between_min > cap {_E}", f"am <= 40 {_E} AND pm <= 40 {_E}")
_PER_STUDENT = "SELECT student_id, sum(options)::BIGINT AS options, round(min(delta), 6) AS delta FROM cand JOIN per ON per.node_id = cand.node_id AND cap_min = 30 + student_id % 10 GROUP BY 1"


def _rule_positions(spark, sf, rule, rider_cap, own_cap):
    """Candidates of each student with the positions that keep all caps by the rule."""
    legs = routes.legs_both_ways(views.route_stops(spark, sf, "student_id"), views.od_matrix(spark, sf), ("student_id",))
    seats = views.visits(spark, sf).groupBy("route_id").agg(F.count("*").alias("load")).withColumn("capacity", F.lit(6))
    rows = insertions.route_rows(legs, F.when(F.col("student_id").isNotNull(), rider_cap), seats)
    c = _candidates(spark, sf).withColumn("cap_min", own_cap.cast("double"))
    return insertions.student_insertions(insertions.best_positions(rows, c, views.travel_minutes_of, rule), c)


def _summary(found):
    return found.groupBy("student_id").agg(F.sum("options").alias("options"), F.round(F.min("delta"), 6).alias("delta"))


@query(_EITHER + _PER_STUDENT)
def q_feasible_insertions(spark, sf):
    """Positions that keep everyone's cap in the morning or on the way back."""
    return _summary(_rule_positions(spark, sf, "either", F.lit(25) + F.col("student_id") % 20, F.lit(30) + F.col("student_id") % 10))


@query(_BOTH + _PER_STUDENT)
def q_feasible_fixed_cap(spark, sf):
    """Positions that keep one fixed cap for everyone, in the morning and on the way back."""
    return _summary(_rule_positions(spark, sf, "both", F.lit(40), F.lit(40)))


@query(
    _EITHER
    + """, top AS (SELECT node_id, cap_min, (SELECT 1) AS one, min(struct_pack(delta := delta, route_id := route_id, seq := seq)) AS b FROM good JOIN (SELECT DISTINCT node_id, 30 + student_id % 10 AS cap_min FROM cand) USING (node_id) WHERE am <= cap_min + 1e-9 OR pm <= cap_min + 1e-9 GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN walk_m <= radius THEN 0.0 WHEN walk_m > (CASE WHEN radius <= 0 THEN 500 ELSE least(3 * radius, 500) END) THEN 'Infinity'::DOUBLE ELSE (walk_m - radius) / (CASE WHEN radius > 0 THEN radius ELSE 50 END) * 2 END AS penalty FROM cand),
c AS (SELECT w.student_id, b.delta + penalty AS cost, b.route_id AS route_id, b.seq AS seq, w.node_id FROM w JOIN top ON top.node_id = w.node_id AND cap_min = 30 + student_id % 10 WHERE NOT isinf(penalty)),
r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY cost, route_id, seq, node_id) AS n FROM c)
SELECT student_id, route_id, seq::BIGINT AS seq, node_id, round(cost, 6) AS cost FROM r WHERE n = 1"""
)
def q_cheapest_insertion(spark, sf):
    """The whole choice: candidates within the walk, all positions, everyone's caps, minutes plus walk penalty, the least for each student."""
    found = _rule_positions(spark, sf, "either", F.lit(25) + F.col("student_id") % 20, F.lit(30) + F.col("student_id") % 10)
    priced = found.withColumn("cost", F.col("delta") + scalars.walk_penalty("walk_m", "radius")).where(F.col("cost") < float("inf"))
    return routes.cheapest(priced, "cost").select("student_id", "route_id", "seq", "node_id", F.round("cost", 6).alias("cost"))


@query(
    with_views("legs")
    + f""", a AS (SELECT route_id, seq, src AS node_id, lag(src) OVER w AS before, dst AS after, lag(minutes) OVER w + minutes AS through FROM legs WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
x AS (SELECT *, {minutes_sql("before", "after")} AS around FROM a WHERE before IS NOT NULL)
SELECT route_id, seq, node_id, round(through - around, 6) AS saved_min FROM x WHERE NOT isinf(through) AND NOT isinf(around)"""
)
def q_removal_savings(spark, sf):
    stops = views.route_stops(spark, sf)
    s = routes.removal_savings(routes.legs(stops, views.od_matrix(spark, sf)), views.priced(routes.pairs_around(stops)))
    # unreachable legs have no meaningful savings
    return s.where("saved_min IS NULL OR (NOT isnan(saved_min) AND abs(saved_min) < double('infinity'))").withColumn("saved_min", F.round("saved_min", 6))


@query(with_views("students", "stops") + "SELECT student_id AS key, node_id AS box FROM students p JOIN stops s ON p.lon BETWEEN s.lon - 0.012 AND s.lon + 0.012 AND p.lat BETWEEN s.lat - 0.01 AND s.lat + 0.01")
def q_points_in_boxes(spark, sf):
    p = views.students(spark, sf).select(F.col("student_id").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    b = views.stops(spark, sf).select(F.col("node_id").alias("box"), (F.col("lon") - 0.012).alias("x1"), (F.col("lat") - 0.01).alias("y1"), (F.col("lon") + 0.012).alias("x2"), (F.col("lat") + 0.01).alias("y2"))
    return spatial.points_in_boxes(p, b, 0.02)


@query(_M + "SELECT mode, count(walk) AS n, round(quantile_cont(walk, 0.25), 6) AS q1, round(quantile_cont(walk, 0.5), 6) AS q2, round(quantile_cont(walk, 0.75), 6) AS q3 FROM m GROUP BY mode")
def q_walk_quartiles(spark, sf):
    return metrics.quartiles(metrics_table(spark, sf), ["mode"], "walk").select("mode", "n", r6("q1"), r6("q2"), r6("q3"))


@query(with_views("visits") + "SELECT mode, round(avg(CASE WHEN student_id % 4 > 0 THEN walk_m END), 6) AS mean_m FROM visits GROUP BY mode")
def q_allowed_mean_walk(spark, sf):
    limited = views.visits(spark, sf).withColumn("walk_m", F.when(F.col("student_id") % 4 > 0, F.col("walk_m")))
    return limited.groupBy("mode").agg(F.round(F.avg("walk_m"), 6).alias("mean_m"))


@query(with_views("visits") + "SELECT node_id, round(CASE WHEN max(node_id % 2) = 0 AND max(walk_m) > 0 THEN avg(walk_m) ELSE max(node_id % 2) END, 6) AS mean_m FROM visits GROUP BY node_id")
def q_mean_walk_guard(spark, sf):
    v = views.visits(spark, sf).withColumn("stored", (F.col("node_id") % 2).cast("double"))
    return metrics.mean_with_stale_zeros(v, ["node_id"], "stored", "walk_m").withColumn("mean_m", F.round("mean_m", 6))


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 2 = 0 AS caps, o_custkey % 3 = 0 AS mrt_on, o_custkey % 5 > 1 AS two_way, 60 + o_custkey % 2 * 30 AS mrt FROM orders)
SELECT CASE WHEN NOT caps THEN 'No MRT' WHEN mrt_on THEN 'MRT ' || mrt WHEN two_way THEN 'DMRT Lenient' ELSE 'DMRT Strict' END AS label, count(*) AS n FROM o GROUP BY 1"""
)
def q_ride_policy_label(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    label = scalars.policy_label(k % 2 == 0, k % 3 == 0, k % 5 > 1, 60 + k % 2 * 30)
    return o.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    with_views("riders")
    + """, x AS (SELECT *, walk_m < 300 AS served, (student_id % 4 * 150)::DOUBLE AS lim FROM riders)
SELECT mode, count(*) FILTER (served) AS served, count(*) AS total, round(avg(served::INT), 6) AS rate,
  round(avg(CASE WHEN served AND direct_min > 0 AND NOT isinf(ride_min) THEN ride_min / direct_min END), 6) AS mean_ratio, median(walk_m) FILTER (served) AS median_m, round(avg(CASE WHEN served AND lim > 0 THEN least(walk_m / lim, 1.0) * 100 END), 6) AS used_pct,
  count(DISTINCT route_id) FILTER (served) AS active_routes FROM x GROUP BY mode"""
)
def q_mode_bundle(spark, sf):
    r = views.riders(spark, sf).withColumn("served", F.col("walk_m") < 300).withColumn("cap_min", scalars.ride_cap("direct_min", 10.0, 5.0)).withColumn("walk_limit_m", (F.col("student_id") % 4 * 150).cast("double"))
    per = r.where("served").groupBy("mode", "route_id").agg(F.count("*").alias("load")).withColumns({"capacity": F.lit(10), "total_min": F.lit(1.0), "total_km": F.lit(1.0)})
    b = metrics.mode_bundle(r, per)
    return b.select("mode", "served", "total", r6("rate"), r6("mean_ratio"), "median_m", r6("used_pct"), "active_routes")


@query(
    """WITH r AS (SELECT output_id, payload FROM (SELECT DISTINCT output_id, payload FROM run_output) WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
x AS (SELECT output_id, TRY_CAST(u.r ->> '$.total_time_min' AS DOUBLE) AS v FROM r, json_each(payload::JSON -> '$.modes') m, unnest(CASE WHEN json_type(m.value, '$.routes') = 'ARRAY' THEN CAST(m.value -> '$.routes' AS JSON[]) END) u(r))
SELECT output_id AS record_id, count(v) AS n, round(sum(v), 6) AS total FROM x WHERE v IS NOT NULL GROUP BY 1"""
)
def q_numbers_of_key(spark, sf):
    found = shred.numbers_of_key(table(spark, sf, "run_output"), "output_id", "payload", "total_time_min")
    return found.groupBy("record_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(_M + "SELECT cohort, count(DISTINCT seed) AS seeds, count(*) AS \"rows\" FROM m GROUP BY cohort")
def q_manifest(spark, sf):
    return metrics.manifest(metrics_table(spark, sf), ["cohort"], "seed")


@query(_M + "SELECT cohort, mode, round(avg(minutes), 9) AS minutes, round(avg(walk), 9) AS walk FROM m GROUP BY cohort, mode")
def q_mode_bars(spark, sf):
    return metrics_table(spark, sf).groupBy("cohort", "mode").agg(F.round(F.avg("minutes"), 9).alias("minutes"), F.round(F.avg("walk"), 9).alias("walk"))


@query("SELECT event_type AS mode, (event_id // 1000) AS iteration, round(avg(value), 6) AS mean_best FROM events GROUP BY 1, 2")
def q_convergence(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("mode"), F.floor(F.col("event_id") / 1000).alias("iteration")).agg(F.round(F.avg("value"), 6).alias("mean_best"))


@query(with_views("visits", "students") + "SELECT coalesce(stage, '(none)') AS stage, count(*) AS riders, count(DISTINCT v.node_id) AS stops_used FROM visits v LEFT JOIN students s ON s.student_id = v.student_id GROUP BY 1")
def q_stage_breakdown(spark, sf):
    joined = views.visits(spark, sf).join(views.students(spark, sf).select("student_id", "stage"), "student_id", "left")
    return joined.groupBy(F.coalesce("stage", F.lit("(none)")).alias("stage")).agg(F.count("*").alias("riders"), F.count_distinct("node_id").alias("stops_used"))


@query("SELECT boundary_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM cairo_boundary_points GROUP BY 1")
def q_boundary_boxes(spark, sf):
    return metrics.box(table(spark, sf, "cairo_boundary_points"), ["boundary_id"])


@query(with_views("legs") + ", rides AS (SELECT route_id, seq, sum(minutes) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ride_min FROM legs), f AS (SELECT route_id, count(DISTINCT student_id) AS students, min(seq) AS seq, count(*) AS stops FROM visits GROUP BY 1) SELECT f.route_id, stops, students, round(ride_min, 6) AS first_ride_min FROM f JOIN rides USING (route_id, seq)")
def q_route_legend(spark, sf):
    r = routes.route_legend(views.route_stops(spark, sf), views.visits(spark, sf), views.rides(spark, sf))
    return r.withColumn("first_ride_min", F.round("first_ride_min", 6))


@query(
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + """, cost AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS w FROM road),
walk(source, node, c) AS (SELECT s_suppkey::BIGINT, s_suppkey::BIGINT, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT source, v, c + w FROM walk JOIN cost ON node = u WHERE c + w <= 60),
best AS (SELECT source, node, min(c) AS c FROM walk GROUP BY 1, 2)
SELECT b.source, b.node, min(p.node) AS before FROM best b LEFT JOIN (SELECT x.source, cost.v, x.node, x.c + w AS total FROM best x JOIN cost ON cost.u = x.node) p ON p.source = b.source AND p.v = b.node AND p.total = b.c GROUP BY 1, 2"""
)
def q_shortest_path_steps(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").cast("bigint").alias("source"), F.col("s_suppkey").cast("bigint").alias("node"), F.lit(0.0).alias("cost"))
    return graph.shortest_steps(s, _streets(spark, sf), 60.0)


@query("SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS elapsed FROM events")
def q_block_elapsed(spark, sf):
    return metrics.elapsed(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "elapsed")


def _horner(values: tuple, x: str) -> str:
    out = f"{values[0]!r}::DOUBLE"
    for v in values[1:]:
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


def _quantile_sql(p: str) -> str:
    """population.normal_quantile in DuckDB SQL, of a column of the query."""
    ratio = lambda both, x: f"{_horner(both[0], x)} / {_horner(both[1], x)}"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    far = f"(CASE WHEN {r} <= 5 THEN {ratio(population.MIDDLE, f'({r} - 1.6)')} ELSE {ratio(population.TAIL, f'({r} - 5.0)')} END)"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(population.CENTRAL, f'(0.180625 - {q} * {q})')} WHEN {q} < 0 THEN -{far} ELSE {far} END"


def _draw_sql(draw: int) -> str:
    return f"((('0x' || left(md5(id || ':42:{draw}'), 13))::BIGINT + 0.5) / 4503599627370496::DOUBLE)"


_BELOW = [0.5 * math.erfc(-x / math.sqrt(2.0)) for x in (-1.6, 3.0)]


@query(
    f"""WITH i AS (SELECT unnest(range((SELECT count(*) FROM customer)))::BIGINT AS id),
u AS (SELECT id, {_BELOW[0]!r}::DOUBLE + {_draw_sql(100)} * ({_BELOW[1]!r}::DOUBLE - {_BELOW[0]!r}::DOUBLE) AS p, {_draw_sql(1)} AS a, {_draw_sql(2)} AS s, {_draw_sql(3)} AS g, {_draw_sql(4)} AS d FROM i),
k AS (SELECT *, 2.0 + {_quantile_sql('p')} AS km, CASE WHEN s < 0.125 THEN 'KG' WHEN s < 0.5 THEN 'ELEMENTARY' WHEN s < 0.75 THEN 'MIDDLE' ELSE 'HIGH' END AS stage FROM u),
l AS (SELECT *, CASE stage WHEN 'KG' THEN 4 WHEN 'ELEMENTARY' THEN 6 WHEN 'MIDDLE' THEN 12 ELSE 15 END AS low, CASE stage WHEN 'KG' THEN 2 WHEN 'ELEMENTARY' THEN 6 ELSE 3 END AS many FROM k)
SELECT id AS student_id, round(30.0 + km / 111.0 * cos(2 * pi() * a), 9) AS lat, round(31.2 + km / (111.0 * cos(radians(30.0))) * sin(2 * pi() * a), 9) AS lon, stage, (low + floor(g * many))::INT AS age, d < 0.125 AS disabled FROM l"""
)
def q_population(spark, sf):
    """As many homes as there are customers, around the school."""
    n = table(spark, sf, "customer").count()
    people = population.homes(spark, n, 42, 30.0, 31.2, {"KG": 1, "ELEMENTARY": 3, "MIDDLE": 2, "HIGH": 2}, {"KG": (4, 5), "ELEMENTARY": (6, 11), "MIDDLE": (12, 14), "HIGH": (15, 17)})
    return people.withColumn("lat", F.round("lat", 9)).withColumn("lon", F.round("lon", 9))
