"""Queries over runs, ledgers, graphs and tests, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from darb.functions import scalars
from darb.operators import crossings, graph, metrics, solver, spatial, stats
from darb.plans import views
from darb.plans.route_queries import HAVERSINE, r6
from darb.plans.views import with_views
from darb.session import table
from darb.sources import ledger
from darb.streaming import budget

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def metrics_table(spark, sf):
    """raw_metrics_tidy with each run once, modes and keys in one spelling and non-measurements as null."""
    m = metrics.latest(table(spark, sf, "raw_metrics_tidy"), ["row_id"], ["loaded_at"])
    return m.withColumn("mode", F.initcap(F.trim("mode"))).withColumn("walk", F.when((F.abs("avg_walk_dist_m") < float("inf")) & ~F.isnan("avg_walk_dist_m"), F.col("avg_walk_dist_m"))).withColumn("minutes", F.nullif(F.col("total_route_time_min"), F.lit(9999.0)))


_M = """WITH m AS (
  SELECT * EXCLUDE (mode, n), 'Mode ' || upper(right(trim(mode), 1)) AS mode, CASE WHEN isnan(avg_walk_dist_m) OR isinf(avg_walk_dist_m) THEN NULL ELSE avg_walk_dist_m END AS walk, nullif(total_route_time_min, 9999.0) AS minutes
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS n FROM raw_metrics_tidy) WHERE n = 1)
"""


@query(_M + "SELECT row_id, cohort, mode, loaded_at, walk FROM m")
def q_ledger_upsert(spark, sf):
    return metrics_table(spark, sf).select("row_id", "cohort", "mode", "loaded_at", "walk")


@query(
    _M
    + """SELECT cohort, mode, count(DISTINCT seed) AS n_seeds, CASE WHEN avg(walk) IS NULL THEN '-' ELSE printf('%.1f', avg(walk)) END AS walk_mean, round(coalesce(stddev_samp(minutes), 0), 6) AS minutes_sd, round(avg(served_rate_pct), 6) AS rate
FROM m GROUP BY cohort, mode"""
)
def q_table1(spark, sf):
    m = metrics_table(spark, sf)
    return m.groupBy("cohort", "mode").agg(F.count_distinct("seed").alias("n_seeds"), F.when(F.avg("walk").isNull(), "-").otherwise(F.format_string("%.1f", F.avg("walk"))).alias("walk_mean"), F.round(F.coalesce(F.stddev_samp("minutes"), F.lit(0.0)), 6).alias("minutes_sd"), F.round(F.avg("served_rate_pct"), 6).alias("rate"))


def _cell(c: str) -> str:
    return f"CASE WHEN avg({c}) IS NULL THEN '-' ELSE printf('%.2f', avg({c})) || ' ± ' || printf('%.2f', coalesce(stddev_samp({c}), 0)) END AS {c}"


@query(_M + f"SELECT cohort, mode, count(DISTINCT seed) AS n_seeds, {', '.join(map(_cell, ['walk', 'minutes', 'served_rate_pct', 'routes_created']))} FROM m GROUP BY cohort, mode")
def q_table1_text(spark, sf):
    return metrics.mean_and_spread(metrics_table(spark, sf), ["cohort", "mode"], ["walk", "minutes", "served_rate_pct", "routes_created"], "seed")


@query(_M + "SELECT cohort, mode, round(avg(alns_runtime_seconds), 6) AS mean_s, round(avg(executed_iterations), 6) AS mean_iterations, round(avg(executed_iterations) / nullif(avg(alns_runtime_seconds), 0), 6) AS per_second FROM m GROUP BY cohort, mode")
def q_iters_per_sec(spark, sf):
    m = metrics_table(spark, sf).withColumnRenamed("alns_runtime_seconds", "runtime_s").withColumnRenamed("executed_iterations", "iterations")
    return metrics.throughput(m, ["cohort", "mode"]).select("cohort", "mode", r6("mean_s"), r6("mean_iterations"), r6("per_second"))


@query(_M + "SELECT mode, coalesce(mode_key, 'unknown') AS mode_key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY mode), 6) AS share FROM m GROUP BY mode, mode_key")
def q_stop_reason_share(spark, sf):
    return metrics.value_shares(metrics_table(spark, sf), ["mode"], "mode_key")


@query(
    """WITH r AS (SELECT o_orderstatus AS size, o_orderpriority AS mode, CASE o_custkey % 3 WHEN 0 THEN 'patience' WHEN 1 THEN 'budget' END AS stop_reason, o_totalprice / 1000 AS s, (o_custkey % 11)::BIGINT AS it FROM orders),
g AS (SELECT size, mode, coalesce(stop_reason, 'unknown') AS stop_reason, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT size, mode, count(*)::BIGINT AS runs, round(avg(s), 6) AS mean_s, min(s) AS min_s, max(s) AS max_s, round(avg(CASE WHEN it > 0 THEN it END), 6) AS mean_iterations,
  (SELECT string_agg(g.stop_reason || '=' || g.n, ',' ORDER BY g.stop_reason) FROM g WHERE g.size = r.size AND g.mode = r.mode) AS reasons FROM r GROUP BY size, mode"""
)
def q_size_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("size"), F.col("o_orderpriority").alias("mode"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 'patience' WHEN 1 THEN 'budget' END").alias("stop_reason"), (F.col("o_totalprice") / 1000).alias("runtime_s"), (F.col("o_custkey") % 11).alias("iterations"))
    return metrics.size_summary(o).withColumn("mean_s", F.round("mean_s", 6)).withColumn("mean_iterations", F.round("mean_iterations", 6))


_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 47.0]


@query(with_views("visits") + "SELECT mode, least(floor(direct_min / 10) * 10, 40) AS bin, count(*) AS n, count(CASE WHEN walk_m < 300 THEN 1 END) AS hits, round(avg((walk_m < 300)::INT), 6) AS rate FROM visits WHERE direct_min BETWEEN 0 AND 47 GROUP BY 1, 2")
def q_binned_service_prob(spark, sf):
    return metrics.histogram(views.visits(spark, sf).withColumn("served", F.col("walk_m") < 300), ["mode"], "direct_min", _EDGES, "served").withColumn("rate", F.round("rate", 6))


@query(_M + "SELECT mode, round(avg(minutes / students_total), 6) AS mean, round(stddev_pop(minutes / students_total), 6) AS spread FROM m GROUP BY mode")
def q_fairness_panel(spark, sf):
    per = F.try_divide("minutes", "students_total")
    return metrics_table(spark, sf).groupBy("mode").agg(F.round(F.avg(per), 6).alias("mean"), F.round(F.stddev_pop(per), 6).alias("spread"))


@query(_M + """SELECT seed, coalesce(sum(students_served) FILTER (mode = 'Mode A'), 0)::BIGINT AS "students_served_Mode A", coalesce(sum(students_served) FILTER (mode = 'Mode B'), 0)::BIGINT AS "students_served_Mode B", coalesce(sum(students_served) FILTER (mode = 'Mode C'), 0)::BIGINT AS "students_served_Mode C" FROM m GROUP BY seed""")
def q_served_pivot(spark, sf):
    return metrics.pivot_counts(metrics_table(spark, sf), "seed", "mode", ["Mode A", "Mode B", "Mode C"], "students_served")


@query(_M + ", s AS (SELECT mode, list_sort(list(walk) FILTER (walk IS NOT NULL)) AS l, count(*) AS c FROM m GROUP BY mode) SELECT mode, l[1] AS lo, l[-1] AS hi, round(list_avg(l), 6) AS mean, len(l) AS n, c - len(l) AS missing, l[len(l) // 2 + 1] AS upper_median FROM s")
def q_upper_median(spark, sf):
    return metrics.distribution(metrics_table(spark, sf), ["mode"], "walk").withColumn("mean", F.round("mean", 6))


@query("SELECT 'repair' AS family, event_type AS op, count(*) AS n, round(count(*) * 100.0 / 5000, 2) AS frequency_pct, round(sum(greatest(value - 1, 0)), 4) AS total_s, round(avg(greatest(value - 1, 0)), 6) AS avg_s, round(min(greatest(value - 1, 0)), 6) AS best_s, round(max(greatest(value - 1, 0)), 6) AS worst_s FROM events GROUP BY event_type")
def q_operator_stats(spark, sf):
    calls = table(spark, sf, "events").select(F.lit("repair").alias("family"), F.col("event_type").alias("op"), (F.col("value") - 1).alias("seconds"))
    return metrics.operator_statistics(calls, 5000).select("family", "op", "n", "frequency_pct", F.round("total_s", 4).alias("total_s"), r6("avg_s"), r6("best_s"), r6("worst_s"))


@query(with_views("od") + "SELECT count(*) FILTER (NOT isinf(minutes)) AS finite_pairs, count(*) FILTER (isinf(minutes)) AS infinite_pairs, round(avg((NOT isinf(minutes))::INT), 4) AS finite_ratio, true AS usable FROM od")
def q_matrix_quality(spark, sf):
    return metrics.matrix_quality(views.od_matrix(spark, sf))


@query("SELECT round(least(10.0, greatest(0.1, sum(l_quantity) / sum(l_quantity + l_tax * 100))), 6) AS factor FROM lineitem")
def q_speed_scale(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("configured_min"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("base_min"))
    return metrics.speed_factor(e).withColumn("factor", F.round("factor", 6))


@query(
    _M
    + """, a AS (SELECT cohort, mode, avg(minutes) AS v FROM m GROUP BY 1, 2), w AS (SELECT cohort, max(v) FILTER (mode = 'Mode C') AS base, max(v) FILTER (mode = 'Mode A') AS a, max(v) FILTER (mode = 'Mode B') AS b FROM a GROUP BY 1)
SELECT cohort, round(base, 6) AS base, round((a - base) * 100 / nullif(base, 0), 1) AS "gain_Mode A", round((b - base) * 100 / nullif(base, 0), 1) AS "gain_Mode B" FROM w"""
)
def q_cross_mode_delta(spark, sf):
    per = metrics_table(spark, sf).groupBy("cohort", "mode").agg(F.avg("minutes").alias("v"))
    return metrics.mode_gains(per, "cohort", "Mode C", ["Mode A", "Mode B"], "v").withColumn("base", F.round("base", 6))


@query(with_views("route_stops") + ", e AS (SELECT DISTINCT node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS v FROM route_stops), x AS (SELECT u AS node, (u + v) % 5 AS r FROM e WHERE v IS NOT NULL UNION ALL SELECT v, NULL FROM e WHERE v IS NOT NULL) SELECT node, count(*) AS degree, max(r) AS out_rank FROM x GROUP BY node")
def q_node_degree_points(spark, sf):
    return metrics.node_degrees(_road(spark, sf).select("u", "v", ((F.col("u") + F.col("v")) % 5).cast("int").alias("class_rank")))


def _road(spark, sf):
    """Distinct directed edges between successive stops: (u, v)."""
    s = views.route_stops(spark, sf)
    return s.select(F.col("node_id").alias("u"), F.lead("node_id").over(Window.partitionBy("route_id").orderBy("seq")).alias("v")).where("v IS NOT NULL").distinct()


_ROAD = with_views("route_stops") + ", road AS (SELECT DISTINCT u, v FROM (SELECT node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS v FROM route_stops) WHERE v IS NOT NULL)"
_HAV = HAVERSINE


@query(
    with_views("students", "stops")
    + f", d AS (SELECT p.student_id AS key, t.node_id AS target, {_HAV} AS metres FROM students p, stops t), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY metres, target) AS r FROM d) SELECT key, round(metres, 4) AS metres FROM n WHERE r = 1"
)
def q_haversine_nearest(spark, sf):
    return spatial.nearest(views.students(spark, sf).withColumnRenamed("student_id", "key"), views.stops(spark, sf).withColumnRenamed("node_id", "target")).select("key", F.round("metres", 4).alias("metres"))


@query(
    with_views("students", "stops", "visits")
    + f""", w AS (SELECT student_id AS key, min(walk_m) AS walk FROM visits GROUP BY 1), d AS (SELECT p.student_id AS key, min({_HAV}) AS metres FROM students p, stops t GROUP BY 1)
SELECT key, round(coalesce(walk, metres), 4) AS metres, walk IS NULL AS fallback FROM d LEFT JOIN w USING (key)"""
)
def q_nearest_with_fallback(spark, sf):
    s = views.students(spark, sf)
    walk = views.visits(spark, sf).groupBy(F.col("student_id").alias("key")).agg(F.min("walk_m").alias("walk"))
    lone = s.withColumnRenamed("student_id", "key").join(walk, "key", "left_anti")
    far = spatial.nearest(lone, views.stops(spark, sf).withColumnRenamed("node_id", "target")).select("key", "metres")
    own = s.select(F.col("student_id").alias("key")).join(walk, "key").select("key", F.col("walk").alias("metres"), F.lit(False).alias("fallback"))
    return own.unionByName(far.withColumn("fallback", F.lit(True))).withColumn("metres", F.round("metres", 4))


@query(
    with_views("students", "stops")
    + """, e AS (SELECT node_id AS edge, lon AS x1, lat AS y1, lon + 0.002 AS x2, lat + 0.001 AS y2 FROM stops),
d AS (SELECT student_id AS key, edge, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t, lon, lat, x1, y1, x2, y2 FROM students, e),
m AS (SELECT key, sqrt(pow(lon - (x1 + t * (x2 - x1)), 2) + pow(lat - (y1 + t * (y2 - y1)), 2)) AS degrees FROM d)
SELECT key, round(min(degrees), 8) AS degrees FROM m GROUP BY key"""
)
def q_nearest_edge(spark, sf):
    e = views.stops(spark, sf).select(F.col("node_id").alias("edge"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + 0.002).alias("x2"), (F.col("lat") + 0.001).alias("y2"))
    p = views.students(spark, sf).select(F.col("student_id").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.nearest_edges_any(p, e).select("key", F.round("degrees", 8).alias("degrees"))


@query(with_views("visits", "students") + "SELECT v.route_id, v.seq FROM visits v JOIN students s ON s.student_id = v.student_id WHERE v.tier = 'none' OR (CASE WHEN s.disabled THEN 'DISABLED' ELSE s.stage END, v.tier) IN (('HIGH', 'secondary'), ('HIGH', 'tertiary'), ('MIDDLE', 'tertiary'))")
def q_policy_semijoin(spark, sf):
    s = views.students(spark, sf).select("student_id", F.when(F.col("disabled"), "DISABLED").otherwise(F.col("stage")).alias("policy_key"))
    v = views.visits(spark, sf).select("student_id", F.struct("route_id", "seq").alias("edge"), (F.coalesce(F.col("tier"), F.lit("?")) != "none").alias("synthetic"), F.col("tier").alias("road_class"))
    policy = spark.createDataFrame([("HIGH", "secondary"), ("HIGH", "tertiary"), ("MIDDLE", "tertiary")], "key string, road_class string")
    return graph.allowed_crossings(v, s, policy).select("edge.route_id", "edge.seq")


@query(_ROAD + ", c AS (SELECT u, v, CASE WHEN u % 4 = 0 AND v % 4 = 0 THEN 'residential' WHEN u % 2 = 0 THEN 'trunk' ELSE 'primary' END AS k FROM road) SELECT node FROM (SELECT u AS node, k FROM c UNION ALL SELECT v, k FROM c) GROUP BY node HAVING bool_and(k IN ('trunk', 'primary'))")
def q_forbidden_antijoin(spark, sf):
    e = _road(spark, sf).withColumn("road_class", F.expr("CASE WHEN u % 4 = 0 AND v % 4 = 0 THEN 'residential' WHEN u % 2 = 0 THEN 'trunk' ELSE 'primary' END"))
    return graph.nodes_only_touching(e, ["trunk", "primary"])


@query(
    with_views("students")
    + """, v AS (SELECT DISTINCT boundary_id AS b, vertex_seq AS q, lon AS x, lat AS y FROM cairo_boundary_points),
e AS (SELECT b, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY b ORDER BY q))
SELECT student_id AS key, b AS region FROM students JOIN e ON (y1 <= lat) <> (y2 <= lat) AND (x2 - x1) * (lat - y1) / (y2 - y1) + x1 > lon GROUP BY 1, 2 HAVING count(*) % 2 = 1"""
)
def q_point_in_polygon(spark, sf):
    p = views.students(spark, sf).select(F.col("student_id").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    rings = table(spark, sf, "cairo_boundary_points").select(F.col("boundary_id").alias("region"), F.col("vertex_seq").alias("seq"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.points_in_regions(p, rings)


@query(with_views("students", "stops") + f"SELECT p.student_id AS key_a, 1000000 + t.node_id AS key_b FROM students p, stops t WHERE {_HAV} <= 400")
def q_bbox_prune_range_join(spark, sf):
    s = views.students(spark, sf).select(F.col("student_id").alias("key"), F.lit("student").alias("owner"), "lat", "lon")
    t = views.stops(spark, sf).select((F.lit(1000000) + F.col("node_id")).alias("key"), F.lit("stop").alias("owner"), "lat", "lon")
    return spatial.near_pairs(s.unionByName(t), 400.0)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) SELECT o_custkey, max(o_orderkey) FILTER (r = 1) AS keep_max, max(o_orderkey) FILTER (f = 1) AS keep_first FROM x GROUP BY 1")
def q_dedup_keep_max(spark, sf):
    o = table(spark, sf, "orders")
    most = metrics.latest(o, ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("keep_max"))
    first = metrics.first_seen(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("keep_first"))
    return most.join(first, "o_custkey")


@query("SELECT k, min(v) AS v FROM (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, l_discount * 100 FROM lineitem WHERE l_returnflag = 'R') GROUP BY k")
def q_union_min(spark, sf):
    i = table(spark, sf, "lineitem")
    a = i.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    b = i.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), (F.col("l_discount") * 100).alias("v"))
    return metrics.union_minimum([a, b], ["k"], "v")


@query(_M + "SELECT seed FROM m WHERE mode = 'Mode A' INTERSECT SELECT seed FROM m WHERE mode = 'Mode B'")
def q_seed_intersect(spark, sf):
    m = metrics_table(spark, sf)
    return m.where("mode = 'Mode A'").select("seed").intersect(m.where("mode = 'Mode B'").select("seed"))


@query("SELECT coalesce(a.n_name, b.n_name) AS key, a.v AS a, b.v AS b, a.v IS DISTINCT FROM b.v AS changed FROM (SELECT n_name, n_regionkey::VARCHAR AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_name, (n_nationkey % 5)::VARCHAR AS v FROM nation WHERE n_nationkey > 8) b ON a.n_name = b.n_name")
def q_config_diff_full_outer(spark, sf):
    n = table(spark, sf, "nation")
    a = n.where("n_nationkey < 15").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    b = n.where("n_nationkey > 8").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 5).cast("string").alias("value"))
    return metrics.config_diff(a, b)


@query(_M + ", w AS (SELECT cohort, avg(minutes) FILTER (mode = 'Mode A') AS a, avg(minutes) FILTER (mode = 'Mode B') AS b FROM m GROUP BY 1) SELECT cohort, round(b - a, 6) AS delta, CASE WHEN abs(a) >= 1e-12 THEN round((b - a) / abs(a) * 100, 6) END AS delta_pct FROM w")
def q_run_delta(spark, sf):
    w = metrics_table(spark, sf).groupBy("cohort").agg(F.avg(F.when(F.col("mode") == "Mode A", F.col("minutes"))).alias("a"), F.avg(F.when(F.col("mode") == "Mode B", F.col("minutes"))).alias("b"))
    return w.select("cohort", F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.round(scalars.relative_change("a", "b"), 6).alias("delta_pct"))


_DELTAS = (
    _M
    + """, p AS (SELECT cohort, seed, avg(walk) FILTER (mode = 'Mode A') AS a, avg(walk) FILTER (mode = 'Mode B') AS b FROM m GROUP BY 1, 2),
d AS (SELECT cohort, seed, a - b AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT cohort, round(delta, 9) AS x FROM d WHERE round(delta, 9) <> 0),
r AS (SELECT cohort, x, rank() OVER (PARTITION BY cohort ORDER BY abs(x)) + (count(*) OVER (PARTITION BY cohort, abs(x)) - 1) / 2.0 AS rk FROM z),
s AS (SELECT cohort, sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN x < 0 THEN rk ELSE 0 END) AS wm FROM r GROUP BY 1)
"""
)


def _deltas(spark, sf):
    return stats.paired_deltas(metrics_table(spark, sf), ["cohort"], "seed", "mode", "Mode A", "Mode B", "walk")


@query(_DELTAS + "SELECT cohort, round(least(wp, wm), 6) AS w, round((wp - wm) / (wp + wm), 6) AS rank_biserial FROM s")
def q_rank_biserial(spark, sf):
    return stats.signed_rank(_deltas(spark, sf), ["cohort"]).where("n_used > 0").select("cohort", r6("w"), r6("rank_biserial"))


@query(_DELTAS + "SELECT cohort, count(*) AS n_pairs, round(median(delta), 6) AS median_delta, round(avg(delta), 6) AS mean_delta FROM d GROUP BY cohort")
def q_paired_delta(spark, sf):
    return stats.signed_rank(_deltas(spark, sf), ["cohort"]).select("cohort", "n_pairs", r6("median_delta"), r6("mean_delta"))


@query(
    _DELTAS.replace("WITH m AS", "WITH RECURSIVE m AS", 1)
    + """, t AS (SELECT cohort, (rk * 2)::BIGINT AS r2, row_number() OVER (PARTITION BY cohort ORDER BY rk, x) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM r),
dp(cohort, i, total, share) AS (
  SELECT DISTINCT cohort, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM t WHERE n <= 50
  UNION ALL SELECT cohort, i, total, sum(share) FROM (SELECT d.cohort, t.i, d.total + f.up * t.r2 AS total, d.share / 2 AS share FROM dp d JOIN t ON t.cohort = d.cohort AND t.i = d.i + 1, (VALUES (0), (1)) f(up)) GROUP BY ALL),
ex AS (SELECT dp.cohort, sum(share) AS p FROM dp JOIN (SELECT DISTINCT cohort, n FROM t) USING (cohort) JOIN s ON s.cohort = dp.cohort WHERE dp.i = n AND least(total, 2 * (wp + wm) - total) <= 2 * least(wp, wm) GROUP BY 1),
pairs AS (SELECT cohort, count(*) AS n_pairs FROM d GROUP BY 1),
big AS (SELECT cohort, any_value(n) AS n, sum(r2 / 2.0) / 2 AS mean, sum(r2 * r2 / 4.0) / 4 AS var FROM t GROUP BY 1),
dist AS (SELECT big.cohort, n, abs(least(wp, wm) - mean) / sqrt(2 * var) AS z FROM big JOIN s ON s.cohort = big.cohort),
no AS (SELECT cohort, n, CASE WHEN z > 4.5 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: pow(-1, k) * exp((2 * k + 1) * ln(z) - lgamma(k + 1)) / (2 * k + 1))) END AS p FROM dist),
w AS (SELECT pairs.cohort, n_pairs, least(wp, wm) AS w, CASE WHEN n_pairs >= 3 THEN CASE WHEN s.cohort IS NULL THEN 1.0 WHEN no.n <= 50 THEN least(1.0, ex.p) ELSE least(1.0, no.p) END END AS p_raw, CASE WHEN n_pairs >= 3 THEN CASE WHEN coalesce(no.n, 0) <= 50 THEN 'exact' ELSE 'normal' END END AS p_method
  FROM pairs LEFT JOIN s ON s.cohort = pairs.cohort LEFT JOIN ex ON ex.cohort = pairs.cohort LEFT JOIN no ON no.cohort = pairs.cohort),
h AS (SELECT *, row_number() OVER (ORDER BY coalesce(p_raw, 1), cohort) AS i, count(*) OVER () AS n FROM w),
a AS (SELECT *, least(1.0, (n - i + 1) * coalesce(p_raw, 1)) AS raw FROM h)
SELECT cohort, n_pairs, round(w, 6) AS w, round(p_raw, 6) AS p_raw, p_method, round(max(raw) OVER (ORDER BY i), 6) AS p_holm FROM a"""
)
def q_wilcoxon_p(spark, sf):
    p = stats.holm(stats.wilcoxon(_deltas(spark, sf), ["cohort"]), "p_raw")
    return p.select("cohort", "n_pairs", r6("w"), r6("p_raw"), "p_method", r6("p_holm"))


@query(
    """WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE ((n_nationkey * 37) % 100) / 1000.0::DOUBLE END AS p FROM nation),
i AS (SELECT k, p, row_number() OVER (ORDER BY coalesce(p, 1)) AS i, count(*) OVER () AS n FROM p), a AS (SELECT *, least(1, (n - i + 1) * coalesce(p, 1)) AS raw FROM i)
SELECT k, round(max(raw) OVER (ORDER BY i), 6) AS p_holm, max(raw) OVER (ORDER BY i) < 0.05 AS significant FROM a"""
)
def q_holm(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 7 != 0, ((F.col("n_nationkey") * 37) % 100) / 1000.0).alias("p"))
    return stats.holm(p, "p").select("k", r6("p_holm"), "significant")


# ---------------------------------------------------------------- graphs




def _streets(spark, sf):
    return _road(spark, sf).withColumn("cost", ((F.col("u") * 5 + F.col("v") * 3) % 40 + 10).cast("double"))


_WALK = """, cost AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS w FROM road),
walk(source, node, c) AS (
  SELECT {seed} AS source, s_suppkey::BIGINT AS node, 0.0::DOUBLE AS c FROM supplier WHERE s_suppkey % 20 = 0
  UNION
  SELECT source, v, c + w FROM walk JOIN cost ON node = u WHERE c + w <= 60)
SELECT source, node, min(c) AS cost FROM walk GROUP BY 1, 2"""


@query(_ROAD.replace("WITH", "WITH RECURSIVE", 1) + _WALK.format(seed="s_suppkey::BIGINT"))
def q_bounded_reachability(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").cast("bigint").alias("source"), F.col("s_suppkey").cast("bigint").alias("node"), F.lit(0.0).alias("cost"))
    return graph.shortest_within(s, _streets(spark, sf), 60.0)


@query(_ROAD.replace("WITH", "WITH RECURSIVE", 1) + _WALK.format(seed="0::BIGINT"))
def q_multisource_reach(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.lit(0).cast("bigint").alias("source"), F.col("s_suppkey").cast("bigint").alias("node"), F.lit(0.0).alias("cost"))
    return graph.shortest_within(s, _streets(spark, sf), 60.0)


@query(
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + """, spot AS (SELECT s_suppkey AS n, 30.0::DOUBLE + ((s_suppkey * 6563) % 2001 - 1000) / 10000.0::DOUBLE AS lat, 31.2::DOUBLE + ((s_suppkey * 31337) % 2001 - 1000) / 10000.0::DOUBLE AS lon FROM supplier),
e AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS w, CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN NULL ELSE (degrees(atan2(b.lon - a.lon, b.lat - a.lat)) + 360) - 360 * floor((degrees(atan2(b.lon - a.lon, b.lat - a.lat)) + 360) / 360) END AS b FROM road JOIN spot a ON a.n = u JOIN spot b ON b.n = v),
turns AS (SELECT x.u AS fu, x.v AS fv, y.v AS tv, y.w + CASE WHEN d > 45 THEN 0.2 ELSE 0 END AS w FROM (SELECT x.u, x.v, x.b AS b1 FROM e x) x JOIN (SELECT u, v, w, b AS b2 FROM e) y ON y.u = x.v, LATERAL (SELECT coalesce(abs((b1 - b2 + 180) - 360 * floor((b1 - b2 + 180) / 360) - 180), 0) AS d) WHERE d <= 140),
best(source, u, v, c) USING KEY (source, u, v) AS (
  SELECT e.u::BIGINT AS source, e.u, e.v, e.w FROM e WHERE e.u % 20 = 0 AND e.w <= 60
  UNION SELECT p.source, p.v, t.tv, min(p.c + t.w) FROM best p JOIN turns t ON t.fu = p.u AND t.fv = p.v LEFT JOIN recurring.best r ON r.source = p.source AND r.u = p.v AND r.v = t.tv WHERE p.c + t.w <= 60 AND (r.c IS NULL OR p.c + t.w < r.c) GROUP BY ALL)
SELECT source, node, round(min(c), 6) AS minutes FROM (SELECT source, v AS node, c FROM best UNION ALL SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey % 20 = 0) GROUP BY 1, 2"""
)
def q_turn_aware_od(spark, sf):
    at = views.stops(spark, sf)
    e = _streets(spark, sf).join(at.selectExpr("node_id AS u", "lat AS lat1", "lon AS lon1"), "u").join(at.selectExpr("node_id AS v", "lat AS lat2", "lon AS lon2"), "v")
    lined = graph.with_bearings(e).select(F.concat_ws(">", "u", "v").alias("edge"), "u", "v", F.col("cost").alias("minutes"), "bearing")
    sources = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").cast("bigint").alias("node"))
    return graph.turn_aware_times(sources, lined, 60.0).withColumn("minutes", F.round("minutes", 6))


@query(_ROAD + ", e AS (SELECT u, v, CASE (u + v) % 4 WHEN 0 THEN 'primary_link' WHEN 1 THEN 'Secondary' WHEN 2 THEN 'tertiary' ELSE 'odd' END AS h, ((u * v) % 900 + 5)::DOUBLE AS m, CASE u % 3 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' END AS s FROM road) SELECT u, v, round(m / ((CASE s WHEN '50' THEN 50 WHEN '30 mph' THEN 30 * 1.60934::DOUBLE ELSE 30 END) * (CASE WHEN h = 'Secondary' THEN 0.8 WHEN h = 'tertiary' THEN 0.8 ELSE 1.0 END)::DOUBLE * 1000 / 60), 6) AS minutes, h <> 'tertiary' AS safe FROM e")
def q_edge_enrichment(spark, sf):
    e = _road(spark, sf).select("u", "v", F.expr("CASE (u + v) % 4 WHEN 0 THEN 'primary_link' WHEN 1 THEN 'Secondary' WHEN 2 THEN 'tertiary' ELSE 'odd' END AS highway"), ((F.col("u") * F.col("v")) % 900 + 5).cast("double").alias("metres"), F.expr("CASE u % 3 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' END AS maxspeed"))
    types = spark.createDataFrame([("default", 1.0, True), ("primary", 1.0, True), ("secondary", 0.8, True), ("tertiary", 0.8, False)], "highway string, multiplier double, safe boolean")
    return graph.enrich_edges(e, types).select("u", "v", r6("minutes"), "safe")


@query(
    """WITH RECURSIVE p AS (SELECT (c_custkey % 40)::VARCHAR AS name, c_custkey AS node, 30.0::DOUBLE + ((c_custkey * 7919) % 2001 - 1000) / 10000.0::DOUBLE AS lat, 31.2::DOUBLE + ((c_custkey * 104729) % 2001 - 1000) / 10000.0::DOUBLE AS lon, c_custkey % 80 < 40 AS same FROM customer),
s AS (SELECT p.*, same = (SELECT q.same FROM p q WHERE q.name = p.name ORDER BY node LIMIT 1) AS a_side FROM p),
x AS (SELECT name, bool_or(a_side) AND bool_or(NOT a_side) AS two, any_value(CASE WHEN same THEN 300.0 ELSE 120.0 END) FILTER (a_side) AS axis FROM s GROUP BY 1),
c AS (SELECT s.name, s.node AS a, t.node AS b, x.axis, (s.lat + t.lat) / 2 AS mla, (s.lon + t.lon) / 2 AS mlo,
    2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(t.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2)))) AS metres,
    degrees(atan2(t.lon - s.lon, t.lat - s.lat)) + 360 AS g FROM s JOIN x ON x.name = s.name AND two JOIN s t ON t.name = s.name AND s.a_side AND NOT t.a_side),
d AS (SELECT *, abs((axis - (g - 360 * floor(g / 360)) + 180) - 360 * floor((axis - (g - 360 * floor(g / 360)) + 180) / 360) - 180) AS delta FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY metres, a, b) AS i FROM d WHERE metres BETWEEN 6 AND 3000 AND abs(least(delta, 180 - delta) - 90) <= 30),
bad AS (SELECT p.i, q.i AS j FROM k p JOIN k q ON p.i < q.i AND (p.a IN (q.a, q.b) OR p.b IN (q.a, q.b) OR (abs(p.mla - q.mla) < 0.01
   AND 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(q.mla - p.mla) / 2), 2) + cos(radians(p.mla)) * cos(radians(q.mla)) * pow(sin(radians(q.mlo - p.mlo) / 2), 2)))) < 100))),
blocks AS (SELECT j AS i, list(i) AS before FROM bad GROUP BY 1),
walk(i, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT w.i + 1, CASE WHEN coalesce(list_has_any(w.taken, b.before), false) THEN w.taken ELSE list_append(w.taken, w.i + 1) END FROM walk w JOIN k ON k.i = w.i + 1 LEFT JOIN blocks b ON b.i = w.i + 1)
SELECT name, 'secondary' AS road_class, a, b, round(metres, 4) AS metres FROM k WHERE i IN (SELECT unnest(taken) FROM walk WHERE i = (SELECT max(i) FROM walk))"""
)
def q_carriageway_crossings(spark, sf):
    at = views.students(spark, sf).select((F.col("student_id") % 40).cast("string").alias("name"), F.lit("secondary").alias("road_class"), F.col("student_id").alias("node"), "lat", "lon", F.when(F.col("student_id") % 80 < 40, 300.0).otherwise(120.0).alias("bearing"))
    return crossings.carriageway_crossings(at, 6.0, 3000.0).select("name", "road_class", "a", "b", F.round("metres", 4).alias("metres"))


# ---------------------------------------------------------------- search and state


def _solutions(spark, sf, enough_only=False):
    people = views.students(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").alias("zone")), "student_id")
    places = views.stops(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("zone")), "node_id")
    return solver.solve_fleets(people, places, seeds=[42, 67], capacity=30, iterations=40, enough_only=enough_only)


@query()
def q_alns_solve(spark, sf):
    """A problem per nation: its customers are to be brought to the middle of its suppliers."""
    return _solutions(spark, sf)


@query()
def q_smallest_fleet(spark, sf):
    return solver.smallest_fleet(_solutions(spark, sf, enough_only=True))


@query(
    """WITH RECURSIVE n AS (SELECT user_id AS route_id, ts::DATE AS day, event_id, value / 10 AS minutes, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT route_id, day, event_id, i, minutes <= 5 AS accepted, CASE WHEN minutes <= 5 THEN minutes ELSE 0 END AS used FROM n WHERE i = 1
  UNION ALL SELECT n.route_id, n.day, n.event_id, n.i, a.used + n.minutes <= 5, a.used + CASE WHEN a.used + n.minutes <= 5 THEN n.minutes ELSE 0 END FROM a JOIN n ON n.route_id = a.route_id AND n.day = a.day AND n.i = a.i + 1)
SELECT route_id, day, event_id, accepted, round(used, 6) AS used_after FROM a"""
)
def q_daily_budget(spark, sf):
    """Requests of a vehicle and day in order; one is accepted while the day's budget lasts."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("route_id"), F.to_date("ts").alias("day"), "ts", "event_id", (F.col("value") / 10).alias("minutes"))
    return budget.daily_budget(e, 5.0).select("route_id", "day", "event_id", "accepted", r6("used_after"))


@query("SELECT run_id, mode, routes, round(total_min, 6) AS total_min FROM (SELECT output_id AS run_id, key AS mode, count(*) AS routes, sum(CAST(r ->> '$.total_time_min' AS DOUBLE)) AS total_min FROM (SELECT DISTINCT output_id, payload FROM run_output WHERE json_valid(payload)) t, json_each(CASE WHEN json_type(payload) = 'OBJECT' THEN payload::JSON -> '$.modes' END) m, unnest(CASE WHEN json_type(m.value, '$.routes') = 'ARRAY' THEN CAST(m.value -> '$.routes' AS JSON[]) END) u(r) GROUP BY 1, 2)")
def q_run_mode_routes(spark, sf):
    return ledger.run_routes(table(spark, sf, "run_output")).groupBy("run_id", "mode").agg(F.count("*").alias("routes"), F.round(F.sum("total_time_min"), 6).alias("total_min"))
