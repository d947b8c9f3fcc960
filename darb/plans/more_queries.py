"""Queries of the smaller operators: lookups, keys, road graphs, crossings, route edits; with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from darb.functions import scalars
from darb.functions.geo import virtual_node_id
from darb.operators import graph, metrics, routes
from darb.plans import views
from darb.plans.route_queries import HAVERSINE, minutes_sql, r6
from darb.plans.run_queries import _M, _ROAD, _WALK, _road, _streets, metrics_table
from darb.plans.views import with_views
from darb.session import table
from darb.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- scalars


@query(
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' kg ' WHEN 1 THEN 'Middle' WHEN 2 THEN 'HIGH' WHEN 3 THEN c_mktsegment WHEN 4 THEN '' END AS t FROM customer),
k AS (SELECT c_custkey, CASE WHEN upper(trim(t)) IN ('KG', 'ELEMENTARY', 'MIDDLE', 'HIGH') THEN upper(trim(t)) ELSE 'ELEMENTARY' END AS stage FROM s)
SELECT c_custkey, stage, CASE stage WHEN 'MIDDLE' THEN 100.0 WHEN 'HIGH' THEN 200.0 ELSE 0.0 END::DOUBLE AS radius, CASE stage WHEN 'KG' THEN 50.0 WHEN 'MIDDLE' THEN 100.0 WHEN 'HIGH' THEN 150.0 ELSE 0.0 END::DOUBLE AS overridden FROM k"""
)
def q_stage_radius(spark, sf):
    t = F.expr("CASE c_custkey % 6 WHEN 0 THEN ' kg ' WHEN 1 THEN 'Middle' WHEN 2 THEN 'HIGH' WHEN 3 THEN c_mktsegment WHEN 4 THEN '' END")
    return table(spark, sf, "customer").select("c_custkey", scalars.stage(t).alias("stage"), scalars.stage_radius(t).alias("radius"), scalars.stage_radius(t, {"KG": 50.0, "HIGH": 150.0}).alias("overridden"))


_CLASSES = "CASE p_partkey % 7 WHEN 0 THEN 'primary_link' WHEN 1 THEN ' Tertiary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'residential' WHEN 4 THEN 'motorway' WHEN 5 THEN 'trunk_link' END"


@query(
    f"""WITH c AS (SELECT p_partkey, regexp_replace(lower(trim({_CLASSES})), '_link$', '') AS c, 29.9::DOUBLE + (p_partkey % 300) / 1000.0::DOUBLE AS lat FROM part)
SELECT p_partkey, CASE WHEN c IN ('tertiary', 'secondary') THEN c WHEN c IN ('primary', 'trunk', 'motorway') THEN 'primary_plus' ELSE 'unknown' END AS tier,
  coalesce(c IN ('motorway', 'trunk', 'primary', 'secondary'), false) AS dangerous, lat BETWEEN 29.95 AND 30.1 AS inside FROM c"""
)
def q_road_rules(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_CLASSES).alias("c"), (F.lit(29.9) + (F.col("p_partkey") % 300) / F.lit(1000.0)).alias("lat"))
    return p.select("p_partkey", scalars.road_tier("c").alias("tier"), scalars.dangerous_road("c").alias("dangerous"), scalars.in_box("lat", F.lit(31.2), 29.95, 31.0, 30.1, 31.4).alias("inside"))


@query(
    """SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS file, left(md5('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'), 8) AS short_key, sha1(p_partkey || '|' || p_brand || '|') AS long_key,
  '999' || round(abs(30.0::DOUBLE + p_partkey / 1000.0::DOUBLE) * 10000000)::BIGINT || round(abs(31.0::DOUBLE - p_partkey / 1000.0::DOUBLE) * 10000000)::BIGINT AS node, format('{:,}', p_partkey * 1000) AS number, printf('%+.1f%%', (p_size - 20) / 4.0::DOUBLE) AS percent,
  ceil(p_size / 7.0)::BIGINT AS buses, round(1000 * pow(0.98, p_size), 6) AS temperature, p_size * 30.0 / 60 AS dwell_min FROM part"""
)
def q_keys_and_texts(spark, sf):
    size = F.col("p_size")
    lat, lon = F.lit(30.0) + F.col("p_partkey") / F.lit(1000.0), F.lit(31.0) - F.col("p_partkey") / F.lit(1000.0)
    return table(spark, sf, "part").select(
        "p_partkey", scalars.safe_file_name("p_name").alias("file"), scalars.short_hash("p_partkey", "p_size").alias("short_key"), scalars.long_hash("p_partkey", "p_brand", F.lit(None)).alias("long_key"),
        virtual_node_id(lat, lon).alias("node"), scalars.number_text(F.col("p_partkey") * 1000).alias("number"), scalars.signed_percent((size - 20) / F.lit(4.0)).alias("percent"),
        scalars.fleet_at_least(size, 7).alias("buses"), F.round(scalars.temperature(size), 6).alias("temperature"), scalars.dwell_minutes(size).alias("dwell_min"),
    )


# ---------------------------------------------------------------- lookups and unions


@query(with_views("students", "visits") + "SELECT stage, count(*) AS students, count(*) FILTER (v.student_id IS NULL) AS unserved FROM students s LEFT JOIN (SELECT DISTINCT student_id FROM visits WHERE walk_m < 60) v ON v.student_id = s.student_id GROUP BY stage")
def q_unserved_lookup(spark, sf):
    served = views.visits(spark, sf).where("walk_m < 60").select("student_id").distinct().withColumn("served", F.lit(True))
    return views.students(spark, sf).join(served, "student_id", "left").groupBy("stage").agg(F.count("*").alias("students"), F.count_if(F.col("served").isNull()).alias("unserved"))


@query(with_views("visits") + ", c AS (SELECT DISTINCT student_id, node_id FROM visits), a AS (SELECT student_id, arg_min(node_id, (walk_m, node_id)) AS node_id FROM visits GROUP BY 1) SELECT c.student_id, c.node_id, a.node_id IS NOT NULL AS is_chosen FROM c LEFT JOIN a ON a.student_id = c.student_id AND a.node_id = c.node_id")
def q_candidate_chosen(spark, sf):
    v = views.visits(spark, sf)
    chosen = v.groupBy("student_id").agg(F.min_by("node_id", F.struct("walk_m", "node_id")).alias("node_id")).withColumn("is_chosen", F.lit(True))
    return v.select("student_id", "node_id").distinct().join(chosen, ["student_id", "node_id"], "left").withColumn("is_chosen", F.coalesce("is_chosen", F.lit(False)))


@query(with_views("visits", "stops") + "SELECT node_id::BIGINT AS node_id FROM visits UNION SELECT node_id FROM stops UNION SELECT 0")
def q_critical_nodes(spark, sf):
    node = lambda d: d.select(F.col("node_id").cast("bigint").alias("node_id"))
    return node(views.visits(spark, sf)).unionByName(node(views.stops(spark, sf))).unionByName(spark.range(1).select(F.col("id").alias("node_id"))).distinct()


@query(_M + ", u AS (SELECT row_id, students_served AS n, 'served' AS part FROM m UNION ALL SELECT row_id, students_unserved, 'unserved' FROM m) SELECT part, count(*) AS rows, sum(n)::BIGINT AS students, count(*) FILTER (cohort IN (100, 200, 400)) AS complete FROM u JOIN (SELECT row_id, cohort FROM m) USING (row_id) GROUP BY part")
def q_served_union(spark, sf):
    m = metrics_table(spark, sf)
    both = metrics.tagged_union({"served": m.select("cohort", F.col("students_served").alias("n")), "unserved": m.select("cohort", F.col("students_unserved").alias("n"))})
    return both.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("students"), F.count_if(F.col("cohort").isin(100, 200, 400)).alias("complete"))


@query(with_views("visits") + "SELECT status, count(DISTINCT node_id) AS stops_used FROM visits WHERE route_id IN (SELECT route_id FROM visits GROUP BY 1 HAVING count(*) > 2) GROUP BY status")
def q_stops_used(spark, sf):
    s = views.route_stops(spark, sf, "status")
    active = s.where("is_pickup").groupBy("route_id").agg(F.count("*").alias("n")).where("n > 2").select("route_id")
    return routes.stops_used(s.join(active, "route_id", "left_semi"), ["status"])


@query(with_views("riders") + "SELECT mode, round(avg(ride_min) FILTER (NOT isinf(ride_min)), 6) AS avg_ride, round(max(ride_min) FILTER (NOT isinf(ride_min)), 6) AS max_ride FROM riders GROUP BY mode")
def q_ride_extremes(spark, sf):
    known = F.when(F.col("ride_min") < float("inf"), F.col("ride_min"))
    return views.riders(spark, sf, ("mode",)).groupBy("mode").agg(F.round(F.avg(known), 6).alias("avg_ride"), F.round(F.max(known), 6).alias("max_ride"))


@query(
    with_views("legs")
    + """, t AS (SELECT route_id, sum(minutes) AS m, count(*) - 1 AS stops FROM legs GROUP BY 1 HAVING NOT bool_or(isinf(minutes))),
i AS (SELECT route_id % 5 AS instance, sum(m) * 60 + 15 * sum(stops) + 5 * sum(stops) AS seconds FROM t GROUP BY 1),
l(instance, best) AS (VALUES (0, 100000.0::DOUBLE), (1, 250000.0), (2, 50000.0), (7, 1.0))
SELECT instance, round(seconds, 4) AS seconds, round((seconds - best) / best * 100, 6) AS gap_pct FROM i JOIN l USING (instance)"""
)
def q_literature_gap(spark, sf):
    """Measured instances beside published ones, with the published dwell of 15 s a stop and 5 s a pupil."""
    legs = routes.legs(views.route_stops(spark, sf), views.od_matrix(spark, sf))
    per = legs.groupBy("route_id").agg(F.sum("minutes").alias("m"), (F.count("*") - 1).alias("stops")).where("m < double('infinity')")
    seconds = per.groupBy((F.col("route_id") % 5).alias("instance")).agg(scalars.benchmark_seconds(F.sum("m"), F.sum("stops"), F.sum("stops")).alias("seconds"))
    published = spark.createDataFrame([(0, 100000.0), (1, 250000.0), (2, 50000.0), (7, 1.0)], "instance bigint, best double")
    return seconds.join(F.broadcast(published), "instance").select("instance", F.round("seconds", 4).alias("seconds"), F.round(scalars.relative_change("best", "seconds"), 6).alias("gap_pct"))


@query(with_views("od") + "SELECT src, dst, round(CASE WHEN isinf(minutes) THEN minutes ELSE minutes * 1.25 END, 6) AS minutes, round(metres, 6) AS metres FROM od")
def q_scaled_minutes(spark, sf):
    return metrics.scaled_minutes(views.od_matrix(spark, sf), 1.25).select("src", "dst", r6("minutes"), r6("metres"))


@query(
    """WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events),
e AS (SELECT *, sum(CASE WHEN prev IS NULL OR value > prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS era FROM b)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, era ORDER BY event_id) - 1 >= 3 AS stop FROM e"""
)
def q_trailing_stop(spark, sf):
    return metrics.trailing(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 3).select("user_id", "event_id", "stop")


# ---------------------------------------------------------------- graphs and crossings

_STREET = ", e AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS metres, (u + v) % 3 = 0 AS synthetic, CASE (u * 2 + v) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'residential' END AS road_class FROM road)"


def _edges(spark, sf):
    return _road(spark, sf).select("u", "v", ((F.col("u") * 5 + F.col("v") * 3) % 40 + 10).cast("double").alias("metres"), ((F.col("u") + F.col("v")) % 3 == 0).alias("synthetic"), F.expr("CASE (u * 2 + v) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'residential' END AS road_class"))


@query(_ROAD + _STREET + ", x AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, metres, road_class, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY metres, road_class NULLS FIRST) AS n FROM e WHERE synthetic) SELECT lo, hi, metres, road_class FROM x WHERE n = 1")
def q_crossing_payload(spark, sf):
    return files.crossing_payload(_edges(spark, sf))


@query(
    _ROAD
    + _STREET
    + """, x AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, metres, road_class, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY metres, road_class NULLS FIRST) AS n FROM e WHERE synthetic),
w AS (SELECT * FROM e WHERE NOT synthetic OR u % 2 = 0), b AS (SELECT lo AS u, hi AS v, metres, road_class FROM x WHERE n = 1 UNION ALL SELECT hi, lo, metres, road_class FROM x WHERE n = 1)
SELECT u, v, metres, synthetic, road_class FROM w UNION ALL SELECT u, v, metres, true, road_class FROM b ANTI JOIN w USING (u, v)"""
)
def q_inject_crossings(spark, sf):
    e = _edges(spark, sf)
    return files.inject_crossings(e.where("NOT synthetic OR u % 2 = 0"), files.crossing_payload(e)).select("u", "v", "metres", "synthetic", "road_class")


@query(_ROAD + _STREET + ", h AS (SELECT * FROM e WHERE u < v OR u % 3 = 0) SELECT p.u, p.v, coalesce(a.metres, b.metres) AS metres FROM road p LEFT JOIN h a ON a.u = p.u AND a.v = p.v LEFT JOIN h b ON b.u = p.v AND b.v = p.u")
def q_edge_either_way(spark, sf):
    return graph.either_way(_road(spark, sf), _edges(spark, sf).where("u < v OR u % 3 = 0"), "metres")


@query(_ROAD + _STREET + ", x AS (SELECT u AS node, metres, NOT synthetic AS safe FROM e UNION ALL SELECT v, metres, NOT synthetic FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY metres, safe) AS n FROM x) SELECT node, safe FROM r WHERE n = 1")
def q_safe_by_shortest_edge(spark, sf):
    return graph.safest_by_shortest_edge(_edges(spark, sf).withColumn("safe", ~F.col("synthetic")))


@query(
    _ROAD
    + _STREET
    + f""", s AS (SELECT s_suppkey AS node, 30.0::DOUBLE + ((s_suppkey * 6563) % 2001 - 1000) / 10000.0::DOUBLE AS lat, 31.2::DOUBLE + ((s_suppkey * 31337) % 2001 - 1000) / 10000.0::DOUBLE AS lon FROM supplier),
d AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, metres, road_class FROM e JOIN s t ON t.node = e.u, (SELECT 30.0::DOUBLE AS lat, 31.2::DOUBLE AS lon) p WHERE metres >= 20 AND (road_class IS NULL OR road_class = 'primary') AND {HAVERSINE} <= 5000),
r AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY metres, road_class NULLS FIRST) AS n FROM d) SELECT lo, hi, metres, road_class FROM r WHERE n = 1"""
)
def q_display_segments(spark, sf):
    at = views.stops(spark, sf).selectExpr("CAST(node_id AS bigint) AS u", "lat", "lon")
    return graph.display_segments(_edges(spark, sf).join(at, "u"), 30.0, 31.2)


_FLAGGED = (
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + """, cost AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS w, (u + v) % 3 = 0 AS flagged FROM road),
walk(source, node, c) AS (
  SELECT s_suppkey::BIGINT AS source, s_suppkey::BIGINT AS node, 0.0::DOUBLE AS c FROM supplier WHERE s_suppkey % 20 = 0
  UNION SELECT source, v, c + w FROM walk JOIN cost ON node = u WHERE c + w <= 45),
plain(source, node, c) AS (
  SELECT s_suppkey::BIGINT AS source, s_suppkey::BIGINT AS node, 0.0::DOUBLE AS c FROM supplier WHERE s_suppkey % 20 = 0
  UNION SELECT source, v, c + w FROM plain JOIN cost ON node = u WHERE c + w <= 45 AND NOT flagged),
r AS (SELECT w.source, w.node, min(w.c) AS cost, NOT EXISTS (SELECT 1 FROM plain p WHERE p.source = w.source AND p.node = w.node) AS only_flagged FROM walk w GROUP BY 1, 2)
"""
)


def _flagged(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").cast("bigint").alias("source"), F.col("s_suppkey").cast("bigint").alias("node"), F.lit(0.0).alias("cost"))
    return graph.reachable_with_flag(s, _streets(spark, sf).withColumn("flagged", (F.col("u") + F.col("v")) % 3 == 0), 45.0)


@query(_FLAGGED + "SELECT source, node, cost, only_flagged FROM r")
def q_crossing_only_reach(spark, sf):
    return _flagged(spark, sf)


@query(_FLAGGED + "SELECT source, count(*) AS reached, count(*) FILTER (only_flagged) AS by_crossing_only, max(cost) AS farthest FROM r GROUP BY source")
def q_reach_counters(spark, sf):
    return graph.reach_counters(_flagged(spark, sf))


@query("SELECT coalesce(a.k, b.k) AS key, greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_orderpriority <> '5-LOW' GROUP BY 1) b ON a.k = b.k")
def q_counters_delta(spark, sf):
    count = lambda d: d.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("value"))
    o = table(spark, sf, "orders")
    return graph.counters_delta(count(o.where("o_orderstatus = 'F'")), count(o.where("o_orderkey % 3 > 0 AND o_orderpriority <> '5-LOW'")), "key")


@query(
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + _WALK.format(seed="s_suppkey::BIGINT").split("SELECT source, node, min(c)")[0]
    + """, m AS (SELECT source, node, min(c) AS minutes FROM walk GROUP BY 1, 2), asked AS (SELECT u AS src, (v + 3) - (v % 3) AS dst FROM road WHERE u % 20 = 0 AND u > 0 GROUP BY ALL)
SELECT src, dst, coalesce(minutes, 'Infinity'::DOUBLE) AS minutes FROM asked LEFT JOIN m ON m.source = src AND m.node = dst"""
)
def q_incremental_matrix(spark, sf):
    """A matrix of some sources, extended by the others, asked for pairs, of which some are beyond the cutoff or no targets."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"))
    sources, targets = s.where("node % 20 = 0"), s.where("node % 3 = 0")
    e = _streets(spark, sf).withColumnRenamed("cost", "minutes")
    some = graph.travel_matrix(sources.where("node % 40 = 0"), targets, e, 60.0)
    pairs = _road(spark, sf).where("u % 20 = 0 AND u > 0").select(F.col("u").alias("src"), (F.col("v") + 3 - F.col("v") % 3).alias("dst")).distinct()
    return graph.pair_times(pairs, graph.extend_matrix(some, sources, targets, e, 60.0))


@query(
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (SELECT u, v, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS c, ((u * 7 + v) % 50 + 100)::DOUBLE AS m FROM road),
best(source, node, s) USING KEY (source, node) AS (
  SELECT s_suppkey::BIGINT, s_suppkey::BIGINT, struct_pack(c := 0.0::DOUBLE, m := 0.0::DOUBLE) FROM supplier WHERE s_suppkey % 20 = 0
  UNION SELECT p.source, e.v, min(struct_pack(c := p.s.c + e.c, m := p.s.m + e.m)) FROM best p JOIN e ON e.u = p.node LEFT JOIN recurring.best r ON r.source = p.source AND r.node = e.v
    WHERE p.s.c + e.c <= 60 AND (r.s IS NULL OR struct_pack(c := p.s.c + e.c, m := p.s.m + e.m) < r.s) GROUP BY 1, 2)
SELECT source AS src, node AS dst, s.c AS minutes, s.m AS metres FROM best WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)"""
)
def q_travel_matrix(spark, sf):
    """Minutes, and the metres along the quickest path."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"))
    e = _streets(spark, sf).select("u", "v", F.col("cost").alias("minutes"), ((F.col("u") * 7 + F.col("v")) % 50 + 100).cast("double").alias("metres"))
    return graph.travel_matrix(s.where("node % 20 = 0"), s.where("node % 3 = 0"), e, 60.0)


@query(with_views("route_stops") + ", s AS (SELECT route_id, seq, node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS v FROM route_stops) SELECT route_id AS path_id, ((arg_max(u, seq) * 37 + arg_max(v, seq) * 11) % 360)::DOUBLE AS bearing FROM s WHERE v IS NOT NULL GROUP BY 1")
def q_last_bearings(spark, sf):
    s = views.route_stops(spark, sf).withColumn("v", F.lead("node_id").over(Window.partitionBy("route_id").orderBy("seq"))).where("v IS NOT NULL")
    e = _road(spark, sf).select("u", "v", F.lit(1.0).alias("minutes"), ((F.col("u") * 37 + F.col("v") * 11) % 360).cast("double").alias("bearing"))
    return graph.last_bearings(s.select(F.col("route_id").alias("path_id"), "seq", F.col("node_id").alias("u"), "v"), e)


@query(
    _ROAD.replace("WITH", "WITH RECURSIVE", 1)
    + ", " + ", ".join(views.CTES[n] for n in ("students", "stops")) + _STREET
    + f""", far AS (SELECT p.student_id, t.node_id, {HAVERSINE} AS m FROM students p, stops t),
home AS (SELECT student_id, arg_min(node_id, (m, node_id)) AS node FROM far GROUP BY 1),
pol(key, road_class) AS (VALUES ('HIGH', 'primary'), ('HIGH', 'tertiary'), ('MIDDLE', 'tertiary')),
g AS (SELECT k.key, u, v, metres * 10 AS w, synthetic FROM e, (SELECT DISTINCT stage AS key FROM students) k WHERE NOT synthetic OR EXISTS (SELECT 1 FROM pol WHERE pol.key = k.key AND pol.road_class = e.road_class)),
starts AS (SELECT DISTINCT stage AS key, node FROM students JOIN home USING (student_id)),
walk(key, home, node, c) USING KEY (key, home, node) AS (
  SELECT key, node, node, 0.0::DOUBLE FROM starts
  UNION SELECT p.key, p.home, g.v, min(p.c + g.w) FROM walk p JOIN g ON g.key = p.key AND g.u = p.node LEFT JOIN recurring.walk r ON r.key = p.key AND r.home = p.home AND r.node = g.v WHERE p.c + g.w <= 300 AND (r.c IS NULL OR p.c + g.w < r.c) GROUP BY 1, 2, 3),
plain(key, home, node, c) USING KEY (key, home, node) AS (
  SELECT key, node, node, 0.0::DOUBLE FROM starts
  UNION SELECT p.key, p.home, g.v, min(p.c + g.w) FROM plain p JOIN g ON g.key = p.key AND g.u = p.node AND NOT g.synthetic LEFT JOIN recurring.plain r ON r.key = p.key AND r.home = p.home AND r.node = g.v WHERE p.c + g.w <= 300 AND (r.c IS NULL OR p.c + g.w < r.c) GROUP BY 1, 2, 3),
met AS (SELECT s.student_id, w.node, w.c, p.node IS NULL AS only_crossing, w.node % 3 AS points FROM students s JOIN home h USING (student_id) JOIN walk w ON w.key = s.stage AND w.home = h.node AND w.c <= s.radius LEFT JOIN plain p ON p.key = w.key AND p.home = w.home AND p.node = w.node WHERE w.node IN (SELECT node_id FROM stops WHERE node_id % 5 > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY points DESC, c, node) AS n FROM met)
SELECT student_id, node, round(c, 4) AS walk_m, only_crossing, n::INT AS rank FROM r WHERE n <= 5
UNION ALL SELECT student_id, arg_min(node_id, (m, node_id)), round(min(m), 4), NULL, 1 FROM far WHERE node_id % 5 > 0 AND student_id NOT IN (SELECT student_id FROM met) GROUP BY 1"""
)
def q_candidate_search(spark, sf):
    """Stops that each student can walk to over edges and crossings that its stage may use, else the nearest that a bus reaches."""
    from darb.operators import spatial

    s = views.students(spark, sf)
    at = views.stops(spark, sf).select(F.col("node_id").cast("bigint").alias("target"), "lat", "lon")
    home = spatial.nearest(s.withColumnRenamed("student_id", "key"), at).select(F.col("key").alias("student_id"), F.col("target").alias("node"))
    homes = s.join(home, "student_id").select("student_id", "node", "lat", "lon", "radius", F.col("stage").alias("policy_key"))
    policy = spark.createDataFrame([("HIGH", "primary"), ("HIGH", "tertiary"), ("MIDDLE", "tertiary")], "key string, road_class string")
    points = at.where("target % 5 > 0").select(F.col("target").alias("node"), "lat", "lon", (F.col("target") % 3).alias("points"))
    found = graph.candidate_stops(homes, _edges(spark, sf).withColumn("metres", F.col("metres") * 10), policy, points, 5)
    return found.withColumn("walk_m", F.round("walk_m", 4))


@query(with_views("route_stops") + ", s AS (SELECT route_id, node_id AS a, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS b FROM route_stops) SELECT DISTINCT route_id AS path_id, least(a, b) AS lo, greatest(a, b) AS hi FROM s WHERE b IS NOT NULL AND (a + b) % 3 = 0")
def q_path_crossings(spark, sf):
    paths = views.route_stops(spark, sf).select(F.col("route_id").alias("path_id"), "seq", F.col("node_id").alias("node"))
    return graph.path_edges(paths, _edges(spark, sf))


_ANGLE = "((p.b - n.b + 180) - 360 * floor((p.b - n.b + 180) / 360) - 180)"


@query(
    with_views("route_stops")
    + f""", s AS (SELECT route_id, seq, node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS v FROM route_stops),
n AS (SELECT route_id, seq, ((u * 5 + v * 3) % 40 + 10)::DOUBLE AS m, ((u * 37 + v * 11) % 360)::DOUBLE AS b FROM s WHERE v IS NOT NULL),
t AS (SELECT n.route_id, n.m + CASE WHEN p.b IS NULL THEN 0 WHEN abs({_ANGLE}) > 140 THEN 9999.0 WHEN abs({_ANGLE}) > 45 THEN 0.2 ELSE 0 END AS m FROM n LEFT JOIN n p ON p.route_id = n.route_id AND p.seq = n.seq - 1)
SELECT route_id AS path_id, round(sum(m), 6) AS minutes FROM t GROUP BY 1"""
)
def q_path_times(spark, sf):
    s = views.route_stops(spark, sf).withColumn("v", F.lead("node_id").over(Window.partitionBy("route_id").orderBy("seq"))).where("v IS NOT NULL")
    e = _road(spark, sf).select("u", "v", ((F.col("u") * 5 + F.col("v") * 3) % 40 + 10).cast("double").alias("minutes"), ((F.col("u") * 37 + F.col("v") * 11) % 360).cast("double").alias("bearing"))
    return graph.path_times(s.select(F.col("route_id").alias("path_id"), "seq", F.col("node_id").alias("u"), "v"), e).withColumn("minutes", F.round("minutes", 6))


_POINTS = "SELECT s_suppkey AS edge, 30.0::DOUBLE + (s_suppkey % 100) / 1000.0::DOUBLE AS lat, 31.0::DOUBLE + (s_suppkey % 77) / 1000.0::DOUBLE AS lon FROM supplier"


def _geometry(spark, sf):
    lat, lon = F.lit(30.0) + (F.col("s_suppkey") % 100) / F.lit(1000.0), F.lit(31.0) + (F.col("s_suppkey") % 77) / F.lit(1000.0)
    point = lambda a, b: F.struct((lat + a).alias("lat"), (lon + b).alias("lon"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("edge"), F.when(F.col("s_suppkey") % 9 > 0, F.array(point(0.0, 0.0), point(0.001, 0.002), point(0.005, 0.001))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>")).alias("points"))


@query(f"SELECT edge, round(CASE WHEN edge % 9 > 0 THEN lat + 0.002 END, 6) AS lat, round(CASE WHEN edge % 9 > 0 THEN lon + 0.001 END, 6) AS lon FROM ({_POINTS})")
def q_path_midpoints(spark, sf):
    return graph.path_midpoints(_geometry(spark, sf)).select("edge", r6("lat"), r6("lon"))


@query(with_views("visits") + f", g AS ({_POINTS}), x AS (SELECT route_id, seq, g.* FROM visits JOIN g ON edge = node_id WHERE edge % 9 > 0) SELECT v.route_id AS path_id, count(x.edge) * 3 AS points, round(coalesce(sum(x.lat * 3 + 0.006), 0), 6) AS lat_sum, round(arg_min(x.lon, x.seq), 6) AS first_lon FROM (SELECT DISTINCT route_id FROM visits) v LEFT JOIN x ON x.route_id = v.route_id GROUP BY 1")
def q_path_polylines(spark, sf):
    paths = views.visits(spark, sf).select(F.col("route_id").alias("path_id"), "seq", F.col("node_id").cast("bigint").alias("edge"))
    lines = graph.path_polylines(paths, _geometry(spark, sf))
    return lines.select("path_id", F.size("points").cast("bigint").alias("points"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"]), 6).alias("lat_sum"), F.round(F.get("points", F.lit(0))["lon"], 6).alias("first_lon"))


@query(
    """WITH p AS (SELECT (c_custkey % 40)::VARCHAR AS name, CASE WHEN c_custkey % 80 < 40 THEN 'l' ELSE 'r' END AS side, (c_custkey * 7919 % 2001)::DOUBLE AS x, (c_custkey * 104729 % 2001)::DOUBLE AS y, (c_custkey % 30)::DOUBLE AS bearing, c_custkey FROM customer),
a AS (SELECT *, radians(avg(bearing) OVER w) AS g, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY name))
SELECT c_custkey, round((x - cx) * sin(g) + (y - cy) * cos(g), 4) AS axis_m FROM a"""
)
def q_axis_positions(spark, sf):
    c = F.col("c_custkey")
    p = table(spark, sf, "customer").select("c_custkey", (c % 40).cast("string").alias("name"), F.when(c % 80 < 40, "l").otherwise("r").alias("side"), (c * 7919 % 2001).cast("double").alias("x"), (c * 104729 % 2001).cast("double").alias("y"), (c % 30).cast("double").alias("bearing"))
    return routes.axis_positions(p).select("c_custkey", F.round("axis_m", 4).alias("axis_m"))


# ---------------------------------------------------------------- edits of routes


@query(
    with_views("route_stops")
    + """, c AS (SELECT route_id, seq, 100000 + seq AS node_id, (seq % 2)::VARCHAR AS k FROM route_stops WHERE is_pickup AND (route_id + seq) % 3 = 0),
r AS (SELECT route_id, node_id, seq, 0 AS b, '' AS k FROM route_stops UNION ALL SELECT route_id, node_id, seq, 1, k FROM c)
SELECT route_id, (row_number() OVER (PARTITION BY route_id ORDER BY seq, b, k) - 1)::INT AS seq, node_id FROM r"""
)
def q_apply_insertions(spark, sf):
    s = views.route_stops(spark, sf)
    chosen = s.where("is_pickup AND (route_id + seq) % 3 = 0").select("route_id", "seq", (F.lit(100000) + F.col("seq")).cast("bigint").alias("node_id"), (F.col("seq") % 2).alias("student_id"))
    return routes.apply_insertions(s, chosen)


@query(
    with_views("route_stops", "visits")
    + """, left_ AS (SELECT DISTINCT route_id, seq FROM visits WHERE student_id % 4 > 0),
k AS (SELECT s.* FROM route_stops s WHERE NOT is_pickup OR EXISTS (SELECT 1 FROM left_ l WHERE l.route_id = s.route_id AND l.seq = s.seq))
SELECT route_id, (row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1)::INT AS seq, node_id FROM k"""
)
def q_remove_students(spark, sf):
    riders = views.visits(spark, sf).select("route_id", "seq", "student_id")
    return routes.without_students(riders, views.route_stops(spark, sf), riders.where("student_id % 4 = 0").select("student_id"))


@query(with_views("visits") + "SELECT DISTINCT route_id, true AS same_stops, true AS priced, true AS no_worse FROM visits")
def q_two_opt_checked(spark, sf):
    """What two_opt returns, checked: the same stops, minutes that follow from the order, and none above the old order's."""
    old = views.route_stops(spark, sf)
    new = routes.two_opt(old, views.travel_minutes)
    follow = lambda d: d.withColumn("m", views.travel_minutes("node_id", F.lead("node_id").over(Window.partitionBy("route_id").orderBy("seq"))))
    total = lambda d: follow(d).groupBy("route_id").agg(F.sum("m").alias("m"), F.sort_array(F.collect_list("node_id")).alias("nodes"))
    before = total(old).select("route_id", F.col("m").alias("m0"), F.col("nodes").alias("nodes0"))
    after = total(new).join(new.groupBy("route_id").agg(F.max("total_min").alias("t")), "route_id").join(before, "route_id")
    close = (F.col("m") == F.col("t")) | (F.abs(F.col("m") - F.col("t")) < 1e-6)
    return after.select("route_id", (F.col("nodes") == F.col("nodes0")).alias("same_stops"), close.alias("priced"), ((F.col("m") <= F.col("m0") + 1e-9) | (F.col("m0") == float("inf"))).alias("no_worse"))
