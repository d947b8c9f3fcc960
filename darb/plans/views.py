"""The routing domain over the driver's tables, as DataFrames and as the same common table expressions in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darb.operators import routes
from darb.operators.classed import ClassedPrice
from darb.session import table

#: lineitem's (orderkey, linenumber) is no key; this order is total.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
SCHOOL = 0


def students(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS student_id",
        "CASE c_custkey % 4 WHEN 0 THEN 'KG' WHEN 1 THEN 'ELEMENTARY' WHEN 2 THEN 'MIDDLE' ELSE 'HIGH' END AS stage",
        "c_custkey % 8 = 0 AS disabled",
        "30.0D + ((c_custkey * 7919) % 2001 - 1000) / 10000.0D AS lat",
        "31.2D + ((c_custkey * 104729) % 2001 - 1000) / 10000.0D AS lon",
        "CAST((c_custkey % 4) * 100 AS DOUBLE) AS radius",
    )


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS node_id", "30.0D + ((s_suppkey * 6563) % 2001 - 1000) / 10000.0D AS lat", "31.2D + ((s_suppkey * 31337) % 2001 - 1000) / 10000.0D AS lon")


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Pickups of a route in order: (route_id, seq from 1, node_id, student_id, walk_m, direct_min, tier)."""
    lines = routes.with_sequence(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "route_id"), "route_id", LINE_ORDER)
    return lines.selectExpr(
        "route_id", "seq", "l_suppkey AS node_id", "l_partkey AS student_id", "l_quantity * 10 AS walk_m",
        "CAST(l_partkey % 50 AS DOUBLE) - 2 AS direct_min",
        "CASE l_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'primary_plus' WHEN 4 THEN 'odd' END AS tier",
        "l_returnflag AS mode", "l_linestatus AS status", "l_shipdate AS at",
    )


def route_stops(spark: SparkSession, sf: str, *carried: str) -> DataFrame:
    """Pickups with the school at both ends: (route_id, seq from 0, node_id, is_pickup), with columns of `visits` that the school lacks.

    A route's pickups are put into one array where they are sorted, so that lineitem is read and shuffled once.
    """
    v = visits(spark, sf).withColumn("node_id", F.col("node_id").cast("bigint"))
    kinds = dict(v.dtypes)
    stop = lambda seq, node, pickup, rest: F.struct(seq.cast("int").alias("seq"), node.alias("node_id"), F.lit(pickup).alias("is_pickup"), *rest)
    school = lambda seq: stop(seq, F.lit(SCHOOL).cast("bigint"), False, [F.lit(None).cast(kinds[c]).alias(c) for c in carried])
    routes_ = v.groupBy("route_id").agg(F.collect_list(stop(F.col("seq"), F.col("node_id"), True, [F.col(c) for c in carried])).alias("s"))
    return routes_.select("route_id", F.inline(F.concat(F.array(school(F.lit(0))), "s", F.array(school(F.size("s") + 1)))))


_MINUTES = "CASE WHEN (src * 13 + dst * 7) % 97 = 0 THEN {inf} ELSE ((src * 31 + dst * 17) % 600) / 100.0{d} + 1.0{d} END"


def travel_minutes(src: str | Column, dst: str | Column) -> Column:
    """Minutes between any two nodes, equal ones too, by the matrix's formula; infinity if unreachable."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    minutes = (a * 31 + b * 17) % 600 / F.lit(100.0) + F.lit(1.0)
    return F.when((a * 13 + b * 7) % 97 == 0, float("inf")).otherwise(minutes)


def _class_of(nodes: np.ndarray) -> np.ndarray:
    return nodes % 600


def _gate_of(nodes: np.ndarray) -> np.ndarray:
    return nodes % 97


def _by_pair(n: int, formula) -> np.ndarray:
    return formula(np.arange(n)[:, None], np.arange(n)[None, :])


#: travel_minutes of arrays of nodes; the formula looks at a node's rests by 600 and by 97 only.
travel_minutes_of = ClassedPrice(_class_of, _gate_of, _by_pair(600, lambda a, b: (a * 31 + b * 17) % 600 / 100.0 + 1.0), _by_pair(97, lambda a, b: (a * 13 + b * 7) % 97 == 0))


def od_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Directed travel between nodes that any route has next to each other, either way; some pairs are unreachable."""
    n = F.concat(F.array(F.lit(SCHOOL).cast("bigint")), F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("node_id").cast("bigint").alias("n")))), lambda x: x["n"]), F.array(F.lit(SCHOOL).cast("bigint")))
    lined = visits(spark, sf).groupBy("route_id").agg(n.alias("n"))
    legs = F.arrays_zip(F.slice("n", 1, F.size("n") - 1).alias("src"), F.slice("n", 2, F.size("n") - 1).alias("dst"))
    both = lined.select(F.explode(legs).alias("p")).select(F.explode(F.array(F.struct(F.col("p.src").alias("src"), F.col("p.dst").alias("dst")), F.struct(F.col("p.dst").alias("src"), F.col("p.src").alias("dst")))).alias("p")).select("p.*").distinct()
    minutes = F.expr(_MINUTES.format(inf="double('infinity')", d="D"))
    return both.withColumn("minutes", minutes).withColumn("metres", F.col("minutes") * 400.0)


def priced(pairs: DataFrame) -> DataFrame:
    """(src, dst, minutes, metres) of all given pairs (src, dst) of nodes, whether or not a route has them next to each other."""
    return pairs.select("src", "dst").distinct().withColumn("minutes", travel_minutes("src", "dst")).withColumn("metres", F.col("minutes") * 400.0)


#: The views above in DuckDB SQL.
CTES = {
    "students": """students AS (
  SELECT c_custkey AS student_id, CASE c_custkey % 4 WHEN 0 THEN 'KG' WHEN 1 THEN 'ELEMENTARY' WHEN 2 THEN 'MIDDLE' ELSE 'HIGH' END AS stage,
    c_custkey % 8 = 0 AS disabled, 30.0::DOUBLE + ((c_custkey * 7919) % 2001 - 1000) / 10000.0::DOUBLE AS lat,
    31.2::DOUBLE + ((c_custkey * 104729) % 2001 - 1000) / 10000.0::DOUBLE AS lon, ((c_custkey % 4) * 100)::DOUBLE AS radius FROM customer)""",
    "stops": """stops AS (
  SELECT s_suppkey AS node_id, 30.0::DOUBLE + ((s_suppkey * 6563) % 2001 - 1000) / 10000.0::DOUBLE AS lat, 31.2::DOUBLE + ((s_suppkey * 31337) % 2001 - 1000) / 10000.0::DOUBLE AS lon FROM supplier)""",
    "visits": """visits AS (
  SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)::INT AS seq,
    l_suppkey AS node_id, l_partkey AS student_id, l_quantity * 10 AS walk_m, (l_partkey % 50)::DOUBLE - 2 AS direct_min,
    CASE l_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'primary_plus' WHEN 4 THEN 'odd' END AS tier,
    l_returnflag AS mode, l_linestatus AS status, l_shipdate AS at FROM lineitem)""",
    "route_stops": """route_stops AS (
  SELECT route_id, seq, node_id, true AS is_pickup FROM visits
  UNION ALL SELECT DISTINCT route_id, 0, 0, false FROM visits
  UNION ALL SELECT route_id, max(seq) + 1, 0, false FROM visits GROUP BY route_id)""",
    "od": """pairs AS (
  SELECT DISTINCT node_id AS src, dst FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS dst FROM route_stops) WHERE dst IS NOT NULL),
od AS (
  SELECT src, dst, minutes, minutes * 400.0 AS metres FROM (
    SELECT src, dst, """ + _MINUTES.format(inf="'Infinity'::DOUBLE", d="::DOUBLE") + """ AS minutes FROM (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs)))""",
    "legs": """legs AS (
  SELECT p.route_id, p.seq, p.src, p.dst, od.minutes, od.metres FROM
    (SELECT route_id, seq, node_id AS src, lead(node_id) OVER (PARTITION BY route_id ORDER BY seq) AS dst FROM route_stops) p
    LEFT JOIN od ON p.src = od.src AND p.dst = od.dst WHERE p.dst IS NOT NULL)""",
    "rides": """rides AS (
  SELECT *, sum(minutes) OVER w AS ride_min, sum(metres) OVER w AS ride_m FROM legs
  WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "riders": """riders AS (
  SELECT v.*, r.ride_min, r.ride_m FROM visits v JOIN rides r ON v.route_id = r.route_id AND v.seq = r.seq)""",
}
_NEEDS = {"route_stops": ["visits"], "od": ["route_stops"], "legs": ["od"], "rides": ["legs"], "riders": ["rides"]}


def with_views(*names: str) -> str:
    """WITH clause of the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(CTES[n] for n in order)


def rides(spark: SparkSession, sf: str) -> DataFrame:
    return routes.morning_rides(routes.legs(route_stops(spark, sf), od_matrix(spark, sf)))


VISIT = ("student_id", "walk_m", "direct_min", "tier", "mode", "status", "at")


def riders(spark: SparkSession, sf: str, carried: tuple[str, ...] = VISIT) -> DataFrame:
    """Visits with the time and length of the ride to school."""
    return routes.morning_rides(routes.legs(route_stops(spark, sf, *carried), od_matrix(spark, sf), carried)).where("seq > 0").withColumnRenamed("src", "node_id").drop("dst", "minutes", "metres")


def riders_both_ways(spark: SparkSession, sf: str, carried: tuple[str, ...] = VISIT) -> DataFrame:
    """Visits with the time of the ride to school (ride_min) and of the ride back on the route run backwards (pm_min)."""
    return routes.rides_both_ways(route_stops(spark, sf, *carried), od_matrix(spark, sf), carried).where("seq > 0")
