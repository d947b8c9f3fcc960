"""Queries that must not cut their candidates, beside plain SQL over all of them."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from darb.operators import routes, solver
from darb.operators.spatial import nearest_edges_any
from darb.plans import views
from darb.plans.run_queries import _HAV
from darb.plans.views import with_views
from tests.conftest import SF
from verify_sql import rows_of

_MIN = "CASE WHEN ({a} * 13 + {b} * 7) % 97 = 0 THEN 'Infinity'::DOUBLE ELSE (({a} * 31 + {b} * 17) % 600) / 100.0::DOUBLE + 1.0 END"
# the nearest stop and those within the walk, against every leg of every route
_ALL = (
    with_views("students", "stops", "legs")
    + f""", far AS (SELECT p.student_id, p.radius, t.node_id, {_HAV} AS m FROM students p, stops t),
cand AS (SELECT student_id, node_id FROM far WHERE m <= radius UNION SELECT student_id, arg_min(node_id, (m, node_id)) FROM far GROUP BY 1),
pos AS (SELECT c.student_id, c.node_id, l.route_id, l.seq, l.dst, l.minutes AS uv, {_MIN.format(a="l.src", b="c.node_id")} AS uc, {_MIN.format(a="c.node_id", b="l.dst")} AS cv FROM cand c, legs l),
ins AS (SELECT *, uc + cv - uv AS delta FROM pos WHERE NOT isinf(uc) AND NOT isinf(cv) AND NOT isinf(uv))
"""
)
WHOLE = {
    "q_insertion_argmin": _ALL + "SELECT student_id, count(*) AS options, round(min(delta), 6) AS delta FROM ins GROUP BY 1",
    "q_regret_k": _ALL
    + """, r AS (SELECT student_id, route_id, min(delta) AS c FROM ins GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY c, route_id) AS n FROM r)
SELECT student_id, round(min(c), 6) AS best, round(coalesce(max(CASE WHEN n = 2 THEN c END) - min(c), 2000 - min(c)), 6) AS regret FROM k GROUP BY 1""",
    "q_nearest_edge": with_views("students", "stops")
    + """, e AS (SELECT lon AS x1, lat AS y1, lon + 0.002 AS x2, lat + 0.001 AS y2 FROM stops),
d AS (SELECT student_id AS key, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t, lon, lat, x1, y1, x2, y2 FROM students, e)
SELECT key, round(min(sqrt(pow(lon - (x1 + t * (x2 - x1)), 2) + pow(lat - (y1 + t * (y2 - y1)), 2))), 8) AS degrees FROM d GROUP BY key""",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, name):
    duck = duckdb.connect()
    for t in ("customer", "supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, SF), duck.sql(WHOLE[name])
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(rel.columns, rel.fetchall())


def test_fleets_grow_until_everyone_is_served(spark):
    rng = random.Random(4)
    at = lambda: (30 + rng.random() / 20, 31 + rng.random() / 20)
    people = spark.createDataFrame([(1, i, *at()) for i in range(301)] + [(2, i, *at()) for i in range(7)] + [(3, 0, *at())], "zone int, student_id int, lat double, lon double")
    places = spark.createDataFrame([(z, i, *at()) for z in (1, 2) for i in range(20)], "zone int, node_id int, lat double, lon double")
    run = lambda block: sorted(map(tuple, solver.solve_fleets(people, places, [1, 2], 30, 5, block=block).collect()))
    rows = run(1)
    assert rows == run(4)  # the blocks change the work alone
    of = lambda zone: {(fleet, served == students) for z, _, fleet, students, served, *_ in rows if z == zone}
    fleets = sorted(fleet for fleet, _ in of(1))
    assert fleets[0] == 11 and {f for f, full in of(1) if full} == {fleets[-1]}
    assert of(2) == {(1, True)} and of(3) == {(1, False)}
    best = {r.zone: r for r in solver.smallest_fleet(solver.solve_fleets(people, places, [1, 2], 30, 5)).collect()}
    assert best[1].fleet == fleets[-1] and best[1].served == 301 and best[3].served == 0
    assert solver.solve_fleets(people.limit(0), places, [1], 30, 5).count() == 0


def test_every_point_gets_its_nearest_edge(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.0), (2, 0.5, 0.5, 0.5, 0.5), (3, None, 0.0, 0.0, 0.0)], "edge bigint, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.005, 0.001), (2, 0.2, 0.2), (3, -40.0, 0.0), (4, None, 1.0), (5, float("nan"), 1.0)], "key bigint, x double, y double")
    got = {r.key: (r.edge, round(r.degrees, 6)) for r in nearest_edges_any(p, e).collect()}
    assert got == {1: (1, 0.001), 2: (1, round((0.19**2 + 0.2**2) ** 0.5, 6)), 3: (1, 40.0)}
    assert nearest_edges_any(p, e.limit(0)).count() == 0


def test_pairs_that_no_route_drives_are_priced(spark, monkeypatch):
    """A route 0-1-2-3-0 alone: 1-3 and 0-2 are in no leg, yet each removal has a saving and each reversal a price."""
    stops = spark.createDataFrame([(1, i, n, n > 0) for i, n in enumerate([0, 1, 2, 3, 0])], "route_id bigint, seq int, node_id bigint, is_pickup boolean")
    monkeypatch.setattr(views, "route_stops", lambda *_: stops)
    minutes = lambda a, b: (a * 31 + b * 17) % 600 / 100 + 1.0
    got = {r.node_id: r.saved_min for r in entry.queries()["q_removal_savings"](spark, SF).collect()}
    assert got == {n: pytest.approx(minutes(a, n) + minutes(n, b) - minutes(a, b)) for a, n, b in ((0, 1, 2), (1, 2, 3), (2, 3, 0))}
    rows = entry.queries()["q_two_opt"](spark, SF).orderBy("seq").collect()
    order = [r.node_id for r in rows]
    total = lambda s: sum(minutes(a, b) for a, b in zip(s, s[1:]))
    assert rows[0].total_min == pytest.approx(total(order)) and rows[0].saved_min == pytest.approx(total([0, 1, 2, 3, 0]) - total(order))
    assert all(total(order[:i] + order[i : j + 1][::-1] + order[j + 1 :]) >= total(order) - 0.01 for i in range(1, 4) for j in range(i + 1, 4))


def test_two_opt_goes_on_beside_unreachable_legs():
    inf = float("inf")
    cost = {(a, b): 1.0 if b == a + 1 else 5.0 for a in range(5) for b in range(5) if a != b} | {(4, 0): 1.0, (0, 1): inf}
    order, minutes, saved = routes._improved([0, 1, 3, 2, 4, 0], cost | {(0, b): inf for b in range(5)}, 0.01)
    inner = lambda s: sum(cost[x] for x in zip(s[1:], s[2:]))
    assert minutes == inf and 0 < saved == pytest.approx(inner([0, 1, 3, 2, 4, 0]) - inner(order))
    order, minutes, saved = routes._improved([0, 1, 2, 3, 4, 0], cost, 0.01)
    assert order[1] != 1 and minutes < inf and saved == inf
