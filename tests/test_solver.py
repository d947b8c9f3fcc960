"""The search's kernel: repairs as tables, fleets that begin alike, fleets that can't do."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from darb.operators import solver


def problem(rng, units, capacity=20, fleet=0):
    minutes = rng.integers(0, 6, (units + 1, units + 1)).astype(float)  # whole numbers: many ties
    minutes = minutes + minutes.T if units % 2 else minutes
    minutes[0, 0] = 0
    return solver.Problem(rng.integers(1, 24 if units % 3 else 12, units).tolist(), minutes, capacity, fleet)


def test_repairs_are_those_of_one_place_at_a_time():
    rng = np.random.default_rng(3)
    for units in range(1, 40):
        p, fleet = problem(rng, units), int(rng.integers(0, 12))
        some = rng.permutation(units)[: units // 2].tolist()
        begun = [[] for _ in range(fleet)]
        solver._regret_capped(p, begun, sorted(some), solver.ONE_ROUTE)
        for fast, slow in ((lambda r, w: solver._regret(p, r, w, None), lambda r, w: solver._regret_capped(p, r, sorted(w), solver.ONE_ROUTE)), (lambda r, w: solver._greedy(p, r, w, random.Random(units)), lambda r, w: (random.Random(units).shuffle(w), solver._greedy_capped(p, r, w)))):
            one, two = [list(r) for r in begun], [list(r) for r in begun]
            fast(one, solver._waiting(p, one))
            slow(two, solver._waiting(p, two))
            assert one == two


def test_fleets_begin_alike():
    rng = np.random.default_rng(5)
    for units in (0, 1, 7, 30):
        p = problem(rng, units)
        for f, routes in solver.first_routes(p, [0, 1, 2, 3, 6, 9, 40]).items():
            alone = [[] for _ in range(f)]
            solver._regret(p, alone, list(range(units)), None)
            assert routes == alone


def test_many_units_are_not_priced_route_by_route(monkeypatch):
    """A zone of 500 stops and 300 buses, of which each place in each bus used to be a call."""
    calls, old = [], solver.Problem.best_place
    monkeypatch.setattr(solver.Problem, "best_place", lambda self, *a: (calls.append(1), old(self, *a))[1])
    xy = np.random.default_rng(4).random((501, 2)) * 30
    p = solver.Problem([16] * 100 + [10] * 400, np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1)), 30, 300)
    found = solver.search(p, 1, 3)
    assert found["served"] == 5600 and len(calls) < 1000
    assert sorted(u for r in found["routes"] for u in r) == list(range(500)) and all(p.load(r) <= 30 for r in found["routes"])


def test_packing_bound():
    assert solver.packing_bound([], 30) == 0 and solver.packing_bound([16] * 5, 30) == 5 and solver.packing_bound([30, 15, 15, 1], 30) == 3
    rng = random.Random(2)

    def fits(sizes, bins):
        return any(all(sum(s for s, b in zip(sizes, at) if b == k) <= 10 for k in range(bins)) for at in itertools.product(range(bins), repeat=len(sizes)))

    for _ in range(25):
        sizes = [rng.randint(1, 10) for _ in range(6)]
        assert not (bound := solver.packing_bound(sizes, 10)) > 6 and (bound == 0 or not fits(sizes, bound - 1))


def test_fleets_in_rounds(spark):
    """Five stops of 16 and seats for 30: four fleets from the least on can't do, whatever the blocks."""
    people = spark.createDataFrame([(1, 100 * k + i, 30.0 + k / 100, 31.0) for k in range(5) for i in range(16)], "zone int, student_id int, lat double, lon double")
    places = spark.createDataFrame([(1, k, 30.0 + k / 100, 31.0) for k in range(5)], "zone int, node_id int, lat double, lon double")
    by = [solver.solve_fleets(people, places, [1, 2], 30, 5, block=b).orderBy("fleet", "seed").collect() for b in (1, 2, 9)]
    assert by[0] == by[1] == by[2] and [(r.fleet, r.seed, r.served) for r in by[0]] == [(f, s, min(f * 16, 80)) for f in (3, 4, 5) for s in (1, 2)]
    grid = solver.solve_grid(people, places, [1, 2], [3, 4, 5], 30, 5).orderBy("fleet", "seed").collect()
    assert grid == by[0]


def test_fleets_below_the_bound_are_not_searched_for_the_smallest(spark):
    people = spark.createDataFrame([(z, 100 * k + i, 30.0 + k / 100, 31.0) for z in (1, 2) for k in range(5) for i in range(16 if z == 1 else 15)], "zone int, student_id int, lat double, lon double")
    places = spark.createDataFrame([(z, k, 30.0 + k / 100, 31.0) for z in (1, 2) for k in range(5)], "zone int, node_id int, lat double, lon double")
    order = lambda d: d.orderBy("zone").collect()
    every, few = (solver.solve_fleets(people, places, [1, 2], 30, 5, enough_only=e) for e in (False, True))
    assert {(r.zone, r.fleet) for r in few.collect()} == {(1, 5), (2, 3)} and order(solver.smallest_fleet(few)) == order(solver.smallest_fleet(every))
    # nobody can ride: no fleet is enough, so each counts
    every, few = (solver.solve_fleets(people, places, [1], 30, 3, cap=F.lit(-1.0), enough_only=e) for e in (False, True))
    assert {(r.zone, r.fleet) for r in few.collect()} == {(r.zone, r.fleet) for r in every.collect()} and order(solver.smallest_fleet(few)) == order(solver.smallest_fleet(every))
