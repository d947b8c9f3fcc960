"""Positions of nodes in routes beside plain loops over all of them."""

import math
import random

import numpy as np
import pytest

from darb.operators import classed, routes
from darb.operators import insertions as ins

INF = math.inf


def minutes(a, b):
    return INF if (a * 5 + b * 3) % 11 == 0 else (a * 7 + b * 13) % 40 / 4 + 1


def price(a, b):
    return np.where((a * 5 + b * 3) % 11 == 0, np.inf, (a * 7 + b * 13) % 40 / 4 + 1.0)


def rides(nodes):
    """Morning ride of each stop, and the ride back on the route run backwards from its first node."""
    morning = [sum(minutes(*x) for x in zip(nodes[k:], nodes[k + 1 :])) for k in range(len(nodes))]
    back = [nodes[0], *reversed(nodes[1:-1])]
    evening = [sum(minutes(*x) for x in zip(back[: len(nodes) - 1 - k], back[1 : len(nodes) - k])) for k in range(len(nodes))]
    return morning, evening


def brute(all_routes, node, cap, rule):
    """(options, delta, route, seq) of a node in all routes {id: [(node, cap of its rider or None)]}."""
    found = []
    for r, stops in all_routes.items():
        nodes = [n for n, _ in stops]
        for i in range(len(nodes) - 1):
            uv, uc, cv = minutes(nodes[i], nodes[i + 1]), minutes(nodes[i], node), minutes(node, nodes[i + 1])
            if INF in (uv, uc, cv):
                continue
            after = [*nodes[: i + 1], node, *nodes[i + 1 :]]
            morning, evening = rides(after)
            keeps = lambda k, c: {"free": True, "am": morning[k] <= c + 1e-9, "either": morning[k] <= c + 1e-9 or evening[k] <= c + 1e-9, "both": morning[k] <= c + 1e-9 and evening[k] <= c + 1e-9}[rule]  # noqa: B023, E731
            if keeps(i + 1, cap) and (rule == "free" or all(keeps(k, stops[k][1]) for k in range(1, i + 1) if stops[k][1] is not None)):
                found.append((uc + cv - uv, r, i))
    best = min(found) if found else None
    return (len(found), *best) if best else None


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    everything = {r: [(0, None), *((rng.randrange(1, 30), rng.choice([None, 10.0, 20.0, 35.0, 60.0])) for _ in range(rng.randrange(0, 7))), (0, None)] for r in range(1, 60)}
    rows = [(r, k, n, c) for r, stops in everything.items() for k, (n, c) in enumerate(stops)]
    stops = spark.createDataFrame(rows, "route_id bigint, seq int, node_id bigint, cap double")
    od = spark.createDataFrame([(a, b, minutes(a, b), 1.0) for a in range(30) for b in range(30)], "src bigint, dst bigint, minutes double, metres double")
    return everything, stops, od


@pytest.mark.parametrize("rule", ["free", "am", "either", "both"])
@pytest.mark.parametrize("block", [200_000, 3])
def test_best_positions(spark, case, monkeypatch, rule, block):
    from pyspark.sql import functions as F

    everything, stops, od = case
    monkeypatch.setattr(ins, "NODE_BLOCK", block)
    rows = ins.route_rows(routes.legs_both_ways(stops, od, ("cap",)), F.col("cap"))
    asked = [(n, c) for n in (0, 3, 7, 12, 40) for c in (5.0, 15.0, 40.0)]
    items = spark.createDataFrame([*asked, asked[0], (None, 5.0), (3, None)], "node_id bigint, cap_min double")
    got = {(r.node_id, r.cap_min): (r.options, round(r.delta, 6), r.route_id, r.seq) for r in ins.best_positions(rows, items, price, rule).collect()}
    want = {(n, c): (b[0], round(b[1], 6), b[2], b[3]) for n, c in asked if (b := brute(everything, n, c, rule))}
    assert got == want and len(want) > 5


def test_cheapest_routes_and_regret(spark, case):
    everything, stops, od = case
    rows = ins.route_rows(routes.legs(stops, od))
    candidates = spark.createDataFrame([("s", 3), ("s", 7), ("t", 12), ("u", None), ("t", 12)], "student_id string, node_id bigint")
    got = {r.student_id: (round(r.best, 6), round(r.regret, 6)) for r in routes.regret(ins.cheapest_routes(rows, candidates, price)).collect()}
    for student, nodes in (("s", (3, 7)), ("t", (12,))):
        per = sorted(min(x[1] for n in nodes if (x := brute({r: stops_}, n, INF, "free"))) for r, stops_ in everything.items() if any(brute({r: stops_}, n, INF, "free") for n in nodes))
        assert got[student] == (round(per[0], 6), round(per[1] - per[0], 6))
    assert set(got) == {"s", "t"}


def test_seats_unknown_legs_and_nothing(spark, case):
    _, stops, od = case
    legs = routes.legs(stops, od)
    seats = spark.createDataFrame([(1, 5, 5), (2, 0, 5), (None, 0, 5)], "route_id bigint, load int, capacity int")
    assert {r.route_id for r in ins.route_rows(legs, seats=seats).collect()} == {2}
    items = spark.createDataFrame([(3, 40.0)], "node_id bigint, cap_min double")
    gone = od.where("src <> 0")  # the first leg of every route is unknown
    found = ins.best_positions(ins.route_rows(routes.legs(stops, gone)), items, price, "free").first()
    assert found.options > 0 and found.seq > 0
    rows = ins.route_rows(legs)
    assert ins.best_positions(rows.limit(0), items, price, "free").count() == ins.best_positions(rows, items.limit(0), price, "am").count() == 0


def test_rides_both_ways(spark, case):
    everything, stops, od = case
    got = {(r.route_id, r.seq): (r.ride_min, r.pm_min) for r in routes.rides_both_ways(stops, od).collect()}
    for r, row in everything.items():
        morning, evening = rides([n for n, _ in row])
        for k in range(1, len(row) - 1):
            assert got[r, k] == (pytest.approx(morning[k]), pytest.approx(evening[k]))


class ByClassOnly(classed.ClassedPrice):
    def __call__(self, src, dst):
        raise AssertionError("priced node by node")


def by_class():
    a, g = np.arange(40), np.arange(11)
    return ByClassOnly(lambda x: x % 40, lambda x: x % 11, (a[:, None] * 7 + a * 13) % 40 / 4 + 1.0, (g[:, None] * 5 + g * 3) % 11 == 0)


@pytest.mark.parametrize("rule", ["free", "am", "either", "both"])
@pytest.mark.parametrize("sizes", [None, (40, 10, 7, 4)])
def test_positions_by_class(spark, case, monkeypatch, rule, sizes):
    """A leg is priced once for all nodes of a class (more nodes than classes), with the results of pricing every node."""
    from pyspark.sql import functions as F

    everything, stops, od = case
    rows = ins.route_rows(routes.legs_both_ways(stops, od, ("cap",)), F.col("cap"))
    asked = [(n, c) for n in (*range(14), 40, 43, 87, 440, 443) for c in (5.0, 15.0, 22.5, 40.0, INF)]
    for name, size in zip(("GATHER", "FIRST", "CHUNK", "SORTED"), sizes or ()):
        monkeypatch.setattr(classed, name, size)
    read = list(rows.toArrow().to_batches(max_chunksize=7))
    nodes = np.array(sorted({n for n, _ in asked}))
    price = by_class()
    kinds, caps = np.unique(price.kinds(nodes)), np.array([5.0, 15.0, 22.5, 40.0, INF])
    (out,) = classed.best_by_class(kinds, caps, price, rule, ins._Legs, ins.SLACK)(iter(read))
    of_kind = {(r["kind"], r["cap_min"]): (r["options"], round(r["delta"], 6), r["route_id"], r["seq"]) for r in out.to_pylist()}
    got = {(n, c): found for n, c in asked if (found := of_kind.get((price.kinds(np.array([n]))[0], c)))}
    want = {(n, c): (b[0], round(b[1], 6), b[2], b[3]) for n, c in asked if (b := brute(everything, n, c, rule))}
    assert got == want and len(want) > 30
    if sizes is None:
        found = ins.best_positions(rows, spark.createDataFrame(asked, "node_id bigint, cap_min double"), price, rule).collect()
        assert {(r.node_id, r.cap_min): (r.options, round(r.delta, 6), r.route_id, r.seq) for r in found} == want


@pytest.mark.parametrize("sizes", [None, (40, 10, 7, 4)])
def test_cheapest_routes_by_class(spark, case, monkeypatch, sizes):
    everything, stops, od = case
    rows = ins.route_rows(routes.legs(stops, od))
    for name, size in zip(("GATHER", "FIRST", "CHUNK", "SORTED"), sizes or ()):
        monkeypatch.setattr(classed, name, size)
    price, nodes = by_class(), np.array([0, 3, 7, 12, 40, 43, 87])
    per = {n: sorted((round(x[1], 6), r) for r, s in everything.items() if (x := brute({r: s}, n, INF, "free")))[:3] for n in map(int, nodes)}
    (out,) = classed.cheapest_by_class(np.unique(price.kinds(nodes)), price, 3, ins._Legs)(iter(rows.toArrow().to_batches(max_chunksize=7)))
    for n in per:
        kind = price.kinds(np.array([n]))[0]
        assert sorted((round(r["delta"], 6), r["route_id"]) for r in out.to_pylist() if r["kind"] == kind) == per[n]
    if sizes is None:
        found = ins.cheapest_routes(rows, spark.createDataFrame([(f"s{n}", n) for n in per], "student_id string, node_id bigint"), price, 3).collect()
        assert {n: sorted((round(r.delta, 6), r.route_id) for r in found if r.student_id == f"s{n}") for n in per} == per
