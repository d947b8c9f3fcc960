"""Operators of the routing domain on small fixtures with known answers, nulls, ties and empty tables."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from darb.functions import scalars
from darb.functions.geo import angle_difference, bearing_deg, crossing_angle_ok, perpendicular_delta, segment_ratio, virtual_node_id
from darb.operators import crossings, graph, metrics, routes, solver, stats


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    assert one(spark, angle_difference(350.0, 10.0), angle_difference(10.0, 350.0), angle_difference(0.0, 180.0), perpendicular_delta(0.0, 100.0)) == (20.0, 20.0, 180.0, 10.0)
    assert one(spark, bearing_deg(0.0, 0.0, 0.0, 1.0), bearing_deg(0.0, 0.0, -1.0, 0.0), bearing_deg(1.0, 1.0, 1.0, 1.0)) == (90.0, 180.0, None)
    assert one(spark, crossing_angle_ok(0.0, 100.0), crossing_angle_ok(0.0, 130.0), crossing_angle_ok(0.0, 50.0, low=40, high=60)) == (True, False, True)
    assert one(spark, segment_ratio(5.0, 5.0, 0.0, 0.0, 0.0, 0.0), segment_ratio(9.0, 0.0, 0.0, 0.0, 1.0, 0.0)) == (0.0, 1.0)
    assert one(spark, virtual_node_id(30.0161312, 31.6982000)) == ("999300161312316982000",)
    assert one(spark, scalars.turn_penalty(0.0, 170.0), scalars.turn_penalty(0.0, 90.0), scalars.turn_penalty(0.0, 30.0), scalars.turn_penalty(F.lit(None).cast("double"), 1.0)) == (9999.0, 0.2, 0.0, 0.0)
    assert one(spark, scalars.speed_kph(F.lit("50 mph")), scalars.speed_kph(F.lit("60")), scalars.speed_kph(F.lit("walk")), scalars.speed_kph(F.lit(None).cast("string"))) == (80.467, 60.0, 30.0, 30.0)
    assert one(spark, scalars.road_tier(F.lit("Secondary_link")), scalars.road_tier(F.lit("trunk")), scalars.road_tier(F.lit(None).cast("string"))) == ("secondary", "primary_plus", "unknown")
    assert one(spark, scalars.road_name(F.lit("  El-Nasr_St/ North "))) == ("el nasr st north",)
    assert one(spark, scalars.walk_penalty(150.0, 100.0), scalars.walk_penalty(400.0, 100.0), scalars.walk_penalty(50.0, 0.0), scalars.walk_penalty(10.0, 100.0)) == (1.0, math.inf, 2.0, 0.0)
    assert one(spark, scalars.ride_cap(20.0, 45.0, 30.0), scalars.ride_cap(0.0, 45.0, 30.0), scalars.ride_cap(math.inf, 45.0, 30.0)) == (50.0, 45.0, math.inf)
    assert one(spark, scalars.finite(F.lit("x")), scalars.finite(F.lit("NaN")), scalars.finite(F.lit(" 2.5")), scalars.finite(math.inf)) == (None, None, 2.5, None)
    assert one(spark, scalars.clamped_percent(7, 5), scalars.clamped_percent(-1, 5), scalars.clamped_percent(1, 0), scalars.clamped_percent(F.lit(None).cast("int"), 5)) == (100.0, 0.0, None, None)
    assert one(spark, scalars.run_timestamp(F.lit("03/11/25 10:24 pm")), scalars.run_timestamp(F.lit("soon"))) == (dt.datetime(2025, 11, 3, 22, 24), None)
    assert one(spark, *(scalars.bin_start(x, [0.0, 10.0, 20.0]) for x in (0.0, 9.9, 10.0, 20.0, 20.1, -0.1))) == (0.0, 0.0, 10.0, 10.0, None, None)
    assert one(spark, scalars.relative_change(0.0, 1.0), scalars.relative_change(-2.0, 1.0)) == (None, 150.0)
    assert one(spark, scalars.mode_key(F.lit(" Constrained")), scalars.mode_key(F.lit("")), scalars.mode_key(F.lit(None).cast("string"))) == ("strictly_constrained", "unknown", "unknown")
    assert one(spark, scalars.stage(F.lit("high ")), scalars.stage(F.lit("x")), scalars.safe_file_name(F.lit("a b/c.json"))) == ("HIGH", "ELEMENTARY", "a_b_c.json")
    assert one(spark, scalars.look_up(F.lit("b"), {"a": 1, "b": 2}), scalars.look_up(F.lit("z"), {"a": 1}, 0)) == (2, 0)


STOPS = "route_id int, seq int, node_id string, is_pickup boolean"
OD = "src string, dst string, minutes double, metres double"


def route(spark, rows=(("S", False), ("a", True), ("b", True), ("S", False)), rid=1):
    return spark.createDataFrame([(rid, i, n, p) for i, (n, p) in enumerate(rows)], STOPS)


def matrix(spark, pairs):
    return spark.createDataFrame([(a, b, m, m * 500 if m is not None else None) for (a, b), m in pairs.items()], OD)


def test_rides_by_hand_on_an_asymmetric_matrix(spark):
    od = matrix(spark, {("S", "a"): 5.0, ("a", "b"): 3.0, ("b", "S"): 7.0, ("S", "b"): 11.0, ("b", "a"): 13.0})
    legs = routes.legs(route(spark), od)
    assert sorted((r.seq, r.ride_min, r.ride_m) for r in routes.morning_rides(legs).collect()) == [(0, 15.0, 7500.0), (1, 10.0, 5000.0), (2, 7.0, 3500.0)]
    assert sorted((r.node_id, r.ride_min) for r in routes.evening_rides(route(spark), od).collect()) == [("a", 24.0), ("b", 11.0)]
    assert [(r.total_min, r.total_km) for r in routes.route_totals(legs).collect()] == [(15.0, 7.5)]


def test_unreachable_and_unknown_legs(spark):
    far = routes.legs(route(spark), matrix(spark, {("S", "a"): 5.0, ("a", "b"): math.inf, ("b", "S"): 7.0}))
    assert [(r.total_min, r.total_km) for r in routes.route_totals(far).collect()] == [(9999.0, 0.0)]
    unknown = routes.legs(route(spark), matrix(spark, {("S", "a"): 5.0, ("b", "S"): 7.0}))
    assert [(r.total_min, r.total_km) for r in routes.route_totals(unknown).collect()] == [(None, None)]
    assert sorted((r.seq, r.ride_min) for r in routes.morning_rides(unknown).collect()) == [(0, None), (1, None), (2, 7.0)]
    empty = route(spark).limit(0)
    assert routes.legs(empty, matrix(spark, {("S", "a"): 1.0})).count() == routes.evening_rides(empty, matrix(spark, {("S", "a"): 1.0})).count() == 0


def test_pickup_order_and_first_boarding(spark):
    assert [r.pickup_order for r in routes.pickup_order(route(spark)).orderBy("seq").collect()] == [0, 1, 2, 2]
    df = route(spark).withColumn("n", F.when(F.col("seq") == 2, 4))
    assert [tuple(r) for r in routes.first_boarding(df, "n").collect()] == [(1, 2)]


def test_insertions_regret_and_application(spark):
    od = matrix(spark, {("S", "a"): 5.0, ("a", "S"): 5.0, ("S", "c"): 2.0, ("c", "a"): 4.0, ("a", "c"): 4.0, ("c", "S"): 3.0, ("S", "S"): 0.0})
    two = route(spark, (("S", False), ("a", True), ("S", False)), 1).unionByName(route(spark, (("S", False), ("S", False)), 2))
    cand = spark.createDataFrame([("s1", 1, "c"), ("s1", 2, "c"), ("s2", 2, "c"), ("s3", 2, "nowhere")], "student_id string, route_id int, node_id string")
    ins = routes.insertion_costs(routes.legs(two, od), cand, od)
    assert sorted(map(tuple, ins.collect())) == [("s1", 1, 0, "c", 1.0), ("s1", 1, 1, "c", 2.0), ("s1", 2, 0, "c", 5.0), ("s2", 2, 0, "c", 5.0)]
    assert sorted(map(tuple, routes.cheapest(ins).collect())) == [("s1", 1, 0, "c", 1.0), ("s2", 2, 0, "c", 5.0)]
    assert sorted(map(tuple, routes.regret(ins).collect())) == [("s1", 1.0, 4.0), ("s2", 5.0, 1995.0)]
    done = routes.apply_insertions(two, routes.cheapest(ins)).orderBy("route_id", "seq").collect()
    assert [tuple(r) for r in done] == [(1, 0, "S"), (1, 1, "c"), (1, 2, "a"), (1, 3, "S"), (2, 0, "S"), (2, 1, "c"), (2, 2, "S")]


def test_dangerous_runs(spark):
    edges = [("p", i, m, d) for i, (m, d) in enumerate([(10.0, False), (60.0, True), (40.0, True), (5.0, False), (200.0, True), (1.0, True), (9.0, False), (30.0, True)])]
    df = spark.createDataFrame(edges, "path_id string, seq int, metres double, dangerous boolean")
    assert sorted(map(tuple, routes.dangerous_runs(df).collect())) == [("p", 1, 2, 100.0, 1), ("p", 7, 7, 30.0, 7)]


def test_best_so_far(spark):
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([1, 3, 3, 2, 5])], "g string, i int, v double")
    assert [(r.best, r.stalled) for r in routes.best_so_far(df, "g", "i", "v").orderBy("i").collect()] == [(1.0, 0), (3.0, 0), (3.0, 1), (3.0, 2), (5.0, 0)]


def test_two_opt_untangles_and_never_worsens(spark):
    at = {"S": (0, 0), "a": (0, 10), "b": (10, 10), "c": (10, 0)}
    pairs = {(x, y): math.dist(at[x], at[y]) for x in at for y in at if x != y}
    tangled = route(spark, (("S", False), ("b", True), ("a", True), ("c", True), ("S", False)))
    got = routes.two_opt(tangled, matrix(spark, pairs)).orderBy("seq").collect()
    assert got[0].total_min == pytest.approx(40.0) and got[0].saved_min > 0 and [r.node_id for r in got][0] == [r.node_id for r in got][-1] == "S"
    assert routes.two_opt(tangled.limit(0), matrix(spark, pairs)).count() == 0


def test_two_opt_prices_reversed_directed_legs():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 9)
        order = [0, *range(1, n), 0]
        cost = {(a, b): rng.random() * 10 for a in range(n) for b in range(n) if a != b and rng.random() < 0.9}
        total = lambda seq: sum(cost.get(p, 0.0 if p[0] == p[1] else 1e9) for p in zip(seq, seq[1:]))
        got, minutes, saved = routes._improved(order, cost, 0.01)
        assert sorted(got) == sorted(order) and got[0] == got[-1] == 0
        assert minutes == pytest.approx(total(got)) and saved == pytest.approx(total(order) - total(got), abs=1e-4)
        assert all(total(got[:i] + got[i : j + 1][::-1] + got[j + 1 :]) >= minutes - 0.02 for i in range(1, n - 1) for j in range(i + 1, n))


def brute_paths(edges, source, limit):
    best, todo = {source: 0.0}, [source]
    while todo:
        u = todo.pop()
        for a, b, w in edges:
            if a == u and best[u] + w <= limit and best[u] + w < best.get(b, math.inf):
                best[b] = best[u] + w
                todo.append(b)
    return best


def test_shortest_within_equals_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(1, 20))) for _ in range(120)]
    df = spark.createDataFrame([*edges, (0, 1, None), (0, 2, math.inf)], "u int, v int, cost double")
    seeds = spark.createDataFrame([(s, s, 0.0) for s in range(5)] + [(99, 1, 100.0)], "source int, node int, cost double")
    got = {(r.source, r.node): r.cost for r in graph.shortest_within(seeds, df, 30.0).collect()}
    assert got == {(s, n): c for s in range(5) for n, c in brute_paths(edges, s, 30.0).items()}
    assert graph.shortest_within(seeds.limit(0), df, 30.0).count() == 0


def test_travel_matrix_has_its_diagonal_and_pairs_their_infinities(spark):
    e = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 100.0)], "u string, v string, minutes double")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {(r.src, r.dst): r.minutes for r in graph.travel_matrix(n, n, e, 60.0).collect()}
    assert got == {("a", "a"): 0.0, ("b", "b"): 0.0, ("c", "c"): 0.0, ("a", "b"): 5.0}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert {(r.src, r.dst): r.minutes for r in graph.pair_times(pairs, graph.travel_matrix(n, n, e)).collect()} == {("a", "b"): 5.0, ("a", "c"): math.inf}
    more = graph.extend_matrix(graph.travel_matrix(n.where("node = 'a'"), n, e), n, n, e)
    assert {(r.src, r.dst): r.minutes for r in more.collect()} == got


def test_turns_cost_and_u_turns_are_never_taken(spark):
    at = {"a": (0.0, 0.0), "b": (0.0, 1.0), "c": (1.0, 1.0), "d": (0.0, 2.0)}
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("b", "d")]
    df = spark.createDataFrame([(f"{u}{v}", u, v, 1.0, *at[u], *at[v]) for u, v in pairs], "edge string, u string, v string, minutes double, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.node: r.minutes for r in graph.turn_aware_times(spark.createDataFrame([("a",)], "node string"), graph.with_bearings(df)).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 2.2, "d": 2.0}
    paths = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (2, 0, "a", "b"), (2, 1, "b", "z")], "path_id int, seq int, u string, v string")
    assert sorted(map(tuple, graph.path_times(paths, graph.with_bearings(df)).collect()), key=lambda r: r[0]) == [(1, 2.2), (2, None)]


def test_flagged_reach(spark):
    e = spark.createDataFrame([(1, 2, 1.0, True), (1, 3, 5.0, False), (3, 2, 1.0, False), (2, 4, 1.0, True)], "u int, v int, cost double, flagged boolean")
    got = sorted(map(tuple, graph.reachable_with_flag(spark.createDataFrame([(1, 1, 0.0)], "source int, node int, cost double"), e, 10.0).collect()))
    assert got == [(1, 1, 0.0, False), (1, 2, 1.0, False), (1, 3, 5.0, False), (1, 4, 2.0, True)]


def test_ways_become_edges(spark):
    ways = spark.createDataFrame([(1, ["a", "b", "z"], "primary", None), (2, ["a", "b"], "tertiary", "-1"), (3, ["b", "a"], "tertiary", "yes"), (4, ["a"], "x", None)], "way_id int, refs array<string>, highway string, oneway string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert sorted(map(tuple, graph.ways_to_edges(ways, nodes).collect())) == [(1, "a", "b", "primary"), (1, "b", "a", "primary"), (2, "b", "a", "tertiary"), (3, "b", "a", "tertiary")]


def test_snapping_splits_both_directions(spark):
    e = spark.createDataFrame([("e", True, "u", "v", 100.0), ("e", False, "v", "u", 100.0), ("f", True, "u", "w", 9.0)], "edge string, forward boolean, u string, v string, metres double")
    s = spark.createDataFrame([("e", "h", 0.25), ("e", "g", 1.5)], "edge string, home string, ratio double")
    got = {(r.u, r.v): round(r.metres, 6) for r in graph.snapped_edges(e, s).collect()}
    assert got == {("u", "h"): 25.0, ("h", "g"): 74.0, ("g", "v"): 1.0, ("v", "g"): 1.0, ("g", "h"): 74.0, ("h", "u"): 25.0, ("u", "w"): 9.0}


def test_greedy_crossings_lock_nodes(spark):
    rows = [("r", "secondary", n, 30.0, 31.0 + x, b) for n, x, b in [("a", 0.0, 0.0), ("b", 0.0001, 180.0), ("c", 0.00025, 0.0), ("d", 0.0004, 180.0)]] + [("q", "secondary", "z", 30.0, 31.0, 180.0)]
    df = spark.createDataFrame(rows, "name string, road_class string, node string, lat double, lon double, bearing double")
    # lanes go north and south, the ways across east; midpoints are 30 m apart, so the spacing takes the second pair
    got = sorted((r.a, r.b) for r in crossings.carriageway_crossings(df, spacing_m=0.0).collect())
    assert got == [("a", "b"), ("c", "d")]
    assert [(r.a, r.b) for r in crossings.carriageway_crossings(df).collect()] == [("a", "b")]


def test_ranks_wilcoxon_and_holm(spark):
    deltas = [1.5, -0.5, 2.0, 2.0, -1.5, 0.0, 3.0]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(deltas)] + [("z", 0, 0.0)], "g string, seed int, delta double")
    got = {r.g: r for r in stats.wilcoxon(df, ["g"]).collect()}
    used = [x for x in deltas if x]
    order = sorted(map(abs, used))
    rank = lambda x: (order.index(x) + 1 + order.index(x) + order.count(x)) / 2
    plus, minus = sum(rank(x) for x in used if x > 0), sum(rank(-x) for x in used if x < 0)
    signs = [min(s, sum(map(rank, order)) - s) for s in (sum(rank(abs(x)) for x, b in zip(used, bits) if b) for bits in itertools.product([0, 1], repeat=len(used)))]
    r = got["g"]
    assert (r.n_pairs, r.n_used, r.w_plus, r.w_minus, r.w) == (7, 6, plus, minus, min(plus, minus))
    assert r.rank_biserial == pytest.approx((plus - minus) / (plus + minus)) and r.median_delta == 1.5
    assert r.p_raw == pytest.approx(sum(s <= min(plus, minus) for s in signs) / len(signs))
    assert got["z"].n_used == 0 and got["z"].p_raw is None and got["z"].rank_biserial is None
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert {r.k: (round(r.p_holm, 6), r.significant) for r in stats.holm(p, "p").collect()} == {"a": (0.04, True), "b": (0.09, False), "c": (0.09, False), "d": (1.0, False)}
    assert stats.wilcoxon(df.limit(0), ["g"]).count() == 0


def test_normal_p_is_near_the_exact_one():
    ranks = [float(k) for k in range(1, 31)]
    assert abs(stats.exact_p(ranks, 150.0) - stats.normal_p(ranks, 150.0)) < 0.01


def test_rates_ratios_and_empty_groups(spark):
    df = spark.createDataFrame([("m", True, 10.0, 5.0), ("m", None, math.inf, 5.0), ("m", False, 6.0, 0.0), ("m", True, 9.0, 3.0)], "mode string, served boolean, ride_min double, direct_min double")
    assert [tuple(r) for r in metrics.service_rate(df, ["mode"]).collect()] == [("m", 2, 4, 0.5)]
    assert [tuple(r) for r in metrics.ride_ratio(df, ["mode"]).collect()] == [("m", 2.5, 0.5, 3.0, 2)]
    capped = df.withColumn("cap_min", F.when(F.col("direct_min") > 0, 9.0))
    assert [tuple(r) for r in metrics.cap_violations(capped, ["mode"]).collect()] == [("m", 3, 2, pytest.approx(200 / 3))]
    assert metrics.service_rate(df.limit(0), ["mode"]).count() == 0


def test_tables_with_single_values_and_none(spark):
    df = spark.createDataFrame([("a", "s1", 1.0), ("b", "s1", 1.0), ("b", "s2", 3.0), ("c", "s1", None), ("c", "s2", float("nan"))], "g string, seed string, x double")
    got = {r.g: (r.n_seeds, r.x) for r in metrics.mean_and_spread(df, ["g"], ["x"], "seed").collect()}
    assert got == {"a": (1, "1.00 ± 0.00"), "b": (2, "2.00 ± 1.41"), "c": (2, "-")}
    assert {r.g: (r.upper_median, r.n, r.missing) for r in metrics.distribution(df, ["g"], "x").collect()} == {"a": (1.0, 1, 0), "b": (3.0, 2, 0), "c": (None, 0, 2)}


def test_ledger_and_sets(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("l", 1, None), (None, 5, "n")], "key string, at int, value string")
    assert sorted(map(tuple, metrics.latest(df, ["key"], ["at"]).collect()), key=repr) == sorted([("k", 2, "new"), ("l", 1, None), (None, 5, "n")], key=repr)
    assert sorted((r.key, r.value) for r in metrics.first_seen(df.where("key IS NOT NULL"), ["key"], ["at"]).collect()) == [("k", "old"), ("l", None)]
    a = spark.createDataFrame([("x", "1"), ("y", None)], "key string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "key string, value string")
    assert sorted(map(tuple, metrics.config_diff(a, b).collect())) == [("x", "1", "1", False), ("y", None, "2", True), ("z", None, None, False)]


def test_tier_shares_sum_to_one(spark):
    df = spark.createDataFrame([("HIGH", "none"), ("HIGH", "tertiary"), ("KG", "weird"), ("KG", None), (None, "none")], "stage string, tier string")
    rows = metrics.tier_shares(df).collect()
    assert {r.stage: r.served for r in rows} == {"HIGH": 2, "KG": 2, "(none)": 1, "(all)": 5}
    for r in rows:
        assert sum(r[f"share_{t}"] for t in scalars.TIERS) == pytest.approx(1.0)
    assert {r.stage: r.n_unknown for r in rows}["KG"] == 2


def test_solver_is_repeatable_and_keeps_seats(spark):
    rng = random.Random(2)
    people = spark.createDataFrame([(z, i, 30 + rng.random() / 20, 31 + rng.random() / 20) for z in (1, 2) for i in range(60)] + [(3, 0, 30.0, 31.0)], "zone int, student_id int, lat double, lon double")
    places = spark.createDataFrame([(z, i, 30 + rng.random() / 20, 31 + rng.random() / 20) for z in (1, 2) for i in range(10)], "zone int, node_id int, lat double, lon double")
    run = lambda: sorted(map(tuple, solver.solve_grid(people, places, [1, 2], [2, 6], 15, 30).collect()))
    first = run()
    assert first == run() and len(first) == 12
    for zone, _, fleet, students, served, used, *_ in first:
        assert served <= min(students, fleet * 15) and used <= fleet
        assert zone == 3 or served == min(students, fleet * 15) or fleet == 2 or served >= 50
    best = {r.zone: r for r in solver.smallest_fleet(solver.solve_grid(people, places, [1], [2, 6], 15, 30)).collect()}
    assert best[1].fleet == 6 and best[3].served == 0


def test_solver_objective_never_falls_below_the_start():
    import numpy as np

    rng = np.random.default_rng(1)
    xy = rng.random((13, 2)) * 30
    p = solver.Problem([5] * 12, np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1)), 20, 4)
    start = [[] for _ in range(4)]
    solver._regret(p, start, list(range(12)), random.Random(0))
    found = solver.search(p, 3, 120)
    assert found["objective"] >= p.objective(start) and all(p.load(r) <= 20 for r in found["routes"])
    assert sorted(u for r in found["routes"] for u in r) == list(range(12))


def test_feasible_insertions_keep_seats_and_caps(spark):
    od = matrix(spark, {("S", "a"): 5.0, ("a", "S"): 5.0, ("S", "c"): 2.0, ("c", "a"): 4.0, ("a", "c"): 4.0, ("c", "S"): 3.0})
    stops = route(spark, (("S", False), ("a", True), ("S", False)), 1)
    rides = routes.morning_rides(routes.legs(stops, od))
    cand = spark.createDataFrame([("s1", 1, "c")], "student_id string, route_id int, node_id string")
    ins = routes.insertion_costs(routes.legs(stops, od), cand, od)  # c before a: delta 1, ride 9; c after a: delta 2, ride 3
    riders = lambda cap: spark.createDataFrame([(1, 1, 5.0, cap)], "route_id int, seq int, ride_min double, cap_min double")
    loads = lambda n: spark.createDataFrame([(1, n, 2)], "route_id int, load int, capacity int")
    caps = lambda x: spark.createDataFrame([("s1", x)], "student_id string, cap_min double")
    run = lambda a, b, c: sorted(r.seq for r in routes.feasible_insertions(ins, rides, riders(a), loads(b), caps(c), od).collect())
    assert run(9.0, 1, 20.0) == [0, 1]
    assert run(6.0, 1, 20.0) == [0]  # a's rider can't ride 2 minutes longer
    assert run(9.0, 1, 5.0) == [1]  # the new rider can't ride 9 minutes
    assert run(9.0, 2, 20.0) == []  # no seat


def test_savings_legends_and_axes(spark):
    od = matrix(spark, {("S", "a"): 5.0, ("a", "b"): 3.0, ("b", "S"): 7.0, ("S", "b"): 6.0})
    legs = routes.legs(route(spark), od)
    assert sorted((r.node_id, r.saved_min) for r in routes.removal_savings(legs, od).collect()) == [("a", 2.0), ("b", None)]
    riders = spark.createDataFrame([(1, 2, "x"), (1, 2, "y")], "route_id int, seq int, student_id string")
    assert [tuple(r) for r in routes.route_legend(route(spark), riders, routes.morning_rides(legs)).collect()] == [(1, 2, 2, 7.0)]
    p = spark.createDataFrame([("r", "A", 0.0, 5.0, 0.0), ("r", "A", 0.0, 1.0, 0.0), ("r", "B", 1.0, 3.0, 0.0)], "name string, side string, x double, y double, bearing double")
    assert sorted((r.side, r.y, r.axis_rank) for r in routes.axis_positions(p).collect()) == [("A", 1.0, 1), ("A", 5.0, 2), ("B", 3.0, 1)]


def test_paths_can_be_followed(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0)], "u string, v string, cost double")
    reached = graph.shortest_within(spark.createDataFrame([("a", "a", 0.0)], "source string, node string, cost double"), e, 10.0)
    steps = graph.shortest_paths(reached, e)
    assert sorted((r.node, r.before) for r in steps.collect()) == [("a", None), ("b", "a"), ("c", "b")]
    ends = spark.createDataFrame([("a", "c"), ("a", "a")], "source string, target string")
    assert sorted((r.target, r.seq, r.node) for r in graph.path_nodes(steps, ends).collect()) == [("a", 0, "a"), ("c", 0, "c"), ("c", 1, "b"), ("c", 2, "a")]


def test_geometry_of_paths(spark):
    g = spark.createDataFrame([("e", [(0.0, 0.0), (2.0, 4.0)]), ("f", [(2.0, 4.0), (3.0, 4.0)]), ("z", [])], "edge string, points array<struct<lat:double,lon:double>>")
    assert {r.edge: (r.lat, r.lon) for r in graph.path_midpoints(g).collect()} == {"e": (1.0, 2.0), "f": (2.5, 4.0), "z": (None, None)}
    p = spark.createDataFrame([(1, 1, "f"), (1, 0, "e"), (1, 2, "gone")], "path_id int, seq int, edge string")
    assert [tuple(x) for x in graph.path_polylines(p, g).first().points] == [(0.0, 0.0), (2.0, 4.0), (2.0, 4.0), (3.0, 4.0)]
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "u string, v string")
    edges = spark.createDataFrame([("a", "b", "one"), ("b", "a", "two")], "u string, v string, name string")
    assert {(r.u, r.v): r.name for r in graph.either_way(pairs, edges.limit(1), "name").collect()} == {("a", "b"): "one", ("b", "a"): "one", ("x", "y"): None}


def test_quartiles_bundles_and_unions(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(30) * 1.0) for _ in range(101)] + [("a", float("nan")), ("n", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    import numpy as np

    got = {r.g: (r.n, r.q1, r.q2, r.q3) for r in metrics.quartiles(df, ["g"], "x").collect()}
    for g in "ab":
        xs = [x for h, x in rows if h == g and x == x]
        assert got[g] == (len(xs), *map(float, np.quantile(xs, [0.25, 0.5, 0.75])))
    assert set(got) == {"a", "b"}
    riders = spark.createDataFrame([("m", True, 10.0, 5.0, 9.0, 100.0, 200.0), ("m", False, None, None, None, None, None), (None, True, 1.0, 1.0, 2.0, 0.0, 0.0)], "mode string, served boolean, ride_min double, direct_min double, cap_min double, walk_m double, walk_limit_m double")
    legs = spark.createDataFrame([("m", 1, 4, 20.0, 2.0), ("m", 0, 4, 0.0, 0.0)], "mode string, load int, capacity int, total_min double, total_km double")
    rows = {r.mode: r for r in metrics.mode_bundle(riders, legs).collect()}
    m = rows["m"]
    assert (m.served, m.total, m.mean_ratio, m.violations, m.median_m, m.used_pct, m.utilisation, m.active_routes, m.route_min) == (1, 2, 2.0, 1, 100.0, 50.0, 0.25, 1, 20.0)
    assert rows[None].active_routes is None and rows[None].median_m == 0.0
    both = metrics.tagged_union({"x": df.select("g"), "y": df.select("x")})
    assert both.columns == ["g", "part", "x"] and both.count() == 206
    log = spark.createDataFrame([("l", i, float(v), v) for i, v in enumerate([1, 4, 4, 4])], "g string, k int, t double, v int")
    assert [r.elapsed for r in metrics.elapsed(log, "g", "k", "t").orderBy("k").collect()] == [None, 3.0, 0.0, 0.0]
    assert [r.stop for r in metrics.trailing(log, "g", "k", "v", 2).orderBy("k").collect()] == [False, False, False, True]


def test_more_scalars(spark):
    assert one(spark, scalars.base_cap(True, 70.0, 45.0), scalars.base_cap(True, 0.0, 45.0), scalars.base_cap(F.lit(None).cast("boolean"), 70.0, 45.0)) == (70.0, 45.0, 45.0)
    assert one(spark, scalars.policy_label(False, True, True), scalars.policy_label(True, True, True, 60.0), scalars.policy_label(True, False, True), scalars.policy_label(True, False, False)) == ("No MRT", "MRT 60", "DMRT Lenient", "DMRT Strict")
    assert one(spark, scalars.dangerous_road(F.lit("primary_link")), scalars.dangerous_road(F.lit("tertiary")), scalars.dangerous_road(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, scalars.in_box(1.0, 2.0, 1.0, 2.0, 3.0, 4.0), scalars.in_box(F.lit(None).cast("double"), 2.0, 1.0, 2.0, 3.0, 4.0)) == (True, False)
    assert one(spark, scalars.candidate_points(3, 2, 2), scalars.candidate_points(F.lit(None).cast("int"), 1, 2), scalars.fleet_at_least(71, 70), scalars.temperature(2), scalars.dwell_minutes(4)) == (2, 0, 2, pytest.approx(960.4), 2.0)
    assert len(one(spark, scalars.long_hash(F.lit("a"), F.lit(None).cast("string")))[0]) == 40


def test_population_is_the_same_for_any_partitioning(spark):
    from darb.operators import population

    make = lambda: population.homes(spark, 500, 42, 30.0, 31.0, {"KG": 1, "HIGH": 3}, {"KG": (4, 5), "HIGH": (15, 17)})
    a = make().orderBy("student_id").collect()
    assert a == make().repartition(7).orderBy("student_id").collect()
    assert all(r.age in ((4, 5) if r.stage == "KG" else (15, 16, 17)) for r in a) and 300 < sum(r.stage == "HIGH" for r in a) < 450
    assert all(0.39 < math.hypot((r.lat - 30) * 111, (r.lon - 31) * 111 * math.cos(math.radians(30))) < 5.01 for r in a)


def test_numbers_of_a_key_at_any_depth(spark):
    from darb.operators.shred import numbers_of_key

    df = spark.createDataFrame([(1, '{"t": 1.5, "a": [{"t": [2, null, "x"]}, {"b": {"t": 1e400}}], "_c": {"t": 9}}'), (2, "{"), (3, None)], "i int, j string")
    assert sorted(r.value for r in numbers_of_key(df, "i", "j", "t").collect()) == [1.5, 2.0]


def test_json_of_any_depth():
    import json

    from darb.functions import jsonio

    deep = '{"a":[' * 30_000 + '1.50, "x\\u00e9", true, null, {}, []' + "]}" * 30_000
    ok, value = jsonio.parse(deep)
    assert ok
    for _ in range(30_000):
        value = value["a"][0] if value["a"][0] != "1.50" else value
    assert value["a"] == ["1.50", "xé", True, None, {}, []]
    for text in ('{"a": 1, "b": [1, 2, {"c": null}], "a": -0.5e+3}', "[]", " {} ", '"x"', "0", "[1 ,2]"):
        assert jsonio._loop(text) == jsonio._DECODER.decode(text), text
    for text in ("", "[1,]", "[1", '{"a"}', '{"a":}', "{1:2}", "01", "[] []", "nul", "NaN", '{"a":1,}', "]", '["a]', "-", '{"a":1 "b":2}'):
        with pytest.raises((ValueError, IndexError)):
            jsonio._loop(text)
        assert not jsonio.parse(text)[0]
    assert json.loads("[1]") == [1]
    assert jsonio.parse("[" * 50_000) == (False, None)


def test_truncated_normal_is_the_inverse(spark):
    from darb.operators import population

    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    p = spark.createDataFrame([(x,) for x in (1e-300, 1e-12, 1e-4, 0.02, 0.2, 0.5, 0.7, 0.999, 1 - 1e-12)], "p double").select("p", population.normal_quantile(F.col("p")).alias("z"))
    assert all(cdf(r.z) == pytest.approx(r.p, rel=1e-9) for r in p.collect())
    for mean, sigma, low, high in ((2.0, 1.0, 0.4, 5.0), (2.0, 0.1, 4.0, 4.2), (2.0, 3.0, 1.9, 2.0), (9.0, 1.0, 0.0, 1.0)):
        rows = spark.range(4000).select(population.truncated_normal(population.uniform(3, 1), mean, sigma, low, high).alias("x")).collect()
        xs = sorted(r.x for r in rows)
        a, b = cdf((low - mean) / sigma), cdf((high - mean) / sigma)
        middle = spark.range(1).select(population.truncated_normal(F.lit(0.5), mean, sigma, low, high).alias("m")).first().m
        assert low <= xs[0] and xs[-1] <= high and abs(sum(x <= middle for x in xs) / 4000 - 0.5) < 0.03
        if 1e-9 < b < 1 - 1e-9:
            assert (cdf((middle - mean) / sigma) - a) / (b - a) == pytest.approx(0.5, abs=1e-6)
    assert spark.range(1).select(population.truncated_normal(F.lit(0.3), 2.0, 0.0, 0.0, 1.0).alias("x")).first().x == 1.0


def test_hot_values_and_groups_keep_their_ranks(spark, monkeypatch):
    from darb.operators import ordered

    monkeypatch.setattr(ordered, "HOT_ROWS", 20)
    monkeypatch.setattr(ordered, "HOT_SHARE", 10)
    rows = [("hot", 1.0)] * 100 + [("hot", float(k)) for k in range(2, 60)] + [(None, 5.0), (None, 7.0), ("b", 3.0), ("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = sorted(map(tuple, stats.average_ranks(df, ["g"], F.col("v")).collect()), key=repr)
    want = sorted([("hot", 1.0, 50.5)] * 100 + [("hot", float(k), 99.0 + k) for k in range(2, 60)] + [(None, 5.0, 1.0), (None, 7.0, 2.0)] + [("b", 3.0, 1.5)] * 2, key=repr)
    assert got == want
    assert {(r.g, r.n, r.lower, r.upper) for r in ordered.medians(df, ["g"], "v").collect()} == {("hot", 158, 1.0, 1.0), (None, 2, 5.0, 7.0), ("b", 2, 3.0, 3.0)}


def test_exact_p_of_many_ranks_and_its_method(spark):
    few = [1.0, 2.0, 3.5, 3.5, 5.0]
    import itertools

    w = 3.0
    share = sum(min(sum(c), sum(few) - sum(c)) <= w for n in range(6) for c in itertools.combinations(few, n)) / 32
    assert stats.exact_p(few, w) == pytest.approx(share)
    many = [float(k) for k in range(1, 301)]
    assert stats.exact_p(many, 20_000.0) == pytest.approx(stats.normal_p(many, 20_000.0), abs=2e-3)
    rows = [("a", k, float(k % 7 - 2)) for k in range(80)] + [("b", k, 1.0 + k) for k in range(5)] + [("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, seed int, delta double")
    assert {r.g: r.p_method for r in stats.wilcoxon(df, ["g"]).collect()} == {"a": "normal", "b": "exact", "c": None}
    every = {r.g: (r.p_method, r.p_raw) for r in stats.wilcoxon(df, ["g"], exact_up_to=None).collect()}
    assert every["a"][0] == "exact" and 0 <= every["a"][1] <= 1


def test_the_latest_of_equal_rows_is_the_same_in_any_order(spark):
    rows = [("k", 2, f"v{i}") for i in range(50)]
    got = {metrics.latest(spark.createDataFrame(rows[i:] + rows[:i], "key string, at int, v string").repartition(3), ["key"], ["at"]).first().v for i in (0, 13, 40)}
    assert len(got) == 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from darb import session

    asked = []
    conf = SimpleNamespace(get=lambda k, d=None: d)
    for master, fails in (("local[4]", False), ("local", False), ("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True)):
        context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=asked.append)
        spark_ = SimpleNamespace(sparkContext=context, conf=conf)
        if fails:
            with pytest.raises(RuntimeError):
                session.ensure_checkpoint_dir(spark_)
        else:
            session.ensure_checkpoint_dir(spark_)
    assert len(asked) == 2
