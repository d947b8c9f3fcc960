"""Crossings beside plain loops over all candidates in order."""

import math
import random

import pytest

from darb.operators import crossings as cr

NODES = "name string, road_class string, node int, lat double, lon double, bearing double"


def metres(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def town(rng, n=120):
    """Roads that go north, the lanes back some 20 metres to the east; nodes may be on several roads."""
    rows = []
    for k in range(n):
        road = rng.choice("pqr")
        west = rng.random() < 0.5
        rows.append((road, rng.choice(["secondary", "tertiary"]), k if rng.random() < 0.9 else k // 2, 30.0 + rng.uniform(0, 0.01), 31.0 + {"p": 0, "q": 0.002, "r": 0.004}[road] + (0 if west else 0.0002) + rng.uniform(-2e-5, 2e-5), 0.0 if west else 180.0))
    return list({(r[0], r[1], r[2]): r for r in rows}.values())


@pytest.mark.parametrize("spacing", [0.0, 40.0, 100.0])
def test_pairs_are_the_greedy_ones(spark, spacing):
    rng = random.Random(int(spacing))
    rows = town(rng)
    found = []
    for road in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == road), key=lambda r: r[2])
        ref = own[0][5]
        a_side, b_side = [r for r in own if r[5] == ref], [r for r in own if r[5] != ref]
        for a in a_side:
            for b in b_side:
                m = metres(a[3:5], b[3:5])
                g = math.degrees(math.atan2(b[4] - a[4], b[3] - a[3])) % 360
                d = abs((ref - g + 180) % 360 - 180)
                if 6 <= m <= 60 and abs(min(d, 180 - d) - 90) <= 30:
                    found.append((m, a[2], b[2], *road, (a[3] + b[3]) / 2, (a[4] + b[4]) / 2))
    first = {}
    for c in found:
        first.setdefault(c[1:3], []).append((c[3], c[4], c[0], c))
    want, used, mids = set(), set(), []
    for c in sorted(min(v)[3] for v in first.values()):
        if c[1] in used or c[2] in used or any(metres(c[5:], x) < spacing for x in mids) and spacing:
            continue
        want.add(c[1:3])
        used |= set(c[1:3])
        mids.append(c[5:])
    got = [(r.a, r.b) for r in cr.carriageway_crossings(spark.createDataFrame(rows, NODES), spacing_m=spacing).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_nodes_left_over_get_a_projected_or_guaranteed_crossing(spark):
    rows = [("p", "secondary", 1, 30.0, 31.0, 0.0), ("p", "secondary", 2, 30.0, 31.0002, 180.0), ("p", "secondary", 3, 30.002, 31.0, 0.0), ("p", "secondary", 4, 30.004, 31.0, 0.0), ("p", "secondary", 5, 30.004, 31.000001 + 0.0002, 180.0), ("p", "secondary", 6, 30.05, 31.0, 0.0), ("one way", "secondary", 7, 30.0, 31.1, 0.0)]
    nodes = spark.createDataFrame(rows, NODES)
    segments = spark.createDataFrame([("p", "secondary", 30.01, 31.0002, 29.99, 31.0002, 180.0), ("p", "secondary", 29.99, 31.0, 30.06, 31.0, 0.0)], "name string, road_class string, lat1 double, lon1 double, lat2 double, lon2 double, bearing double")
    real = cr.carriageway_crossings(nodes.where("node < 3"))
    assert [(r.a, r.b) for r in real.collect()] == [(1, 2)]
    got = {r.a: r for r in cr.fallback_crossings(nodes, segments, real).collect()}
    assert got[3].kind == "projected" and got[3].b.startswith("999") and got[3].metres == pytest.approx(metres((30.002, 31.0), (30.002, 31.0002)), abs=0.1)
    assert got[4].kind == "projected_real" and got[4].b == "5" and 5 not in got
    assert got[6].kind == "guaranteed" and got[6].metres == 6.0 and metres((30.05, 31.0), (got[6].lat_b, got[6].lon_b)) == pytest.approx(6.0, abs=0.02)
    assert set(got) == {3, 4, 6}
    tight = {r.a: r.kind for r in cr.fallback_crossings(nodes, segments, real, spacing_m=300.0).collect()}
    assert tight[3] == "projected_no_spacing" and set(tight) == {3, 4, 6}
    assert cr.fallback_crossings(nodes.limit(0), segments, real).count() == cr.carriageway_crossings(nodes.limit(0)).count() == 0


def test_stretches_change_no_result_and_keep_conflicts_few(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"{k % 3}", "secondary", k, 30.0 + rng.randrange(30) * 1e-4, 31.0 + rng.randrange(30) * 1e-4, 0.0 if k % 2 else 180.0) for k in range(240)]
    nodes = spark.createDataFrame(rows, NODES)
    most, settled = [], cr._settled
    monkeypatch.setattr(cr, "_settled", lambda *x: most.append((out := settled(*x))[1]) or out)
    want = sorted((r.a, r.b) for r in cr.carriageway_crossings(nodes, spacing_m=40.0).collect())
    at_once = most.pop()
    monkeypatch.setattr(cr, "BATCH", 60)
    monkeypatch.setattr(cr, "CONFLICTS", 500)
    assert sorted((r.a, r.b) for r in cr.carriageway_crossings(nodes, spacing_m=40.0).collect()) == want and len(want) > 10
    assert len(most) > 1 and 2 * sum(most) < at_once, (most, at_once)


def pairs_by_loop(rows, spacing):
    """Pairs of nodes that stand when all are gone through by distance, then nodes; a pair on several roads counts on the first."""
    first = {}
    for road in sorted({r[:2] for r in rows}):
        own = sorted((r for r in rows if r[:2] == road), key=lambda r: r[2])
        for a in (r for r in own if r[5] == own[0][5]):
            for b in (r for r in own if r[5] != own[0][5]):
                m = metres(a[3:5], b[3:5])
                d = abs((own[0][5] - math.degrees(math.atan2(b[4] - a[4], b[3] - a[3])) + 180) % 360 - 180)
                if 6 <= m <= 60 and abs(min(d, 180 - d) - 90) <= 30:
                    first.setdefault((a[2], b[2]), (m, a[2], b[2], ((a[3] + b[3]) / 2, (a[4] + b[4]) / 2)))
    out, used, mids = [], set(), []
    for _, a, b, mid in sorted(first.values()):
        if not {a, b} & used and not (spacing and any(metres(mid, x) < spacing for x in mids)):
            out.append((a, b))
            used |= {a, b}
            mids.append(mid)
    return sorted(out)


@pytest.mark.parametrize("spacing", [0.0, 25.0, 100.0])
def test_nodes_that_share_places_pair_as_in_a_loop(spark, spacing, monkeypatch):
    rng = random.Random(int(spacing) + 7)
    # few places in lines with many ties, several nodes at each, some of them on both roads
    rows = {}
    for k in range(150):
        node, back = rng.randrange(110), rng.random() < 0.5
        rows.setdefault(("pq"[k % 2], node), ("pq"[k % 2], "secondary", node, 30.0 + rng.randrange(8) * 2e-4, 31.0 + (2e-4 if back else 0.0) + rng.randrange(2) * 4e-4, 180.0 if back else 0.0))
    rows = list(rows.values())
    want = pairs_by_loop(rows, spacing)
    nodes = spark.createDataFrame(rows, NODES)
    assert sorted((r.a, r.b) for r in cr.carriageway_crossings(nodes, spacing_m=spacing).collect()) == want and len(want) > 1
    # where stretches end, also for want of nodes at hand, changes nothing
    monkeypatch.setattr(cr, "BATCH", 20)
    monkeypatch.setattr(cr, "MOST", 40, raising=False)
    monkeypatch.setattr(cr, "DEEP", 1, raising=False)
    assert sorted((r.a, r.b) for r in cr.carriageway_crossings(nodes, spacing_m=spacing).collect()) == want


def test_many_nodes_at_few_places_are_few_candidates(spark, monkeypatch):
    rows = [("p", "secondary", k, 30.0 + k // 2 % 3 * 0.002, 31.0 + k % 2 * 2e-4, k % 2 * 180.0) for k in range(240)]
    seen, settled = [], cr._settled
    monkeypatch.setattr(cr, "_settled", lambda left, *x: seen.append(left.count()) or settled(left, *x))
    got = sorted((r.a, r.b) for r in cr.carriageway_crossings(spark.createDataFrame(rows, NODES)).collect())
    assert got == pairs_by_loop(rows, 100.0) == [(0, 1), (2, 3), (4, 5)]
    assert sum(seen) <= 9, seen  # pairs of places; of nodes there are 4,800 near enough
