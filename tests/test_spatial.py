import math
import random

import pytest
from pyspark.sql import functions as F

from darb.functions.geo import EARTH_M, haversine_m
from darb.operators import ordered, spatial
from darb.operators.ordered import at_ranks, medians, with_neighbour, with_running_total
from darb.operators.spatial import near_and_inside, near_pairs, nearest, nearest_edges, points_in_boxes, points_in_regions


def metres(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def points(spark, rows):
    return spark.createDataFrame(rows, "key bigint, owner string, lat double, lon double")


@pytest.mark.parametrize("lat,lon", [(30.0, 31.2), (0.0, 180.0), (89.99999, 10.0), (-90.0, 0.0), (60.0, -179.99999)])
def test_near_pairs_equal_brute_force_also_at_poles_and_date_line(spark, lat, lon):
    rng = random.Random(7)
    rows = []
    for k in range(250):
        y = max(-90.0, min(90.0, lat + rng.uniform(-1e-3, 1e-3)))
        x = (lon + rng.uniform(-1e-3, 1e-3) / max(0.01, math.cos(math.radians(y))) + 180) % 360 - 180
        rows.append((k, rng.choice("abc"), y, x))
    rows += [(1000 + k, f"o{k % 4}", rows[0][2], rows[0][3]) for k in range(30)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and metres(a[2:], b[2:]) <= 20}
    got = [tuple(r) for r in near_pairs(points(spark, rows), 20.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_location_is_split_into_blocks(spark):
    rows = [(k, f"o{k % 3}", 30.0, 31.0) for k in range(700)]
    got = [tuple(r) for r in near_pairs(points(spark, rows), 5.0).collect()]
    assert len(got) == len(set(got)) == sum(1 for a in range(700) for b in range(a + 1, 700) if a % 3 != b % 3)


def test_near_pairs_nulls_repeats_and_empty(spark):
    rows = [(1, "a", 30.0, 31.0), (1, "a", 30.0, 31.0), (2, "b", 30.0, 31.0), (3, "c", None, 31.0), (4, "c", float("nan"), 31.0), (None, "d", 30.0, 31.0), (5, None, 30.0, 31.0), (6, "e", 30.0, float("inf"))]
    df = points(spark, rows).withColumn("place", F.lit(1)).withColumn("cell", F.lit(2))
    assert sorted(tuple(r) for r in near_pairs(df, 5.0).collect()) == [(1, 2), (1, 5), (2, 5)]
    assert near_pairs(df.limit(0), 5.0).count() == 0


@pytest.mark.parametrize("cell_rows,few", [(2000, 16), (3, 2), (10, 5)])
def test_hot_cells_and_crowds_lose_and_repeat_nothing(spark, monkeypatch, cell_rows, few):
    """One school gate: most points within some metres, several at the very same place; cells are salted, members in blocks."""
    monkeypatch.setattr(spatial, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(spatial, "FEW", few)
    monkeypatch.setattr(spatial, "BLOCK", 4)
    monkeypatch.setattr(ordered, "HOT_ROWS", 6)
    monkeypatch.setattr(ordered, "HOT_SHARE", 20)
    rng = random.Random(4)
    spots = [(30.0 + rng.uniform(-4e-5, 4e-5), 31.0 + rng.uniform(-4e-5, 4e-5)) for _ in range(60)]
    rows = [(k, rng.choice("abcde"), *spots[min(59, int(rng.expovariate(0.1)))]) for k in range(300)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and metres(a[2:], b[2:]) <= 5}
    got = [tuple(r) for r in near_pairs(points(spark, rows), 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r.key: (r.class_key, r.class_size, r.near_classes, r.near_points) for r in spatial.near_classes(points(spark, rows), 5.0).collect()}
    for k, _, *at in rows:
        same = [b[0] for b in rows if b[2:] == tuple(at)]
        near = [b for b in rows if metres(at, b[2:]) <= 5]
        assert classes[k] == (min(same), len(same), len({b[2:] for b in near}) - 1, len(near) - 1)
    assert spatial.near_classes(points(spark, rows).limit(0), 5.0).count() == 0


def test_boxes_of_all_sizes(spark):
    rng = random.Random(6)
    boxes = [(k, x, y, x + w, y + h) for k in range(80) for x, y, w, h in [(rng.uniform(-5, 5), rng.uniform(-5, 5), 10 ** rng.uniform(-4, 1), 10 ** rng.uniform(-4, 1))]] + [(900, -1e6, -1e6, 1e6, 1e6), (901, 1.0, 1.0, 1.0, 1.0), (902, 2.0, 0.0, 1.0, 1.0), (903, 0.0, 0.0, float("inf"), 1.0), (904, None, 0.0, 1.0, 1.0)]
    pts = [(k, rng.uniform(-6, 6), rng.uniform(-6, 6)) for k in range(200)] + [(500, 1.0, 1.0), (501, None, 0.0), (502, float("nan"), 0.0)]
    got = [tuple(r) for r in points_in_boxes(spark.createDataFrame(pts, "key int, x double, y double"), spark.createDataFrame(boxes, "box int, x1 double, y1 double, x2 double, y2 double")).collect()]
    want = {(k, b) for k, x, y in pts[:201] for b, x1, y1, x2, y2 in boxes[:82] if x1 <= x <= x2 and y1 <= y <= y2}
    assert len(got) == len(set(got)) and set(got) == want and (500, 901) in want
    assert points_in_boxes(spark.createDataFrame(pts, "key int, x double, y double"), spark.createDataFrame(boxes, "box int, x1 double, y1 double, x2 double, y2 double").limit(0)).count() == 0


def test_strips_are_salted_by_their_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(spatial, "STRIP_ROWS", 5)
    square = [(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    rng = random.Random(2)
    pts = [(k, rng.uniform(-1, 5), rng.choice([1.0, 1.0001, 3.0, 5.0])) for k in range(200)]
    got = points_in_regions(spark.createDataFrame(pts, "key bigint, x double, y double"), spark.createDataFrame(square, "region bigint, seq int, x double, y double"), strips=8)
    assert sorted(r.key for r in got.collect()) == [k for k, x, y in pts if 0 <= x <= 4 and 0 <= y <= 4]


def rings(spark, shapes):
    return spark.createDataFrame([(r, i, float(x), float(y)) for r, shape in shapes.items() for i, (x, y) in enumerate(shape)], "region bigint, seq int, x double, y double")


def inside(spark, pts, shapes):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "key bigint, x double, y double")
    return sorted(tuple(r) for r in points_in_regions(df, rings(spark, shapes)).collect())


def test_boundaries_belong_to_their_region(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    pts = [(2, 2), (0, 0), (4, 4), (2, 0), (0, 2), (4, 2), (5, 2), (-1, 4), (2, 4), (4.0001, 2)]
    assert inside(spark, pts, {7: square}) == [(k, 7) for k in (0, 1, 2, 3, 4, 5, 8)]


def test_rays_through_vertices_closed_rings_repeats_and_nesting(spark):
    diamond = [(2, 0), (4, 2), (2, 4), (0, 2)]
    ring = rings(spark, {1: diamond, 2: [*diamond, diamond[0]], 3: [(1, 1), (3, 1), (3, 3), (1, 3)]})
    ring = ring.unionByName(ring).repartition(5)
    pts = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 2.0), (2, -1.0, 2.0), (3, 2.0, 2.0), (4, None, 2.0), (5, float("nan"), 1.0)], "key bigint, x double, y double")
    assert sorted(tuple(r) for r in points_in_regions(pts, ring).collect()) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (3, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize("broadcast_rows", [100_000, 10])
def test_random_polygons_equal_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    shapes = {}
    for r in range(6):
        cx, cy, n = rng.uniform(0, 10), rng.uniform(0, 10), rng.randint(3, 40)
        shapes[r] = [(cx + rng.uniform(0.5, 4) * math.cos(2 * math.pi * i / n), cy + rng.uniform(0.5, 4) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    pts = [(rng.uniform(-2, 12), rng.uniform(-2, 12)) for _ in range(500)]
    want = []
    for k, (x, y) in enumerate(pts):
        for r, s in shapes.items():
            odd = False
            for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
            if odd:
                want.append((k, r))
    assert inside(spark, pts, shapes) == sorted(want)


def test_no_regions_and_no_points(spark):
    empty = spark.createDataFrame([], "region bigint, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 1.0, 1.0)], "key bigint, x double, y double")
    assert points_in_regions(pts, empty).count() == 0
    assert points_in_regions(pts.limit(0), rings(spark, {1: [(0, 0), (1, 0), (1, 1)]})).count() == 0


def test_request_rules(spark):
    schema = "request_id bigint, meta struct<student_id:string,new_location:struct<latitude:double,longitude:double>>, key string"
    rows = [(1, (" a", (30.0, 31.0)), "x"), (1, (" a", (30.0, 31.0)), "x"), (2, ("A ", (30.0, 31.0)), "x"), (3, ("b", (30.00001, 31.0)), "x"), (4, ("c", (0.0, 0.0)), "x"), (5, ("c", None), "x"), (6, None, "x"), (7, ("z", (0.0, 31.0)), "x")]
    bounds = spark.createDataFrame([(9, i, x, y) for i, (x, y) in enumerate([(30.0, 29.0), (32.0, 29.0), (32.0, 31.0), (30.0, 31.0)])], "boundary_id bigint, vertex_seq int, lon double, lat double")
    got = sorted(tuple(r) for r in near_and_inside(spark.createDataFrame(rows, schema), bounds).collect())
    assert got == [("inside", 1, 9), ("inside", 2, 9), ("inside", 3, 9), ("near", 1, 3), ("near", 2, 3)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    p = [(k, rng.uniform(29, 31), rng.uniform(30, 32)) for k in range(80)] + [(100, -45.0, -170.0), (101, None, 1.0)]
    t = [(k, rng.uniform(29, 31), rng.uniform(30, 32)) for k in range(25)] + [(30, None, None)]
    got = {r.key: r.metres for r in nearest(spark.createDataFrame(p, "key bigint, lat double, lon double"), spark.createDataFrame(t, "target bigint, lat double, lon double")).collect()}
    assert set(got) == {k for k, a, _ in p if a is not None}
    for k, *at in p:
        if at[0] is not None:
            assert got[k] == pytest.approx(min(metres(at, x[1:]) for x in t if x[1] is not None), rel=1e-9)
    assert nearest(spark.createDataFrame(p, "key bigint, lat double, lon double"), spark.createDataFrame([], "target bigint, lat double, lon double")).count() == 0


def test_nearest_edges(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.0), (2, 0.0, 0.002, 0.01, 0.002), (3, 0.5, 0.5, 0.5, 0.5)], "edge bigint, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.005, 0.0009), (2, 0.005, 0.0012), (3, 0.2, 0.2), (4, 0.5, 0.501)], "key bigint, x double, y double")
    got = {r.key: (r.edge, round(r.ratio, 6), round(r.degrees, 6)) for r in nearest_edges(p, e).collect()}
    assert got == {1: (1, 0.5, 0.0009), 2: (2, 0.5, 0.0008), 4: (3, 0.0, 0.001)}


def test_neighbours_across_partitions(spark):
    rows = [(f"g{k % 3}" if k % 7 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k int").withColumn("v", F.col("k") * 10)
    for after in (False, True):
        got = {(r.g, r.k): r.w for r in with_neighbour(df, ["g"], ["k"], {"v": "w"}, after).collect()}
        by = {}
        for g, k in rows:
            by.setdefault(g, []).append(k)
        want = {}
        for g, ks in by.items():
            ks.sort()
            for i, k in enumerate(ks):
                j = i + (1 if after else -1)
                want[g, k] = ks[j] * 10 if 0 <= j < len(ks) else None
        assert got == want
    assert with_neighbour(df.limit(0), ["g"], ["k"], {"v": "w"}).count() == 0


def test_running_totals_and_ranks_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), k, rng.randrange(40)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.t for r in with_running_total(df, ["g"], ["k"], "v", "t").collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j <= k) for g, k, _ in rows}
    middle = {r.g: (r.n, r.lower, r.upper) for r in medians(df.unionByName(spark.createDataFrame([("a", 1, None), ("none", 1, None)], df.schema)), ["g"], "v").collect()}
    for g in {"hot", "a", None}:
        vs = sorted(v for h, _, v in rows if h == g)
        assert middle[g] == (len(vs), vs[(len(vs) - 1) // 2], vs[len(vs) // 2])
    assert "none" not in middle and at_ranks(df.limit(0), ["g"], "v", {"r": F.lit(0)}).count() == 0


def test_haversine_of_columns(spark):
    df = spark.createDataFrame([(30.0, 31.0, 30.1, 31.2)], "a double, b double, c double, d double")
    assert df.select(haversine_m("a", "b", "c", "d")).first()[0] == pytest.approx(metres((30.0, 31.0), (30.1, 31.2)))


def test_points_in_boxes(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.2, 0.1), (2, -0.3, -0.3, 0.0, 0.0), (3, 1.0, 1.0, 0.0, 0.0)], "box int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.15, 0.1), (3, 0.5, 0.5), (4, None, 0.0)], "key int, x double, y double")
    assert sorted(map(tuple, points_in_boxes(p, b).collect())) == [(1, 1), (1, 2), (2, 1)]


def test_equal_locations_are_compared_once(spark, monkeypatch):
    """Many points and targets at few places: distances are worked out between places, ties go to the least target."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)
    place = [(30.0 + k / 1000, 31.0) for k in range(5)]
    points = spark.createDataFrame([(k, *place[k % 5], 150.0) for k in range(400)], "key bigint, lat double, lon double, radius double")
    targets = spark.createDataFrame([(k, *place[k % 5]) for k in range(300)], "target bigint, lat double, lon double")
    compared = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()
    real = spatial.haversine_m
    monkeypatch.setattr(spatial, "haversine_m", lambda *a: compared(real(*a)))
    near = spatial.nearest(points, targets).collect()
    assert {(r.key, r.target, r.metres) for r in near} == {(k, k % 5, 0.0) for k in range(400)}
    all_ = spatial.within(points, targets).collect()
    assert {(r.key, r.target) for r in all_} == {(k, t) for k in range(400) for t in range(300) if abs(k % 5 - t % 5) <= 1}
    assert len(all_) == len({(r.key, r.target) for r in all_}) and seen.value < 1000
