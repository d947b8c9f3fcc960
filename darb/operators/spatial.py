"""Points near other points, and points inside regions.

Neighbours: latitudes are cut into strips a little higher than the search distance and each strip into cells
of the same width in metres (one cell where a strip touches a pole, cells wrap at 180 degrees). A location
has one home cell and probes every cell that its search box overlaps; home and probe meet in an equi join and
the exact great-circle distance decides. Equal locations are one class before the join, so a place with a
third of all points is one row there. A class with few members takes them along; the members of others are joined
for the rows of the result only, split into blocks so that no task gets a whole hot class. Cells with many
locations are salted. `near_classes` gives the classes and their links without expanding members into pairs.

Regions: crossing parity in SQL. Polygon edges are binned into the latitude strips that they span, points get
the strip that they are in, both meet on the strip, and a ray to the east crosses an edge where the edge's
latitude span (closed below, open above) has the point's latitude and the edge lies east of the point. The
crossings are summed by point and region, odd sums are inside. Boundaries are handled explicitly: a point on
an edge or on a vertex belongs to the region whatever its parity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darb.functions.geo import EARTH_M, haversine_m
from darb.operators.intervals import student_key
from darb.operators.ordered import join_counted, with_neighbour
from darb.session import BROADCAST_ROWS, durable, small_side

#: Members of one location are handled in blocks of this size where pairs are expanded.
BLOCK = 256
#: Members that a location takes along through the join.
FEW = 16
#: Locations of a cell, and points of a strip, that one task handles; a key with more is salted.
CELL_ROWS, STRIP_ROWS = 2_000, 200_000


def _cells(lat: Column, lon: Column, metres: float, cell_m: float, probe: bool) -> Column:
    """Array of cell ids: the home cell, or every cell that the box of `metres` around the point overlaps."""
    step = math.degrees(cell_m / EARTH_M)
    reach = math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-12
    strip = lambda x: F.floor((x + 90.0) / step)

    def in_strip(s: Column) -> Column:
        edge = F.greatest(F.abs(s * step - 90.0), F.abs((s + 1) * step - 90.0))  # the latitude farthest from the equator
        n = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0.0), F.cos(F.radians(F.least(edge, F.lit(90.0))))) * 360.0 / step)).cast("bigint")
        at = lambda x: F.floor((x + 180.0) / 360.0 * n).cast("bigint")
        key = lambda c: s.cast("bigint") * 2_000_000_000 + F.pmod(c, n)
        if not probe:
            return F.array(key(at(lon)))
        grown = F.abs(lat) + reach
        wide = F.when(grown < 89.999, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(grown)))))).otherwise(F.lit(180.0))
        last = F.least(at(lon + wide), at(lon - wide) + n - 1)
        return F.transform(F.sequence(at(lon - wide), last), key)

    if not probe:
        return in_strip(strip(lat))
    return F.flatten(F.transform(F.sequence(strip(lat - reach), strip(lat + reach)), in_strip))


def near_locations(places: DataFrame, metres: float) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b, ...) with (lat_a, lon_a) < (lat_b, lon_b) of `places` (lat, lon, ...; distinct) at most `metres` apart.

    Other columns come along with _a and _b behind their names. A cell with over CELL_ROWS locations is spread over
    several tasks: its homes are salted, its probes copied.
    """
    cell_m = max(2.0 * metres, 0.5)
    side = lambda s, probe: places.select(*(F.col(c).alias(f"{c}_{s}") for c in places.columns), F.explode(_cells(F.col("lat"), F.col("lon"), metres, cell_m, probe)).alias("cell"))
    home, probe = side("a", False), side("b", True)
    hot = durable(home.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("salts")).where("salts > 1"))
    keys = ["cell"]
    if not hot.isEmpty():
        salts = small_side(hot)
        home = home.join(salts, "cell", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("lat_a", "lon_a"), F.col("salts")), F.lit(0))).drop("salts")
        probe = probe.join(salts, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts"), F.lit(1)).cast("bigint") - 1))).drop("salts")
        keys = ["cell", "salt"]
    # a location has one home cell and probes a cell once, hence a pair comes out once
    before = (F.col("lat_a") < F.col("lat_b")) | ((F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") < F.col("lon_b")))
    return home.join(probe, keys).where(before & (haversine_m("lat_a", "lon_a", "lat_b", "lon_b") <= metres)).drop(*keys)


def located(points: DataFrame) -> DataFrame:
    """(key, owner, lat, lon) of `points` that count, each key once.

    A row counts if key and coordinates are there, finite and the latitude is in [-90, 90]; longitudes wrap. Points
    without owner get the owner ''.
    """
    ok = points.where(F.col("key").isNotNull() & F.col("lat").between(-90.0, 90.0) & (F.abs("lon") < float("inf")))
    # -0.0 and 0.0 are one place, and so are longitudes 360 degrees apart
    lon = F.when(F.col("lon").between(-180.0, 180.0), F.col("lon")).otherwise(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0) + 0.0
    return ok.select("key", F.coalesce("owner", F.lit("")).alias("owner"), (F.col("lat") + 0.0).alias("lat"), lon.alias("lon")).dropDuplicates(["key"])


def near_pairs(points: DataFrame, metres: float) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of points of different owners at most `metres` apart.

    `points`: (key bigint, owner string, lat double, lon double); see located() for those that count. Points without
    owner are no one's: they pair with every owner but not with each other. Equal keys count once. The result has
    one row per pair, as asked; what grows with the square of a hot location is only that result, and its blocks are
    spread over all tasks.
    """
    return _pairs(durable(located(points)), metres)


def _pairs(base: DataFrame, metres: float) -> DataFrame:
    member = F.struct("key", "owner")
    # a place's members go along only if they are few: the first and last cost nothing, up to FEW are collected
    sizes = durable(base.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.min(member).alias("one"), F.max(member).alias("two")))
    several = sizes.where(F.col("n").between(3, FEW)).select("lat", "lon")
    lists = base.join(several, ["lat", "lon"], "left_semi").groupBy("lat", "lon").agg(F.collect_list(member).alias("few"))
    ms = F.when(F.col("n") == 1, F.array("one")).when(F.col("n") == 2, F.array("one", "two")).otherwise(F.col("few"))
    places = durable(sizes.join(lists, ["lat", "lon"], "left").select("lat", "lon", "n", ms.alias("ms")))
    links = near_locations(places, metres)
    direct = links.where("ms_a IS NOT NULL AND ms_b IS NOT NULL").select("ms_a", "ms_b", F.lit(False).alias("same"))
    own = places.where("n > 1 AND ms IS NOT NULL").select(F.col("ms").alias("ms_a"), F.col("ms").alias("ms_b"), F.lit(True).alias("same"))
    met = direct.unionByName(own)
    crowds = places.where("ms IS NULL")
    if not crowds.isEmpty():
        met = met.unionByName(_crowded(base, places, durable(links.where("ms_a IS NULL OR ms_b IS NULL").drop("ms_a", "ms_b"))))
    rows = met.select(F.explode("ms_a").alias("x"), "ms_b", "same").select("x", F.explode("ms_b").alias("y"), "same")
    rows = rows.where(F.col("x.owner") != F.col("y.owner")).where(~F.col("same") | (F.col("x.key") < F.col("y.key")))
    return rows.select(F.least("x.key", "y.key").alias("key_a"), F.greatest("x.key", "y.key").alias("key_b"))


def _crowded(base: DataFrame, places: DataFrame, links: DataFrame) -> DataFrame:
    """(ms_a, ms_b, same): blocks of members of linked places of which one has many, and of such a place with itself.

    Every pair of blocks of two linked places (or of one place) meets in its own key.
    """
    ends = links.select(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")).unionByName(links.select(F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"))).unionByName(places.where("ms IS NULL").select("lat", "lon")).distinct()
    sizes = durable(places.select("lat", "lon", "n").join(ends, ["lat", "lon"], "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    # a block holds about BLOCK members, so collecting one is bounded
    blocks = durable(join_counted(base, sizes, ["lat", "lon"]).select("lat", "lon", block, F.struct("key", "owner").alias("m")).groupBy("lat", "lon", "block").agg(F.collect_list("m").alias("ms")))
    of = lambda n, s: F.ceil(F.col(n) / BLOCK).cast("int").alias(f"blocks_{s}")
    pairs = links.select("lat_a", "lon_a", "lat_b", "lon_b", of("n_a", "a"), of("n_b", "b"))
    crowds = places.where("ms IS NULL")
    pairs = pairs.unionByName(crowds.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), of("n", "a"), of("n", "b")))
    tasks = pairs.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    own = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    tasks = tasks.where(~own | (F.col("block_a") <= F.col("block_b")))
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "block", "ms")))
    met = tasks.join(side("a"), ["lat_a", "lon_a", "block_a"]).join(side("b"), ["lat_b", "lon_b", "block_b"])
    return met.select("ms_a", "ms_b", (own & (F.col("block_a") == F.col("block_b"))).alias("same"))


def near_classes(points: DataFrame, metres: float) -> DataFrame:
    """(key, class_key, class_size, near_classes, near_points): each point with its class, the points at its very place, and the links of that.

    `class_key` is the class's least key; `near_classes` counts the other classes at most `metres` away, `near_points`
    all other points within that distance, those at the same place and of the same owner too. The rows are as many as
    points, however many pairs they form.
    """
    base = durable(located(points))
    places = durable(base.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.min("key").alias("class_key")))
    links = near_locations(places.select("lat", "lon", "n"), metres)
    end = lambda s, o: links.select(F.col(f"lat_{s}").alias("lat"), F.col(f"lon_{s}").alias("lon"), F.col(f"n_{o}").alias("other"))
    linked = end("a", "b").unionByName(end("b", "a")).groupBy("lat", "lon").agg(F.count("*").alias("near_classes"), F.sum("other").alias("others"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    per_place = durable(places.join(linked, ["lat", "lon"], "left").select("lat", "lon", "n", "class_key", zero("near_classes").alias("near_classes"), (zero("others") + F.col("n") - 1).alias("near_points")))
    return join_counted(base.select("key", "lat", "lon"), per_place, ["lat", "lon"]).select("key", "class_key", F.col("n").alias("class_size"), "near_classes", "near_points")


def nearest(points: DataFrame, targets: DataFrame, start_m: float = 250.0, by: str | None = None) -> DataFrame:
    """(key, target, metres): the nearest target (target, lat, lon) of each point (key, lat, lon) with usable coordinates.

    Rounds of growing distance: a point that finds targets within the round's distance has its true nearest among
    them and drops out; the rest go on with four times the distance, up to half the globe. Ties go to the least
    target. Without targets the result is empty; keys should be distinct. With `by`, a column of both sides, only targets
    with the point's value count; points whose value no target has give no row.
    """
    group = [by] if by else []
    usable = lambda d, k: d.where(F.col(k).isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
    rest = usable(points, "key").select("key", *group, "lat", "lon")
    goal = usable(targets, "target").select("target", *group, F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    if by:
        rest = rest.join(goal.select(by).distinct(), by, "left_semi")
    everyone = durable(rest)
    # equal locations are searched once, and of equal targets the least counts
    place = ["lat", "lon", *group]
    rest = durable(everyone.select(*place).distinct())
    goal = goal.groupBy(*group, "t_lat", "t_lon").agg(F.min("target").alias("target"))
    out, metres = None, start_m
    while True:
        home = goal.withColumn("cell", F.explode(_cells(F.col("t_lat"), F.col("t_lon"), metres, 2 * metres, False)))
        probe = rest.withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), metres, 2 * metres, True)))
        distance = haversine_m("lat", "lon", "t_lat", "t_lon")
        found = probe.join(home, ["cell", *group]).withColumn("metres", distance).where(F.col("metres") <= metres)
        best = durable(found.groupBy(*place).agg(F.min(F.struct("metres", "target")).alias("b")).select(*place, "b.target", "b.metres"))
        out = best if out is None else out.unionByName(best)
        rest = durable(rest.join(best, place, "left_anti"))
        if metres > math.pi * EARTH_M or rest.isEmpty():
            return everyone.join(small_side(out), place).groupBy("key").agg(F.min(F.struct("metres", "target")).alias("b")).select("key", "b.target", "b.metres")
        metres *= 4


def within(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, target, metres): all targets (target, lat, lon) within each point's own radius; points are (key, lat, lon, radius).

    The cells have the size of the largest radius.
    """
    goal = _usable(targets, "target").select("target", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    return within_places(points, targets).join(goal, ["t_lat", "t_lon"]).select("key", "target", "metres")


def _usable(d: DataFrame, key: str) -> DataFrame:
    return d.where(F.col(key).isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))


def within_places(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, t_lat, t_lon, metres): as within(), the targets' locations instead of the targets, each once however many are there."""
    at = _usable(points, "key").where("radius >= 0").select("key", "lat", "lon", "radius")
    most = max(at.agg(F.max("radius")).first()[0] or 0.0, 1.0)
    # pairs of locations first, so that equal ones are compared once
    goal = _usable(targets, "target").select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).distinct()
    home = goal.withColumn("cell", F.explode(_cells(F.col("t_lat"), F.col("t_lon"), most, 2 * most, False)))
    probe = at.select("lat", "lon", "radius").distinct().withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), most, 2 * most, True)))
    found = probe.join(home, "cell").withColumn("metres", haversine_m("lat", "lon", "t_lat", "t_lon"))
    close = durable(found.where("metres <= radius").select("lat", "lon", "radius", "t_lat", "t_lon", "metres"))
    return at.join(small_side(close), ["lat", "lon", "radius"]).select("key", "t_lat", "t_lon", "metres")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 0.05) -> DataFrame:
    """(key, box) for points (key, x, y) in boxes (box, x1, y1, x2, y2), edges included: a range join by grid cells.

    Cells come in levels, each twice as wide as the one before; a box is put into the few cells that it overlaps at the
    level of its size, a point has one cell at each level that any box has, so a match comes out once and a huge box
    is a few rows. `cell` should be about the usual box's size; it changes the work, not the result. Boxes that aren't
    finite hold nothing.
    """
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in ("x1", "x2", "y1", "y2"))
    level = F.greatest(F.lit(0), F.ceil(F.coalesce(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / cell), F.lit(0.0)))).cast("int")
    at = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))).cast("bigint")
    ok = boxes.where(f"x1 <= x2 AND y1 <= y2 AND {finite}").withColumn("level", level)
    levels = sorted(r[0] for r in ok.select("level").distinct().collect())  # as many as a double's exponents at most
    ok = ok.withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.col("x2"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.col("y2")))))
    every = F.explode(F.array(*map(F.lit, levels))) if levels else F.explode(F.array().cast("array<int>"))
    p = points.select("key", "x", "y", every.alias("level")).select("key", "x", "y", "level", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"))
    return p.join(ok, ["level", "cx", "cy"]).where("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2").select("key", "box")


def nearest_edges(points: DataFrame, edges: DataFrame, reach_deg: float = 0.005) -> DataFrame:
    """(key, edge, ratio, degrees): the nearest edge of each point and where on it, within `reach_deg` (planar).

    `edges`: (edge, x1, y1, x2, y2). An edge is put into every grid cell that its box, grown by the reach,
    overlaps; a point has one cell, so a match comes out once. Points with nothing in reach give no row.
    """
    from darb.functions.geo import segment_distance, segment_ratio

    cell = lambda v: F.floor(v / (2 * reach_deg)).cast("bigint")
    span = lambda a, b: F.sequence(cell(F.least(a, b) - reach_deg), cell(F.greatest(a, b) + reach_deg))
    placed = edges.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    at = points.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    near = at.join(placed, ["cx", "cy"]).withColumn("degrees", segment_distance("x", "y", "x1", "y1", "x2", "y2")).where(F.col("degrees") <= reach_deg)
    best = near.groupBy("key").agg(F.min(F.struct("degrees", "edge", segment_ratio("x", "y", "x1", "y1", "x2", "y2").alias("ratio"))).alias("b"))
    return best.select("key", "b.edge", "b.ratio", "b.degrees")


def nearest_edges_any(points: DataFrame, edges: DataFrame, start_deg: float = 0.005) -> DataFrame:
    """As nearest_edges, but at any distance: (key, edge, ratio, degrees) for every point with finite coordinates.

    Rounds of growing reach as in nearest(): a point that finds an edge within the reach has its nearest among those and
    drops out; the rest go on with twice the reach. Without usable edges the result is empty; keys should be distinct.
    """
    finite = lambda d, *c: d.where(" AND ".join(f"abs({x}) < double('infinity')" for x in c))
    lines = durable(finite(edges, "x1", "y1", "x2", "y2").select("edge", "x1", "y1", "x2", "y2"))
    rest = durable(finite(points, "x", "y").where("key IS NOT NULL").select("key", "x", "y"))
    out, reach = None, start_deg
    while True:
        best = durable(nearest_edges(rest, lines, reach))
        out = best if out is None else out.unionByName(best)
        rest = durable(rest.join(best, "key", "left_anti"))
        if rest.isEmpty() or lines.isEmpty():
            return out
        reach *= 2


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edges (region, x1, y1, x2, y2) of rings given as (region, seq, x, y).

    Repeated rows count once (of unequal rows with one seq, the smallest x, y); vertices without region, seq or
    finite coordinates don't count; the last vertex is joined to the first, and a ring that repeats its first
    vertex at its end merely gets an edge without length. A region without vertices that count has no edges.
    """
    ok = vertices.where("region IS NOT NULL AND seq IS NOT NULL AND abs(x) < double('infinity') AND abs(y) < double('infinity')")
    ring = ok.groupBy("region", "seq").agg(F.min(F.struct("x", "y")).alias("v")).select("region", "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    following = with_neighbour(ring, ["region"], ["seq"], {"x": "x2", "y": "y2"}, after=True)
    ends = ring.groupBy("region").agg(F.min_by(F.struct("x", "y"), "seq").alias("v"))
    edges = following.join(ends, "region").select("region", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce("x2", "v.x").alias("x2"), F.coalesce("y2", "v.y").alias("y2"))
    return edges.where("x1 <> x2 OR y1 <> y2")


def points_in_regions(points: DataFrame, vertices: DataFrame, strips: int = 4096) -> DataFrame:
    """(key, region) for every point (key, x, y) that lies in or on a region's ring (region, seq, x, y).

    Coordinates are planar. Points with a null, NaN or infinite coordinate lie nowhere. A ring of one point has
    no inside; a ring of two holds the points of its segment. `strips` is how many strips the regions' whole
    latitude span is cut into; it changes the work, not the result. Equal locations are tested once.
    """
    edges = durable(polygon_edges(vertices))
    span = edges.agg(F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"), F.count("*").alias("n")).first()
    low, high = (span["low"], span["high"]) if span["n"] else (0.0, 0.0)
    step = (high - low) / strips or 1.0
    strip = lambda y: F.floor((y - low) / step).cast("int")
    binned = edges.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    # points outside the regions' box can't be in any; the filter also drops null and NaN
    box = edges.agg(F.min(F.least("x1", "x2")).alias("x_low"), F.max(F.greatest("x1", "x2")).alias("x_high")).first()
    inside_box = F.col("y").between(low, high) & F.col("x").between(box["x_low"] or 0.0, box["x_high"] or 0.0)
    usable = points.where(F.col("key").isNotNull() & inside_box).select("key", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).distinct()
    places = usable.select("x", "y").distinct().withColumn("strip", strip(F.col("y")))
    if binned.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = places.join(F.broadcast(binned), "strip")
    else:  # a strip of a city may hold a third of all points: its points are spread by their number, its edges copied
        places = durable(places)
        salts = small_side(durable(places.groupBy("strip").agg(F.ceil(F.count("*") / STRIP_ROWS).cast("int").alias("salts")).where("salts > 1")))
        spread = places.join(salts, "strip", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("x", "y"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        copies = binned.join(salts, "strip", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        met = spread.join(copies, ["strip", "salt"])
    # the edge's x on the ray, and the explicit boundary test
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("x") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    touches = (cross == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    east = F.when(F.col("y2") > F.col("y1"), cross > 0).otherwise(cross < 0)
    hit = met.groupBy("x", "y", "region").agg(F.sum((spans & ~east).cast("int")).alias("crossings"), F.max(touches.cast("int")).alias("touch"))
    held = hit.where("crossings % 2 = 1 OR touch = 1").select("x", "y", "region")
    return usable.join(held, ["x", "y"]).select("key", "region").distinct()


def request_points(requests: DataFrame) -> DataFrame:
    """(key, owner, lat, lon) of the change-location requests that count: both coordinates there, not NaN, not both 0."""
    at = "meta.new_location."
    points = requests.select(F.col("request_id").alias("key"), student_key("meta.student_id").alias("owner"), F.col(at + "latitude").alias("lat"), F.col(at + "longitude").alias("lon"))
    return points.where("key IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)")


def near_and_inside(requests: DataFrame, boundaries: DataFrame, metres: float = 5.0) -> DataFrame:
    """p4: (case_kind 'near'|'inside', key_a, key_b), see near_pairs and points_in_regions."""
    points = request_points(requests)
    near = near_pairs(points, metres).select(F.lit("near").alias("case_kind"), "key_a", "key_b")
    rings = boundaries.select(F.col("boundary_id").alias("region"), F.col("vertex_seq").alias("seq"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = points_in_regions(points.select("key", F.col("lon").alias("x"), F.col("lat").alias("y")), rings)
    return near.unionByName(inside.select(F.lit("inside").alias("case_kind"), F.col("key").alias("key_a"), F.col("region").alias("key_b")))
