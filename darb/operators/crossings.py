"""Crossings of two-way roads whose lanes are apart: pairs of real nodes, and projected ones where a node has no partner.

A road is a name and a class. Its nodes have two sides by the bearing of their lane (within 90 degrees of the road's
reference, that of its least node, or not); a road counts if it has both and their mean bearings are opposite.
Candidates come from an equi join on the road and on grid cells of the largest distance.

Nodes of one road and side at one place are a class: all pairs of two classes have one distance and one midpoint, so
pairs of classes are made, not pairs of nodes, and a pair of classes stands for the least pair of its free nodes.

Which candidates stand is a greedy choice, nearest first, with nodes used once over all roads and midpoints a spacing
apart. It goes through the order in stretches of a bounded number of rows. A stretch is gone through by one task, which
moves a pair of classes on to its next nodes when one is taken; what it leaves standing then rules out most of the rows
behind it, in joins over all of them. That gives the very result of going through all candidates in order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darb.functions.geo import EARTH_M, angle_difference, bearing_deg, crossing_angle_ok, haversine_m, segment_ratio, virtual_node_id
from darb.operators.spatial import _cells
from darb.session import durable, small_side

#: The distance of a crossing that nothing else gives, how near a node is the same, in metres.
GUARANTEED_M, SAME_NODE_M = 6.0, 1.5
#: Rows of the first stretch of the order and of any, and how many of one that fall are aimed at.
BATCH, MOST, CONFLICTS = 20_000, 400_000, 300_000
#: Free nodes of a class that a stretch has at hand at first.
DEEP = 16


def sides(nodes: DataFrame, opposite: float = 150.0) -> DataFrame:
    """Nodes (name, road_class, node, lat, lon, bearing) of roads with both directions, with side 'A' or 'B' and the road's axis, the mean bearing of side A.

    A node that has several bearings on a road counts with the least.
    """
    once = nodes.where("node IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND bearing IS NOT NULL").groupBy("name", "road_class", "node").agg(F.min(F.struct("bearing", "lat", "lon")).alias("n")).select("name", "road_class", "node", "n.*")
    first = once.groupBy("name", "road_class").agg(F.min_by("bearing", "node").alias("__ref"))
    sided = once.join(first, ["name", "road_class"]).withColumn("side", F.when(angle_difference("bearing", "__ref") < 90.0, "A").otherwise("B")).drop("__ref")
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("bearing")))
    axes = sided.groupBy("name", "road_class").agg(mean("A").alias("axis"), mean("B").alias("__b")).where(angle_difference("axis", "__b") >= opposite)
    return sided.join(axes.drop("__b"), ["name", "road_class"])


def _blocked(left: DataFrame, stand: DataFrame, nodes: list[str], spacing_m: float) -> DataFrame:
    """`left` without the candidates that share a node with one of `stand` or have their midpoint within the spacing of it."""
    ends = stand.select(F.explode(F.array(*nodes)).alias("__n")).distinct()
    for n in nodes:
        left = left.join(ends.withColumnRenamed("__n", n), n, "left_anti")
    return _apart(left, stand, spacing_m)


def _apart(left: DataFrame, taken: DataFrame, spacing_m: float) -> DataFrame:
    """`left` without the candidates whose midpoint is within the spacing of one of `taken` (mid_lat, mid_lon)."""
    if spacing_m <= 0:
        return left
    cell = lambda d, lat, lon, probe: d.withColumn("__c", F.explode(_cells(F.col(lat), F.col(lon), spacing_m, 2 * spacing_m, probe)))
    old = cell(taken.select(F.col("mid_lat").alias("__la"), F.col("mid_lon").alias("__lo")).distinct(), "__la", "__lo", False)
    close = cell(left.select("mid_lat", "mid_lon").distinct(), "mid_lat", "mid_lon", True).join(old, "__c").where(haversine_m("mid_lat", "mid_lon", "__la", "__lo") < spacing_m).select("mid_lat", "mid_lon").distinct()
    return left.join(small_side(durable(close)), ["mid_lat", "mid_lon"], "left_anti")


def greedy(candidates: DataFrame, order: list[Column], nodes: list[str], spacing_m: float, taken: DataFrame | None = None) -> DataFrame:
    """The candidates (..., mid_lat, mid_lon) that stand when all are gone through in `order`: none shares a node (the columns in `nodes`) or has its midpoint within `spacing_m` of one that stands.

    `order` must be total. `taken` (mid_lat, mid_lon) stand already. With a spacing of 0 only nodes count.

    They are taken in stretches of the order, the first of BATCH: what a stretch leaves standing rules out most of those
    behind it. Stretches grow or shrink with what falls in them, up to MOST; where they end changes no result.
    """
    columns = candidates.columns
    left = candidates.withColumn("__o", F.struct(*order))
    left = durable(_apart(left, taken, spacing_m) if taken is not None else left)
    stand, size = None, BATCH
    while True:
        rest, now = left.count(), left
        if rest > size:
            now = durable(left.orderBy("__o").limit(size))
            left = left.join(F.broadcast(now.agg(F.max("__o").alias("__last"))), F.col("__o") > F.col("__last")).drop("__last")
        held, met, *_ = _settled(now, nodes, spacing_m, rest > size)
        stand = held if stand is None else durable(stand.unionByName(held))
        if rest <= size:
            return stand.select(*columns)
        left = durable(_blocked(left, held, nodes, spacing_m))
        size = _next_size(size, met)


def _next_size(size: int, met: int) -> int:
    return max(BATCH, min(MOST, int(size * min(4.0, CONFLICTS / max(1, met)))))


def _greedy_classes(pairs: DataFrame, members: DataFrame, spacing_m: float) -> DataFrame:
    """greedy() of all pairs of nodes of `pairs` of classes (class_a, class_b, metres, mid_lat, mid_lon), by metres, a, b: (a, b, class_a, class_b, metres, mid_lat, mid_lon).

    `members`: (class, node). All pairs of a pair of classes have its distance, so what is nearer than the end of a
    stretch is settled, and rows as far as the end stay for the next one. A pair counts with the least nodes of its
    classes that are free; a class has `deep` of them at hand, and a stretch ends where these don't do.
    """
    columns = ["a", "b", *pairs.columns]
    left, stand, size, deep = pairs, None, BATCH, DEEP
    while True:
        rest = left.count()
        now, far = left, None
        if rest > size:
            far = left.select("metres").orderBy("metres").limit(size).agg(F.max("metres")).first()[0]
            now = left.where(F.col("metres") <= far)
        free = members
        if stand is not None:
            used = stand.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            free = members.join(small_side(used), "node", "left_anti")
        # one more than the task gets tells whether there are more
        ranked = free.withColumn("__r", F.row_number().over(Window.partitionBy("class").orderBy("node"))).where(F.col("__r") <= deep + 1)
        heads = durable(ranked.groupBy("class").agg(F.min("node").alias("n"), F.sort_array(F.collect_list("node")).alias("all")))
        for s in "ab":
            now = now.join(heads.select(F.col("class").alias(f"class_{s}"), F.col("n").alias(s), F.slice("all", 1, deep).alias(f"__all_{s}"), (F.size("all") > deep).alias(f"__more_{s}")), f"class_{s}")
        now = now.withColumn("__o", F.struct("metres", "a", "b"))
        if rest > size:
            now = now.orderBy("__o").limit(size)
        held, met, end, short = _settled(now.select(*columns, "__o", "__all_a", "__all_b", "__more_a", "__more_b"), ["a", "b"], spacing_m, rest > size)
        stand = held if stand is None else durable(stand.unionByName(held))
        if end is None and far is None:
            return stand
        # without an end none of them has free nodes
        left = durable(_apart(left.where(F.col("metres") > far if end is None else F.col("metres") >= end), held, spacing_m))
        deep = deep * 4 if short else deep
        size = max(1, min(_next_size(size, met), MOST * DEEP // deep))


def _settled(left: DataFrame, nodes: list[str], spacing_m: float, cut: bool = False) -> tuple[DataFrame, int, float | None, bool]:
    """greedy() of the rows of a stretch by their order in __o, in one task; how many fell; where it ended if not with the last row; whether that is for want of nodes at hand.

    With __all_x and __more_x for each x of `nodes` a row stands for all pairs of its classes: __all_x are the first free
    nodes of the class, __more_x tells whether there are others, and __o has metres, then the nodes. `cut`: rows that
    aren't here come behind the last one, so nothing behind it is settled.
    """
    extra = {"__o", *(f"__{k}_{n}" for k in ("all", "more") for n in nodes)}
    columns = [f for f in left.schema.fields if f.name not in extra]
    # a last row without values, but for __met, tells the rest
    said = T.StructType([T.StructField(f.name, f.dataType) for f in columns] + [T.StructField("__met", T.LongType()), T.StructField("__end", T.DoubleType()), T.StructField("__short", T.BooleanType())])
    names = [f.name for f in columns]
    done = durable(left.repartition(1).mapInArrow(lambda batches: _walk(batches, names, nodes, spacing_m, cut), said))
    told = done.where("__met IS NOT NULL").select("__met", "__end", "__short").first() or (0, None, False)
    return done.where("__met IS NULL").select(*names), *told


def _walk(batches: Iterator[pa.RecordBatch], columns: list[str], nodes: list[str], spacing_m: float, cut: bool) -> Iterator[pa.RecordBatch]:
    """The work of _settled()."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    order = t.column("__o").combine_chunks()
    keys = list(zip(*(x.to_pylist() for x in order.flatten()), strict=True))
    classes = f"__all_{nodes[0]}" in t.column_names
    # where a node is in the key; only a pair of classes has others to move on to
    places = [order.type.get_field_index(n) for n in nodes] if classes else []
    ends = None if classes else list(zip(*(t.column(n).to_pylist() for n in nodes), strict=True))
    spots = list(zip(t.column("mid_lat").to_pylist(), t.column("mid_lon").to_pylist(), strict=True))
    cells = _cubes(t, spacing_m) if spacing_m > 0 else None
    near: dict[tuple, list] = {}  # midpoints that stand, in their cube and those around
    shut, used, taken, met = set(), set(), [], 0
    lists: dict[tuple, list] = {}

    def blocked(row: int) -> bool:
        if spots[row] in shut:
            return True
        lat, lon = spots[row]
        if any(_metres(lat, lon, *m) < spacing_m for m in near.get(cells[row], ())):
            shut.add(spots[row])
            return True
        return False

    def at_hand(row: int, n: str) -> list:
        if (row, n) not in lists:
            lists[row, n] = t.column(f"__all_{n}")[row].as_py()
        return lists[row, n]

    rows = sorted(range(len(keys)), key=keys.__getitem__)
    last = keys[rows[-1]] if cut else None
    moved: list[tuple] = []
    i, end, short = 0, None, False
    while i < len(rows) or moved:
        if i == len(rows) or moved and moved[0] < (keys[rows[i]], rows[i]):
            key, row = heapq.heappop(moved)
        else:
            key, row = keys[rows[i]], rows[i]
            i += 1
        if last is not None and key > last:
            break
        if spacing_m > 0 and blocked(row):
            met += 1
            continue
        now = [key[p] for p in places] if classes else ends[row]
        if not any(n in used for n in now):
            taken.append((row, now))
            used.update(now)
            if spacing_m > 0:
                x, y, z = cells[row]
                shut.add(spots[row])
                for cube in ((x + a, y + b, z + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)):
                    near.setdefault(cube, []).append(spots[row])
                continue
        else:
            met += 1
        if not classes:
            continue
        key, gone = list(key), False
        for p, n in zip(places, nodes, strict=True):
            if key[p] in used:
                key[p] = next((x for x in at_hand(row, n) if x not in used), None)
                if key[p] is None:
                    gone = True
                    short |= t.column(f"__more_{n}")[row].as_py()
        if short:
            end = key[0]
            break
        if not gone:
            heapq.heappush(moved, (tuple(key), row))
    if end is None and last is not None:
        end = last[0]
    kept = t.take(pa.array([row for row, _ in taken], pa.int64()))
    out = {c: kept.column(c) for c in columns}
    if classes:
        out |= {n: pa.chunked_array([pa.array([now[k] for _, now in taken], t.schema.field(n).type)]) for k, n in enumerate(nodes)}
    told = {"__met": (met, pa.int64()), "__end": (float(end) if classes and end is not None else None, pa.float64()), "__short": (short, pa.bool_())}
    out |= {c: pa.nulls(len(taken), kind) for c, (_, kind) in told.items()}
    yield from pa.table(out).to_batches()
    yield pa.RecordBatch.from_pydict({c: pa.nulls(1, t.schema.field(c).type) for c in columns} | {c: pa.array([v], kind) for c, (v, kind) in told.items()})


def _cubes(t: pa.Table, metres: float) -> list[tuple]:
    """The cube of each midpoint, of a width that takes points less than `metres` apart to the same cube or to ones that touch."""
    lat, lon = (np.radians(t.column(c).to_numpy()) for c in ("mid_lat", "mid_lon"))
    at = EARTH_M * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    return list(map(tuple, np.floor(at / (metres * (1 + 1e-6) + 1e-3)).astype(np.int64).tolist()))


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """haversine_m() of numbers."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


def carriageway_crossings(nodes: DataFrame, min_m: float = 6.0, max_m: float = 60.0, opposite: float = 150.0, spacing_m: float = 100.0, off_right_angle: float = 30.0) -> DataFrame:
    """(name, road_class, a, b, metres, mid_lat, mid_lon): crossings from side A to side B of two-way roads, see sides() and greedy().

    `nodes`: (name, road_class, node, lat, lon, bearing). The way across is within `off_right_angle` degrees of a right
    angle to the road's axis; of equal distances the smaller nodes come first.
    """
    placed = durable(sides(nodes, opposite))
    # nodes of several roads are classes of their own
    several = durable(placed.groupBy("node").count().where("count > 1").select("node", F.col("node").alias("own")))
    placed = placed.join(small_side(several), "node", "left")
    place = ["name", "road_class", "side", "lat", "lon", "own"]
    classes = durable(placed.select(*place, "axis").distinct().withColumn("class", F.monotonically_increasing_id()))
    keys = classes.select(*(F.col(c).alias(f"__{c}") for c in place), "class")
    members = durable(placed.join(keys, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]).select("class", "node"))
    side = lambda s, n, probe: classes.where(F.col("side") == n).select("name", "road_class", *(["axis"] if s == "a" else []), *(F.col(c).alias(f"{c}_{s}") for c in ("class", "own", "lat", "lon")), F.explode(_cells(F.col("lat"), F.col("lon"), max_m, 2 * max_m, probe)).alias("cell"))
    met = side("a", "A", False).join(side("b", "B", True), ["name", "road_class", "cell"]).withColumn("metres", haversine_m("lat_a", "lon_a", "lat_b", "lon_b"))
    fit = met.where(F.col("metres").between(min_m, max_m) & crossing_angle_ok("axis", bearing_deg("lat_a", "lon_a", "lat_b", "lon_b"), off_right_angle))
    columns = ["class_a", "class_b", "metres", ((F.col("lat_a") + F.col("lat_b")) / 2).alias("mid_lat"), ((F.col("lon_a") + F.col("lon_b")) / 2).alias("mid_lon")]
    if several.isEmpty():
        pairs = durable(fit.select(*columns))
    else:
        # a pair of nodes may be on several roads; it is one candidate, of the first
        found = durable(fit.select(*columns, "name", "road_class", "own_a", "own_b"))
        twice = F.col("own_a").isNotNull() & F.col("own_b").isNotNull()
        once = found.where(twice).groupBy("own_a", "own_b").agg(F.min(F.struct("name", "road_class", "metres", "mid_lat", "mid_lon", "class_a", "class_b")).alias("c")).select("c.*")
        bare = ["class_a", "class_b", "metres", "mid_lat", "mid_lon"]
        pairs = durable(found.where(~twice).select(*bare).unionByName(once.select(*bare)))
    stand = _greedy_classes(pairs, members, spacing_m)
    return stand.join(classes.select(F.col("class").alias("class_a"), "name", "road_class"), "class_a").select("name", "road_class", "a", "b", "metres", "mid_lat", "mid_lon")


def fallback_crossings(nodes: DataFrame, segments: DataFrame, crossings: DataFrame, max_m: float = 60.0, opposite: float = 150.0, spacing_m: float = 100.0) -> DataFrame:
    """(name, road_class, a, b, lat_b, lon_b, metres, kind): a crossing for each node of a two-way road that `crossings` leave without.

    It leads to the nearest place on the other side's `segments` (name, road_class, lat1, lon1, lat2, lon2, bearing) at most
    `max_m` away; a node of the road within 1.5 metres of that place is taken ('projected_real'), else a new one
    ('projected', named by its place). Those keep the spacing to all crossings first ('projected...'), the rest come
    without it ('..._no_spacing'); a node with nothing opposite gets a crossing of 6 metres at a right angle to the road
    ('guaranteed'). Nodes are used once.
    """
    placed = durable(sides(nodes, opposite))
    used = crossings.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lone = durable(placed.join(used, "node", "left_anti"))
    axes = placed.select("name", "road_class", "axis").distinct()
    on = segments.join(axes, ["name", "road_class"]).withColumn("side", F.when(angle_difference("bearing", "axis") < 90.0, "A").otherwise("B"))
    # segments in the cells of their ends and of points between, a reach apart
    steps = F.greatest(F.lit(1), F.ceil(haversine_m("lat1", "lon1", "lat2", "lon2") / max_m)).cast("int")
    along = on.withColumn("__t", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: i / steps)))
    cut = along.withColumn("cell", F.explode(_cells(F.col("lat1") + F.col("__t") * (F.col("lat2") - F.col("lat1")), F.col("lon1") + F.col("__t") * (F.col("lon2") - F.col("lon1")), 2 * max_m, 4 * max_m, True)))
    ways = cut.select("name", "road_class", F.col("side").alias("__s"), "lat1", "lon1", "lat2", "lon2", "cell").distinct()
    home = lone.withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), 2 * max_m, 4 * max_m, False)))
    shrink = F.cos(F.radians("lat"))
    t = segment_ratio(F.col("lon") * shrink, F.col("lat"), F.col("lon1") * shrink, F.col("lat1"), F.col("lon2") * shrink, F.col("lat2"))
    met = home.join(ways, ["name", "road_class", "cell"]).where("side <> __s").withColumn("__r", t)
    spot = met.withColumn("lat_b", F.col("lat1") + F.col("__r") * (F.col("lat2") - F.col("lat1"))).withColumn("lon_b", F.col("lon1") + F.col("__r") * (F.col("lon2") - F.col("lon1"))).withColumn("metres", haversine_m("lat", "lon", "lat_b", "lon_b")).where(F.col("metres") <= max_m)
    nearest = spot.groupBy("name", "road_class", "node").agg(F.min(F.struct("metres", "lat_b", "lon_b")).alias("p"))
    aimed = lone.join(nearest, ["name", "road_class", "node"], "left")
    per = GUARANTEED_M / 111_000.0
    angle = F.radians(F.col("axis") + 90.0)
    aimed = aimed.select(
        "name", "road_class", F.col("node").alias("a"), "lat", "lon", F.when(F.col("p").isNull(), "guaranteed").otherwise("projected").alias("kind"), F.coalesce("p.metres", F.lit(GUARANTEED_M)).alias("metres"),
        F.coalesce("p.lat_b", F.col("lat") + per * F.cos(angle)).alias("lat_b"), F.coalesce("p.lon_b", F.col("lon") + per * F.sin(angle) / shrink).alias("lon_b"),
    )
    # a node of the same road at the very place is taken
    at = lambda d, lat, lon, probe: d.withColumn("cell", F.explode(_cells(F.col(lat), F.col(lon), SAME_NODE_M, 2 * SAME_NODE_M, probe)))
    near = at(aimed.select("name", "road_class", "a", "lat_b", "lon_b"), "lat_b", "lon_b", True).join(at(placed.select("name", "road_class", F.col("node").alias("__n"), F.col("lat").alias("__la"), F.col("lon").alias("__lo")), "__la", "__lo", False), ["name", "road_class", "cell"])
    reused = near.where((F.col("a") != F.col("__n")) & (haversine_m("lat_b", "lon_b", "__la", "__lo") <= SAME_NODE_M)).groupBy("name", "road_class", "a").agg(F.min(F.struct(haversine_m("lat_b", "lon_b", "__la", "__lo").alias("m"), F.col("__n").cast("string").alias("n"))).alias("r"))
    named = aimed.join(reused, ["name", "road_class", "a"], "left")
    named = named.withColumn("b", F.coalesce("r.n", virtual_node_id("lat_b", "lon_b"))).withColumn("kind", F.when(F.col("r").isNotNull(), F.concat("kind", F.lit("_real"))).otherwise(F.col("kind")))
    named = durable(named.withColumn("mid_lat", (F.col("lat") + F.col("lat_b")) / 2).withColumn("mid_lon", (F.col("lon") + F.col("lon_b")) / 2).withColumn("__a", F.col("a").cast("string")).drop("r"))
    # a node that crossings use is no end of another
    free = named.join(used.select(F.col("node").cast("string").alias("b")), "b", "left_anti")
    order = [F.col("metres"), F.col("__a"), F.col("b"), F.col("name"), F.col("road_class")]
    first = durable(greedy(free.where("kind LIKE 'projected%'"), order, ["__a", "b"], spacing_m, crossings))
    ends = first.select(F.explode(F.array("__a", "b")).alias("__e")).distinct()
    rest = free.join(ends.withColumnRenamed("__e", "__a"), "__a", "left_anti").join(ends.withColumnRenamed("__e", "b"), "b", "left_anti")
    second = greedy(rest, [(F.col("kind").startswith("guaranteed")).alias("last"), *order], ["__a", "b"], 0.0)
    second = second.withColumn("kind", F.when(F.col("kind").startswith("projected"), F.concat("kind", F.lit("_no_spacing"))).otherwise(F.col("kind")))
    return first.unionByName(second).select("name", "road_class", "a", "b", "lat_b", "lon_b", "metres", "kind")
