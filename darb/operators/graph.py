"""Road graphs as edge tables (u, v, ...): enrichment, reachability, travel matrices, snapping, crossings.

Searches over integral ids go through `search`, whole in a task a source, while a task can hold the graph. Others are
rounds of relational relaxation: a round joins the frontier with the edges, keeps the least cost
per (source, node) and goes on with what improved. Every round is checkpointed, so lineage doesn't grow and a
lost executor costs one round. Costs are bounded, so the number of rounds is, and frontier rows are spread by
node with all sources of a run, not by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darb.functions.geo import bearing_deg
from darb.functions.scalars import road_class, speed_kph, travel_minutes, turn_penalty
from darb.operators import search
from darb.session import durable, small_side


def enrich_edges(edges: DataFrame, road_types: DataFrame, default_kph: float = 30.0) -> DataFrame:
    """Adds road_class, kph, minutes and safe to edges (u, v, metres, highway, maxspeed).

    `road_types`: (highway, multiplier, safe); a class that it lacks gets its 'default' row, without that 1.0 and
    safe. Speeds in miles are converted.
    """
    types = road_types.select(F.col("highway").alias("__h"), "multiplier", "safe")
    fallback = road_types.where("highway = 'default'").agg(F.max("multiplier").alias("m"), F.bool_or("safe").alias("s")).first()  # one row
    out = edges.withColumn("road_class", road_class("highway")).join(small_side(types), F.col("road_class") == F.col("__h"), "left")
    kph = speed_kph("maxspeed", default_kph) * F.coalesce("multiplier", F.lit(fallback["m"]), F.lit(1.0))
    return out.select(*edges.columns, "road_class", kph.alias("kph"), travel_minutes("metres", kph).alias("minutes"), F.coalesce("safe", F.lit(fallback["s"]), F.lit(True)).alias("safe"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, the cheapest of parallel ones: (u, v, cost)."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")
    return edges.select("u", "v", "cost").unionByName(back).groupBy("u", "v").agg(F.min("cost").alias("cost"))


def ways_to_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges (way_id, u, v, highway) of ways (way_id, refs, highway, oneway); both ends must be among `nodes`.

    oneway 'yes' keeps the order, '-1' reverses it, roundabouts (junction) are one-way; others go both ways.
    """
    step = ways.select("way_id", "highway", F.col("oneway").cast("string").alias("oneway"), F.posexplode("refs").alias("i", "u"))
    pair = step.withColumn("v", F.lead("u").over(Window.partitionBy("way_id").orderBy("i"))).where("v IS NOT NULL")
    forward = pair.where("oneway IS NULL OR oneway <> '-1'").select("way_id", "u", "v", "highway")
    backward = pair.where("oneway IS NULL OR oneway IN ('-1', 'no')").select("way_id", F.col("v").alias("u"), F.col("u").alias("v"), "highway")
    known = nodes.select("node")
    edges = forward.unionByName(backward)
    return edges.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi").select("way_id", "u", "v", "highway")


def _integral(df: DataFrame, columns: list[str]) -> bool:
    kinds = dict(df.dtypes)
    return all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in columns)


def shortest_within(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node, cost): least costs from seeds (source, node, cost) over edges (u, v, cost), none above `limit`.

    Costs must not be negative. Seeds above the limit reach nothing. Edges with a null or infinite cost don't exist.
    """
    found = _searched(seeds, edges, limit, "cost")
    return _rounds(seeds, edges, limit) if found is None else found.select("source", "node", "cost")


def _searched(seeds: DataFrame, edges: DataFrame, limit: float, kind: str, targets: DataFrame | None = None) -> DataFrame | None:
    """search.searched() of edges (u, v, cost[, metres]) with the types that rounds give, or None if it can't hold the graph."""
    if not (_integral(seeds, ["source", "node"]) and _integral(edges, ["u", "v"]) and (targets is None or _integral(targets, ["node"]))):
        return None
    there = edges.where("cost IS NOT NULL AND cost < double('infinity')" + (" AND metres IS NOT NULL" if kind == "length" else ""))
    held = search.packed(there.select("u", "v", F.col("cost").alias("w"), (F.col("metres") if kind == "length" else F.lit(0.0)).alias("x")))
    if held is None:
        return None
    types = dict(edges.dtypes) | dict(seeds.dtypes)
    node = search.wider(types["node"], types["v"])
    return search.searched(seeds, held, limit, kind, targets).select(F.col("source").cast(types["source"]).alias("source"), F.col("node").cast(node).alias("node"), "cost", "metres", F.col("before").cast(types["u"]).alias("before"))


def _rounds(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    usable = durable(edges.where("cost IS NOT NULL AND cost < double('infinity')").select("u", "v", F.col("cost").alias("w")))
    best = durable(seeds.where(F.col("cost") <= limit).groupBy("source", "node").agg(F.min("cost").alias("cost")))
    frontier = best
    while True:
        step = frontier.join(usable, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        least = step.where(F.col("cost") <= limit).groupBy("source", "node").agg(F.min("cost").alias("new"))
        frontier = durable(least.join(best, ["source", "node"], "left").where("cost IS NULL OR new < cost").select("source", "node", F.col("new").alias("cost")))
        if frontier.isEmpty():
            return best
        best = durable(best.unionByName(frontier).groupBy("source", "node").agg(F.min("cost").alias("cost")))


def shortest_with_length(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node, cost, metres): shortest_within() with the metres along the path, of equally cheap paths the shortest's.

    `seeds`: (source, node, cost, metres), `edges`: (u, v, cost, metres), neither cost nor metres negative.
    """
    found = _searched(seeds, edges, limit, "length")
    return _rounds_with_length(seeds, edges, limit) if found is None else found.select("source", "node", "cost", "metres")


def _rounds_with_length(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    usable = durable(edges.where("cost IS NOT NULL AND cost < double('infinity') AND metres IS NOT NULL").select("u", "v", F.col("cost").alias("w"), F.col("metres").alias("m")))
    least = lambda d, name: d.where(F.col("cost") <= limit).groupBy("source", "node").agg(F.min(F.struct("cost", "metres")).alias(name))
    best = durable(least(seeds, "b"))
    frontier = best
    while True:
        step = frontier.join(usable, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("b.cost") + F.col("w")).alias("cost"), (F.col("b.metres") + F.col("m")).alias("metres"))
        frontier = durable(least(step, "new").join(best, ["source", "node"], "left").where("b IS NULL OR new < b").select("source", "node", F.col("new").alias("b")))
        if frontier.isEmpty():
            return best.select("source", "node", "b.cost", "b.metres")
        best = durable(best.unionByName(frontier).groupBy("source", "node").agg(F.min("b").alias("b")))


def shortest_paths(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, before): for each reached (source, node, cost) a node before it on a shortest path; null at the start.

    `reached` comes from shortest_within with the same edges (u, v, cost); of several the smallest is taken. Following
    `before` gives the path.
    """
    near = reached.select("source", F.col("node").alias("u"), F.col("cost").alias("c"))
    into = near.join(edges.select("u", "v", F.col("cost").alias("w")), "u").select("source", F.col("v").alias("node"), "u", (F.col("c") + F.col("w")).alias("total"), "w")
    tight = reached.join(into, ["source", "node"]).where("abs(total - cost) <= 1e-9 * (1 + abs(cost)) AND w > 0").groupBy("source", "node").agg(F.min("u").alias("before"))
    return reached.select("source", "node").join(tight, ["source", "node"], "left")


def shortest_steps(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node, before): shortest_paths() of what shortest_within() reaches, in one search where it can hold the graph."""
    found = _searched(seeds, edges, limit, "before")
    return shortest_paths(_rounds(seeds, edges, limit), edges) if found is None else found.select("source", "node", "before")


def path_nodes(steps: DataFrame, ends: DataFrame, most: int = 10_000) -> DataFrame:
    """(source, target, seq, node): the paths to the targets (source, target), followed back round by round; seq counts from the target.

    Tables of two rounds, then of four, and so on are written as one, so the plan has as many parts as the
    logarithm of the longest path.
    """
    at = durable(ends.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("seq")))
    parts = [(1, at)]
    known = durable(steps.where("before IS NOT NULL"))
    for _ in range(most):
        at = durable(at.join(known, ["source", "node"]).select("source", "target", F.col("before").alias("node"), (F.col("seq") + 1).alias("seq")))
        if at.isEmpty():
            out = parts[0][1]
            for _, part in parts[1:]:
                out = out.unionByName(part)
            return out
        parts.append((1, at))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (n, second), (_, first) = parts.pop(), parts.pop()
            parts.append((2 * n, durable(first.unionByName(second))))
    raise ValueError("a path is longer than the limit")


def either_way(pairs: DataFrame, edges: DataFrame, keep: str) -> DataFrame:
    """Pairs (u, v) with column `keep` of the edge from u to v, or else of the one from v to u, the smallest of parallel ones."""
    there = edges.groupBy("u", "v").agg(F.min(keep).alias("__a"))
    back = edges.groupBy(F.col("v").alias("u"), F.col("u").alias("v")).agg(F.min(keep).alias("__b"))
    return pairs.join(there, ["u", "v"], "left").join(back, ["u", "v"], "left").withColumn(keep, F.coalesce("__a", "__b")).drop("__a", "__b")


def path_midpoints(geometry: DataFrame) -> DataFrame:
    """(edge, lat, lon, points): mean of an edge's polyline (edge, points array of lat, lon); null for an empty one."""
    mean = lambda f: F.try_divide(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[f]), F.nullif(F.size("points"), F.lit(0)))
    return geometry.select("edge", mean("lat").alias("lat"), mean("lon").alias("lon"), "points")


def path_polylines(paths: DataFrame, geometry: DataFrame) -> DataFrame:
    """(path_id, points): the polylines of a path's edges (path_id, seq, edge) one behind the other; unknown edges are left out."""
    joined = paths.join(geometry.select("edge", "points"), "edge")
    ordered = joined.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("seq", "points"))).alias("p"))
    return ordered.select("path_id", F.flatten(F.col("p.points")).alias("points"))


def reachable_with_flag(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node, cost, only_flagged): least costs, and whether the node is reached only over flagged edges.

    `edges` have a boolean `flagged`; a node that a path without flagged edges reaches within the limit isn't
    only flagged.
    """
    every = shortest_within(seeds, edges, limit)
    plain = shortest_within(seeds, edges.where("NOT flagged"), limit).select("source", "node", F.lit(True).alias("__p"))
    return every.join(plain, ["source", "node"], "left").select("source", "node", "cost", F.col("__p").isNull().alias("only_flagged"))


def travel_matrix(sources: DataFrame, targets: DataFrame, edges: DataFrame, cutoff: float = 60.0) -> DataFrame:
    """(src, dst, minutes): least minutes from sources to the targets (node) that they reach by the cutoff.

    A source that is a target reaches itself in 0 minutes. A pair that isn't there is unreachable; see pair_times. If the
    edges have metres, so has the matrix: those along the quickest path.
    """
    lengths = "metres" in edges.columns
    start = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"), F.lit(0.0).alias("metres")).distinct()
    ways = edges.select("u", "v", F.col("minutes").alias("cost"), *(["metres"] if lengths else []))
    found = _searched(start, ways, cutoff, "length" if lengths else "cost", targets)
    if found is None:
        found = _rounds_with_length(start, ways, cutoff) if lengths else _rounds(start.drop("metres"), ways, cutoff)
        found = found.join(targets.select("node"), "node", "left_semi")
    return found.select(F.col("source").alias("src"), F.col("node").alias("dst"), F.col("cost").alias("minutes"), *(["metres"] if lengths else []))


def pair_times(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """The pairs (src, dst, ...) asked for with their minutes, +Infinity where the matrix has none."""
    return pairs.join(matrix.select("src", "dst", "minutes"), ["src", "dst"], "left").withColumn("minutes", F.coalesce("minutes", F.lit(float("inf"))))


def extend_matrix(matrix: DataFrame, sources: DataFrame, targets: DataFrame, edges: DataFrame, cutoff: float = 60.0) -> DataFrame:
    """A matrix with the rows of sources that it lacks; what it has isn't computed again."""
    missing = sources.join(matrix.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return matrix.select("src", "dst", "minutes").unionByName(travel_matrix(missing, targets, edges, cutoff))


def turn_aware_times(sources: DataFrame, edges: DataFrame, cutoff: float = 60.0) -> DataFrame:
    """(source, node, minutes) with turn penalties; U-turns are never taken.

    `edges`: (edge, u, v, minutes, bearing); a path's first edge has no turn. With integral nodes the turns are worked
    out inside the search, where a path meets them. Else it runs over the line graph: its nodes are edges, its edges the
    turns from one to the next, a table of edges times their successors.
    """
    usable = edges.where("minutes IS NOT NULL AND minutes < double('infinity')")
    if _integral(sources, ["node"]) and (held := search.packed(usable.select("u", "v", F.col("minutes").alias("w"), F.coalesce("bearing", F.lit(search.UNKNOWN)).alias("x")))):
        seeds = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
        kinds = dict(sources.dtypes) | dict(edges.dtypes)
        found = search.searched(seeds, held, cutoff, "turn")
        return found.select(F.col("source").cast(kinds["node"]).alias("source"), F.col("node").cast(search.wider(kinds["node"], kinds["v"])).alias("node"), F.col("cost").alias("minutes"))
    a = edges.select(F.col("edge").alias("u"), F.col("v").alias("via"), F.col("bearing").alias("b1"))
    b = edges.select(F.col("edge").alias("v"), F.col("u").alias("via"), F.col("bearing").alias("b2"), "minutes")
    turns = a.join(b, "via").withColumn("turn", turn_penalty("b1", "b2")).where("turn < 1000").select("u", "v", (F.col("minutes") + F.col("turn")).alias("cost"))
    seeds = sources.select(F.col("node").alias("u")).distinct().join(edges, "u").select(F.col("u").alias("source"), F.col("edge").alias("node"), F.col("minutes").alias("cost"))
    found = shortest_within(seeds, turns, cutoff).join(edges.select(F.col("edge").alias("node"), F.col("v").alias("at")), "node")
    own = sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.lit(0.0).alias("cost"))
    return found.select("source", "at", "cost").unionByName(own).groupBy("source", F.col("at").alias("node")).agg(F.min("cost").alias("minutes"))


def path_times(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, minutes): travel plus turn penalties along paths (path_id, seq, u, v); the cheapest of parallel edges."""
    cheapest = edges.groupBy("u", "v").agg(F.min_by(F.struct("minutes", "bearing"), "minutes").alias("e"))
    w = Window.partitionBy("path_id").orderBy("seq")
    along = paths.join(cheapest, ["u", "v"], "left").withColumn("turn", turn_penalty(F.lag("e.bearing").over(w), F.col("e.bearing")))
    return along.groupBy("path_id").agg(F.when(F.count_if(F.col("e.minutes").isNull()) == 0, F.sum(F.col("e.minutes") + F.col("turn"))).alias("minutes"))


def snapped_edges(edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Edges (u, v, metres) with homes put on them: a snap (edge, home, ratio) splits its edge and the reverse one.

    Ratios are held within [0.01, 0.99]; several homes of an edge split it in order. Edges carry `edge`, the
    same for both directions, and `forward`.
    """
    cuts = snaps.select("edge", "home", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("ratio"))).alias("ratio"))
    hit = edges.join(cuts.select("edge").distinct(), "edge", "left_semi")
    along = hit.join(cuts, "edge").select("edge", "forward", F.col("home").alias("node"), F.when(F.col("forward"), F.col("ratio")).otherwise(1 - F.col("ratio")).alias("at"), "metres")
    ends = hit.select("edge", "forward", F.col("u").alias("node"), F.lit(0.0).alias("at"), "metres").unionByName(hit.select("edge", "forward", F.col("v").alias("node"), F.lit(1.0).alias("at"), "metres"))
    w = Window.partitionBy("edge", "forward").orderBy("at", "node")
    parts = along.unionByName(ends).withColumn("v", F.lead("node").over(w)).withColumn("to", F.lead("at").over(w)).where("v IS NOT NULL")
    split = parts.select("edge", "forward", F.col("node").alias("u"), "v", ((F.col("to") - F.col("at")) * F.col("metres")).alias("metres"))
    return edges.join(cuts.select("edge").distinct(), "edge", "left_anti").select("edge", "forward", "u", "v", "metres").unionByName(split)


def allowed_crossings(edges: DataFrame, walkers: DataFrame, policy: DataFrame) -> DataFrame:
    """(student_id, edge): plain edges for everyone on the walk, synthetic ones only where the policy (key, road_class) has them.

    `edges`: (edge, student_id, synthetic, road_class) as met on walks; a class that is null or unknown is denied.
    """
    keyed = edges.join(walkers.select("student_id", F.col("policy_key").alias("key")), "student_id")
    plain = keyed.where("NOT synthetic").select("student_id", "edge")
    crossed = keyed.where("synthetic").join(small_side(policy), ["key", "road_class"], "left_semi").select("student_id", "edge")
    return plain.unionByName(crossed)


def nodes_only_touching(edges: DataFrame, bad: list[str]) -> DataFrame:
    """Nodes all of whose edges are of the given classes (a set difference by anti-join)."""
    ends = lambda d: d.select(F.col("u").alias("node")).unionByName(d.select(F.col("v").alias("node"))).distinct()
    return ends(edges.where(F.col("road_class").isin(*bad))).join(ends(edges.where(~F.col("road_class").isin(*bad) | F.col("road_class").isNull())), "node", "left_anti")


def safest_by_shortest_edge(edges: DataFrame) -> DataFrame:
    """(node, safe): the flag of a node's shortest edge at either end; ties go to unsafe."""
    ends = edges.select(F.col("u").alias("node"), "metres", "safe").unionByName(edges.select(F.col("v").alias("node"), "metres", "safe"))
    return ends.groupBy("node").agg(F.min_by("safe", F.struct("metres", "safe")).alias("safe"))


def with_bearings(edges: DataFrame) -> DataFrame:
    """Adds the planar bearing of edges with coordinates (lat1, lon1, lat2, lon2)."""
    return edges.withColumn("bearing", bearing_deg("lat1", "lon1", "lat2", "lon2"))


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, lo, hi) of the synthetic edges (u, v, synthetic) on paths (path_id, seq, node), once each, whichever way they are passed."""
    step = paths.withColumn("after", F.lead("node").over(Window.partitionBy("path_id").orderBy("seq"))).where("after IS NOT NULL")
    passed = step.select("path_id", F.least("node", "after").alias("lo"), F.greatest("node", "after").alias("hi")).distinct()
    return passed.join(edges.where("synthetic").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), ["lo", "hi"], "left_semi").select("path_id", "lo", "hi")


def last_bearings(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, bearing): the bearing of the last edge of each path (path_id, seq, u, v), of parallel ones the quickest's; null if it is unknown."""
    quickest = edges.groupBy("u", "v").agg(F.min_by("bearing", "minutes").alias("bearing"))
    last = paths.groupBy("path_id").agg(F.max_by(F.struct("u", "v"), "seq").alias("e")).select("path_id", "e.u", "e.v")
    return last.join(quickest, ["u", "v"], "left").select("path_id", "bearing")


def candidate_stops(homes: DataFrame, edges: DataFrame, policy: DataFrame, points: DataFrame, most: int = 15) -> DataFrame:
    """(student_id, node, walk_m, only_crossing, rank): the nodes that each student can walk to, the best first.

    `homes`: (student_id, node, lat, lon, radius, policy_key), `edges`: walk edges (u, v, metres, synthetic, road_class),
    `policy`: (key, road_class) of the crossings that a key may use, `points`: (node, lat, lon, points) of the nodes that a
    bus reaches. A student walks `radius` metres at most over plain edges and the crossings that its key may use;
    only_crossing says that no walk without one gets there. Of the nodes with points the best are kept: more points first,
    then the shorter walk, then the smaller node. A student with none gets the node nearest by air, at any distance, with
    null for only_crossing.

    The students of a policy key and a home share their search, so a search goes from homes, not from students.
    """
    from darb.operators.spatial import nearest

    keys = [r[0] for r in homes.select("policy_key").where("policy_key IS NOT NULL").distinct().limit(1001).collect()]
    if len(keys) > 1000:
        raise ValueError("too many policy keys")
    top = homes.agg(F.max("radius")).first()[0] or 0.0
    steps = edges.select("u", "v", F.col("metres").alias("cost"), "synthetic", "road_class")
    # each key's graph under names of its own, so that one search serves all keys
    name = lambda key, node: F.struct(key.alias("key"), node.alias("node"))
    kept = policy.where(F.col("key").isin(keys)).select("key", "road_class").distinct()
    every = F.explode(F.array(*map(F.lit, keys))) if keys else F.explode(F.array().cast("array<string>"))
    plain = steps.where("NOT synthetic").select("u", "v", "cost", F.lit(False).alias("flagged"), every.alias("key"))
    crossed = steps.where("synthetic").join(small_side(kept), "road_class").select("u", "v", "cost", F.lit(True).alias("flagged"), "key")
    graph_ = plain.unionByName(crossed).select(name(F.col("key"), F.col("u")).alias("u"), name(F.col("key"), F.col("v")).alias("v"), "cost", "flagged")
    starts = homes.where("node IS NOT NULL AND policy_key IS NOT NULL").select(name(F.col("policy_key"), F.col("node")).alias("node")).distinct().select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    reached = reachable_with_flag(starts, graph_, float(top)).select(F.col("source.key").alias("policy_key"), F.col("source.node").alias("home"), F.col("node.node").alias("node"), F.col("cost").alias("walk_m"), "only_flagged")
    met = homes.withColumnRenamed("node", "home").select("student_id", "home", "radius", "policy_key").join(reached, ["policy_key", "home"]).where(F.col("walk_m") <= F.col("radius"))
    best = Window.partitionBy("student_id").orderBy(F.desc("points"), "walk_m", "node")
    good = met.join(points.select("node", "points"), "node").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("student_id", "node", "walk_m", F.col("only_flagged").alias("only_crossing"), "rank")
    good = durable(good)
    lone = homes.join(good.select("student_id").distinct(), "student_id", "left_anti").select(F.col("student_id").alias("key"), "lat", "lon")
    far = nearest(lone, points.select(F.col("node").alias("target"), "lat", "lon")).select(F.col("key").alias("student_id"), F.col("target").alias("node"), F.col("metres").alias("walk_m"), F.lit(None).cast("boolean").alias("only_crossing"), F.lit(1).alias("rank"))
    return good.unionByName(far)


def reach_counters(reached: DataFrame) -> DataFrame:
    """(source, reached, by_crossing_only, farthest) of reachable_with_flag()'s rows."""
    return reached.groupBy("source").agg(F.count("*").alias("reached"), F.count_if("only_flagged").alias("by_crossing_only"), F.max("cost").alias("farthest"))


def counters_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counters (key, value) of two moments: (key, delta), never below 0; a counter that one lacks counts as 0 there."""
    joined = before.select(key, F.col("value").alias("__a")).join(after.select(key, F.col("value").alias("__b")), key, "full_outer")
    zero = F.lit(0)
    return joined.select(key, F.greatest(zero, F.coalesce("__b", zero) - F.coalesce("__a", zero)).alias("delta"))


def display_segments(edges: DataFrame, lat: float, lon: float, least_m: float = 20.0, within_m: float = 5000.0) -> DataFrame:
    """(lo, hi, metres, road_class): undirected edges worth drawing: of a dangerous or unknown class, long enough and with their start near a point.

    `edges`: (u, v, metres, road_class, lat, lon); of parallel ones the shortest counts.
    """
    from darb.functions.geo import haversine_m
    from darb.functions.scalars import dangerous_road

    near = edges.where((F.col("metres") >= least_m) & (F.col("road_class").isNull() | dangerous_road("road_class")) & (haversine_m("lat", "lon", lat, lon) <= within_m))
    best = near.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min(F.struct("metres", "road_class")).alias("e"))
    return best.select("lo", "hi", "e.*")
