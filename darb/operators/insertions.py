"""Every position of every route for a set of nodes: cheapest insertions, feasible ones, regrets.

The nodes (stops that students could board at) are a query set, which is taken in blocks of at most NODE_BLOCK
against all routes. A route is one row with its stops in order and the minutes of its legs both ways; rows go
through Arrow batches, in which legs meet the block's nodes as arrays. A task keeps its best position or its least
costs for each node and gives them out once, so what is shuffled is tasks x nodes, never a position. What a position
costs depends on the node, not on the student, so students take over the sums of their nodes by a join.

Minutes between any two nodes come from a function of two arrays of nodes (infinite if unreachable). A ClassedPrice,
whose minutes depend on classes of the nodes, is worked out by class instead of by node; see `classed`. Where minutes exist as a table only, `routes.insertion_costs` joins it.

Who may be put where: a student rides at most its cap. With rule 'am' the morning ride counts, with 'either' the
morning ride or the ride back on the route run backwards (the default), with 'both' the two of them. Riders who
board before the new stop ride longer both ways and must keep their own caps by the same rule; later riders don't
notice. Caps are kept up to SLACK minutes, as sums of minutes are rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from darb.operators.classed import ClassedPrice, best_by_class, cheapest_by_class, with_kinds
from darb.session import durable, shuffle_partitions

NODE_BLOCK, PRICES, CELLS, SLACK = 200_000, 2_000_000, 250_000, 1e-9
#: By classes of nodes only with so many different caps at most, which are columns of a histogram.
CLASSED_CAPS = 64
Price = Callable[[np.ndarray, np.ndarray], np.ndarray]


def route_rows(legs: DataFrame, cap: Column | None = None, seats: DataFrame | None = None, budgets: DataFrame | None = None) -> DataFrame:
    """(route_id, nodes, minutes, back, caps, seqs, most): one row per route of its legs (route_id, seq, src, dst, minutes[, back_min]).

    `cap` is the cap of whoever boards at the leg's start (null: nobody, or no cap), `seats`: (route_id, load,
    capacity), by which full routes are left out; a route that it lacks has no seats. `budgets`: (route_id, most), the
    minutes that a route may still grow by; a route that it lacks has no limit.
    """
    back = F.col("back_min") if "back_min" in legs.columns else F.lit(None).cast("double")
    leg = F.struct("seq", "src", "dst", F.col("minutes").cast("double").alias("m"), back.alias("b"), (cap if cap is not None else F.lit(None)).cast("double").alias("c"))
    # a fixed number of partitions: little data, but much work for each row, so they mustn't be put together by size
    spread = legs.repartition(shuffle_partitions(legs.sparkSession), "route_id")
    rows = spread.groupBy("route_id").agg(F.array_sort(F.collect_list(leg)).alias("l"))
    nodes = F.concat(F.col("l.src"), F.array(F.element_at("l", -1)["dst"])).cast("array<bigint>")
    out = rows.select("route_id", nodes.alias("nodes"), F.col("l.m").alias("minutes"), F.col("l.b").alias("back"), F.col("l.c").alias("caps"), F.col("l.seq").alias("seqs"))
    if seats is not None:
        out = out.join(seats.where("load < capacity").select("route_id"), "route_id", "left_semi")
    if budgets is None:
        return out.withColumn("most", F.lit(float("inf")))
    return out.join(budgets.select("route_id", F.col("most").cast("double").alias("most")), "route_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))


class _Legs:
    """The legs of a batch of routes as arrays, in order of routes and positions."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
        n = batch.num_rows
        lengths = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(lengths.max(initial=0))
        live = np.arange(width) < lengths[:, None]

        def pad(i: int, fill: float, at: np.ndarray = live) -> np.ndarray:
            out = np.full(at.shape, fill)
            out[at] = batch.column(i).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
            return out

        self.ids = batch.column(0).to_pylist()
        minutes, back = pad(2, np.nan), pad(3, np.nan)  # unknown legs are NaN, which no comparison passes
        caps = pad(4, np.inf)
        nodes = np.zeros((n, width + 1), np.int64)
        nodes[np.arange(width + 1) < (lengths + (lengths > 0))[:, None]] = pc.fill_null(batch.column(1).flatten(), 0).to_numpy(zero_copy_only=False)
        suffix = lambda x: np.cumsum(np.where(live, x, 0.0)[:, ::-1], axis=1)[:, ::-1]
        self.morning, evening = suffix(minutes), suffix(back)
        after = lambda x: np.concatenate([x[:, 1:], np.zeros((n, 1))], axis=1)  # noqa: E731  the ride from the leg's end on
        self.route, self.position = np.nonzero(live & np.isfinite(minutes))
        pick = lambda x: x[self.route, self.position]
        self.seq = pick(pad(5, 0.0)).astype(np.int64)
        self.src, self.dst, self.uv = nodes[self.route, self.position], nodes[self.route, self.position + 1], pick(minutes)
        self.rest, self.rest_back = pick(after(self.morning)), pick(after(evening))
        self.back, self.caps = back, caps
        self.most = batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64)

    def riders(self, legs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which of the legs, the minutes left of a rider's cap in the morning, and on the way back but for what lies between the leg's end and start).

        One after the other the stops from the route's first to the leg's start; a route's length bounds them.
        """
        position, route = self.position[legs], self.route[legs]
        for stop in range(int(position.max(initial=-1)) + 1):
            on = np.flatnonzero((position >= stop) & np.isfinite(self.caps[route, stop]))
            if len(on):
                cap = self.caps[route[on], stop]
                # on the way back: from the leg's start to this stop, leg by leg
                along = np.concatenate([np.zeros((len(self.back), 1)), np.cumsum(self.back[:, stop:], axis=1)], axis=1)
                yield on, cap - self.morning[route[on], stop], cap - along[route[on], position[on] - stop]


class _Prices:
    """Minutes between the ends of a batch's legs and some nodes, each distinct pair priced once: rows are nodes, columns legs."""

    def __init__(self, legs: _Legs, price: Price):
        self.legs, self.price = legs, price
        self.src, self.of_src = np.unique(legs.src, return_inverse=True)
        self.dst, self.of_dst = np.unique(legs.dst, return_inverse=True)

    def node_blocks(self, nodes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of the nodes in which a table of prices stays small."""
        size = max(1, PRICES // max(1, len(self.src), len(self.dst)))
        for start in range(0, len(nodes), size):
            yield start, min(len(nodes), start + size)

    def at(self, nodes: np.ndarray) -> None:
        near = nodes[:, None]
        self.to, self.onward = self.price(self.src[None, :], near), self.price(near, self.dst[None, :])
        self.back_to, self.back_on = None, None

    def delta(self, part: slice) -> np.ndarray:
        out = self.to[:, self.of_src[part]]
        out += self.onward[:, self.of_dst[part]]
        out -= self.legs.uv[part]
        return out

    def backwards(self, nodes: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """From the leg's end to the node, and from there to the leg's start."""
        if self.back_to is None:
            self.back_to, self.back_on = self.price(self.dst[None, :], nodes[:, None]), self.price(nodes[:, None], self.src[None, :])
        return self.back_to[:, self.of_dst[part]], self.back_on[:, self.of_src[part]]


def _parts(legs: _Legs, width: int, whole_routes: bool = False) -> Iterator[slice]:
    """Runs of legs with about CELLS cells; a route isn't cut if `whole_routes`."""
    size, n, start = max(1, CELLS // max(1, width)), len(legs.uv), 0
    while start < n:
        end = min(n, start + size)
        if whole_routes:
            while end < n and legs.route[end] == legs.route[end - 1]:
                end += 1
        yield slice(start, end)
        start = end


def _best(nodes: np.ndarray, caps: np.ndarray, price: Price, rule: str):
    """Per (node, cap): how many positions keep all caps, and the cheapest with its place (ties: the first route and seq)."""
    names, where = np.unique(nodes, return_inverse=True)
    by_cap = [(c, items[np.argsort(where[items], kind="stable")]) for c in np.unique(caps) for items in [np.flatnonzero(caps == c)]]

    def kept_by(legs: _Legs, prices: _Prices, block: np.ndarray, part: slice, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minutes of each position at which nobody else's cap breaks (else infinite), and the ride of whoever boards there."""
        ride = prices.onward[:, prices.of_dst[part]] + legs.rest[part]
        fits = np.ones(delta.shape, bool)
        if rule != "am":
            evening, detour = prices.backwards(block, part)
            evening += legs.rest_back[part]
            detour += evening
            ride = np.fmin(ride, evening) if rule == "either" else np.maximum(ride, evening)
        for on, left, left_back in legs.riders(np.arange(part.start, part.stop)):
            kept = delta[:, on] <= left + SLACK
            if rule != "am":
                kept_back = detour[:, on] <= left_back + SLACK
                kept = kept | kept_back if rule == "either" else kept & kept_back
            fits[:, on] &= kept
        return np.where(fits, delta, np.inf), ride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, least = np.zeros(len(nodes), np.int64), np.full(len(nodes), np.inf)
        routes, seqs = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for batch in batches:
            legs = _Legs(batch)
            ids, prices = np.array(legs.ids, np.int64), _Prices(legs, price)
            for start, end in prices.node_blocks(names):
                block = names[start:end]
                prices.at(block)
                of_cap = [(c, items[np.searchsorted(where[items], start) : np.searchsorted(where[items], end)]) for c, items in by_cap]
                for part in _parts(legs, end - start):
                    cost, ride = prices.delta(part), None
                    if rule != "free":
                        cost, ride = kept_by(legs, prices, block, part, cost)
                    most = legs.most[legs.route[part]]
                    if np.isfinite(most).any():
                        cost = np.where(cost <= most + SLACK, cost, np.inf)
                    for cap, items in of_cap:
                        if not len(items):
                            continue
                        at = where[items] - start
                        own = cost if len(at) == end - start else cost[at]
                        if ride is not None:
                            own = np.where((ride if own is cost else ride[at]) <= cap + SLACK, own, np.inf)
                        options[items] += np.count_nonzero(own < np.inf, axis=1)
                        first = own.argmin(axis=1)
                        value = own[np.arange(len(at)), first]
                        route, seq = ids[legs.route[part][first]], legs.seq[part][first]
                        old = least[items]
                        better = (value < old) | (value == old) & np.isfinite(value) & ((route < routes[items]) | (route == routes[items]) & (seq < seqs[items]))
                        chosen = items[better]
                        least[chosen], routes[chosen], seqs[chosen] = value[better], route[better], seq[better]
        some = options > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[some], pa.int64()), pa.array(caps[some], pa.float64()), pa.array(options[some], pa.int64()), pa.array(least[some], pa.float64()), pa.array(routes[some], pa.int64()), pa.array(seqs[some], pa.int64())],
            names=["node_id", "cap_min", "options", "delta", "route_id", "seq"],
        )

    return run


def _cheapest_routes(nodes: np.ndarray, price: Price, k: int):
    """Per node the k cheapest routes of a task; it has whole routes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, route = np.full((len(nodes), k), np.inf), np.zeros((len(nodes), k), np.int64)
        for batch in batches:
            legs = _Legs(batch)
            ids, prices = np.array(legs.ids, np.int64), _Prices(legs, price)
            for start, end in prices.node_blocks(nodes):
                prices.at(nodes[start:end])
                for part in _parts(legs, end - start, True):
                    begins = np.flatnonzero(np.diff(legs.route[part], prepend=-1))
                    each = np.concatenate([cost[start:end], np.minimum.reduceat(prices.delta(part), begins, axis=1)], axis=1)
                    names = np.concatenate([route[start:end], np.broadcast_to(ids[legs.route[part][begins]], (end - start, len(begins)))], axis=1)
                    first = np.argpartition(each, k - 1, axis=1)[:, :k]
                    cost[start:end], route[start:end] = np.take_along_axis(each, first, axis=1), np.take_along_axis(names, first, axis=1)
        some = np.isfinite(cost)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(nodes[:, None], cost.shape)[some], pa.int64()), pa.array(route[some], pa.int64()), pa.array(cost[some], pa.float64())], names=["node_id", "route_id", "delta"])

    return run


def _in_blocks(items: DataFrame, columns: list[str], rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Union of `make`'s pass over all routes for each block of at most about NODE_BLOCK items."""
    items = durable(items)
    blocks = max(1, -(-items.count() // NODE_BLOCK))
    if blocks > 1:
        rows = durable(rows)
    out = None
    for block in range(blocks):
        found = items.where(F.pmod(F.xxhash64(*columns), F.lit(blocks)) == block).orderBy(*columns).collect()  # about NODE_BLOCK
        part = rows.mapInArrow(make([np.array([r[c] for r in found]) for c in columns]), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _named(items: DataFrame, price: ClassedPrice) -> tuple[DataFrame, np.ndarray] | None:
    """`items` (node_id, ...) with the kind of each node, and the kinds there are; None if those are no fewer than a block."""
    named = durable(items.mapInArrow(with_kinds(price, 0), StructType([*items.schema.fields, StructField("kind", LongType())])))
    kinds = named.select("kind").distinct().limit(NODE_BLOCK + 1).toPandas()["kind"].to_numpy(np.int64)
    return (named, np.sort(kinds)) if len(kinds) <= NODE_BLOCK else None


def _few_tasks(rows: DataFrame) -> DataFrame:
    """A task gives out a row for each kind, so there are only as many as keep all cores busy."""
    return rows.coalesce(max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def _best_classed(rows: DataFrame, items: DataFrame, price: ClassedPrice, rule: str) -> DataFrame | None:
    if (found := _named(items, price)) is None:
        return None
    named, kinds = found
    caps = [r[0] for r in named.where("NOT isnan(cap_min)").select("cap_min").distinct().limit(CLASSED_CAPS + 1).collect()]
    if len(caps) > CLASSED_CAPS:
        return None
    schema = "kind bigint, cap_min double, options bigint, delta double, route_id bigint, seq bigint"
    each = _few_tasks(rows).mapInArrow(best_by_class(kinds, np.sort(np.array(caps, np.float64)), price, rule, _Legs, SLACK), schema)
    best = each.groupBy("kind", "cap_min").agg(F.sum("options").alias("options"), F.min(F.struct("delta", "route_id", "seq")).alias("b"))
    return named.join(best, ["kind", "cap_min"]).select("node_id", "cap_min", "options", "b.*")


def _cheapest_classed(rows: DataFrame, nodes: DataFrame, price: ClassedPrice, k: int) -> DataFrame | None:
    """(node_id, route_id, delta) of the k cheapest routes of each node."""
    if (found := _named(nodes, price)) is None:
        return None
    named, kinds = found
    each = _few_tasks(rows).mapInArrow(cheapest_by_class(kinds, price, k, _Legs), "kind bigint, route_id bigint, delta double")
    first = each.withColumn("__n", F.row_number().over(Window.partitionBy("kind").orderBy("delta", "route_id"))).where(F.col("__n") <= k)
    return named.join(first, "kind").select("node_id", "route_id", "delta")


def best_positions(rows: DataFrame, items: DataFrame, price: Price, rule: str = "either") -> DataFrame:
    """(node_id, cap_min, options, delta, route_id, seq) of each (node_id, cap_min) of `items` that fits anywhere in route_rows.

    `options`: how many positions of all routes keep the caps by `rule` ('am', 'either', 'both', or 'free' for none), the
    others: the cheapest, of equal ones the first by (route_id, seq). Positions with an unreachable or unknown leg
    don't count. Nothing comes out for no routes or items. A route without legs has no positions.
    """
    schema = "node_id bigint, cap_min double, options bigint, delta double, route_id bigint, seq bigint"
    usable = items.where("node_id IS NOT NULL AND cap_min IS NOT NULL").select(F.col("node_id").cast("bigint").alias("node_id"), F.col("cap_min").cast("double").alias("cap_min")).distinct()
    if isinstance(price, ClassedPrice):
        classed = _best_classed(rows.where("route_id IS NOT NULL"), usable, price, rule)
        if classed is not None:
            return classed
    found = _in_blocks(usable, ["node_id", "cap_min"], rows.where("route_id IS NOT NULL"), lambda c: _best(c[0].astype(np.int64), c[1].astype(np.float64), price, rule), schema)
    best = F.min(F.struct("delta", "route_id", "seq")).alias("b")
    return found.groupBy("node_id", "cap_min").agg(F.sum("options").alias("options"), best).select("node_id", "cap_min", "options", "b.*")


def student_insertions(positions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(student_id, node_id, options, delta, route_id, seq[, extra]): each student's candidates (student_id, node_id, cap_min, ...) with their positions."""
    return candidates.join(positions, ["node_id", "cap_min"]).drop("cap_min")


def cheapest_routes(rows: DataFrame, candidates: DataFrame, price: Price, k: int = 2) -> DataFrame:
    """(student_id, route_id, delta) of at least the k cheapest routes of each student among all routes, for routes.regret().

    Each node of a student keeps its k cheapest routes; the student's are among those.
    """
    nodes = candidates.where("node_id IS NOT NULL").select(F.col("node_id").cast("bigint").alias("node_id")).distinct()
    rows = rows.where("route_id IS NOT NULL")
    found = _cheapest_classed(rows, nodes, price, k) if isinstance(price, ClassedPrice) else None
    if found is None:
        found = _in_blocks(nodes, ["node_id"], rows, lambda c: _cheapest_routes(c[0].astype(np.int64), price, k), "node_id bigint, route_id bigint, delta double")
    return candidates.join(found, "node_id").select("student_id", "route_id", "delta")
