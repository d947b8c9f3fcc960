"""Searches of many sources, each made whole in one task that holds the graph as arrays.

What rounds of joins would write, sources times edges a round or all turns of a junction, never exists as rows: a
task's labels are one array over the nodes (or edges) at a time, and only results leave it. The graph goes out packed, a
copy a task, so it is for graphs with up to EDGES edges and integral ids; `graph` keeps its rounds for the others.

Labels are corrected bucket by bucket in order of cost. With buckets as wide as the least cost of an edge a node is
settled when its bucket is reached; with smaller costs it may be looked at again. Costs are sums along the path in its
order, as in the rounds, so both give the same numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darb.session import durable

#: Edges that a task holds (about 8 to 20 bytes each), and edges that are looked at in one go.
EDGES, STEP = 40_000_000, 1_000_000
#: Turns as in scalars.turn_penalty, and what stands for an unknown bearing.
SHARP, U_TURN, TURN_MIN, UNKNOWN = 45.0, 140.0, 0.2, -1e300
_INTEGRAL = ["tinyint", "smallint", "int", "bigint"]
_SLACK = 1e-9


class Graph:
    """Edges by their start and sorted by cost: those of node k are at start[k] to start[k + 1]. `ids` are sorted."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32))
        parts = sorted(parts or [empty], key=lambda p: int(p[0][0]) if len(p[0]) else 0)
        heads, degrees = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.ids = np.unique(np.concatenate([heads, *(np.unique(p[2]) for p in parts)]))
        n, total = len(self.ids), int(degrees.sum())
        of = np.searchsorted(self.ids, heads)
        count = np.zeros(n, np.int64)
        count[of] = degrees
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.dst = np.empty(total, np.int32)
        self.w = np.empty(total, np.float32 if all(p[3].dtype == np.float32 for p in parts) else np.float64)
        self.x = np.empty(total, np.float32 if all(p[4].dtype == np.float32 for p in parts) else np.float64)
        at = 0
        while parts:
            _, degree, v, w, x = parts.pop(0)
            begin = self.start[of[at : at + len(degree)]]
            where = np.repeat(begin - np.concatenate([[0], np.cumsum(degree)[:-1]]), degree) + np.arange(len(v)) if len(v) else np.empty(0, np.int64)
            self.dst[where], self.w[where], self.x[where] = np.searchsorted(self.ids, v), w, x
            at += len(degree)
        self.least = float(self.w.min()) if total else 0.0

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of nodes, -1 for those without edges."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def width(self, limit: float) -> float:
        return max(self.least, limit / 256, 1e-12)

    def out(self, nodes: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in `nodes`, edges) of the edges with costs up to `most`, in pieces."""
        low, high = self.start[nodes], self.start[nodes + 1]
        begin = low
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            inside = open_ & (self.w[np.where(open_, middle, 0)] <= most)
            low, high = np.where(inside, middle + 1, low), np.where(open_ & ~inside, middle, high)
        lengths = low - begin
        ends = np.cumsum(lengths)
        at = 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            size = lengths[at:to]
            if total := int(size.sum()):
                rows = np.repeat(np.arange(at, to), size)
                yield rows, np.repeat(begin[at:to] - (np.cumsum(size) - size), size) + np.arange(total)
            at = to


def _ordered(label: np.ndarray, pending: np.ndarray, width: float) -> Iterator[np.ndarray]:
    """Pending nodes, those of the lowest bucket first, until there are none."""
    while len(waiting := np.flatnonzero(pending)):
        cost = label[waiting]
        now = waiting[cost <= cost.min() + width * (1 - _SLACK)]
        pending[now] = False
        yield now


def least_costs(g: Graph, nodes: np.ndarray, costs: np.ndarray, limit: float) -> np.ndarray:
    """Least costs of all nodes from seeds, infinite beyond the limit."""
    label, pending = np.full(len(g.ids), np.inf), np.zeros(len(g.ids), bool)
    np.minimum.at(label, nodes, costs)
    pending[nodes] = True
    for now in _ordered(label, pending, g.width(limit)):
        cost = label[now]
        most = min(limit, float(label.max())) - cost  # no dearer edge helps any node
        for rows, edges in g.out(now, most + _SLACK * (1 + limit)):
            to, new = g.dst[edges].astype(np.int64), cost[rows] + g.w[edges].astype(np.float64)
            better = (new <= limit) & (new < label[to])
            to = to[better]
            np.minimum.at(label, to, new[better])
            pending[to] = True
    return label


def least_lengths(g: Graph, label: np.ndarray, nodes: np.ndarray, costs: np.ndarray, metres: np.ndarray, limit: float) -> np.ndarray:
    """Least metres (the edges' x) among the paths of least cost."""
    out, pending = np.full(len(g.ids), np.inf), np.zeros(len(g.ids), bool)
    own = costs == label[nodes]
    np.minimum.at(out, nodes[own], metres[own])
    pending[nodes[own]] = True
    reached = label[label < np.inf]
    top = float(reached.max()) if len(reached) else 0.0
    for now in _ordered(label, pending, g.width(limit)):
        cost, length = label[now], out[now]
        for rows, edges in g.out(now, top - cost + _SLACK * (1 + limit)):
            to = g.dst[edges].astype(np.int64)
            tight = cost[rows] + g.w[edges].astype(np.float64) == label[to]
            rows, edges, to = rows[tight], edges[tight], to[tight]
            new = length[rows] + g.x[edges].astype(np.float64)
            better = new < out[to]
            to = to[better]
            np.minimum.at(out, to, new[better])
            pending[to] = True
    return out


def nodes_before(g: Graph, label: np.ndarray, limit: float) -> np.ndarray:
    """The smallest node before each on a path of least cost, by graph.shortest_paths' rule; len(ids) for none."""
    out = np.full(len(g.ids), len(g.ids), np.int64)
    now = np.flatnonzero(label < np.inf)
    if len(now):
        cost = label[now]
        top = float(cost.max())
        for rows, edges in g.out(now, top - cost + 2 * _SLACK * (1 + limit)):
            to, w = g.dst[edges].astype(np.int64), g.w[edges].astype(np.float64)
            goal = label[to]
            with np.errstate(invalid="ignore"):
                tight = (np.abs(cost[rows] + w - goal) <= 1e-9 * (1 + np.abs(goal))) & (w > 0) & (goal < np.inf)
            np.minimum.at(out, to[tight], now[rows[tight]])
    return out


class Turns:
    """Least minutes with turn penalties; labels are of edges, x is their bearing.

    An arrival at a node matters only while some edge out of it could be reached cheaper: until every way out has a
    label that a turn from it can't beat. So of a junction's arrivals a few are looked at, not each with each way out.
    """

    def __init__(self, g: Graph):
        self.g, self.label, self.done = g, np.full(len(g.dst), np.inf), np.full(len(g.dst), np.inf)
        self.need = np.full(len(g.ids), np.inf)

    def minutes(self, source: int, limit: float) -> np.ndarray:
        g, width, buckets, touched, seen = self.g, self.g.width(limit), {}, [], []

        def reach(edges: np.ndarray) -> None:
            touched.append(edges)
            edges = edges[self.label[edges] < self.need[g.dst[edges]]]  # others help nothing where they arrive
            key = np.floor(self.label[edges] / width).astype(np.int64)
            order = np.argsort(key, kind="stable")
            keys, begin = np.unique(key[order], return_index=True)
            for k, part in zip(keys.tolist(), np.split(edges[order], begin[1:])):
                buckets.setdefault(k, []).append(part)

        for _, edges in g.out(np.array([source]), np.array([limit])):
            edges = edges[g.w[edges] <= limit]
            self.label[edges] = g.w[edges]
            reach(edges)
        while buckets:
            edges = np.sort(np.concatenate(buckets.pop(min(buckets))))
            edges = edges[np.append(True, edges[1:] != edges[:-1])] if len(edges) else edges
            edges = edges[(self.label[edges] < self.done[edges]) & (self.label[edges] < self.need[g.dst[edges]])]
            at, cost = g.dst[edges].astype(np.int64), self.label[edges]
            self.done[edges] = cost
            order = np.lexsort((cost, at))
            edges, at, cost = edges[order], at[order], cost[order]
            places, cur = np.unique(at, return_index=True)
            end = np.append(cur[1:], len(at))
            seen.append(places)
            while True:  # the cheapest arrival of each node, then the next as far as it matters
                on = cur < end
                on[on] = cost[cur[on]] < self.need[places[on]]
                if not on.any():
                    break
                places, cur, end = places[on], cur[on], end[on]
                self._pass(edges[cur], places, cost[cur], limit, reach)
                cur = cur + 1
        out = np.full(len(g.ids), np.inf)
        if touched:
            edges = np.concatenate(touched)
            np.minimum.at(out, g.dst[edges].astype(np.int64), self.label[edges])
            self.label[edges] = self.done[edges] = np.inf
        for places in seen:
            self.need[places] = np.inf
        return out

    def _pass(self, arrived: np.ndarray, nodes: np.ndarray, cost: np.ndarray, limit: float, reach: Callable) -> None:
        g, bearing = self.g, self.g.x[arrived].astype(np.float64)
        need = np.full(len(nodes), -np.inf)
        for rows, edges in g.out(nodes, limit - cost + _SLACK * (1 + limit)):
            b1, b2, w = bearing[rows], g.x[edges].astype(np.float64), g.w[edges].astype(np.float64)
            with np.errstate(invalid="ignore"):
                d = np.abs(np.mod(b1 - b2 + 180.0, 360.0) - 180.0)
                turn = np.where((b1 == UNKNOWN) | (b2 == UNKNOWN) | (d <= SHARP), 0.0, np.where(d <= U_TURN, TURN_MIN, np.inf))
            new = cost[rows] + (w + turn)
            better = (new <= limit) & (new < self.label[edges])
            self.label[edges[better]] = new[better]
            reach(edges[better])
            fits = cost[rows] + w <= limit
            np.maximum.at(need, rows[fits], self.label[edges[fits]] - w[fits])
        self.need[nodes] = need


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values as float32 if that loses nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = values.astype(np.float32)
    return small if np.array_equal(small.astype(np.float64), values) else values


def _bytes(values: np.ndarray) -> bytes:
    return values.dtype.str.encode() + b":" + zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _values(data: bytes) -> np.ndarray:
    kind, _, rest = data.partition(b":")
    return np.frombuffer(zlib.decompress(rest), kind.decode())


_PACKED = "n bigint, u binary, degree binary, v binary, w binary, x binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        lists, u = b.column("e"), b.column("u").to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        v, w, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("v", "w", "x"))
        degree = np.diff(lists.offsets.to_numpy())
        by = np.argsort(u, kind="stable")
        order = np.lexsort((w, np.repeat(u, degree)))
        v = v[order]
        if len(v) and -(2**31) <= v.min() and v.max() < 2**31:
            v = v.astype(np.int32)
        row = {"n": len(v), "u": _bytes(u[by]), "degree": _bytes(degree[by].astype(np.int64)), "v": _bytes(v), "w": _bytes(_narrow(w[order])), "x": _bytes(_narrow(x[order]))}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("u", "degree", "v", "w", "x"))]))


def packed(edges: DataFrame) -> DataFrame | None:
    """Edges (u, v, w, x) as few rows with arrays, or None if they are too many or ids aren't integral."""
    if any(t not in _INTEGRAL for c, t in edges.dtypes if c in "uv"):
        return None
    rows = edges.select(F.col("u").cast("bigint").alias("u"), F.struct(F.col("v").cast("bigint").alias("v"), F.col("w").cast("double").alias("w"), F.col("x").cast("double").alias("x")).alias("e")).where("u IS NOT NULL AND e.v IS NOT NULL")
    out = durable(rows.groupBy("u").agg(F.collect_list("e").alias("e")).mapInArrow(_pack, _PACKED))
    return out if (out.agg(F.sum("n")).first()[0] or 0) <= EDGES else None


def searched(seeds: DataFrame, graph: DataFrame, limit: float, kind: str, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, cost, metres, before) of seeds (source, node, cost, metres) over a packed graph, of integral ids as bigint.

    `kind`: 'cost', 'length' (with metres, which are the edges' x), 'before' (with the node before) or 'turn' (costs with
    turns, seeds cost nothing). With `targets` (node) only those come out.
    """
    spark = seeds.sparkSession
    long = lambda c: F.col(c).cast("bigint").alias(c)
    starts = durable(seeds.where(F.col("cost") <= limit).select(long("source"), long("node"), F.col("cost").cast("double").alias("cost"), (F.col("metres").cast("double") if "metres" in seeds.columns else F.lit(0.0)).alias("metres")).where("source IS NOT NULL AND node IS NOT NULL").distinct())
    blocks = max(1, min(spark.sparkContext.defaultParallelism, starts.select("source").distinct().count()))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    rows = graph.select("*", F.lit(0).alias("kind"), every)
    if targets is not None:
        rows = rows.unionByName(targets.select(long("node")).where("node IS NOT NULL").distinct().select("node", F.lit(1).alias("kind"), every), allowMissingColumns=True)
    rows = rows.unionByName(starts.select("*", F.lit(2).alias("kind"), F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")), allowMissingColumns=True)
    sent = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "source")
    some = targets is not None

    def answers(g: Graph, turns: Turns | None, wanted: np.ndarray | None, source: int, nodes: np.ndarray, costs: np.ndarray, metres: np.ndarray) -> pa.RecordBatch:
        at = g.index(nodes)
        known = at >= 0
        lone = {}
        for node, cost, m in zip(nodes[~known].tolist(), costs[~known].tolist(), metres[~known].tolist()):  # seeds without edges
            lone[node] = min(lone.get(node, (np.inf, np.inf)), (cost, m))
        at, costs, metres = at[known], costs[known], metres[known]
        if turns is not None:
            label = np.full(len(g.ids), np.inf)
            for k in at.tolist():
                np.minimum(label, turns.minutes(k, limit), out=label)
            label[at] = 0.0
        else:
            label = least_costs(g, at, costs, limit)
        show = np.flatnonzero(label < np.inf)
        if wanted is not None:
            show = show[np.isin(g.ids[show], wanted, assume_unique=True)]
            lone = {k: v for k, v in lone.items() if k in set(wanted.tolist())}
        length = least_lengths(g, label, at, costs, metres, limit) if kind == "length" else None
        before = nodes_before(g, label, limit)[show] if kind == "before" else None
        more = len(lone)
        out = {"source": pa.array(np.full(len(show) + more, source, np.int64)), "node": pa.array(np.concatenate([g.ids[show], np.array(list(lone), np.int64)]))}
        out["cost"] = pa.array(np.concatenate([label[show], np.array([c for c, _ in lone.values()], float)]))
        out["metres"] = pa.nulls(len(show) + more, pa.float64()) if length is None else pa.array(np.concatenate([length[show], np.array([m for _, m in lone.values()], float)]))
        if before is None:
            out["before"] = pa.nulls(len(show) + more, pa.int64())
        else:
            none = before >= len(g.ids)
            out["before"] = pa.array(np.concatenate([g.ids[np.where(none, 0, before)] if len(before) else before, np.zeros(more, np.int64)]), mask=np.concatenate([none, np.ones(more, bool)]))
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, wanted, g, turns, block = [], [], None, None, None
        held: tuple | None = None  # seeds of the source that isn't complete yet
        sort_key = lambda b: (b.column("block").to_numpy(zero_copy_only=False), b.column("kind").to_numpy(zero_copy_only=False))
        for b in batches:
            if not b.num_rows:
                continue
            blocks_, kinds = sort_key(b)
            cuts = [0, *(np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if blocks_[i] != block:
                    if held:
                        yield answers(g, turns, wanted, *held)
                    parts, wanted, g, turns, held, block = [], [], None, None, None, blocks_[i]
                piece = b.slice(i, j - i)
                if kinds[i] == 0:
                    parts += [tuple(_values(r[c]) for c in ("u", "degree", "v", "w", "x")) for r in piece.select(["u", "degree", "v", "w", "x"]).to_pylist()]
                elif kinds[i] == 1:
                    wanted.append(piece.column("node").to_numpy(zero_copy_only=False))
                else:
                    if g is None:
                        g = Graph(parts)
                        parts = []
                        turns = Turns(g) if kind == "turn" else None
                        wanted = (np.concatenate(wanted) if wanted else np.empty(0, np.int64)) if some else None
                    source, *rest = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("source", "node", "cost", "metres"))
                    ends = [0, *(np.flatnonzero(np.diff(source)) + 1).tolist(), len(source)]
                    for s, e in zip(ends, ends[1:]):
                        own = [c[s:e] for c in rest]
                        if held and held[0] == source[s]:
                            held = (held[0], *(np.concatenate([x, y]) for x, y in zip(held[1:], own)))
                            continue
                        if held:
                            yield answers(g, turns, wanted, *held)
                        held = (int(source[s]), *own)
        if held:
            yield answers(g, turns, wanted, *held)

    return sent.mapInArrow(run, "source bigint, node bigint, cost double, metres double, before bigint")


def wider(*types: str) -> str:
    """The widest of integral types."""
    return max(types, key=_INTEGRAL.index)
