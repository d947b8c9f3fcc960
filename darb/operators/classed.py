"""Insertions where the minutes between two nodes depend on a few classes of theirs, as they do between zones.

A ClassedPrice has the minutes as a table by class, and which pairs are unreachable as a table by gate; nodes of
equal class and gate (a kind) cost the same at every leg, so a leg is priced once a class, not once a node. What of it
holds for which gates is counted by the legs' own gates: a class keeps a histogram of its positions over the pairs
of gates of a leg's ends and over the smallest cap that a position keeps, and each gate takes the pairs that are open
to it. Of the cheapest positions only those are looked at that come before the worst of what the gates have so far.

All of it is exact: the figures are those of pricing every node at every leg, by the same sums in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Legs that are taken together, those taken first for a bound, and those that go through the arithmetic at once.
GATHER, FIRST, CHUNK, SORTED = 400_000, 20_000, 32_768, 4_096


class ClassedPrice:
    """Minutes between nodes: minutes[class, class], infinite where shut[gate, gate]; both from the first node to the second."""

    def __init__(self, of_class: Callable[[np.ndarray], np.ndarray], of_gate: Callable[[np.ndarray], np.ndarray], minutes: np.ndarray, shut: np.ndarray):
        self.of_class, self.of_gate, self.minutes, self.shut = of_class, of_gate, np.asarray(minutes, np.float64), np.asarray(shut, bool)
        self.classes, self.gates = len(self.minutes), len(self.shut)

    def __call__(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        return np.where(self.shut[self.of_gate(src), self.of_gate(dst)], np.inf, self.minutes[self.of_class(src), self.of_class(dst)])

    def kinds(self, nodes: np.ndarray) -> np.ndarray:
        """One number for a node's class and gate."""
        return self.of_class(nodes) * self.gates + self.of_gate(nodes)


def with_kinds(price: ClassedPrice, column: int):
    """Adds the kind of the nodes in a column to Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = price.kinds(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.int64())], names=[*batch.schema.names, "kind"])

    return run


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of routes put together to about GATHER legs, the first to fewer."""
    held, legs, most = [], 0, FIRST
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            legs += len(batch.column(2).flatten())
        if legs >= most:
            yield join()
            held, legs, most = [], 0, GATHER
    if held:
        yield join()


class _Picked:
    """Sums over one axis of a table for each gate, by the list of what counts or of what doesn't, whichever is shorter."""

    def __init__(self, picked: np.ndarray):
        count = picked.sum(axis=1).max(initial=0)
        self.without = count > (~picked).sum(axis=1).max(initial=0)
        lists = [np.flatnonzero(row) for row in (~picked if self.without else picked)]
        width = max(map(len, lists), default=0)
        self.at = np.array([[*x, *[0] * (width - len(x))] for x in lists], np.int64).reshape(len(lists), width)
        self.real = np.array([[True] * len(x) + [False] * (width - len(x)) for x in lists], bool).reshape(len(lists), width)

    def _listed(self, take: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(shape, np.int64)
        for j in range(self.at.shape[1]):
            part = take(self.at[:, j])
            real = self.real[:, j]
            out += part if real.all() else np.where(real.reshape(-1, *[1] * (part.ndim - 1)), part, 0)
        return out

    def first_axis(self, table: np.ndarray) -> np.ndarray:
        """(gate, ...) sums of table (x, ...) over the x that count for the gate."""
        listed = self._listed(lambda at: table[at], (len(self.at), *table.shape[1:]))
        return table.sum(axis=0)[None] - listed if self.without else listed

    def second_axis(self, table: np.ndarray) -> np.ndarray:
        """(gate, ...) sums of table (gate, x, ...) over the x that count for the gate."""
        gate = np.arange(len(self.at))
        listed = self._listed(lambda at: table[gate, at], (len(self.at), *table.shape[2:]))
        return table.sum(axis=1) - listed if self.without else listed


class _Gates:
    """For which gates of a node a position counts, by the gates of the leg's ends, in each state of the way back.

    State 0: the way back is open, or doesn't matter; 1: from the node to the leg's start it is shut; 2: from the leg's
    end to the node it is. On the way there both parts are open in all states.
    """

    def __init__(self, shut: np.ndarray, both_ways: bool):
        to, on, back_to, back_on = ~shut.T, ~shut, ~shut.T, ~shut  # (gate of the node, gate of the leg's start, end, end, start)
        states = [(to & back_on, on & back_to), (to & ~back_on, on & back_to), (to, on & ~back_to)] if both_ways else [(to, on)]
        self.n = len(shut)
        self.picked = [(_Picked(u), _Picked(v)) for u, v in states]
        self.open = np.stack([(u.T[:, None, :] & v.T[None, :, :]).reshape(self.n * self.n, self.n) for u, v in states])

    def count(self, state: int, table: np.ndarray) -> np.ndarray:
        u, v = self.picked[state]
        return v.second_axis(u.first_axis(table))


class _Classed:
    """A batch's legs with the classes and gates of their ends; legs with more riders come first, so that a rider's minutes are a prefix."""

    def __init__(self, legs, price: ClassedPrice, riders: bool, slack: float):
        n = len(legs.uv)
        count, triples = np.zeros(n, np.int64), []
        if riders:
            for on, left, left_back in legs.riders(np.arange(n)):
                triples.append((on, count[on], left + slack, left_back + slack))
                count[on] += 1
        order = np.argsort(-count, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes = np.bincount(count, minlength=1)
        self.with_more = n - np.cumsum(sizes)  # at r: legs with more than r riders
        self.riders = [(np.empty(self.with_more[r]), np.empty(self.with_more[r])) for r in range(len(sizes) - 1)]
        self.left, self.left_back = np.full(n, np.inf), np.full(n, np.inf)
        for on, rank, left, left_back in triples:
            at = place[on]
            np.minimum.at(self.left, at, left)
            np.minimum.at(self.left_back, at, left_back)
            for r in np.unique(rank):
                its = rank == r
                self.riders[r][0][at[its]], self.riders[r][1][at[its]] = left[its], left_back[its]
        self.alone = count[order] == 0
        src, dst = legs.src[order], legs.dst[order]
        self.u, self.v = price.of_class(src).astype(np.intp), price.of_class(dst).astype(np.intp)
        self.pair = (price.of_gate(src) * price.gates + price.of_gate(dst)).astype(np.intp)
        self.uv, self.rest, self.rest_back = legs.uv[order], legs.rest[order], legs.rest_back[order]
        self.route, self.seq = np.asarray(legs.ids, np.int64)[legs.route[order]], legs.seq[order]
        most = legs.most[legs.route[order]]
        self.most = most + slack if np.isfinite(most).any() else None
        self.n = n

    def chunks(self) -> Iterator[slice]:
        for start in range(0, self.n, CHUNK):
            yield slice(start, min(self.n, start + CHUNK))


def _least_first(delta: np.ndarray, bound: Callable[[np.ndarray], np.ndarray], take: Callable[[np.ndarray], None]) -> None:
    """Gives the entries to `take` in parts; of many the smallest first, after which only those that the bound still lets through."""
    left = np.arange(len(delta))
    if len(left) > SORTED:
        first = np.argpartition(delta, SORTED // 2)[: SORTED // 2]
        take(first)
        rest = np.ones(len(delta), bool)
        rest[first] = False
        left = np.flatnonzero(rest)
        left = left[bound(left)]
    for start in range(0, len(left), 16 * SORTED):
        part = left[start : start + 16 * SORTED]
        take(part[bound(part)])


def best_by_class(kinds: np.ndarray, caps: np.ndarray, price: ClassedPrice, rule: str, make_legs: Callable, slack: float):
    """Per (kind, cap) what insertions._best gives per (node, cap); `caps` are sorted and distinct."""
    of_kind, of_gate = kinds // price.gates, kinds % price.gates
    classes, row = np.unique(of_kind, return_inverse=True)
    most_cap, full = len(caps), np.uint8(len(caps))
    limits = caps + slack
    both_ways = rule in ("either", "both")
    bounded = bool(np.isfinite(price.minutes).all())

    def own(ride: np.ndarray) -> np.ndarray:
        """The index of the least cap that a ride keeps; len(caps) for none."""
        k = np.full(len(ride), full)
        for limit in limits:
            k -= (ride <= limit).view(np.uint8)
        return k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = price.gates
        gates, every = _Gates(price.shut, both_ways), np.arange(g)
        states = len(gates.picked)
        shape = (len(classes), g, most_cap)
        options, least = np.zeros(shape, np.int64), np.full(shape, np.inf)
        routes, seqs = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        bound = np.full((len(classes), most_cap + 1), np.inf)
        bound[:, most_cap] = -np.inf
        for batch in gathered(batches):
            legs = _Classed(make_legs(batch), price, rule != "free", slack)
            if not legs.n:
                continue
            spread = legs.pair * (most_cap + 1)
            delta, kept = np.empty(legs.n), np.zeros((states, legs.n), np.uint8)
            same = None
            for i, c in enumerate(classes):
                into, out_of = np.ascontiguousarray(price.minutes[:, c]), price.minutes[c]
                top = bound[i, :most_cap].max()
                near = []
                for part in legs.chunks():
                    u, v = legs.u[part], legs.v[part]
                    onward = out_of.take(v)
                    d = into.take(u)
                    d += onward
                    d -= legs.uv[part]
                    delta[part] = d
                    near.append(part.start + np.flatnonzero(d <= top))
                    if rule == "free" and bounded and legs.most is None:
                        continue
                    barred = ~(d < np.inf) if not bounded else np.zeros(len(d), bool)
                    if legs.most is not None:
                        barred |= ~(d <= legs.most[part])
                    if rule == "free":
                        kept[0, part] = np.where(barred, full, 0)
                        continue
                    onward += legs.rest[part]
                    if not both_ways:
                        k = own(onward)
                        np.copyto(k, full, where=barred | ~(d <= legs.left[part]))
                        kept[0, part] = k
                        continue
                    evening = into.take(v)
                    evening += legs.rest_back[part]
                    detour = out_of.take(u)
                    detour += evening
                    join = np.fmin if rule == "either" else np.maximum
                    k = own(join(onward, evening))
                    k_there = own(join(onward, np.inf))
                    there = d <= legs.left[part]
                    if rule == "either":
                        fits = np.ones(len(d), bool)
                        for r, (left, left_back) in enumerate(legs.riders):
                            m = min(len(d), int(legs.with_more[r]) - part.start)
                            if m <= 0:
                                break
                            at = slice(part.start, part.start + m)
                            fits[:m] &= (d[:m] <= left[at]) | (detour[:m] <= left_back[at])
                    else:
                        fits = there & (detour <= legs.left_back[part])
                        there &= legs.alone[part]
                    lost = barred | ~there
                    kept[0, part] = np.where(fits & ~barred, k, full)
                    kept[1, part] = np.where(lost, full, k)
                    kept[2, part] = np.where(lost, full, k_there)
                if rule == "free" and bounded and legs.most is None:
                    if same is None:
                        same = gates.count(0, np.bincount(legs.pair, minlength=g * g).reshape(g, g, 1))
                    options[i] += same
                else:
                    for s in range(states):
                        table = np.bincount(spread + kept[s], minlength=g * g * (most_cap + 1)).reshape(g, g, most_cap + 1)[:, :, :most_cap]
                        options[i] += np.cumsum(gates.count(s, table), axis=1)
                near = np.concatenate(near)
                state = np.repeat(np.arange(states), len(near))
                leg = np.tile(near, states)
                cap = kept[state, leg]
                useful = delta[leg] <= bound[i][cap]
                state, leg, cap = state[useful], leg[useful], cap[useful]
                value = delta[leg]
                some = value < np.inf
                state, leg, cap, value = state[some], leg[some], cap[some], value[some]

                def take(part: np.ndarray) -> None:
                    part = part[np.lexsort((legs.seq[leg[part]], legs.route[leg[part]], value[part]))]  # noqa: B023
                    allowed = gates.open[state[part], legs.pair[leg[part]]]  # noqa: B023
                    its = cap[part]  # noqa: B023
                    for k in range(most_cap):
                        rows = np.flatnonzero(its <= k)
                        if not len(rows):
                            continue
                        sub = allowed[rows]
                        first = sub.argmax(axis=0)
                        e = part[rows[first]]
                        new, route, seq = value[e], legs.route[leg[e]], legs.seq[leg[e]]  # noqa: B023
                        old, old_route, old_seq = least[i, :, k], routes[i, :, k], seqs[i, :, k]  # noqa: B023
                        better = sub[first, every] & ((new < old) | (new == old) & ((route < old_route) | (route == old_route) & (seq < old_seq)))
                        old[better], old_route[better], old_seq[better] = new[better], route[better], seq[better]
                    bound[i, :most_cap] = least[i].max(axis=0)  # noqa: B023

                _least_first(value, lambda x: value[x] <= bound[i][cap[x]], take)  # noqa: B023
        options, least, routes, seqs = (x[row, of_gate] for x in (options, least, routes, seqs))  # (kind, cap)
        some = options > 0
        at, k = np.nonzero(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds[at], pa.int64()), pa.array(caps[k], pa.float64()), pa.array(options[some], pa.int64()), pa.array(least[some], pa.float64()), pa.array(routes[some], pa.int64()), pa.array(seqs[some], pa.int64())],
            names=["kind", "cap_min", "options", "delta", "route_id", "seq"],
        )

    return run


def cheapest_by_class(kinds: np.ndarray, price: ClassedPrice, k: int, make_legs: Callable):
    """Per kind the k cheapest routes of a task, the first of equal ones; it has whole routes."""
    of_kind, of_gate = kinds // price.gates, kinds % price.gates
    classes, row = np.unique(of_kind, return_inverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = price.gates
        open_, every = _Gates(price.shut, False).open[0], np.arange(g)
        cost, route = np.full((len(classes), g, k), np.inf), np.zeros((len(classes), g, k), np.int64)
        for batch in gathered(batches):
            legs = _Classed(make_legs(batch), price, False, 0.0)
            if not legs.n:
                continue
            delta = np.empty(legs.n)
            for i, c in enumerate(classes):
                into, out_of = np.ascontiguousarray(price.minutes[:, c]), price.minutes[c]
                near, top = [], cost[i, :, -1].max()
                for part in legs.chunks():
                    d = into.take(legs.u[part])
                    d += out_of.take(legs.v[part])
                    d -= legs.uv[part]
                    delta[part] = d
                    near.append(part.start + np.flatnonzero(d <= top))
                near = np.concatenate(near)
                value = delta[near]
                near, value = near[value < np.inf], value[value < np.inf]

                def take(part: np.ndarray) -> None:
                    part = part[np.lexsort((legs.route[near[part]], value[part]))]  # noqa: B023
                    if not len(part):
                        return
                    allowed, name = open_[legs.pair[near[part]]], legs.route[near[part]]  # noqa: B023
                    costs, names = [cost[i]], [route[i]]  # noqa: B023
                    # a route that has a better place already isn't taken again
                    for _ in range(k):
                        first = allowed.argmax(axis=0)
                        found = allowed[first, every]
                        costs.append(np.where(found, value[part][first], np.inf)[:, None])  # noqa: B023
                        names.append(name[first][:, None])
                        allowed = allowed & (name[:, None] != name[first][None, :])
                    costs, names = np.concatenate(costs, axis=1), np.concatenate(names, axis=1)
                    order = np.lexsort((names, costs), axis=-1)
                    costs, names = np.take_along_axis(costs, order, axis=1), np.take_along_axis(names, order, axis=1)
                    for j in range(1, costs.shape[1]):  # parts of one batch may hold legs of the same route
                        again = ((names[:, :j] == names[:, j : j + 1]) & np.isfinite(costs[:, :j])).any(axis=1)
                        costs[again, j] = np.inf
                    order = np.lexsort((names, costs), axis=-1)[:, :k]
                    cost[i], route[i] = np.take_along_axis(costs, order, axis=1), np.take_along_axis(names, order, axis=1)  # noqa: B023

                _least_first(value, lambda x: value[x] <= cost[i, :, -1].max(), take)  # noqa: B023
        cost, route = cost[row, of_gate], route[row, of_gate]
        some = np.isfinite(cost)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(kinds[:, None], cost.shape)[some], pa.int64()), pa.array(route[some], pa.int64()), pa.array(cost[some], pa.float64())], names=["kind", "route_id", "delta"])

    return run
