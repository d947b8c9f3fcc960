"""Adaptive large neighbourhood search over a grid of (zone, seed, fleet size): one solver per group, all groups in parallel.

A zone is a problem of its own; zones, seeds and fleet sizes multiply into independent tasks. Students board at the
nearest stop of their zone, which a grid join finds before the tasks are made, so a task gets stops with their numbers
of students only. A stop's students are a unit that one vehicle takes as far as its seats go. The search removes units
and puts them back: removals are random, by worst saving, by relatedness, a stretch of a route, or a whole route;
repairs are greedy or by regret, of all that waits or of a bounded part of it. Where units have caps, a place must keep
the ride of everyone in the route within them, in the morning or on the way back. Operators are drawn by weights that
follow their success, worse solutions are accepted with a falling temperature. Two phases may follow: one that empties
routes and repairs by regret, and a last one for units that no route has. Everything is driven by the seed and the
number of iterations, never by the clock, so a run can be repeated.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darb.session import BROADCAST_ROWS, durable

#: Weights of the objective, cooling, rewards and memory of the operators' weights, largest share removed,
#: regret of a unit with one route, discount of a unit in the same route, patience once the least fleet serves all,
#: cooling of the merging phase, calls of the last phase and the share and number that it shakes.
SERVED, ROUTE = 10_000.0, 5_000.0
COOLING, REWARDS, MEMORY, TOP = 0.98, (30.0, 15.0, 5.0), 0.7, 0.25
ONE_ROUTE, SAME_ROUTE, POLISH = 2000.0, 0.5, 30
TAIL_COOLING, RESCUE_CALLS, KICK_SHARE, KICK_MOST = 0.96, 4, 0.03, 12
#: Lengths of routes that are kept, and places that are worked out at once.
KNOWN, PLACES = 500_000, 1_000_000
#: Fleets of a zone and seed that a task searches.
FLEETS = 4
SCHEMA = "zone bigint, seed int, fleet int, students int, served int, routes_used int, total_min double, objective double, iterations int, accepted int, best_iteration int, stop_reason string"
STOPS = "zone bigint, seed int, fleet int, route int, seq int, node_id bigint, part int, load int, arrive_min double"


class Problem:
    """Units (students at a stop), minutes between stops (index 0 is the school), seats of a vehicle, the longest ride of each unit, and which are hard to place."""

    def __init__(self, sizes: list[int], minutes: np.ndarray, capacity: int, fleet: int, caps: list[float] | None = None, hard: set[int] | None = None):
        self.sizes, self.minutes, self.capacity, self.fleet = sizes, minutes, capacity, fleet
        self.caps = caps if caps and min(caps) < math.inf else None
        self.hard = hard or set()
        self.seats = np.array(sizes, np.int64)
        self.reverse = minutes if np.array_equal(minutes, minutes.T) else np.ascontiguousarray(minutes.T)
        self.known: dict[tuple[int, ...], float] = {}

    def length(self, route: list[int]) -> float:
        if (found := self.known.get(key := tuple(route))) is not None:
            return found
        if len(self.known) >= KNOWN:
            self.known.clear()
        stops = [0, *(u + 1 for u in route), 0]
        self.known[key] = out = float(sum(self.minutes[a, b] for a, b in zip(stops, stops[1:]))) if route else 0.0
        return out

    def objective(self, routes: list[list[int]]) -> float:
        used = [r for r in routes if r]
        return SERVED * sum(self.sizes[u] for r in used for u in r) - ROUTE * len(used) - sum(map(self.length, used))

    def load(self, route: list[int]) -> int:
        return sum([self.sizes[u] for u in route])

    def keeps_caps(self, route: list[int]) -> bool:
        """Whether each unit's ride is within its cap in the morning or on the route run backwards."""
        if self.caps is None:
            return True
        stops = [u + 1 for u in route]
        morning = evening = 0.0
        for k in range(len(stops) - 1, -1, -1):
            after = stops[k + 1] if k + 1 < len(stops) else 0
            morning += self.minutes[stops[k], after]
            evening += self.minutes[after, stops[k]]
            if min(morning, evening) > self.caps[route[k]] + 1e-9:
                return False
        return True

    def best_place(self, route: list[int], unit: int) -> tuple[float, int] | None:
        """(added minutes, position) of the cheapest place for a unit that keeps seats and caps, or None."""
        if self.load(route) + self.sizes[unit] > self.capacity:
            return None
        stops = np.array([0, *(u + 1 for u in route), 0])
        t, c = self.minutes, unit + 1
        added = t[stops[:-1], c] + t[c, stops[1:]] - t[stops[:-1], stops[1:]]
        if self.caps is None:
            k = int(added.argmin())
            return (float(added[k]), k) if added[k] < math.inf else None
        for k in np.argsort(added, kind="stable").tolist():
            if added[k] == math.inf:
                return None
            if self.keeps_caps([*route[:k], unit, *route[k:]]):
                return float(added[k]), k
        return None


def _random(p: Problem, routes, n, rng) -> list[int]:
    units = [u for r in routes for u in r]
    return rng.sample(units, min(n, len(units)))


def _worst(p: Problem, routes, n, rng) -> list[int]:
    saved = [(p.length(r) - p.length(r[:i] + r[i + 1 :]), u) for r in routes for i, u in enumerate(r)]
    return [u for _, u in sorted(saved, reverse=True)[:n]]


def _related(p: Problem, routes, n, rng) -> list[int]:
    units = [u for r in routes for u in r]
    if not units:
        return []
    seed = rng.choice(units)
    where = {u: k for k, r in enumerate(routes) for u in r}
    return sorted(units, key=lambda u: (p.minutes[seed + 1, u + 1] - (SAME_ROUTE if where[u] == where[seed] else 0.0), u))[:n]


def _route(p: Problem, routes, n, rng) -> list[int]:
    used = [r for r in routes if r]
    return list(min(used, key=lambda r: (p.load(r), r))) if used else []


def _sequence(p: Problem, routes, n, rng) -> list[int]:
    """Stretches of successive stops of routes drawn at random, n units together."""
    used, gone, out = [r for r in routes if r], [], set()
    for _ in range(max(3, 2 * len(used))):
        if len(gone) >= n or not used:
            break
        left = [u for u in rng.choice(used) if u not in out]
        if left:
            size = rng.randint(1, min(len(left), n - len(gone)))
            start = rng.randint(0, len(left) - size)
            gone += left[start : start + size]
            out.update(left[start : start + size])
    return gone


def workset(p: Problem, waiting: list[int], limit: int | None, rng) -> list[int]:
    """At most `limit` of the units that wait: up to half of them hard ones, the others drawn at random; all without a limit."""
    if not limit or len(waiting) <= limit:
        return list(waiting)
    hard, easy = [u for u in waiting if u in p.hard], [u for u in waiting if u not in p.hard]
    keep = rng.sample(hard, min(len(hard), max(1, limit // 2)))
    keep += rng.sample(easy, min(len(easy), limit - len(keep)))
    rng.shuffle(keep)
    return keep


class _Places:
    """The cheapest place of each waiting unit in each route, as a table (unit, route), for units without caps.

    Empty routes are alike, so they aren't in the table: `alone` is a unit's cost there, and the first of `empty` is
    the one that counts. A route that takes a unit is looked at again, the others stay as they are.
    """

    def __init__(self, p: Problem, routes: list[list[int]], units: list[int]):
        self.p, self.routes, self.units = p, routes, units
        at = np.array(units, np.int64) + 1
        self.sizes = p.seats[at - 1]
        # a row per unit: minutes to each stop, and from there
        self.back = p.minutes[at]
        self.there = self.back if p.reverse is p.minutes else p.reverse[at]
        self.alone = np.where(self.sizes <= p.capacity, self.there[:, 0] + self.back[:, 0] - p.minutes[0, 0], np.inf)
        self.alone[~(self.alone < np.inf)] = np.inf
        self.spare = [p.capacity - p.load(r) for r in routes]
        self.empty = [k for k, r in enumerate(routes) if not r]
        self.cost, self.place = np.full((len(units), len(routes)), np.inf), np.zeros((len(units), len(routes)), np.int32)
        self.waits = self.sizes.copy()  # as many seats as the unit needs; more than there are once it is placed
        least = int(self.sizes.min(initial=p.capacity + 1))
        by_length: dict[int, list[int]] = {}
        for k, spare in enumerate(self.spare):
            if spare >= least and routes[k]:
                by_length.setdefault(len(routes[k]), []).append(k)
        for n, same in by_length.items():
            step = max(1, PLACES // ((n + 1) * max(1, len(units))))
            for i in range(0, len(same), step):
                self._fill(np.array(same[i : i + step]), n)

    def _fill(self, which: np.ndarray, n: int) -> None:
        stops = np.zeros((n + 2, len(which)), np.int64)
        stops[1:-1] = np.array([self.routes[k] for k in which]).T + 1
        spare, base = np.array([self.spare[k] for k in which]), self.p.minutes[stops[:-1], stops[1:]]
        value, place = None, 0
        for j in range(n + 1):
            added = self.there.take(stops[j], axis=1)
            added += self.back.take(stops[j + 1], axis=1)
            added -= base[j]
            if value is None:
                value = added
            else:
                less = ~(added >= value) & ~np.isnan(value)
                place, value = np.where(less, j, place), np.where(less, added, value)
        value[~((value < np.inf) & (self.sizes[:, None] <= spare))] = np.inf
        self.cost[:, which], self.place[:, which] = value, place

    def cut(self, fleet: int) -> _Places:
        """The same with the first routes only."""
        out = copy(self)
        out.routes, out.spare, out.empty = [list(r) for r in self.routes[:fleet]], self.spare[:fleet], [k for k in self.empty if k < fleet]
        out.waits, out.cost, out.place = self.waits.copy(), self.cost[:, :fleet].copy(), self.place[:, :fleet].copy()
        return out

    def insert(self, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts the i-th unit into route k, and gives the units that still fit there with what they cost now."""
        if self.empty and k == self.empty[0]:
            self.routes[k].append(self.units[i])
            self.empty.pop(0)
        else:
            self.routes[k].insert(int(self.place[i, k]), self.units[i])
        self.spare[k] -= int(self.sizes[i])
        self.waits[i] = self.p.capacity + 1
        self.cost[:, k] = np.inf
        fits = (self.waits <= self.spare[k]).nonzero()[0]
        if not len(fits):
            return fits, np.empty(0)
        stops = np.array([0, *(u + 1 for u in self.routes[k]), 0])
        rows = fits[:, None]
        added = self.there[rows, stops[:-1]]
        added += self.back[rows, stops[1:]]
        added -= self.p.minutes[stops[:-1], stops[1:]]
        self.place[fits, k] = first = added.argmin(axis=1)
        value = added[np.arange(len(fits)), first]
        value[~(value < np.inf)] = np.inf
        self.cost[fits, k] = value
        return fits, value


def _greedy(p: Problem, routes, waiting, rng) -> None:
    rng.shuffle(waiting)
    if p.caps is not None:
        return _greedy_capped(p, routes, waiting)
    if not waiting or not routes:
        return None
    table = _Places(p, routes, waiting)
    for i in range(len(waiting)):
        k = int(table.cost[i].argmin())
        cost, alone = table.cost[i, k], table.alone[i]
        if table.empty and (alone < cost or alone == cost and table.empty[0] < k):
            k, cost = table.empty[0], alone
        if cost < np.inf:
            table.insert(i, k)
        else:
            table.waits[i] = p.capacity + 1
    return None


def _greedy_capped(p: Problem, routes, waiting) -> None:
    for unit in waiting:
        options = [(place[0], k, place[1]) for k, r in enumerate(routes) if (place := p.best_place(r, unit))]
        if options:
            _, k, i = min(options)
            routes[k].insert(i, unit)


class _Regret:
    """Insertion by regret, a unit a step, for units without caps."""

    def __init__(self, p: Problem, routes: list[list[int]], waiting: list[int], big: float):
        self.table, self.big, n = _Places(p, routes, waiting), big, len(waiting)
        self.live = np.ones(n, bool)
        # the two cheapest routes of each unit among those with units, and what follows with the empty ones
        self.c1, self.k1, self.c2, self.k2 = np.empty(n), np.zeros(n, np.int64), np.empty(n), np.zeros(n, np.int64)
        self.best, self.chosen, self.regret = np.empty(n), np.zeros(n, np.int64), np.empty(n)
        self._rank(np.arange(n))
        self._weigh(slice(None))

    def cut(self, fleet: int) -> _Regret:
        """The same with the first routes only."""
        out = copy(self)
        for name in ("live", "c1", "k1", "c2", "k2", "best", "chosen", "regret"):
            setattr(out, name, getattr(self, name).copy())
        out.table = self.table.cut(fleet)
        out._weigh(slice(None))
        return out

    def _rank(self, rows: np.ndarray) -> None:
        own, m = self.table.cost[rows], np.arange(len(rows))
        self.k1[rows] = first = own.argmin(axis=1)
        self.c1[rows] = own[m, first]
        own[m, first] = np.inf
        self.k2[rows] = second = own.argmin(axis=1)
        self.c2[rows] = own[m, second]

    def _weigh(self, rows) -> None:
        b, c, second, empty = self.c1[rows], self.k1[rows], self.c2[rows], self.table.empty
        if empty:
            a = self.table.alone[rows]
            opens = (a < b) | (a == b) & (empty[0] < c)
            second = np.where(opens, np.minimum(b, a) if len(empty) > 1 else b, np.minimum(second, a))
            b, c = np.where(opens, a, b), np.where(opens, empty[0], c)
        with np.errstate(invalid="ignore"):
            r = np.where(second < np.inf, second, self.big) - b
        r[np.isnan(r)] = 0.0
        r[~(self.live[rows] & (b < np.inf))] = -np.inf
        self.best[rows], self.chosen[rows], self.regret[rows] = b, c, r

    def step(self) -> bool:
        """Whether a unit was put in."""
        regret, best, table = self.regret, self.best, self.table
        if (top := regret.max()) == -np.inf:
            return False
        ties = (regret == top).nonzero()[0]
        if len(ties) > 1:
            ties = ties[best[ties] == best[ties].min()]
        i, empty = int(ties[-1]), len(table.empty)
        k = int(self.chosen[i])
        had = (self.k1 == k) | (self.k2 == k)  # the route may cost more now, so all routes are looked at again
        had &= self.live
        self.live[i] = had[i] = False
        regret[i] = -np.inf
        fits, new = table.insert(i, k)
        again = had.nonzero()[0]
        if len(again):
            self._rank(again)
        if len(fits):
            c1, k1, c2, k2 = self.c1, self.k1, self.c2, self.k2
            other = ~had[fits]
            fits, new = fits[other], new[other]
            first = (new < c1[fits]) | (new == c1[fits]) & (k < k1[fits])
            rows = fits[first]
            c2[rows], k2[rows], c1[rows], k1[rows] = c1[rows], k1[rows], new[first], k
            between = ~first & (new < c2[fits])
            rows = fits[between]
            c2[rows], k2[rows] = new[between], k
        changed = slice(None) if len(table.empty) != empty else np.concatenate([again, fits])
        if len(table.empty) != empty or len(changed):
            self._weigh(changed)
        return True


def _regret(p: Problem, routes, waiting, rng, big: float = ONE_ROUTE) -> None:
    waiting = sorted(waiting)
    if p.caps is not None:
        _regret_capped(p, routes, waiting, big)
    elif waiting and routes:
        run = _Regret(p, routes, waiting, big)
        while run.step():
            pass


def first_routes(p: Problem, fleets: list[int]) -> dict[int, list[list[int]]]:
    """The routes that _regret makes of all units, for each of the fleets.

    While two routes or more are empty, their number doesn't matter, so the fleets have their steps up to there in common.
    """
    out, units = {}, list(range(len(p.sizes)))
    shared = [f for f in sorted(set(fleets)) if f >= 2 and units and p.caps is None]
    for f in set(fleets) - set(shared):
        out[f] = [[] for _ in range(f)]
        _regret(p, out[f], units, None)
    if shared:
        run = _Regret(p, [[] for _ in range(shared[-1] + 1)], units, ONE_ROUTE)
        routes, going = run.table.routes, True
        for f in shared:
            while going and len(routes) - len(run.table.empty) < f - 1:
                going = run.step()
            own = run.cut(f) if going else None
            while own is not None and own.step():
                pass
            out[f] = own.table.routes if own is not None else [list(r) for r in routes[:f]]
    return out


def _regret_capped(p: Problem, routes, waiting, big: float) -> None:
    places = {u: {k: x for k, r in enumerate(routes) if (x := p.best_place(r, u))} for u in waiting}
    while waiting:
        ranked = []
        for u in waiting:
            costs = sorted((c, k) for k, (c, _) in places[u].items())
            if costs:
                ranked.append((costs[1][0] - costs[0][0] if len(costs) > 1 else big - costs[0][0], -costs[0][0], u, costs[0][1]))
        if not ranked:
            return
        _, _, unit, k = max(ranked)
        routes[k].insert(places[unit][k][1], unit)
        waiting.remove(unit)
        for u in waiting:  # only the changed route is looked at again
            places[u].pop(k, None)
            if x := p.best_place(routes[k], u):
                places[u][k] = x


DESTROY: dict[str, Callable] = {"random": _random, "worst": _worst, "related": _related, "sequence": _sequence, "route": _route}
REPAIR: dict[str, Callable] = {"greedy": _greedy, "regret": _regret}


def _without(routes: list[list[int]], gone) -> list[list[int]]:
    gone = set(gone)
    return [[u for u in route if u not in gone] for route in routes]


def _waiting(p: Problem, routes: list[list[int]]) -> list[int]:
    placed = {u for route in routes for u in route}
    return [u for u in range(len(p.sizes)) if u not in placed]


def _served(p: Problem, routes: list[list[int]]) -> int:
    return sum(p.sizes[u] for r in routes for u in r)


def merge_tail(p: Problem, current: list[list[int]], best: list[list[int]], iterations: int, temperature: float, rng) -> list[list[int]]:
    """The best routes after rounds that empty the least loaded route and repair by regret, accepted by a temperature that falls from a twentieth."""
    value, best_value, t = p.objective(current), p.objective(best), max(1e-3, temperature * 0.05)
    for _ in range(iterations):
        gone = _route(p, current, 0, rng)
        if not gone:
            break
        trial = _without(current, gone)
        _regret(p, trial, _waiting(p, trial), rng)
        new = p.objective(trial)
        if new > value or rng.random() < math.exp(max(-700.0, (new - value) / t)):
            current, value = trial, new
        if new > best_value + 1e-9:
            best, best_value = [list(r) for r in trial], new
        t *= TAIL_COOLING
    return best


def rescue(p: Problem, routes: list[list[int]], rng, calls: int = RESCUE_CALLS) -> list[list[int]]:
    """Routes after some repairs for units that wait; where that helps none, some of the worst served are taken out and all put back. It never serves fewer."""
    for _ in range(calls):
        before = _served(p, routes)
        if not _waiting(p, routes):
            break
        trial = [list(r) for r in routes]
        _regret(p, trial, _waiting(p, trial), rng)
        _greedy(p, trial, _waiting(p, trial), rng)
        if _served(p, trial) <= before:
            units = sum(map(len, trial))
            trial = _without(trial, _worst(p, trial, max(1, min(KICK_MOST, int(units * KICK_SHARE))), rng))
            _regret(p, trial, _waiting(p, trial), rng)
            _greedy(p, trial, _waiting(p, trial), rng)
        if _served(p, trial) > before or _served(p, trial) == before and p.objective(trial) >= p.objective(routes):
            routes = trial
    return routes


def search(p: Problem, seed: int, iterations: int, patience: int = 80, limit: int | None = None, tail: int = 0, first: list[list[int]] | None = None) -> dict:
    """The best routes found, and how the search went. `first` are the routes of first_routes(), if they are there.

    `limit` bounds the units of a repair, `tail` is the number of merging rounds behind the search. It stops after its
    iterations, after `patience` iterations without a better solution, or after POLISH of those once the fewest
    vehicles that could serve everyone do.
    """
    rng = random.Random(seed)
    units = list(range(len(p.sizes)))
    current = [list(r) for r in (first_routes(p, [p.fleet])[p.fleet] if first is None else first)]
    best, value = [list(r) for r in current], p.objective(current)
    best_value, temperature, accepted, best_at, reason = value, 1000.0, 0, 0, "iterations_completed"
    weights = {name: 1.0 for name in [*DESTROY, *REPAIR]}
    everyone, least = sum(p.sizes), -(-sum(p.sizes) // p.capacity)
    step = 0
    for step in range(1, iterations + 1):
        d = rng.choices(list(DESTROY), [weights[x] for x in DESTROY])[0]
        r = rng.choices(list(REPAIR), [weights[x] for x in REPAIR])[0]
        n = max(1, int(len(units) * rng.uniform(0.05, TOP)))
        trial = _without(current, DESTROY[d](p, current, n, rng))
        REPAIR[r](p, trial, workset(p, _waiting(p, trial), limit, rng), rng)
        new = p.objective(trial)
        reward = 0.0
        if new > best_value + 1e-9:
            best, best_value, best_at, reward = [list(x) for x in trial], new, step, REWARDS[0]
        elif new > value + 1e-9:
            reward = REWARDS[1]
        if new >= value or rng.random() < math.exp(max(-700.0, (new - value) / temperature)):
            reward = reward or REWARDS[2]
            current, value, accepted = trial, new, accepted + 1
        for x in (d, r):
            weights[x] = max(0.05, MEMORY * weights[x] + (1 - MEMORY) * reward)
        temperature = max(1e-6, temperature * COOLING)
        done = _served(p, best) == everyone and sum(map(bool, best)) <= least
        if step - best_at >= (min(POLISH, patience) if done else patience):
            reason = "theoretical_optimum_polish" if done and POLISH < patience else "no_improve_patience"
            break
    if tail:
        best = merge_tail(p, current, best, tail, temperature, rng)
    if _waiting(p, best):
        best = rescue(p, best, rng)
    used = [r for r in best if r]
    return {"routes": used, "served": _served(p, used), "total_min": sum(map(p.length, used)), "objective": p.objective(best), "iterations": step, "accepted": accepted, "best_iteration": best_at, "stop_reason": reason}


def _metres(lat, lon, lat2, lon2):
    a, b = np.radians(lat), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def assigned(students: DataFrame, stops: DataFrame) -> DataFrame:
    """(zone, student_id, node_id, walk_m): each student's nearest stop of the same zone; students of zones without stops have null ones."""
    from darb.operators.spatial import nearest

    own = students.select(F.col("zone").cast("bigint").alias("zone"), "student_id", "lat", "lon").where("zone IS NOT NULL")
    points = own.select("zone", F.struct("zone", "student_id").alias("key"), "lat", "lon")
    goal = stops.select(F.col("zone").cast("bigint").alias("zone"), F.col("node_id").cast("bigint").alias("target"), "lat", "lon").where("zone IS NOT NULL")
    found = nearest(points, goal, by="zone").select("key.zone", "key.student_id", F.col("target").alias("node_id"), F.col("metres").alias("walk_m"))
    return own.select("zone", "student_id").join(found, ["zone", "student_id"], "left")


def _units(students: DataFrame, stops: DataFrame, cap: Column | None) -> DataFrame:
    """(zone, node_id, lat, lon, size, cap_min, hard, school_lat, school_lon): a row per stop that anyone boards at; a zone without stops has one without node."""
    facts = ["zone", "student_id", (cap if cap is not None else F.lit(float("inf"))).alias("cap_min"), (F.col("radius") <= 0 if "radius" in students.columns else F.lit(False)).alias("hard")]
    joined = assigned(students, stops).join(students.withColumn("zone", F.col("zone").cast("bigint")).select(*facts), ["zone", "student_id"])
    board = joined.groupBy("zone", "node_id").agg(F.count("*").cast("int").alias("size"), F.min("cap_min").alias("cap_min"), F.bool_or("hard").alias("hard"))
    places = stops.select(F.col("zone").cast("bigint").alias("zone"), F.col("node_id").cast("bigint").alias("node_id"), "lat", "lon")
    school = places.groupBy("zone").agg(F.avg("lat").alias("school_lat"), F.avg("lon").alias("school_lon"))
    return durable(board.join(places, ["zone", "node_id"], "left").join(school, "zone", "left"))


def _zones(units: DataFrame, capacity: int) -> DataFrame:
    """(zone, students, node_id, size, cap_min, hard, lat, lon, school_lat, school_lon, bound): a row per zone with its units as arrays, in order of the nodes; see packing_bound()."""
    each = units.groupBy("zone").agg(F.sum("size").cast("int").alias("students"), F.array_sort(F.collect_list(F.struct("node_id", "size", "cap_min", "hard", "lat", "lon", "school_lat", "school_lon"))).alias("u"))
    placed = F.filter("u", lambda x: x["node_id"].isNotNull())
    each = each.select("zone", "students", *(placed.getField(c).alias(c) for c in ("node_id", "size", "cap_min", "hard", "lat", "lon")), F.get(placed, F.lit(0))["school_lat"].alias("school_lat"), F.get(placed, F.lit(0))["school_lon"].alias("school_lon"))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield pd.DataFrame({"zone": rows["zone"], "bound": [packing_bound(pieces(x, capacity)[0], capacity) for x in rows["size"]]})

    return durable(each.join(each.select("zone", "size").mapInPandas(bounds, "zone bigint, bound int"), "zone"))


def pieces(sizes, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(size, stop, part) of each unit: a stop with more students than seats is several units."""
    cut = [(min(capacity, int(count) - begin), k, n) for k, count in enumerate(sizes) for n, begin in enumerate(range(0, int(count), capacity))]
    return [x[0] for x in cut], [x[1] for x in cut], [x[2] for x in cut]


def packing_bound(sizes: list[int], capacity: int) -> int:
    """A number of vehicles that can't be gone below if each unit is to have its seats in one (Martello and Toth's second bound).

    For any size up to half the seats: units that leave less than that size have a vehicle of their own, so do those of
    over half the seats, and the others from that size on must go into what the latter leave or into further vehicles.
    """
    x = np.array(sizes, np.int64)
    best = 0
    for least in [0, *np.unique(x[2 * x <= capacity]).tolist()]:
        alone, large, small = x[x > capacity - least], x[(x <= capacity - least) & (2 * x > capacity)], x[(2 * x <= capacity) & (x >= least)]
        left = small.sum() - (len(large) * capacity - large.sum())
        best = max(best, len(alone) + len(large) + max(0, -(-int(left) // capacity)))
    return best


def _solve(zones: DataFrame, tasks: DataFrame, capacity: int, iterations: int, metres_per_min: float, tail: int = 0, routes: bool = False) -> DataFrame:
    """One row per task (zone, seed, fleet) whose zone has students, see SCHEMA; or with `routes` a row per stop of its routes, see STOPS.

    Up to FLEETS fleets of a zone and seed are searched one after the other, as they begin alike.
    """
    names = [c.split()[0] for c in (STOPS if routes else SCHEMA).split(", ")]

    def rows_of(zone: int, seed: int, fleet: int, students: int, nodes, units, minutes: np.ndarray, found: dict) -> list[tuple]:
        if not routes:
            return [(zone, seed, fleet, students, found["served"], len(found["routes"]), *(found[k] for k in names[6:]))]
        sizes, at, part = units
        out = []
        for r, route in enumerate(found["routes"], 1):
            clock, before = 0.0, 0
            for seq, u in enumerate(route, 1):
                clock, before = clock + float(minutes[before, u + 1]), u + 1
                out.append((zone, seed, fleet, r, seq, int(nodes[at[u]]), part[u], sizes[u], clock))
            out.append((zone, seed, fleet, r, len(route) + 1, None, None, 0, clock + float(minutes[before, 0])))
        return out

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                units = sizes, at, _ = pieces(row.size_, capacity)
                lats, lons = (np.array([s, *np.asarray(x)[at]], float) if at else np.zeros(1) for s, x in ((row.school_lat, row.lat), (row.school_lon, row.lon)))
                minutes = _metres(lats[:, None], lons[:, None], lats[None, :], lons[None, :]) / metres_per_min
                caps, hard = np.asarray(row.cap_min, float), row.hard
                problem = Problem(sizes, minutes, capacity, 0, [float(caps[k]) for k in at], {u for u, k in enumerate(at) if hard[k]})
                fleets = [int(f) for f in row.fleets]
                first = first_routes(problem, fleets)
                for problem.fleet in fleets:
                    found = search(problem, int(row.seed), iterations, tail=tail, first=first.pop(problem.fleet))
                    out = pd.DataFrame(rows_of(int(row.zone), int(row.seed), problem.fleet, int(row.students), row.node_id, units, minutes, found), columns=names)
                    yield out.astype({"node_id": "Int64", "part": "Int32"}) if routes else out

    several = tasks.select(F.col("zone").cast("bigint").alias("zone"), "seed", "fleet").distinct().groupBy("zone", "seed").agg(F.array_sort(F.collect_list("fleet")).alias("f"))
    begin = F.explode(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / FLEETS).cast("int")))
    groups = durable(several.select("zone", "seed", "f", begin.alias("i")).select("zone", "seed", F.slice("f", F.col("i") * FLEETS + 1, FLEETS).alias("fleets")))
    # a task is seconds of work, so few of them go together
    most = 16 * groups.sparkSession.sparkContext.defaultParallelism
    spread = groups.repartition(max(1, min(groups.count(), most)))
    few = zones.agg(F.sum(F.size("node_id"))).first()[0] or 0
    work = spread.join(F.broadcast(zones) if few <= BROADCAST_ROWS else zones, "zone").withColumnRenamed("size", "size_")
    return work.mapInPandas(solve, STOPS if routes else SCHEMA)


def solve_grid(students: DataFrame, stops: DataFrame, seeds: list[int], fleets: list[int], capacity: int, iterations: int, metres_per_min: float = 400.0, tail: int = 0, cap: Column | None = None) -> DataFrame:
    """One row per (zone, seed, fleet) with what the search found; see SCHEMA.

    `students`: (zone, student_id, lat, lon[, radius]), `stops`: (zone, node_id, lat, lon); the school is the mean of the
    zone's stops. `cap` is an expression of a student's longest ride. Zones without stops serve nobody; zones without
    students give no row.
    """
    zones = _zones(_units(students, stops, cap), capacity)
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(k).alias("fleet")) for s in seeds for k in fleets)))
    tasks = zones.select("zone", grid.alias("g")).select("zone", "g.*")
    return _solve(zones, tasks, capacity, iterations, metres_per_min, tail)


def solve_routes(students: DataFrame, stops: DataFrame, tasks: DataFrame, capacity: int, iterations: int, metres_per_min: float = 400.0, tail: int = 0, cap: Column | None = None) -> DataFrame:
    """The routes behind solve_grid's rows for tasks (zone, seed, fleet): a row per stop, the school last without node; see STOPS.

    `part` numbers the units of a stop with more students than seats, `arrive_min` is the time since the school.
    """
    return _solve(_zones(_units(students, stops, cap), capacity), tasks, capacity, iterations, metres_per_min, tail, routes=True)


def solve_fleets(students: DataFrame, stops: DataFrame, seeds: list[int], capacity: int, iterations: int, metres_per_min: float = 400.0, block: int = 3, tail: int = 0, cap: Column | None = None, enough_only: bool = False) -> DataFrame:
    """As solve_grid, with each zone's fleets from ceil(students / capacity) upwards to the first that serves everyone.

    Fleets below packing_bound() can't serve everyone, so the first round has all of them, and `block` from the bound
    on; then come rounds of `block` fleets. Zones whose students are all served drop out, and larger fleets than the
    first that serves all are left out, so `block` changes the work, not the result. A bus for each unit serves
    everyone whom a route of its own serves, so rounds end there; a zone without stops has the least fleet only.

    With `enough_only` a zone that some fleet serves lacks the fleets below its bound, which smallest_fleet() has no use for.
    """
    zones = _zones(_units(students, stops, cap), capacity)
    most = F.aggregate("size", F.lit(0).cast("bigint"), lambda n, x: n + F.ceil(x / capacity))
    least, stopless = F.ceil(F.col("students") / capacity).cast("int"), F.size("node_id") == 0
    open_ = durable(zones.select("zone", least.alias("least"), F.when(stopless, least).otherwise(F.greatest(least, "bound")).alias("bound"), F.when(stopless, least).otherwise(F.greatest(least, most.cast("int"))).alias("most")))
    first = F.col("bound" if enough_only else "least")
    rest, out = open_.select("zone", first.alias("begin"), F.least(F.col("bound") + block - 1, "most").alias("last"), "most"), None
    seed = F.explode(F.array(*map(F.lit, seeds)))
    while not rest.isEmpty():
        tasks = rest.select("zone", F.explode(F.sequence("begin", "last")).alias("fleet")).select("zone", seed.alias("seed"), "fleet")
        found = durable(_solve(zones, tasks, capacity, iterations, metres_per_min, tail))
        full = found.groupBy("zone").agg(F.min(F.when(F.col("served") == F.col("students"), F.col("fleet"))).alias("enough"))
        kept = found.join(full, "zone").where("enough IS NULL OR fleet <= enough").drop("enough")
        out = kept if out is None else out.unionByName(kept)
        short = full.where("enough IS NULL").select("zone")
        rest = durable(rest.join(short, "zone", "left_semi").withColumn("begin", F.col("last") + 1).withColumn("last", F.least(F.col("last") + block, "most")).where("begin <= most"))
    if out is None:
        return _solve(zones, open_.select("zone", F.lit(0).alias("seed"), F.col("least").alias("fleet")), capacity, iterations, metres_per_min)
    if enough_only:
        never = durable(open_.join(out.where("served = students").select("zone").distinct(), "zone", "left_anti").where("least < bound"))
        if not never.isEmpty():
            tasks = never.select("zone", F.explode(F.sequence(F.col("least"), F.col("bound") - 1)).alias("fleet")).select("zone", seed.alias("seed"), "fleet")
            out = out.unionByName(durable(_solve(zones, tasks, capacity, iterations, metres_per_min, tail)))
    return out


def smallest_fleet(solutions: DataFrame) -> DataFrame:
    """Per zone the smallest fleet that serves everyone (else the one that serves most), with its best objective."""
    rank = F.struct((F.col("served") < F.col("students")).alias("short"), F.when(F.col("served") < F.col("students"), -F.col("served")).otherwise(F.col("fleet")).alias("cost"), F.col("fleet"), -F.col("objective"), F.col("seed"))
    best = solutions.groupBy("zone").agg(F.min_by(F.struct("fleet", "seed", "served", "students", "objective"), rank).alias("b"))
    return best.select("zone", "b.*")
