import random

import pytest

from darb.operators import graph, search


def streets(spark, nodes, edges, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([0.5, 1.0, 2.0, 3.7]), float(rng.randrange(1, 9)), rng.choice([None, *map(float, range(0, 360, 20))])) for _ in range(edges)]
    rows = [(f"{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "edge string, u bigint, v bigint, minutes double, metres double, bearing double"), rows


def walked(rows, source, limit):
    """Least minutes with turns by trying every path of edges, cheapest first."""
    import heapq

    best, heap = {}, [(r[3], r[0]) for r in rows if r[1] == source and r[3] <= limit]
    by = {r[0]: r for r in rows}
    heapq.heapify(heap)
    while heap:
        cost, e = heapq.heappop(heap)
        if e in best:
            continue
        best[e] = cost
        for f in rows:
            if f[1] != by[e][2] or f[0] in best:
                continue
            d = None if by[e][5] is None or f[5] is None else abs((by[e][5] - f[5] + 180) % 360 - 180)
            if d is not None and d > 140:
                continue
            new = cost + (f[3] + (0.2 if d is not None and d > 45 else 0.0))
            if new <= limit:
                heapq.heappush(heap, (new, f[0]))
    out = {source: 0.0}
    for e, cost in best.items():
        out[by[e][2]] = min(out.get(by[e][2], cost), cost)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_are_those_of_all_paths(spark, seed):
    e, rows = streets(spark, 25, 150, seed)
    e = e.unionByName(spark.createDataFrame([("n", 1, 2, None, 1.0, 0.0), ("i", 1, 2, float("inf"), 1.0, 0.0)], e.schema))
    got = {}
    for r in graph.turn_aware_times(spark.createDataFrame([(1,), (2,), (99,), (2,)], "node int"), e, 6.0).collect():
        got.setdefault(r.source, {})[r.node] = r.minutes
    assert got == {1: pytest.approx(walked(rows, 1, 6.0)), 2: pytest.approx(walked(rows, 2, 6.0)), 99: {99: 0.0}}


def test_turns_of_a_junction_are_no_table(spark, monkeypatch):
    """1,000 ways into a junction and 1,000 out of it are a million turns."""
    kept = []
    for module in (graph, search):
        monkeypatch.setattr(module, "durable", lambda d, eager=True, f=module.durable: kept.append((out := f(d, eager)).count()) or out)
    ways = spark.range(1, 1001).selectExpr("id", "CAST(id % 360 AS DOUBLE) AS b")
    e = ways.selectExpr("concat('i', id) AS edge", "id AS u", "0L AS v", "1.0D AS minutes", "b AS bearing").unionByName(ways.selectExpr("concat('o', id)", "0L", "id + 1000", "1.0D", "b").toDF("edge", "u", "v", "minutes", "bearing"))
    got = {r.node: r.minutes for r in graph.turn_aware_times(spark.createDataFrame([(5,)], "node bigint"), e, 60.0).collect()}
    turned = lambda k: abs((5 - k % 360 + 180) % 360 - 180)
    assert got == pytest.approx({5: 0.0, 0: 1.0} | {k + 1000: 2.0 if turned(k) <= 45 else 2.2 for k in range(1, 1001) if turned(k) <= 140})
    assert max(kept) <= 2000


def no_rounds(monkeypatch, names):
    def fails(*_):
        raise AssertionError("rounds of joins")

    for name in names:
        monkeypatch.setattr(graph, name, fails)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def messy(spark, seed):
    """Streets with parallel edges, costs of 0, loops and edges that don't exist."""
    e, _ = streets(spark, 30, 120, seed)
    e = e.selectExpr("u", "v", "CASE WHEN u % 7 = 0 THEN 0.0D ELSE minutes END AS cost", "metres")
    return e.unionByName(spark.createDataFrame([(1, 2, None, 1.0), (1, 2, float("inf"), 1.0), (1, 3, float("nan"), 1.0)], e.schema))


@pytest.mark.parametrize("seed", [3, 4])
def test_matrices_are_those_of_rounds(spark, monkeypatch, seed):
    e = messy(spark, seed)
    seeds = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.5, 3.0), (7, 7, 0.0, 0.0), (99, 99, 0.0, 0.0), (8, 8, 50.0, 0.0)], "source bigint, node bigint, cost double, metres double")
    want = rows_of(graph._rounds_with_length(seeds, e, 5.0)), rows_of(graph._rounds(seeds, e, 5.0))
    people = spark.createDataFrame([(1,), (7,), (99,)], "node bigint")
    goals = spark.createDataFrame([(k,) for k in (1, 3, 6, 9, 12, 99, 99, 500)], "node bigint")
    ways = e.withColumnRenamed("cost", "minutes")
    start = people.selectExpr("node AS source", "node", "0.0D AS cost", "0.0D AS metres")
    wanted = rows_of(graph._rounds_with_length(start, e, 5.0).join(goals, "node", "left_semi").select("source", "node", "cost", "metres"))
    no_rounds(monkeypatch, ["_rounds", "_rounds_with_length"])
    assert rows_of(graph.shortest_with_length(seeds, e, 5.0)) == want[0]
    assert rows_of(graph.shortest_within(seeds.drop("metres"), e, 5.0)) == want[1]
    assert rows_of(graph.travel_matrix(people, goals, ways, 5.0)) == wanted
    assert rows_of(graph.shortest_within(seeds.limit(0), e, 5.0)) == []
    assert rows_of(graph.shortest_within(seeds.where("source = 1").drop("metres"), e.limit(0), 5.0)) == [(1, 1, 0.0), (1, 2, 0.5)]


def test_steps_are_those_of_rounds(spark, monkeypatch):
    e = messy(spark, 5)
    seeds = spark.createDataFrame([(1, 1, 0.0), (7, 7, 0.0), (99, 99, 0.0)], "source int, node int, cost double")
    want = rows_of(graph.shortest_paths(graph._rounds(seeds, e, 5.0), e))
    no_rounds(monkeypatch, ["_rounds", "shortest_paths"])
    got = graph.shortest_steps(seeds, e, 5.0)
    assert rows_of(got) == want and len({r[2] for r in want}) > 5
