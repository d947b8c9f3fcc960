import json

from hypothesis import given, settings
from hypothesis import strategies as st

from darb.functions.jsonio import Number, parse, unwrap
from darb.operators.shred import assemble, nested_items, shred, shred_value, whole_number

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text().filter(lambda k: not k.startswith("_")), c, max_size=4), max_leaves=25)


def unwrapped(v):
    v = unwrap(v)
    if isinstance(v, dict):
        return {k: unwrapped(x) for k, x in v.items() if not k.startswith("_")}
    return [unwrapped(x) for x in v] if isinstance(v, list) else v


@settings(max_examples=300, deadline=None)
@given(values)
def test_exact_round_trip(value):
    ok, parsed = parse(json.dumps(value))
    assert ok and assemble(shred_value(1, parsed)) == unwrapped(parsed)


def test_numbers_keep_their_digits_and_invalid_json_is_refused():
    assert parse("[99929969577653098123, 1.50]") == (True, [Number("99929969577653098123"), Number("1.50")])
    for bad in ("{", "", "NaN", "[1,]", "{'a':1}", None, "[" * 200_000):
        assert parse(bad) == (False, None)


REQUESTS = "request_id bigint, data string, node string, label int"
RUNS = "output_id bigint, payload string"


def found(spark, requests, runs=()):
    q = spark.createDataFrame([(i, d, "n", 1) for i, d in requests], REQUESTS)
    r = spark.createDataFrame(list(runs), RUNS)
    return sorted(tuple(x) for x in nested_items(q, r).collect())


def test_positions_parents_and_odd_parts(spark):
    block = {
        "buses": [None, {"id": "B1", "capacity": "14"}, {"id": 10**25, "capacity": 22.0}, {"capacity": None}, "loose"],
        "routes": {"id": "R1", "path": [{"node_id": 5}, None, {"node_id": "x", "students": {"id": "S1"}}, {"students": [None, {"id": None}]}]},
        "_comment": {"buses": [{"id": "no"}]},
    }
    text = json.dumps(block)
    want = sorted(
        [(1, "bus", "", 1, "B1"), (1, "bus", "", 2, "1" + "0" * 25), (1, "bus", "", 3, ""), (1, "capacity", "1", 0, "14"), (1, "capacity", "2", 0, "22"), (1, "route", "", 0, "R1")]
        + [(1, "stop", "0", 0, "5"), (1, "stop", "0", 2, "x"), (1, "stop", "0", 3, ""), (1, "student", "0/2", 0, "S1"), (1, "student", "0/3", 1, "")]
    )
    assert found(spark, [(1, text), (1, text)]) == want
    assert found(spark, [(1, json.dumps(text))]) == want  # kept as text
    block["buses"] = json.dumps(block["buses"])
    assert found(spark, [(1, json.dumps(block))]) == want


def test_runs(spark):
    run = {"modes": {"A": {"routes": [{"route_id": 7}, {"students": 1}]}, "B": None, "_c": {"routes": [{"route_id": "no"}]}, "D": {"skipped": True}}, "debug_stats": json.dumps({"synthetic_crossings": [{"strategy": "s"}, {"strategy": None}, {"added": 1}]}), "other": {"synthetic_crossings": {"strategy": "no"}}}
    assert found(spark, [], [(5, json.dumps(run)), (5, json.dumps(run)), (6, "{")]) == [(5, "crossing", "", 0, "s"), (5, "run_route", "A", 0, "7"), (5, "run_route", "A", 1, "")]


def test_nulls_empty_long_and_scalar_records(spark):
    long = json.dumps({"buses": [{"id": "x" * 200_000, "note": "é" * 100_000}]})
    got = found(spark, [(None, "{}"), (1, None), (2, ""), (3, "7"), (4, "[]"), (5, '{"buses": []}'), (6, '{"buses": "\\ud800"}'), (7, long)], [(None, None)])
    assert [(r[0], r[1], len(r[4])) for r in got] == [(7, "bus", 200_000)]
    assert found(spark, []) == []
    nodes = shred(spark.createDataFrame([(5, '{"a": [[], [1]], "b": "\\ud800"}', "n", 1)], REQUESTS), "request_id", "data").collect()
    assert [(n.node, n.parent, n.label, n.ordinal, n.kind, n.scalar) for n in sorted(nodes, key=lambda n: n.node)] == [(0, -1, "", None, "object", None), (1, 0, "a", 0, "empty", None), (2, 0, "a", 1, "array", None), (3, 2, "", 0, "number", "1"), (4, 0, "b", None, "string", "?")]


def test_whole_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("22.0",), (" 7 ",), ("1e2",), ("12.5",), ("many",), ("99999999999999999999999999999999999999999",), (None,)], "t string")
    assert [r[0] for r in df.select(whole_number(F.col("t"))).collect()] == ["22", "7", "100", "12.5", "many", "9" * 41, None]
