import datetime as dt
import json
import random

import pytest

from darb.functions.jsonio import parse
from darb.operators import schema_drift as sd

SCHEMA = "file_id bigint, producer string, family string, written_at timestamp, received_at timestamp, payload string, profile int, pid string"


def at(k):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=k)


def files(spark, rows):
    """rows: (file_id, producer, hour, payload or object)."""
    return spark.createDataFrame([(i, p, "f", at(h) if h is not None else None, None, x if isinstance(x, str) or x is None else json.dumps(x), 1, "x") for i, p, h, x in rows], SCHEMA)


def changes(spark, rows):
    return sorted(tuple(r) for r in sd.changes(files(spark, rows)).collect())


def brute(rows):
    by, seen, out = {}, set(), []
    for i, p, h, x in rows:
        ok, v = parse(x if isinstance(x, str) or x is None else json.dumps(x))
        if ok and i is not None and i not in seen:
            seen.add(i)
            by.setdefault(p, []).append((h if h is not None else -1, i, v))
    for fs in by.values():
        last, state = None, {}
        for _, i, v in sorted(fs, key=lambda x: x[:2]):
            now = sd.profile(v)
            found, state = sd.step(last, state, now)
            out += [(i, a, b) for a, b in found]
            last = now
    return sorted(out)


@pytest.mark.parametrize(
    "name,want",
    [("mrt_enabled", ["mrt", "enabled"]), ("mrt enabled", ["mrt", "enabled"]), ("mrtEnabled", ["mrt", "enabled"]), ("RuntimeSeconds", ["runtime", "seconds"]), ("busID", ["bus", "id"]), ("HTTPServer", ["http", "server"]), ("ID", ["id"]), ("n_buses2", ["n", "buses2"]), ("", [])],
)
def test_words(name, want):
    assert sd.words(name) == want


def test_kinds_of_change(spark):
    rows = [
        (1, "p", 0, {"a": 1, "b": {"busId": "x"}, "c": None, "gone": 5}),
        (2, "p", 1, {"a": "1", "b": {"bus_id": "x"}, "c": None, "fresh": True}),
        (3, "p", 2, {"a": None, "b": {"bus_id": "x"}, "c": 1, "fresh": True}),
        (4, "p", 3, {"a": 2, "b": {"bus_id": "x"}, "c": 2, "fresh": True}),
    ]
    assert changes(spark, rows) == [(2, "a", "retyped"), (2, "b.bus_id", "renamed"), (2, "fresh", "added"), (2, "gone", "removed"), (4, "a", "retyped")]


def test_rename_by_equal_value_quoted_or_not_with_retype(spark):
    rows = [(1, "p", 0, {"n_buses": 17}), (2, "p", 1, {"fleet": {"count": "17.0"}}), (3, "p", 2, {"fleet": {"total": 5}})]
    assert changes(spark, rows) == [(2, "fleet.count", "renamed"), (2, "fleet.count", "retyped"), (3, "fleet.count", "removed"), (3, "fleet.total", "added")]


def test_types_are_remembered_over_nulls_and_renames_but_not_over_removal(spark):
    rows = [(1, "p", 0, {"x_a": 1}), (2, "p", 1, {"x_b": None}), (3, "p", 2, {"x_b": "s"}), (4, "p", 3, {}), (5, "p", 4, {"x_b": 1})]
    assert changes(spark, rows) == [(2, "x_b", "renamed"), (3, "x_b", "retyped"), (4, "x_b", "removed"), (5, "x_b", "added")]


def test_arrays_comments_order_repeats_and_invalid_files(spark):
    rows = [
        (2, "p", 5, {"r": [{"id": 1}, {"id": "a"}], "_note": {"x": 1}}),
        (1, "p", 1, '{"r": [{"id": 1}]}'),
        (1, "p", 1, '{"r": [{"id": 1}]}'),
        (3, "p", 3, "{bad"),
        (4, "p", 4, '{"r": NaN}'),
        (5, "q", 0, {"Case": 1}),
        (6, "q", 1, {"case": 1}),
        (7, None, 0, {}),
        (8, None, 1, {"n": 1}),
        (None, "p", 2, {"zzz": 1}),
        (9, "p", 9, None),
        (10, "q", None, {"Case": 1, "early": 2}),
    ]
    assert changes(spark, rows) == [(2, "r.id", "retyped"), (5, "early", "removed"), (6, "case", "renamed"), (8, "n", "added")]
    assert changes(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_hot_producer_over_many_partitions_equals_one_scan(spark, seed):
    rng = random.Random(seed)
    keys = ["a_id", "b_id", "count", "n_count", "x", "y"]
    rows = []
    for k in range(300):
        p = "hot" if rng.random() < 0.7 else rng.choice(["q", "r", None])
        payload = {key: rng.choice([None, None, None, 1, "1", "t", True]) for key in keys if rng.random() < 0.8}
        rows.append((k, p, rng.randrange(200), payload if rng.random() < 0.95 else "{"))
    assert changes(spark, rows) == brute(rows)


def test_consistent_table_and_alternatives(spark):
    rows = [(1, "p", 0, {"buses": [{"bus id": "B"}], "n": 17}), (2, "p", 1, {"buses": [{"bus_id": "B"}, {"bus_id": None}], "n": "17.0"}), (3, "p", 2, {"buses": [], "n": True})]
    table = sorted((r.file_id, r.field, r.pos, r.tag, r.v_string, r.v_number, r.v_boolean, r.canonical) for r in sd.consistent_table(files(spark, rows)).collect())
    assert table == [
        (1, "buses.bus id", 0, "string", "B", None, None, "B"),
        (1, "n", 0, "number", None, 17.0, None, "17"),
        (2, "buses.bus id", 0, "string", "B", None, None, "B"),
        (2, "buses.bus id", 1, "null", None, None, None, None),
        (2, "n", 0, "string", "17.0", None, None, "17"),
        (3, "n", 0, "boolean", None, None, True, "true"),
    ]
    seen = {(r.field_path, r.tag): (r.files, r.first_file_id) for r in sd.alternatives(files(spark, rows)).collect()}
    assert seen == {("buses.bus id", "string"): (1, 1), ("buses.bus_id", "string"): (1, 2), ("n", "number"): (1, 1), ("n", "string"): (1, 2), ("n", "boolean"): (1, 3)}


def test_long_and_odd_documents(spark):
    rows = [(1, "p", 0, {"a": "x" * 300_000, "k" * 5000: 1}), (2, "p", 1, {"a": list(range(20_000)), "": {"": 0}}), (3, "p", 2, '{"\\ud800": 1e400, "a": [1]}'), (4, "p", 3, "5")]
    assert changes(spark, rows) == brute(rows)
    assert sd.consistent_table(files(spark, rows)).count() == 2 + 20_001 + 2 + 1
