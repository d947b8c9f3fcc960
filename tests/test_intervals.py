import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from darb.operators.intervals import IntervalMap, merge_intervals, student_periods

D = dt.date


def brute(ranges):
    days = sorted({d for a, b in ranges for d in range(a, b + 1)})
    periods = []
    for d in days:
        if periods and periods[-1][1] == d - 1:
            periods[-1][1] = d
        else:
            periods.append([d, d])
    return [tuple(p) for p in periods]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 60), st.integers(0, 15)), max_size=25))
def test_map_equals_brute_force(pairs):
    ranges = [(a, a + n) for a, n in pairs]
    m = IntervalMap()
    for a, b in ranges:
        m.insert(a, b)
    periods = brute(ranges)
    assert m.periods() == periods
    assert m.gaps() == [(a[1] + 1, b[0] - 1) for a, b in zip(periods, periods[1:])]


def rows(df):
    return sorted((r.entity, r.span_kind, r.first_day, r.last_day) for r in df.collect())


def test_overlaps_nesting_adjacency_and_gaps(spark):
    df = spark.createDataFrame(
        [("a", D(2024, 1, 1), D(2024, 1, 5)), ("a", D(2024, 1, 2), D(2024, 1, 3)), ("a", D(2024, 1, 6), D(2024, 1, 6)), ("a", D(2024, 1, 9), D(2024, 1, 9)), ("b", D(2024, 1, 1), D(2024, 1, 1)), ("b", D(2024, 1, 1), D(2024, 1, 1))],
        "entity string, a date, b date",
    )
    assert rows(merge_intervals(df, "entity", "a", "b")) == [
        ("a", "gap", D(2024, 1, 7), D(2024, 1, 8)),
        ("a", "period", D(2024, 1, 1), D(2024, 1, 6)),
        ("a", "period", D(2024, 1, 9), D(2024, 1, 9)),
        ("b", "period", D(2024, 1, 1), D(2024, 1, 1)),
    ]


def test_nulls_wrong_order_empty_and_clashing_columns(spark):
    schema = "entity string, a date, b date, first_day string, span_kind int, last_day int"
    df = spark.createDataFrame([(None, D(2024, 1, 1), D(2024, 1, 2), "x", 1, 2), ("a", None, D(2024, 1, 2), None, None, None), ("a", D(2024, 1, 1), None, None, None, None), ("a", D(2024, 1, 3), D(2024, 1, 2), None, None, None)], schema)
    assert rows(merge_intervals(df, "entity", "a", "b")) == []
    assert rows(merge_intervals(df.limit(0), "entity", "a", "b")) == []


def test_hot_entity_and_small_memory(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.5 else f"e{rng.randrange(40)}", rng.randrange(3000), rng.randrange(6)) for _ in range(4000)]
    base = D(2020, 1, 1)
    df = spark.createDataFrame([(e, base + dt.timedelta(a), base + dt.timedelta(a + n)) for e, a, n in data], "entity string, a date, b date").repartition(7)
    want = []
    for entity in {e for e, _, _ in data}:
        want += [(entity, "period", base + dt.timedelta(a), base + dt.timedelta(b)) for a, b in brute([(a, a + n) for e, a, n in data if e == entity])]
    for held in (3, 200_000):
        assert sorted(r for r in rows(merge_intervals(df, "entity", "a", "b", held)) if r[1] == "period") == sorted(want)


def test_student_ids_are_trimmed_and_upper_cased(spark):
    schema = "request_id bigint, meta struct<student_id:string,valid_from:date,valid_until:date>"
    df = spark.createDataFrame([(1, (" s1", D(2024, 2, 28), D(2024, 2, 29))), (2, ("S1\t", D(2024, 3, 1), D(2024, 3, 2))), (3, None)], schema)
    assert [tuple(r) for r in student_periods(df).collect()] == [("S1", "period", "2024-02-28", "2024-03-02")]
