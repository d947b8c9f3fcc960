import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from darb.llm import percentiles as pc


def test_keys_keep_the_order_of_doubles(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 7.999999999999999, 8.0]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [math.ldexp(1.0, k) for k in range(-1074, 1024, 3)] + [math.ldexp(1 - 2**-53, k) for k in range(-1000, 1024, 3)]
    values = [v for v in values if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", pc.order_key(F.col("v")).alias("k"), pc.key_value(pc.order_key(F.col("v"))).alias("back")).collect()
    assert all(r.v == r.back for r in rows)
    ordered = sorted(rows, key=lambda r: r.v)
    assert all((a.k < b.k) == (a.v < b.v) for a, b in zip(ordered, ordered[1:]))


def groups(spark, data):
    return spark.createDataFrame([(g, x, "n", 1) for g, x in data], "g string, x double, pct string, prefix int")


def test_exact_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e3), float(rng.randrange(5)), -rng.random() * 1e-9])) for _ in range(3000)] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    bad = [("a", None), ("a", float("nan")), ("none", None)]
    wanted = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.g, r.pct): (r.n, r.value) for r in pc.percentiles(groups(spark, data + bad), ["g"], "x", wanted).collect()}
    for g in {g for g, _ in data}:
        xs = [x for h, x in data if h == g]
        for p in wanted:
            assert got[g, p][0] == len(xs) and got[g, p][1] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-15)
    assert len(got) == 5 * len({g for g, _ in data})


def test_infinities_ties_and_empty(spark):
    data = [("a", math.inf), ("a", 1.0), ("a", -math.inf), ("t", 5.0)] + [("t", 5.0)] * 50
    got = {(r.g, r.pct): r.value for r in pc.percentiles(groups(spark, data), ["g"], "x", [0.0, 0.5, 1.0]).collect()}
    assert [got["a", p] for p in (0.0, 0.5, 1.0)] == [-math.inf, 1.0, math.inf] and got["t", 0.5] == 5.0
    assert pc.percentiles(groups(spark, data).limit(0), ["g"], "x", [0.5]).count() == 0


def test_merged_sketches_equal_the_whole_within_their_bound(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), rng.lognormvariate(3, 2) * rng.choice([1, -1])) for _ in range(4000)]
    df = groups(spark, data).withColumn("day", F.abs(F.hash("x")) % 5)
    days = pc.sketch(df, ["day", "g"], "x", 24)
    merged = pc.merge_sketches(days.drop("day"), ["g"])
    exact = {(r.g, r.pct): r.value for r in pc.percentiles(df, ["g"], "x", [0.1, 0.5, 0.95]).collect()}
    whole = {(r.g, r.pct): (r.n, r.value) for r in pc.sketch_percentiles(pc.sketch(df, ["g"], "x", 24), ["g"], [0.1, 0.5, 0.95], 24).collect()}
    parts = {(r.g, r.pct): (r.n, r.value) for r in pc.sketch_percentiles(merged, ["g"], [0.1, 0.5, 0.95], 24).collect()}
    assert parts == whole
    for key, value in exact.items():
        assert parts[key][1] == pytest.approx(value, rel=2**-11)


METRICS = "row_id bigint, cohort int, mode string, avg_walk_dist_m double, total_route_time_min double, metric string, v double, loaded_at timestamp"


def test_wide_tails_rules(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(k, 10, [" mode a", "Mode A ", "MODE A"][k % 3], 1.0 if k < 90 else 10.0, 50.0, "m", 1.0, at) for k in range(100)]
    rows += rows[:50]  # repeats count once
    rows += [(1000, 10, "Mode A", None, 9999.0, None, None, at), (1001, 10, "Mode A", float("nan"), float("inf"), None, None, None), (None, 10, "Mode A", 1e9, 1e9, None, None, None), (1002, None, None, 5.0, 5.0, None, None, None)]
    got = sorted((r.cohort, r.mode_name, r.metric) for r in pc.wide_tails(spark.createDataFrame(rows, METRICS)).collect())
    assert got == [(10, "Mode A", "avg_walk_dist_m")]
    assert pc.wide_tails(spark.createDataFrame([], METRICS)).count() == 0
