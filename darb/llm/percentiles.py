"""Percentiles per group of very large numeric columns, by radix selection.

A double is mapped to a 64-bit integer of the same order. The bits are looked at digit by digit from the top:
one pass counts, per group and digit value, the rows whose higher digits are those of a wanted rank, and the
digit in which the rank falls is the next digit of the answer. Rows outside that digit drop out of the next
pass. Each pass is a map-side combined count, so what is shuffled is at most (groups x ranks x digit values)
per task and not the rows, and a group with a third of all rows is no slower than another. After `bits` bits a
value is known to a relative error of 2^-(bits - 12) (bits 13 and up hold the mantissa), after 64 it is exact.

The counts of a fixed number of leading bits are a sketch (`sketch`): sketches of days or partitions are added
row by row (`merge_sketches`) and give the same percentiles, within the same error, as the whole
(`sketch_percentiles`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.session import durable, small_side

DIGIT_BITS = 16


def order_key(value: Column) -> Column:
    """64-bit integer in the order of the double `value`: -inf < ... < -0.0 = 0.0 < ... < inf < NaN.

    The IEEE bit pattern of the magnitude, negated for negative values, from exact arithmetic on powers of two.
    """
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")  # may be off by one next to powers of two
    e = guess + (a >= F.pow(F.lit(2.0), guess + 1)).cast("int") - (a < F.pow(F.lit(2.0), guess)).cast("int")
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("bigint")
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + mantissa
    tiny = (a * 2.0**537 * 2.0**537).cast("bigint")
    bits = F.when(F.isnan(v), 0x7FF8 << 48).when(a == float("inf"), 0x7FF0 << 48).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an order key."""
    bits = F.abs(key)
    e, m = F.shiftright(bits, 52).cast("int"), bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    a = F.when(e == 0, m * 2.0**-1074).when(e >= 2047, F.when(m == 0, float("inf")).otherwise(float("nan"))).otherwise((m / float(1 << 52) + 1.0) * F.pow(F.lit(2.0), e - 1023))
    return F.when(key < 0, -a).otherwise(a)


def _same(names: list[str]) -> Column:
    """Equality of `names` with their twins, named h_..., of the other side; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in names])


def _ranks(counts: DataFrame, groups: list[str], percentiles: list[float]) -> DataFrame:
    """The 0-based ranks between which each percentile is interpolated: (groups, pct, side, rank, weight, n)."""
    each = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("pct")) for p in percentiles)))
    at = counts.withColumn("p", each).select(*groups, "n", F.col("p.pct").alias("pct"))
    position = F.col("pct") * (F.col("n") - 1)
    low = at.select(*groups, "n", "pct", F.floor(position).alias("rank"), (1 - (position - F.floor(position))).alias("weight"), F.lit(0).alias("side"))
    high = at.select(*groups, "n", "pct", F.ceil(position).alias("rank"), (position - F.floor(position)).alias("weight"), F.lit(1).alias("side"))
    return low.unionByName(high)


def _pick(histogram: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
    """Per target the digit that holds its rank: histogram (groups, prefix, digit, n), targets with prefix and rank in it."""
    window = Window.partitionBy(*groups, "prefix").orderBy("digit")
    below = F.sum("n").over(window) - F.col("n")
    spans = histogram.select(*(F.col(c).alias(f"h_{c}") for c in [*groups, "prefix"]), F.col("digit").alias("h_digit"), below.alias("h_below"), F.col("n").alias("h_n"))
    joined = spans.join(small_side(targets), _same([*groups, "prefix"]) & F.expr("rank >= h_below AND rank < h_below + h_n"))
    kept = [c for c in targets.columns if c not in ("prefix", "rank")]
    return joined.select(*kept, F.col("h_digit").alias("prefix"), F.expr("rank - h_below").alias("rank"))


def percentiles(df: DataFrame, groups: list[str], value: str, wanted: list[float], bits: int = 64) -> DataFrame:
    """(groups, n bigint, pct double, value double): percentiles of `value` per group, linear between ranks.

    `wanted` are fractions from 0 to 1. Null and NaN values don't count; infinities do, as the values that they
    are. Null group values are a group of their own; groups without a value that counts give no row; ties and
    repeated rows count as they stand; other columns are ignored. With `bits` under 64 each answer is the
    smallest value of those that share the leading bits.
    """
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = durable(rows.select(*names, order_key(F.col("v")).alias("key")))
    targets, shift = None, 64
    while shift > 64 - bits:
        shift = max(shift - DIGIT_BITS, 0)
        digit = F.shiftright(F.col("key"), shift)  # the digit with all higher ones
        if targets is None:
            histogram = durable(rows.select(*names, F.lit(0).cast("bigint").alias("prefix"), digit.alias("digit")).groupBy(*names, "prefix", "digit").agg(F.count("*").alias("n")))
            targets = _ranks(histogram.groupBy(*names).agg(F.sum("n").alias("n")), names, wanted).withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            # groups x ranks: broadcast if that is few, so that the rows needn't move; shuffled otherwise
            active = small_side(targets.select(*(F.col(c).alias(f"h_{c}") for c in [*names, "prefix"])).distinct())
            above = rows.withColumn("prefix", F.shiftright(F.col("key"), shift + DIGIT_BITS))
            left = above.join(active, _same([*names, "prefix"]), "left_semi")
            histogram = left.select(*names, "prefix", digit.alias("digit")).groupBy(*names, "prefix", "digit").agg(F.count("*").alias("n"))
        targets = durable(_pick(histogram, targets, names))
    number = key_value(F.shiftleft(F.col("prefix"), shift))
    both = targets.groupBy(*names, "n", "pct").agg(F.max(F.when(F.col("side") == 0, number)).alias("a"), F.max(F.when(F.col("side") == 1, number)).alias("b"), F.max(F.when(F.col("side") == 1, F.col("weight"))).alias("w"))
    answer = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    return both.select(*(F.col(n).alias(g) for g, n in zip(groups, names)), "n", "pct", answer.alias("value"))


def sketch(df: DataFrame, groups: list[str], value: str, bits: int = 24) -> DataFrame:
    """Mergeable sketch (groups, digit bigint, n bigint): counts of the leading `bits` bits of the values that count."""
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    return rows.groupBy(*groups, F.shiftright(order_key(F.col("__v")), 64 - bits).alias("digit")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """One sketch of several of equal bits: the union of their rows goes in, the sums come out."""
    return sketches.groupBy(*groups, "digit").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketched: DataFrame, groups: list[str], wanted: list[float], bits: int = 24) -> DataFrame:
    """(groups, n, pct, value): as percentiles(..., bits=bits) of the rows that the sketch counted."""
    histogram = sketched.withColumn("prefix", F.lit(0).cast("bigint"))
    totals = sketched.groupBy(*groups).agg(F.sum("n").alias("n"))
    targets = _ranks(totals, groups, wanted).withColumn("prefix", F.lit(0).cast("bigint"))
    picked = _pick(histogram, targets, groups)
    number = key_value(F.shiftleft(F.col("prefix"), 64 - bits))
    both = picked.groupBy(*groups, "n", "pct").agg(F.max(F.when(F.col("side") == 0, number)).alias("a"), F.max(F.when(F.col("side") == 1, number)).alias("b"), F.max(F.when(F.col("side") == 1, F.col("weight"))).alias("w"))
    return both.select(*groups, "n", "pct", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))


METRICS = ("avg_walk_dist_m", "total_route_time_min")


def metric_values(metrics: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(cohort, mode_name, metric, v, *more) of raw_metrics_tidy: every row_id once, values that are measurements.

    `mode_name` is the trimmed mode as 'Mode A'; null, NaN, infinite and 9999.0 are left out. A null row_id is
    no run and doesn't count. The mode is a key beside the id, which names one record and so has one mode: with
    numbers only to keep, rows are combined by hashing instead of sorting.
    """
    mode = F.initcap(F.trim(F.regexp_replace("mode", r"\s+", " ")))
    runs = metrics.where("row_id IS NOT NULL").select("row_id", "cohort", mode.alias("mode_name"), *METRICS, *more)
    once = runs.groupBy("row_id", "mode_name").agg(*(F.first(c).alias(c) for c in ("cohort", *METRICS, *more)))
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS)))
    long = once.select("cohort", "mode_name", *more, pair.alias("p")).select("cohort", "mode_name", "p.metric", "p.v", *more)
    return long.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity') AND v <> 9999.0")


def wide_tails(metrics: DataFrame, ratio: float = 3.0) -> DataFrame:
    """p2: (cohort, mode_name, metric) of the groups whose 95th percentile is at least `ratio` times their median."""
    found = percentiles(metric_values(metrics), ["cohort", "mode_name", "metric"], "v", [0.5, 0.95])
    both = found.groupBy("cohort", "mode_name", "metric").agg(F.max(F.when(F.col("pct") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("pct") == 0.95, F.col("value"))).alias("p95"))
    return both.where(F.col("p95") >= ratio * F.col("p50")).select("cohort", "mode_name", "metric")
