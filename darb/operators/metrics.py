"""Aggregates over routes, riders and runs. Everything is grouped aggregation with map-side combining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.functions.scalars import TIERS, bin_start, clamped_percent, finite, tier_rank
from darb.operators.ordered import at_ranks, medians


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def _beside(base: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """`base` with the other columns of `more`, one row per group in both; null group values match."""
    renamed = more.select(*(F.col(c).alias(f"__r_{c}") for c in groups), *[c for c in more.columns if c not in groups])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in groups])
    return base.join(renamed, same, "left").drop(*(f"__r_{c}" for c in groups))


def _service_columns() -> list[Column]:
    return [F.sum(F.coalesce(F.col("served"), F.lit(False)).cast("bigint")).alias("served"), F.count("*").alias("total")]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("rate", F.coalesce(F.try_divide("served", "total"), F.lit(0.0)))


def service_rate(riders: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, served, total, rate): rate is 0.0 for a group without riders that count; a null flag is not served."""
    return _with_rate(riders.groupBy(*groups).agg(*_service_columns()))


def utilisation(route_loads: DataFrame, groups: list[str]) -> DataFrame:
    """Mean of load / capacity over routes with a positive capacity."""
    return route_loads.groupBy(*groups).agg(F.coalesce(F.avg(F.when(F.col("capacity") > 0, F.col("load") / F.col("capacity"))), F.lit(0.0)).alias("utilisation"))


def _ratio_columns(on: Column) -> list[Column]:
    ride, direct = finite("ride_min"), finite("direct_min")
    ratio = F.when(on & (direct > 0), ride / direct)
    return [F.avg(ratio).alias("mean_ratio"), F.stddev_pop(ratio).alias("std_ratio"), F.max(ratio).alias("max_ratio"), F.sum((on & ratio.isNull()).cast("bigint")).alias("missing")]


def ride_ratio(riders: DataFrame, groups: list[str]) -> DataFrame:
    """Mean, population deviation and maximum of ride / direct, and how many riders lack a usable pair.

    A pair counts if both are finite and direct is positive; a group without any has nulls.
    """
    return riders.groupBy(*groups).agg(*_ratio_columns(F.lit(True)))


def _violation_columns(on: Column, ride: str, cap: str) -> list[Column]:
    over = F.when(on & F.col(ride).isNotNull() & F.col(cap).isNotNull(), F.col(ride) > F.col(cap))
    return [F.count(over).alias("checked"), F.count_if(over).alias("violations")]


def _with_violation_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("violation_pct", F.try_divide(F.col("violations") * 100.0, "checked"))


def cap_violations(riders: DataFrame, groups: list[str], ride: str = "ride_min", cap: str = "cap_min") -> DataFrame:
    """(groups, checked, violations, violation_pct): rides over their cap among those with both; pct null if none was checked."""
    return _with_violation_pct(riders.groupBy(*groups).agg(*_violation_columns(F.lit(True), ride, cap)))


def _walk_columns(on: Column, speed: float) -> list[Column]:
    walk = F.when(on, F.col("walk_m"))
    used = F.when((F.col("walk_limit_m") > 0) & walk.isNotNull(), F.least(walk / F.col("walk_limit_m"), F.lit(1.0)) * 100.0)
    return [F.avg(walk).alias("avg_m"), F.max(walk).alias("max_m"), F.min(walk).alias("min_m"), (F.avg(walk) / speed).alias("avg_min"), F.avg(used).alias("used_pct")]


def _walk_medians(riders: DataFrame, groups: list[str]) -> DataFrame:
    return medians(riders.select(*groups, "walk_m"), groups, "walk_m").select(*groups, ((F.col("lower") + F.col("upper")) / 2).alias("median_m"))


def walk_statistics(riders: DataFrame, groups: list[str], speed: float = 80.0) -> DataFrame:
    """Mean, exact median, maximum and minimum walk, mean minutes, and mean use of the walk limit in percent."""
    base = riders.groupBy(*groups).agg(*_walk_columns(F.lit(True), speed))
    return _beside(base, _walk_medians(riders, groups), groups)


def mean_with_stale_zeros(riders: DataFrame, groups: list[str], stored: str, fallback: str) -> DataFrame:
    """A stored mean, replaced by the riders' own mean where it is 0 although somebody walks."""
    own, kept = F.avg(fallback), F.max(stored)
    return riders.groupBy(*groups).agg(F.when((kept == 0) & (F.max(fallback) > 0), own).otherwise(kept).alias("mean_m"))


def highest_tier(crossings: DataFrame, rider: str = "student_id") -> DataFrame:
    """The riskiest tier that each rider uses; text that is no tier counts as unknown."""
    return crossings.groupBy(rider).agg(F.max_by(F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("unknown"), tier_rank("tier")).alias("tier"))


def tier_shares(riders: DataFrame, by: str = "stage") -> DataFrame:
    """(by, served, n_<tier>, share_<tier>) per value of `by` and, under '(all)', overall; shares to 4 places."""
    known = F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("unknown")
    counts = [F.count_if(known == t).alias(f"n_{t}") for t in TIERS]
    rolled = riders.rollup(by).agg(F.grouping(by).alias("__all"), F.count("*").alias("served"), *counts)
    shares = [F.round(F.col(f"n_{t}") / F.greatest(F.lit(1), F.col("served")), 4).alias(f"share_{t}") for t in TIERS]
    return rolled.select(F.when(F.col("__all") == 1, "(all)").otherwise(F.coalesce(F.col(by), F.lit("(none)"))).alias(by), "served", *[f"n_{t}" for t in TIERS], *shares)


def edge_usage(walks: DataFrame) -> DataFrame:
    """(lo, hi, students, homes, uses) per undirected edge of walks (u, v, student_id, home)."""
    ends = walks.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "student_id", "home")
    return ends.groupBy("lo", "hi").agg(F.count_distinct("student_id").alias("students"), F.count_distinct("home").alias("homes"), F.count("*").alias("uses"))


def used_and_considered(df: DataFrame, groups: list[str]) -> DataFrame:
    """Percentages of eligible riders who use and who were considered for a crossing; considered is at least used."""
    used, seen, total = F.count_if("used"), F.count_if(F.col("considered") | F.col("used")), F.count_if("eligible")
    return df.groupBy(*groups).agg(clamped_percent(used, total).alias("used_pct"), clamped_percent(seen, total).alias("considered_pct"))


def value_shares(df: DataFrame, group: list[str], value: str, digits: int = 6) -> DataFrame:
    """(group, value, n, share): counts of each value and their share in the group; null is 'unknown'."""
    counts = df.groupBy(*group, F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias(value)).agg(F.count("*").alias("n"))
    key = [*group, "__one"]
    keyed = counts.withColumn("__one", F.lit(1))
    whole = keyed.groupBy(*key).agg(F.sum("n").alias("__n"))
    return _beside(keyed, whole, key).select(*group, value, "n", F.round(F.col("n") / F.col("__n"), digits).alias("share"))


def size_summary(runs: DataFrame) -> DataFrame:
    """Runtime count, mean, min and max, mean of positive iterations, and stop reasons, per instance size and mode."""
    per = runs.groupBy("size", "mode", F.coalesce("stop_reason", F.lit("unknown")).alias("stop_reason")).agg(
        F.count("*").alias("n"), F.count("runtime_s").alias("timed"), F.sum("runtime_s").alias("s"), F.min("runtime_s").alias("lo"), F.max("runtime_s").alias("hi"), F.sum(F.when(F.col("iterations") > 0, F.col("iterations"))).alias("it"), F.count_if(F.col("iterations") > 0).alias("it_n")
    )
    reasons = F.array_sort(F.collect_list(F.struct("stop_reason", "n")))
    return per.groupBy("size", "mode").agg(F.sum("n").alias("runs"), F.try_divide(F.sum("s"), F.sum("timed")).alias("mean_s"), F.min("lo").alias("min_s"), F.max("hi").alias("max_s"), F.try_divide(F.sum("it"), F.sum("it_n")).alias("mean_iterations"), F.array_join(F.transform(reasons, lambda r: F.concat_ws("=", r["stop_reason"], r["n"])), ",").alias("reasons"))


def mean_and_spread(df: DataFrame, groups: list[str], measures: list[str], seed: str, digits: int = 2) -> DataFrame:
    """Per group the number of distinct seeds and, for each measure, 'mean ± sd' (sample deviation, 0 for one value, '-' for none)."""
    cells = []
    for m in measures:
        v = finite(m)
        mean, spread = F.avg(v), F.coalesce(F.stddev_samp(v), F.lit(0.0))
        cells.append(F.when(mean.isNull(), "-").otherwise(F.format_string(f"%.{digits}f ± %.{digits}f", mean, spread)).alias(m))
    return df.groupBy(*groups).agg(F.count_distinct(seed).alias("n_seeds"), *cells)


def throughput(runs: DataFrame, groups: list[str]) -> DataFrame:
    """Mean runtime, mean iterations and the ratio of both; null where the mean runtime is 0."""
    return runs.groupBy(*groups).agg(F.avg("runtime_s").alias("mean_s"), F.avg("iterations").alias("mean_iterations")).withColumn("per_second", F.try_divide("mean_iterations", F.nullif(F.col("mean_s"), F.lit(0.0))))


def histogram(df: DataFrame, groups: list[str], value: str, edges: list[float], flag: str | None = None) -> DataFrame:
    """(groups, bin, n[, hits, rate]) with half-open bins, the last one closed; values outside count nowhere."""
    binned = df.withColumn("bin", bin_start(value, edges)).where("bin IS NOT NULL").groupBy(*groups, "bin")
    if flag is None:
        return binned.agg(F.count("*").alias("n"))
    return binned.agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"), _share(F.coalesce(F.col(flag), F.lit(False))).alias("rate"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """Sums of a measure with a column per value of a fixed list; missing cells are 0."""
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col(measure))), F.lit(0)).alias(f"{measure}_{v}") for v in values]
    return df.groupBy(row).agg(*sums)


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Minimum, maximum, mean, the upper of the two middle values, and how many values are missing."""
    v = finite(value)
    base = df.groupBy(*groups).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"))
    middle = medians(df.select(*groups, v.alias("__v")), groups, "__v").select(*groups, F.col("upper").alias("upper_median"))
    return _beside(base, middle, groups)


def operator_statistics(calls: DataFrame, iterations: int) -> DataFrame:
    """Count, share of iterations, total, mean, best and worst seconds per family and operator; negative times are 0."""
    s = F.greatest(F.col("seconds"), F.lit(0.0))
    return calls.groupBy("family", "op").agg(F.count("*").alias("n"), F.round(F.count("*") * 100.0 / max(1, iterations), 2).alias("frequency_pct"), F.sum(s).alias("total_s"), F.avg(s).alias("avg_s"), F.min(s).alias("best_s"), F.max(s).alias("worst_s"))


def matrix_quality(od: DataFrame, least_ratio: float = 0.0001) -> DataFrame:
    """One row: finite and infinite pairs, the finite ratio to 4 places, whether the matrix may be used."""
    ok = F.col("minutes") < float("inf")
    out = od.agg(F.count_if(ok).alias("finite_pairs"), F.count_if(~ok).alias("infinite_pairs"))
    ratio = F.coalesce(F.try_divide(F.col("finite_pairs").cast("double"), F.col("finite_pairs") + F.col("infinite_pairs")), F.lit(0.0))
    return out.select("*", F.round(ratio, 4).alias("finite_ratio"), ((F.col("finite_pairs") > 0) & (ratio >= least_ratio)).alias("usable"))


def speed_factor(edges: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """One row: configured over base minutes of all edges, held between low and high, 1.0 without edges."""
    return edges.agg(F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), F.try_divide(F.sum("configured_min"), F.sum("base_min")))), F.lit(1.0)).alias("factor"))


def scaled_minutes(od: DataFrame, factor: float) -> DataFrame:
    """Finite minutes times a factor; infinities and metres stay."""
    return od.withColumn("minutes", F.when(F.col("minutes") < float("inf"), F.col("minutes") * factor).otherwise(F.col("minutes")))


def mode_gains(runs: DataFrame, key: str, base: str, others: list[str], measure: str) -> DataFrame:
    """Per key, the base mode's value and each other mode's gain over it in percent, to 1 place; null if one is missing."""
    value = lambda m: F.max(F.when(F.col("mode") == m, F.col(measure)))
    wide = runs.groupBy(key).agg(value(base).alias("base"), *(value(m).alias(f"v_{m}") for m in others))
    gains = [F.round(F.try_divide((F.col(f"v_{m}") - F.col("base")) * 100.0, F.nullif(F.col("base"), F.lit(0.0))), 1).alias(f"gain_{m}") for m in others]
    return wide.select(key, "base", *gains)


def node_degrees(edges: DataFrame, rank: str = "class_rank") -> DataFrame:
    """(node, degree, out_rank): edges at either end, and the best class of those that leave; loops count twice."""
    ends = edges.select(F.col("u").alias("node"), F.col(rank).alias("r")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("r")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.max("r").alias("out_rank"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b, changed) of two (key, value) tables, whichever side has the key."""
    left, right = a.select("key", F.col("value").alias("a")), b.select("key", F.col("value").alias("b"))
    return left.join(right, "key", "full_outer").select("key", "a", "b", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in `order`: an upsert of a ledger. Of rows that tie the one with the largest hash of its other columns counts.

    max_by over a struct combines before the shuffle, so a key with a third of all rows costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    hashed = [F.col(c) for c, kind in df.dtypes if c in rest and "map<" not in kind]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *([F.xxhash64(*hashed).alias("__hash")] if hashed else []))).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*df.columns)


def union_minimum(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The least value per key over several tables of one layout."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.min(value).alias(value))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in `order`, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def shared_boost(candidates: DataFrame) -> DataFrame:
    """Candidates re-ranked: those wanted by at least two students first, by popularity, then by their own rank."""
    popular = candidates.groupBy("node_id").agg(F.count_distinct("student_id").alias("popularity"))
    joined = candidates.join(popular, "node_id")
    order = Window.partitionBy("student_id").orderBy(F.desc(F.col("popularity") >= 2), F.desc("popularity"), "rank", "node_id")
    return joined.select("student_id", "node_id", "popularity", F.row_number().over(order).alias("new_rank"))


def quartiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, q1, q2, q3), linear between ranks, exact at any size."""
    v = df.select(*groups, finite(value).alias("__v"))
    at = {f"{side}{i}": f(F.lit(i / 4) * (F.col("n") - 1)) for i in (1, 2, 3) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = at_ranks(v, groups, "__v", at)
    part = lambda i: F.lit(i / 4) * (F.col("n") - 1) - F.floor(F.lit(i / 4) * (F.col("n") - 1))
    return found.select(*groups, "n", *((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part(i)).alias(f"q{i}") for i in (1, 2, 3)))


def box(df: DataFrame, groups: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """South, west, north, east and centre of each group's points."""
    out = df.groupBy(*groups).agg(F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))
    return out.withColumn("lat", (F.col("south") + F.col("north")) / 2).withColumn("lon", (F.col("west") + F.col("east")) / 2)


def mode_bundle(riders: DataFrame, routes: DataFrame, mode: str = "mode", speed: float = 80.0) -> DataFrame:
    """One row per mode with a run's figures: service, rides, walks and routes side by side.

    `riders`: (mode, served, ride_min, direct_min, cap_min, walk_m, walk_limit_m), `routes`: (mode, load, capacity,
    total_min, total_km). The riders are aggregated in one pass, their medians in another; all meet on the few modes.
    """
    g, on = [mode], F.coalesce(F.col("served"), F.lit(False))
    out = riders.groupBy(*g).agg(*_service_columns(), *_ratio_columns(on), *_violation_columns(on, "ride_min", "cap_min"), *_walk_columns(on, speed))
    out = _beside(_with_violation_pct(_with_rate(out)), _walk_medians(riders.where(on), g), g)
    active = routes.where("load > 0")
    used = F.avg(F.when(F.col("capacity") > 0, F.col("load") / F.col("capacity")))
    totals = active.groupBy(mode).agg(F.coalesce(used, F.lit(0.0)).alias("utilisation"), F.count("*").alias("active_routes"), F.sum("total_min").alias("route_min"), F.sum("total_km").alias("route_km"), F.avg("total_min").alias("mean_route_min"))
    return _beside(out, totals, g)


def manifest(df: DataFrame, groups: list[str], seed: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count_distinct(seed).alias("seeds"), F.count("*").alias("rows"))


def tagged_union(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """Tables one under another with the name of each; columns that a table lacks are null."""
    out = None
    for tag, df in parts.items():
        tagged = df.withColumn(name, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def elapsed(log: DataFrame, group: str, order: str, at: str) -> DataFrame:
    """Adds elapsed: time since the log's previous row of the group, in the unit of `at`; null for the first."""
    return log.withColumn("elapsed", F.col(at) - F.lag(at).over(Window.partitionBy(group).orderBy(order)))


def trailing(log: DataFrame, group: str, k: str, value: str, patience: int) -> DataFrame:
    """Adds stop: whether a search over growing k would stop at this row, its value not beating the best for `patience` rows."""
    from darb.operators.routes import best_so_far

    return best_so_far(log, group, k, value).withColumn("stop", F.col("stalled") >= patience)
