"""Paired tests and corrections, ranks by windows, exact p-values in one Arrow pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.operators.ordered import join_counted, medians, with_running_total


def paired_deltas(df: DataFrame, groups: list[str], seed: str, mode: str, first: str, second: str, measure: str) -> DataFrame:
    """(groups, seed, delta): first mode less second, for seeds that have both, each with a non-null value.

    Several values of a seed and mode are averaged.
    """
    value = lambda m: F.avg(F.when(F.col(mode) == m, F.col(measure)))
    both = df.where(F.col(mode).isin(first, second)).groupBy(*groups, seed).agg(value(first).alias("__a"), value(second).alias("__b"))
    return both.where("__a IS NOT NULL AND __b IS NOT NULL").select(*groups, seed, (F.col("__a") - F.col("__b")).alias("delta"))


def average_ranks(df: DataFrame, groups: list[str], by: Column, name: str = "rank") -> DataFrame:
    """Ranks from 1 per group with ties at their mean rank.

    Ties are counted before counts are summed up over the distinct values, in range partitions; rows get their
    rank by join_counted: neither a hot value nor a hot group is one task's. Null groups are groups, null values have
    the lowest rank.
    """
    keyed = df.withColumn("__v", by)
    counts = keyed.groupBy(*groups, "__v").agg(F.count("*").alias("__c"))
    ranked = with_running_total(counts, groups, ["__v"], "__c", "__to")
    return join_counted(keyed, ranked.select(*groups, "__v", "__c", (F.col("__to") - (F.col("__c") - 1) / 2.0).alias(name)), [*groups, "__v"], "__c").drop("__v", "__c")


def signed_rank(deltas: DataFrame, groups: list[str], digits: int = 9) -> DataFrame:
    """(groups, n_pairs, n_used, w_plus, w_minus, w, rank_biserial, median_delta, mean_delta).

    Zero deltas (to `digits` places) are dropped before ranking; a group of zeros has no ranks and nulls.
    """
    rounded = deltas.withColumn("__d", F.round("delta", digits))
    ranked = average_ranks(rounded.where("__d <> 0"), groups, F.abs(F.col("__d")))
    sums = ranked.groupBy(*groups).agg(F.count("*").alias("n_used"), F.sum(F.when(F.col("__d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("__d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    base = deltas.groupBy(*groups).agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_delta"))
    middle = medians(deltas.select(*groups, "delta"), groups, "delta").select(*groups, ((F.col("lower") + F.col("upper")) / 2).alias("median_delta"))
    joined = base.join(middle, groups, "left").join(sums, groups, "left")
    total = F.col("w_plus") + F.col("w_minus")
    return joined.select(*groups, "n_pairs", F.coalesce("n_used", F.lit(0)).alias("n_used"), "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), F.try_divide(F.col("w_plus") - F.col("w_minus"), total).alias("rank_biserial"), "median_delta", "mean_delta")


def exact_p(ranks: list[float], w: float) -> float:
    """Two-sided p: the share of all sign choices whose smaller rank sum is at most w.

    Shares of rank sums are added up rank by rank, so any number of ranks will do (time grows with its cube).
    """
    doubled = [round(2 * r) for r in ranks]
    share = np.zeros(sum(doubled) + 1)
    share[0] = 1.0
    for r in doubled:
        share *= 0.5
        share[r:] += share[: len(share) - r].copy()
    limit, total = round(2 * w), len(share) - 1
    sums = np.arange(total + 1)
    return float(min(1.0, share[np.minimum(sums, total - sums) <= limit].sum()))


def normal_p(ranks: list[float], w: float) -> float:
    """Two-sided p from the normal limit, with the variance of the ranks at hand (hence corrected for ties)."""
    mean, variance = sum(ranks) / 2.0, sum(r * r for r in ranks) / 4.0
    return min(1.0, math.erfc(abs(w - mean) / math.sqrt(2 * variance))) if variance else 1.0


def wilcoxon(deltas: DataFrame, groups: list[str], exact_up_to: int | None = 50, least_pairs: int = 3, digits: int = 9) -> DataFrame:
    """signed_rank with p_raw and p_method: 'exact' for up to `exact_up_to` used pairs, else 'normal'; both null under `least_pairs` pairs.

    With `exact_up_to` None every group's p is exact; its ranks then go to one task, which suits groups of some
    thousands. The normal p needs two sums of a group only, which aggregate. A group of zeros has p 1, 'exact'.
    """
    exact_up_to = (1 << 31) if exact_up_to is None else exact_up_to
    table = signed_rank(deltas, groups, digits)
    ranked = average_ranks(deltas.withColumn("__d", F.round("delta", digits)).where("__d <> 0"), groups, F.abs(F.col("__d")))
    sums = ranked.groupBy(*groups).agg(F.sum("rank").alias("__s"), F.sum(F.col("rank") * F.col("rank")).alias("__q"))
    small = table.where(F.col("n_used").between(1, exact_up_to)).select(*groups)
    lists = ranked.join(small, groups, "left_semi").groupBy(*groups).agg(F.collect_list("rank").alias("__ranks"))
    joined = table.join(sums, groups, "left").join(lists, groups, "left")

    @F.pandas_udf("double")
    def p_value(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ranks, w, s, q in parts:
            out = []
            for r, a, b, c in zip(ranks, w, s, q):
                if r is not None and len(r):
                    out.append(exact_p(list(r), a))
                elif b is not None and not math.isnan(b) and c > 0:
                    out.append(min(1.0, math.erfc(abs(a - b / 2) / math.sqrt(c / 2))))
                else:
                    out.append(1.0)
            yield pd.Series(out, dtype="float64")

    p = F.when(F.col("n_pairs") >= least_pairs, p_value("__ranks", "w", "__s", "__q"))
    method = F.when(F.col("n_pairs") >= least_pairs, F.when(F.col("n_used") <= exact_up_to, "exact").otherwise("normal"))
    return joined.withColumn("p_raw", p).withColumn("p_method", method).drop("__ranks", "__s", "__q")


def holm(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and significant: step-down over all rows together; a null p counts as 1.0.

    The rows are tests (a few per comparison), so one window over them is small by nature.
    """
    value = F.coalesce(F.col(p), F.lit(1.0))
    numbered = df.withColumn("__n", F.count("*").over(Window.partitionBy())).withColumn("__i", F.row_number().over(Window.orderBy(value)))
    raw = F.least(F.lit(1.0), (F.col("__n") - F.col("__i") + 1) * value)
    upto = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("p_holm", F.max(raw).over(upto)).withColumn("significant", F.col("p_holm") < alpha).drop("__n", "__i")
