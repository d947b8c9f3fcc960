"""Neighbours, running sums and order statistics within a group, without a task per group.

A window function sorts a whole group in one task. Here the rows are range-partitioned by (group, order), so a
group with a third of all rows is shared by many tasks; inside a partition a window per (partition, group)
finds the neighbours, and for the rows at a partition's edge a table with one row per (partition, group) and the
named columns supplies them; of a group it has as many rows as partitions hold that group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darb.session import durable, shuffle_partitions

#: A key with more rows than both is hot (see join_counted).
HOT_SHARE, HOT_ROWS = 2000, 10_000


def with_neighbour(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str], after: bool = False) -> DataFrame:
    """`df` plus, under the names in `columns`' values, those columns of the row before (or after) in the group.

    (group, order) should identify a row; rows that tie come in an undefined order. The first (last) row of a
    group gets nulls. Null group values are a group of their own. An empty `df` gives an empty result.
    """
    n = shuffle_partitions(df.sparkSession)
    parts = durable(df.repartitionByRange(n, *group, *order).withColumn("__pid", F.spark_partition_id()))
    key = ["__pid", *group]
    window = Window.partitionBy(*key).orderBy(*[F.desc(c) if after else F.asc(c) for c in order])
    shifted = parts.withColumn("__n", F.row_number().over(window))
    for c in columns:
        shifted = shifted.withColumn(f"__in_{c}", F.lag(F.struct(c)).over(window))
    # what each (partition, group) offers to the next partition of the same group: its outermost row
    pick = F.min_by if after else F.max_by
    offer = parts.groupBy(*key).agg(pick(F.struct(*columns), F.struct(*order)).alias("__edge"))
    across = Window.partitionBy(*group).orderBy(F.desc("__pid") if after else F.asc("__pid"))
    offer = offer.withColumn("__edge", F.lag("__edge").over(across)).where("__edge IS NOT NULL").withColumn("__n", F.lit(1))
    on = [shifted[c].eqNullSafe(offer[c]) for c in [*key, "__n"]]
    joined = shifted.join(offer.select(*key, "__n", "__edge"), on, "left")
    return joined.select(*[shifted[c] for c in df.columns], *[F.coalesce(shifted[f"__in_{c}"], F.struct(offer["__edge"][c].alias(c)))[c].alias(new) for c, new in columns.items()])


def with_running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` plus, as `name`, the sum of `value` over the group's rows up to and with this one.

    (group, order) should identify a row. Sums within a range partition come from a window per (partition,
    group), what lies before from a table with one row per (partition, group).
    """
    n = shuffle_partitions(df.sparkSession)
    parts = durable(df.repartitionByRange(n, *group, *order).withColumn("__pid", F.spark_partition_id()))
    local = F.sum(value).over(Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__pid", *group).agg(F.sum(value).alias("__sum"))
    offsets = sums.select(*(F.col(c).alias(f"__o_{c}") for c in ["__pid", *group]), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in ["__pid", *group]])
    return parts.withColumn("__local", local).join(offsets, same, "left").select(*df.columns, (F.col("__local") + F.col("__off")).alias(name))


def join_counted(df: DataFrame, counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of `df` with `counted`, one row per key with how many rows of `df` it has; nulls in keys are equal.

    Keys with more rows than HOT_ROWS and 1/HOT_SHARE of all are hot: there are under HOT_SHARE of them, which are
    broadcast, so a key with a third of all rows stays in as many tasks as hold it.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    many = max(HOT_ROWS, total // HOT_SHARE)
    key = [f"__k{i}" for i in range(len(on))]
    named = counted.select(*(F.col(c).alias(k) for c, k in zip(on, key)), *(c for c in counted.columns if c not in on))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, key)])
    hot = named.where(F.col(n) > many)
    if hot.isEmpty():
        return df.join(named, same).drop(*key)
    hot = F.broadcast(durable(hot))
    cold = df.join(hot.select(*key), same, "left_anti").join(named.where(F.col(n) <= many), same)
    return df.join(hot, same).unionByName(cold).drop(*key)


def at_ranks(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(groups, n, *ranks): the group's values at the given 0-based ranks, each an expression of the group's size `n`.

    Equal values are counted before anything is ordered. Null values don't count; groups without values give no
    row; null group values are a group of their own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__c"))
    upto = with_running_total(counts, groups, [value], "__c", "__to")
    placed = join_counted(upto, counts.groupBy(*groups).agg(F.sum("__c").alias("n"), F.count("*").alias("__values")), groups, "__values")
    picked = [F.min(F.when(F.col("__to") > r, F.col(value))).alias(name) for name, r in ranks.items()]
    return placed.groupBy(*groups, "n").agg(*picked)


def medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, lower, upper): the two middle values of each group, equal where its size is odd."""
    return at_ranks(df, groups, value, {"lower": F.floor((F.col("n") - 1) / 2), "upper": F.floor(F.col("n") / 2)})
