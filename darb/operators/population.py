"""Synthetic student homes around a school: seeded by hashes of (seed, id, draw), so every partitioning gives the same rows.

A distance is drawn from the normal distribution cut off at its bounds, by the inverse of that: one draw each, however
narrow the bounds are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, draw: int, key: Column | str = "id") -> Column:
    """A number in (0, 1) that depends on the key, the seed and the number of the draw only: the first 52 bits of the MD5 of 'key:seed:draw'."""
    name = F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed)), F.lit(str(draw)))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: The published coefficients (Wichura, algorithm AS 241, PPND16) of the normal distribution's inverse, highest power first.
CENTRAL = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(both: tuple, x: Column) -> Column:
    """One polynomial over another."""
    powers = []
    for values in both:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + F.lit(v)
        powers.append(out)
    return powers[0] / powers[1]


def normal_quantile(p: Column) -> Column:
    """The standard normal number below which lies a share p of (0, 1), to about 16 digits."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    far = F.when(r <= 5.0, _ratio(MIDDLE, r - 1.6)).otherwise(_ratio(TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRAL, 0.180625 - q * q)).otherwise(F.when(q < 0, -far).otherwise(far))


def truncated_normal(u: Column, mean: float, sigma: float, low: float, high: float) -> Column:
    """The number of the normal distribution cut off at low and high at a share u of (0, 1); the mean, held within the bounds, if sigma is 0."""
    if not sigma > 0 or not low < high:
        return F.lit(min(max(mean, low), high))
    a, b = (low - mean) / sigma, (high - mean) / sigma
    sign = 1.0
    if a > 0:  # the tail on the left has more digits
        a, b, u, sign = -b, -a, 1.0 - u, -1.0
    below = lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0))
    z = normal_quantile(F.lit(below(a)) + u * (below(b) - below(a)))
    return F.least(F.lit(high), F.greatest(F.lit(low), F.lit(mean) + F.lit(sign * sigma) * z))


def weighted(value: Column, weights: dict[str, float]) -> Column:
    """The key in whose part of the summed weights a number of (0, 1) falls."""
    total, upto, out = sum(weights.values()), 0.0, None
    for key, w in weights.items():
        upto += w / total
        out = F.when(value < upto, key) if out is None else out.when(value < upto, key)
    return out.otherwise(list(weights)[-1])


def homes(spark: SparkSession, n: int, seed: int, lat: float, lon: float, stages: dict[str, float], ages: dict[str, tuple[int, int]], peak_km: float = 2.0, sigma_km: float = 1.0, min_km: float = 0.4, max_km: float = 5.0, disabled: float = 0.125) -> DataFrame:
    """(student_id, lat, lon, stage, age, disabled) of n homes, their distances normal around a ring and within its bounds."""
    km = truncated_normal(uniform(seed, 100), peak_km, sigma_km, min_km, max_km)
    angle = 2.0 * math.pi * uniform(seed, 1)
    base = spark.range(n).withColumn("km", km).withColumn("angle", angle).withColumn("stage", weighted(uniform(seed, 2), stages))
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (a, b) in ages.items():
        low, high = F.when(F.col("stage") == name, a).otherwise(low), F.when(F.col("stage") == name, b).otherwise(high)
    age = (low + F.floor(uniform(seed, 3) * (high - low + 1))).cast("int")
    return base.select("id", (F.lit(lat) + F.col("km") / 111.0 * F.cos("angle")).alias("lat"), (F.lit(lon) + F.col("km") / (111.0 * math.cos(math.radians(lat))) * F.sin("angle")).alias("lon"), "stage", age.alias("age"), (uniform(seed, 4) < disabled).alias("disabled")).withColumnRenamed("id", "student_id")
