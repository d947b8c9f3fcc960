"""Text formats: benchmark instances, boundary rings, road types, logs, cached matrices, crossing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _line() -> Column:
    """Orders the lines of a file, also when it is read in several splits."""
    return F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("line")


def _numbered(df: DataFrame, file: str, name: str) -> DataFrame:
    """Numbers from 0 in the order of the lines of a file (an instance or a ring: small by nature)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(file).orderBy("line")) - 1).drop("line")


def bus_instance(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A benchmark instance (lines tagged s, a, d, w behind a header) as stops, addresses, od and walks.

    Stops and addresses are numbered from 0 in the order of the file, within each instance; a name may hold
    commas. Lines are told by their tag, not by the header's counts, so the files split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("instance"), _line(), F.trim("value").alias("value"))
    tagged = lambda tag, n: lines.where(F.col("value").startswith(f"{tag},")).select("instance", "line", F.split("value", ",", n).alias("f"))
    d = lambda i: F.trim(F.col("f")[i]).try_cast("double")
    n = lambda i: F.trim(F.col("f")[i]).try_cast("int")

    return {
        "stops": _numbered(tagged("s", 4).select("instance", "line", d(1).alias("lat"), d(2).alias("lon"), F.col("f")[3].alias("name")), "instance", "stop"),
        "addresses": _numbered(tagged("a", 5).select("instance", "line", d(1).alias("lat"), d(2).alias("lon"), n(3).alias("pupils"), F.col("f")[4].alias("name")), "instance", "address"),
        "od": tagged("d", -1).select("instance", n(1).alias("src"), n(2).alias("dst"), d(3).alias("km"), (d(4) / 60.0).alias("minutes")),
        "walks": tagged("w", -1).select("instance", n(1).alias("address"), n(2).alias("stop"), d(3).alias("km"), (d(4) / 60.0).alias("minutes")),
    }


def boundary_ring(spark: SparkSession, path: str) -> DataFrame:
    """(ring, seq, lon, lat) of a boundary CSV: named columns in any order, or lon,lat without a header; rows that aren't numbers don't count."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("ring"), _line(), F.lower(F.trim("value")).alias("v"))
    head = lines.where(F.col("v").contains("lat")).groupBy("ring").agg(F.min_by("v", "line").alias("head"))
    names = F.transform(F.split("head", ","), F.trim)
    parts = F.split("v", ",")
    position = lambda name, default: F.when(F.col("head").isNull(), F.lit(default)).otherwise(F.array_position(names, name).cast("int") - 1)
    value = lambda name, default: F.trim(F.get(parts, position(name, default))).try_cast("double")
    rows = lines.join(head, "ring", "left").select("ring", "line", value("lon", 0).alias("lon"), value("lat", 1).alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    return _numbered(rows, "ring", "seq")


def road_types(spark: SparkSession, base: dict, override: dict | None = None) -> DataFrame:
    """(highway, multiplier, safe) of a speed configuration; an override's road types replace the whole map."""
    config = {**base, **(override or {})}
    rows = [(k, float(v.get("speed_multiplier", 1.0)), bool(v.get("safe_to_cross", True))) for k, v in config.get("road_types", {}).items()]
    return spark.createDataFrame(rows, "highway string, multiplier double, safe boolean")


def log_parts(lines: DataFrame, mark: str = "[DEBUG]") -> tuple[DataFrame, DataFrame]:
    """Log lines (value) with and without the mark."""
    marked = F.coalesce(F.col("value").contains(mark), F.lit(False))
    return lines.where(marked), lines.where(~marked)


def write_matrix(matrix: DataFrame, path: str, key: str) -> None:
    """Store a travel matrix under its key; other keys stay, the same key is replaced."""
    matrix.withColumn("key", F.lit(key)).write.partitionBy("key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The matrix of a key: only its partition is read."""
    return spark.read.parquet(path).where(F.col("key") == key).drop("key")


def crossing_payload(edges: DataFrame) -> DataFrame:
    """Synthetic edges once per undirected pair: (lo, hi, metres, road_class), the shortest of several."""
    ends = edges.where("synthetic").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "metres", "road_class")
    return ends.groupBy("lo", "hi").agg(F.min_by(F.struct("metres", "road_class"), F.struct("metres", "road_class")).alias("e")).select("lo", "hi", "e.*")


def inject_crossings(walk: DataFrame, payload: DataFrame) -> DataFrame:
    """Walk edges (u, v, metres, synthetic, road_class) with a payload's edges in both directions, unless the pair is there."""
    new = payload.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "metres", "road_class").unionByName(payload.select(F.col("hi").alias("u"), F.col("lo").alias("v"), "metres", "road_class")).withColumn("synthetic", F.lit(True))
    return walk.unionByName(new.join(walk.select("u", "v"), ["u", "v"], "left_anti"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, graph_hash: str) -> None:
    """A road graph as two tables, a partition per graph; the same graph is replaced."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("graph_hash", F.lit(graph_hash)).write.partitionBy("graph_hash").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, graph_hash: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph: only its partitions are read."""
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("graph_hash") == graph_hash).drop("graph_hash") for name in ("nodes", "edges"))


def newest_file(spark: SparkSession, directory: str, glob: str) -> str | None:
    """Path of the latest file in a directory that matches, ties to the later name; null if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path", "modificationTime")
    return found.agg(F.max(F.struct("modificationTime", "path")).alias("f")).select("f.path").first()[0]


def save_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run's rows in its own partition of a history."""
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
