"""Run outputs and evaluation ledgers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darb.operators.metrics import latest
from darb.operators.shred import entities, on_parent, shred

_MODE = "map<string,struct<routes_created:int,students_served:int,students_unserved:int,skipped:boolean,total_route_time_min:double,alns_runtime_seconds:double,executed_iterations:int,stop_reason:string>>"


def run_routes(runs: DataFrame) -> DataFrame:
    """(run_id, mode, pos, route_id, students_count, total_time_min, total_distance_km) of the routes of all modes."""
    nodes = shred(runs, "output_id", "payload").repartition("record_id")
    found = entities(nodes, None, ["route_id", "students_count", "total_time_min", "total_distance_km"])
    modes = on_parent(found, found.where("label = 'modes' AND parent = 0"), {"label": "holder"}).select("record_id", "node", F.col("label").alias("mode"))
    routes = on_parent(found.where("label = 'routes'"), modes, {"mode": "mode"})
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return routes.select(F.col("record_id").alias("run_id"), "mode", "pos", "route_id", number("students_count"), number("total_time_min"), number("total_distance_km"))


def run_modes(runs: DataFrame) -> DataFrame:
    """(output_id, mode, ...): one row per run and mode that isn't skipped, repeated runs once."""
    once = runs.dropDuplicates(["output_id"])
    parsed = once.select("output_id", F.explode(F.from_json(F.get_json_object("payload", "$.modes"), _MODE)).alias("mode", "m"))
    return parsed.where("m IS NOT NULL AND NOT coalesce(m.skipped, false)").select("output_id", "mode", "m.*").drop("skipped")


def common_modes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Modes that two runs both have."""
    return a.select("mode").intersect(b.select("mode"))


def evaluation_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of every evaluation.json under `root`, latest per (source_output, generated_at), with the file's directory."""
    schema = "updated_at string, runs array<struct<run_id:string,source_output:string,generated_at:string,recorded_at:string,config:struct<n_students:int,seed:int,iterations:int>>>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "evaluation.json").json(root)
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("directory"), F.explode("runs").alias("r")).select("directory", "r.*")
    return latest(rows, ["source_output", "generated_at"], ["recorded_at", "run_id", "directory"])


def cohort_runs(spark: SparkSession, root: str) -> DataFrame:
    """output.json files of a tree <n>Students/<seed>/, with cohort and seed from the path and the text of the document."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "output.json").text(root)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"(\d+)Students", 1).try_cast("int").alias("cohort"), F.regexp_extract(path, r"/([^/]+)/output\.json$", 1).alias("seed"), F.col("value").alias("payload"))
