import json
import math
import random

from pyspark.sql import functions as F

from darb.sources import files, ledger, requests, sinks


def document(tmp_path, name="a.json", **data):
    meta = {"mode": "change_location", "constraints": {"mrt enabled": True, "mrt": 70, "floor_minutes": 40}}
    (tmp_path / name).write_text(json.dumps({"meta": meta, "data": data}))


def test_requests_and_defaults(spark, tmp_path):
    stop = {"node_id": 99929969577653098123, "latitude": 30.0, "longitude": 31.0, "type": "pickup", "students": [{"id": "S1", "home_latitude": 30.001, "home_longitude": 31.0, "age": 9}]}
    school = {"node_id": 1, "latitude": 30.1, "longitude": 31.1, "type": "school"}
    document(
        tmp_path,
        buses=[{"id": "B1", "capacity": 10}, {"id": "B2", "capacity": 5}, {"id": "B1", "capacity": 20}],
        students=[{"id": "S9", "latitude": 30.0, "longitude": 31.0, "school_stage": "high", "valid_from": "2024-01-05", "valid_until": "soon"}, {"id": "S8"}],
        routes=[{"id": "R1", "bus_id": "B1", "path": [school, stop, None, school]}, {"id": "R2", "bus_id": "gone", "path": []}],
    )
    q = requests.read_requests(spark, str(tmp_path))
    assert {r.bus_id: (r.pos, r.capacity) for r in requests.buses(q).collect()} == {"B1": (2, 20), "B2": (1, 5)}
    assert [(r.student_id, r.stage, r.fee, r.assignment, str(r.valid_from), r.valid_until) for r in requests.students(q).orderBy("pos").collect()] == [("S9", "HIGH", 100.0, "permanent", "2024-01-05", None), ("S8", "ELEMENTARY", 100.0, "permanent", "None", None)]
    assert [(r.route_id, r.route_tmax) for r in requests.routes(q).collect()] == [("R1", 75.0)]
    c = requests.constraints(q).first()
    assert (c.floor_minutes, c.ceiling_minutes, c.mrt_enabled, c.route_tmax, c.acceptable_offset_minutes) == (40.0, 60.0, True, 70.0, 30.0)
    assert {(r.route_id, r.seq) for r in requests.empty_routes(q).collect()} == {("R2", 0), ("R2", 1), ("R3", 0), ("R3", 1)}
    stops = requests.route_stops(q)
    assert [(r.seq, r.node_id) for r in stops.orderBy("seq").collect()] == [(0, "1"), (1, "99929969577653098123"), (3, "1")]
    riders = requests.boarded(q)
    assert [(r.seq, r.student_id, r.lat) for r in riders.collect()] == [(1, "S1", 30.001)]
    totals = spark.createDataFrame([("R1", 12.345, 30.0), ("R2", 1.0, 1.0)], "route_id string, total_km double, total_min double")
    made = [json.loads(r.document) for r in requests.route_documents(stops, riders, totals).collect()]
    assert len(made) == 1 and made[0]["total_distance_km"] in (12.34, 12.35) and [len(s["students"]) for s in made[0]["path"]] == [0, 1, 0]
    assert made[0]["path"][1]["students"][0] == {"id": "S1", "walk_distance": 111.2}


def test_a_document_without_data_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"meta": {}}')
    try:
        requests.read_requests(spark, str(tmp_path)).collect()
        raise AssertionError("it was read")
    except Exception as error:
        assert "no meta or data" in str(error)


def test_bus_instances_and_rings(spark, tmp_path):
    (tmp_path / "p.bus").write_text("2,1,1,K,3.2\ns,30.0,31.0,School, Main\ns,30.1,31.1,Gate\na,30.2,31.2,4,Home, A\nd,0,1,2.5,120\nw,0,1,0.4,300\n")
    t = files.bus_instance(spark, str(tmp_path / "p.bus"))
    assert [(r.stop, r["name"]) for r in t["stops"].orderBy("stop").collect()] == [(0, "School, Main"), (1, "Gate")]
    assert [(r.address, r.pupils, r["name"]) for r in t["addresses"].collect()] == [(0, 4, "Home, A")]
    assert [(r.src, r.dst, r.km, r.minutes) for r in t["od"].collect()] == [(0, 1, 2.5, 2.0)] and [(r.address, r.stop, r.minutes) for r in t["walks"].collect()] == [(0, 1, 5.0)]
    (tmp_path / "h.csv").write_text("lat,lon\n30.0,31.0\n30.5,31.5\nx,y\n")
    (tmp_path / "n.csv").write_text("31.0,30.0\n31.5,30.5\n")
    for name in ("h.csv", "n.csv"):
        assert [(r.lon, r.lat) for r in files.boundary_ring(spark, str(tmp_path / name)).orderBy("seq").collect()] == [(31.0, 30.0), (31.5, 30.5)]


def test_matrices_by_key_and_crossings(spark, tmp_path):
    m = spark.createDataFrame([("a", "b", math.inf), ("b", "a", 2.0)], "src string, dst string, minutes double")
    path = str(tmp_path / "m")
    files.write_matrix(m, path, "k1")
    files.write_matrix(m.limit(1), path, "k2")
    files.write_matrix(m, path, "k1")
    assert files.read_matrix(spark, path, "k1").count() == 2 and files.read_matrix(spark, path, "k2").count() == 1
    e = spark.createDataFrame([("b", "a", 5.0, True, "tertiary"), ("a", "b", 4.0, True, "secondary"), ("a", "c", 1.0, False, None)], "u string, v string, metres double, synthetic boolean, road_class string")
    payload = files.crossing_payload(e)
    assert [tuple(r) for r in payload.collect()] == [("a", "b", 4.0, "secondary")]
    assert sorted((r.u, r.v, r.synthetic) for r in files.inject_crossings(e.where("u = 'a' AND v = 'c'"), payload).collect()) == [("a", "b", True), ("a", "c", False), ("b", "a", True)]


def test_ledgers(spark, tmp_path):
    for name, when in (("one", "2025-01-01"), ("two", "2025-01-02")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "evaluation.json").write_text(json.dumps({"runs": [{"run_id": name, "source_output": "o", "generated_at": "g", "recorded_at": when, "config": {"seed": 42}}]}))
    assert [(r.run_id, r.config.seed) for r in ledger.evaluation_runs(spark, str(tmp_path)).collect()] == [("two", 42)]
    (tmp_path / "100Students" / "67").mkdir(parents=True)
    (tmp_path / "100Students" / "67" / "output.json").write_text('{"modes": {}}')
    assert [(r.cohort, r.seed, r.payload) for r in ledger.cohort_runs(spark, str(tmp_path)).collect()] == [(100, "67", '{"modes": {}}')]
    runs = spark.createDataFrame([(1, json.dumps({"modes": {"A": {"routes_created": 2, "routes": [{"route_id": "R1", "total_time_min": 3.5}]}, "B": {"skipped": True}, "C": None}})), (2, None)], "output_id bigint, payload string")
    assert [(r.output_id, r.mode, r.routes_created) for r in ledger.run_modes(runs.union(runs)).collect()] == [(1, "A", 2)]
    assert [(r.run_id, r.mode, r.route_id, r.total_time_min) for r in ledger.run_routes(runs).collect()] == [(1, "A", "R1", 3.5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", math.nan, 1.0), ("c", math.inf, None)], "k string, x double, y double")
    sinks.write_json(df, str(tmp_path / "j"))
    lines = sorted(line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines())
    assert lines == ['{"k":"a_b","y":1.0}', '{"k":"c"}']
    assert "a\\_b" in sinks.latex_table(df.select("k"), "100 %") and sinks.markdown_table(df.select("k")).splitlines()[2] == "| a_b |"
    assert sinks.ascii_table(df.select("k")).splitlines()[1] == "| k   |"
    sinks.write_csv(df.select("k"), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    with_mark, rest = files.log_parts(spark.createDataFrame([("[DEBUG] x",), ("y",), (None,)], "value string"))
    assert with_mark.count() == 1 and rest.count() == 2
    try:
        sinks.markdown_table(spark.range(5), most=3)
        raise AssertionError("too long")
    except ValueError:
        pass


def test_graphs_histories_and_newest_files(spark, tmp_path):
    n = spark.createDataFrame([("a", 30.0, 31.0)], "node string, lat double, lon double")
    e = spark.createDataFrame([("a", "a", 1.0)], "u string, v string, metres double")
    path = str(tmp_path / "g")
    files.write_graph(n, e, path, "h1")
    files.write_graph(n.limit(0), e, path, "h2")
    nodes, edges = files.read_graph(spark, path, "h1")
    assert nodes.count() == edges.count() == 1 and nodes.columns == n.columns
    assert files.newest_file(spark, str(tmp_path / "g" / "edges" / "graph_hash=h1"), "*.parquet").endswith(".parquet")
    files.save_run(e, str(tmp_path / "runs"), "r1")
    files.save_run(e, str(tmp_path / "runs"), "r2")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
