import datetime as dt
import random

from pyspark.sql import functions as F

from darb.operators.intervals import merge_intervals
from darb.streaming.budget import daily_budget, daily_budget_stream
from darb.streaming.intervals import interval_stream
from darb.streaming.upsert import current_version, read_ledger, upsert_batch

DAY = dt.date(2024, 1, 1)


def run(stream, tmp_path, sink):
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_budget_in_batch_equals_a_loop_and_the_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(4), DAY + dt.timedelta(rng.randrange(3)), k, None if rng.random() < 0.05 else rng.random() * 3) for k in range(300)]
    rows = [(r, d, dt.datetime.combine(d, dt.time(8)) + dt.timedelta(minutes=k // 2), k, m) for r, d, k, m in rows]
    schema = "route_id int, day date, ts timestamp, event_id int, minutes double"
    df = spark.createDataFrame(rows, schema)
    used, want = {}, {}
    for r, d, t, k, m in sorted(rows, key=lambda x: (x[2], x[3])):
        ok = m is not None and used.get((r, d), 0.0) + m <= 5.0
        used[r, d] = used.get((r, d), 0.0) + (m if ok else 0.0)
        want[k] = ok
    assert {r.event_id: r.accepted for r in daily_budget(df, 5.0).collect()} == want
    assert daily_budget(df.limit(0), 5.0).count() == 0
    source = tmp_path / "in"
    df.repartition(1).write.parquet(str(source))
    got = {}
    run(daily_budget_stream(spark.readStream.schema(schema).parquet(str(source)), 5.0), tmp_path, lambda b, i: got.update({r.event_id: r.accepted for r in b.collect()}))
    assert got == want


def test_interval_stream_ends_as_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"e{rng.randrange(5)}", DAY + dt.timedelta(a := rng.randrange(200)), DAY + dt.timedelta(a + rng.randrange(-1, 9))) for _ in range(300)] + [(None, DAY, DAY), ("e1", None, DAY)]
    schema = "entity string, first_day date, last_day date"
    df = spark.createDataFrame(rows, schema)
    df.repartition(6).write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "in"))
    out = []
    run(interval_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))), tmp_path, lambda b, i: out.extend(b.collect()))
    last = {}
    for r in out:
        last[r.entity] = max(last.get(r.entity, 0), r.version)
    now = sorted((r.entity, r.span_kind, r.first_day, r.last_day) for r in out if r.version == last[r.entity])
    assert max(last.values()) > 1
    assert now == sorted(map(tuple, merge_intervals(df, "entity", "first_day", "last_day").collect()))


def test_ledger_upserts_survive_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert current_version(spark, path) == -1 and read_ledger(spark, path) is None
    merge = upsert_batch(path, ["k"], ["at"])
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, at int, v string")
    merge(batch(("a", 1, "x"), ("b", 1, "y")), 0)
    merge(batch(("a", 2, "z"), ("c", 1, "w")), 1)
    merge(batch(("a", 2, "z"), ("c", 1, "w")), 1)
    assert sorted(map(tuple, read_ledger(spark, path).collect())) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
    assert current_version(spark, path) == 1
