"""Daily detour budgets: a request is accepted while its vehicle's budget of the day lasts, and only then uses it.

Greedy acceptance depends on the order, so a (vehicle, day) is followed in order of time. In batch, partitions
are sorted and streamed through, holding one running sum; as a stream, the sum is the keyed state, which a
timer of event time drops when the day is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _follow(budget: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used = object(), 0.0
        for batch in batches:
            flags, sums = [], []
            for route, day, minutes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
                if (route, day) != current:
                    current, used = (route, day), 0.0
                ok = minutes is not None and used + minutes <= budget
                used += minutes if ok else 0.0
                flags.append(ok)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_()), pa.array(sums, pa.float64())], names=["route_id", "day", "ts", "event_id", "minutes", "accepted", "used_after"])

    return run


def daily_budget(requests: DataFrame, budget: float) -> DataFrame:
    """(route_id, day, ts, event_id, minutes, accepted, used_after) of requests in order of (ts, event_id).

    A request without minutes is refused; null routes or days are keys like others.
    """
    rows = requests.select("route_id", "day", "ts", "event_id", F.col("minutes").cast("double").alias("minutes"))
    ordered = rows.repartition("route_id", "day").sortWithinPartitions("route_id", "day", "ts", "event_id")
    kinds = dict(rows.dtypes)
    return ordered.mapInArrow(_follow(budget), ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", accepted boolean, used_after double")


def daily_budget_stream(requests: DataFrame, budget: float, delay: str = "1 day") -> DataFrame:
    """The same over a stream of (route_id, day, ts, event_id, minutes); a micro-batch's requests of a key are taken in order.

    State is one double per (route_id, day) and goes when the watermark passes the day's end; later requests
    of that day are dropped by the watermark.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        flags, sums = [], []
        for minutes in rows["minutes"]:
            ok = minutes == minutes and used + minutes <= budget
            used += minutes if ok else 0.0
            flags.append(bool(ok))
            sums.append(used)
        state.update((used,))
        end = pd.Timestamp(key[1]) + pd.Timedelta(days=1)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"route_id": key[0], "day": key[1], "event_id": rows["event_id"].to_numpy(), "accepted": flags, "used_after": sums})

    kinds = dict(requests.dtypes)
    schema = f"route_id {kinds['route_id']}, day {kinds['day']}, event_id {kinds['event_id']}, accepted boolean, used_after double"
    return requests.withWatermark("ts", delay).groupBy("route_id", "day").applyInPandasWithState(update, schema, "used double", "append", GroupStateTimeout.EventTimeTimeout)
