"""Continuous periods as a stream: the ordered map of disjoint intervals is each entity's keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darb.operators.intervals import IntervalMap


def interval_stream(ranges: DataFrame) -> DataFrame:
    """(entity, version, span_kind, first_day, last_day): all spans of the entities that a micro-batch changes.

    `ranges` is a stream of (entity string, first_day date, last_day date), both inclusive. Each change of an
    entity's map raises its version; the spans of the highest version are the current ones, and a batch that
    changes nothing emits nothing. Ranges with a null or with their ends swapped don't count.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, parts, state):
        firsts, lasts, version = state.get if state.exists else ([], [], 0)
        m = IntervalMap(list(firsts), list(lasts))
        before = m.periods()
        for rows in parts:
            for a, b in zip(rows["a"], rows["b"]):
                m.insert(int(a), int(b))
        if m.periods() == before:
            return
        state.update((m.firsts, m.lasts, version + 1))
        spans = [("period", *x) for x in m.periods()] + [("gap", *x) for x in m.gaps()]
        yield pd.DataFrame([(key[0], version + 1, *s) for s in spans], columns=["entity", "version", "span_kind", "a", "b"])

    days = ranges.select("entity", F.unix_date("first_day").alias("a"), F.unix_date("last_day").alias("b")).where("entity IS NOT NULL AND a IS NOT NULL AND b >= a")
    out = days.groupBy("entity").applyInPandasWithState(update, "entity string, version bigint, span_kind string, a int, b int", "firsts array<int>, lasts array<int>, version bigint", "append", GroupStateTimeout.NoTimeout)
    return out.select("entity", "version", "span_kind", F.date_from_unix_date("a").alias("first_day"), F.date_from_unix_date("b").alias("last_day"))
