"""Continuous periods and gaps of overlapping, nested and gapped day ranges, per entity.

Method: every entity has an ordered map of disjoint intervals. An insertion finds the intervals that it
touches by binary search, merges them into one and thereby shrinks or splits the gaps, which are what lies
between neighbours of the map. The same map is the keyed state of the batch and of the streaming operator.

Batch plan. (1) Equal (entity, from, until) triples collapse in the JVM before the shuffle (partial
aggregation), so repeats of a hot entity never travel. (2) Triples are spread by a hash of entity and range,
so that an entity with a third of all rows is shared by all tasks; each task keeps maps of the entities it
sees and emits their disjoint intervals; the maps held at once are bounded (`max_held`), a map that is let
go early is only less merged, never wrong. (3) The partial intervals are shuffled by entity, sorted, and
streamed through one map at a time. Memory per task is one entity's disjoint map, which is bounded by the
calendar, not by the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "entity string, first_day int, last_day int"
_SPAN = "entity string, span_kind string, first_day int, last_day int"


class IntervalMap:
    """Disjoint, non-adjacent closed intervals of integers, ordered by their starts.

    >>> m = IntervalMap()
    >>> for a, b in [(1, 3), (10, 12), (4, 5)]:
    ...     m.insert(a, b)
    >>> m.periods(), m.gaps()
    ([(1, 5), (10, 12)], [(6, 9)])
    """

    __slots__ = ("firsts", "lasts")

    def __init__(self, firsts: list[int] | None = None, lasts: list[int] | None = None):
        self.firsts, self.lasts = firsts or [], lasts or []

    def insert(self, first: int, last: int) -> None:
        """Add [first, last]; intervals that overlap it or are adjacent to it become one with it."""
        lo = bisect_left(self.lasts, first - 1)  # the first interval that ends at or after the day before
        hi = bisect_right(self.firsts, last + 1)  # one behind the last interval that starts by the day after
        if lo < hi:
            first, last = min(first, self.firsts[lo]), max(last, self.lasts[hi - 1])
        self.firsts[lo:hi] = [first]
        self.lasts[lo:hi] = [last]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.firsts, self.lasts))

    def gaps(self) -> list[tuple[int, int]]:
        return [(a + 1, b - 1) for a, b in zip(self.lasts, self.firsts[1:])]


def _batch(names: list[str], columns: list[list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _partial(max_held: int):
    names, types = ["entity", "first_day", "last_day"], [pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, IntervalMap] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(e, a, b) for e, m in held.items() for a, b in m.periods()]
            return _batch(names, [list(x) for x in zip(*rows)] or [[], [], []], types)

        for batch in batches:
            for entity, first, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (m := held.get(entity)) is None:
                    m = held[entity] = IntervalMap()
                before = len(m.firsts)
                m.insert(first, last)
                size += len(m.firsts) - before
            if size > max_held:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["entity", "span_kind", "first_day", "last_day"], [pa.string(), pa.string(), pa.int32(), pa.int32()]
    current, m, out = None, IntervalMap(), []

    def close() -> None:
        out.extend((current, "period", a, b) for a, b in m.periods())
        out.extend((current, "gap", a, b) for a, b in m.gaps())

    for batch in batches:
        for entity, first, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if entity != current:
                if current is not None:
                    close()
                current, m = entity, IntervalMap()
            m.insert(first, last)
        if len(out) > 20_000:
            yield _batch(names, [list(x) for x in zip(*out)], types)
            out.clear()
    if current is not None:
        close()
    if out:
        yield _batch(names, [list(x) for x in zip(*out)], types)


def merge_intervals(df: DataFrame, entity: Column | str, first: Column | str, last: Column | str, max_held: int = 200_000) -> DataFrame:
    """Periods and gaps of each entity: (entity string, span_kind 'period'|'gap', first_day date, last_day date).

    `first` and `last` are dates, both inclusive; adjacent days join. Rows whose entity, first or last is null
    or whose last lies before first don't count. Repeated rows and ties change nothing; an empty input gives an
    empty result; other columns of `df` are ignored whatever their names. A gap lies between two successive
    periods, so an entity with one period has none. `max_held` bounds the intervals that a task holds in step 2.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    ranges = (
        df.select(col(entity).cast("string").alias("entity"), F.unix_date(col(first).cast("date")).alias("first_day"), F.unix_date(col(last).cast("date")).alias("last_day"))
        .where("entity IS NOT NULL AND first_day IS NOT NULL AND last_day >= first_day")
        .distinct()
    )
    partial = ranges.mapInArrow(_partial(max_held), _PART)
    spans = partial.repartition("entity").sortWithinPartitions("entity", "first_day", "last_day").mapInArrow(_final, _SPAN)
    return spans.select("entity", "span_kind", F.date_from_unix_date("first_day").alias("first_day"), F.date_from_unix_date("last_day").alias("last_day"))


def student_key(column: Column | str) -> Column:
    """Student ids as compared everywhere: trimmed of white space and upper-cased."""
    return F.upper(F.regexp_replace(column, r"^\s+|\s+$", ""))


def student_periods(requests: DataFrame) -> DataFrame:
    """p3: (student_id, span_kind, from_day, until_day) of change_location_input, days as 'yyyy-MM-dd'.

    An id that is empty after trimming is an id like any other; a null id is none. A null meta is a request
    without dates.
    """
    spans = merge_intervals(requests, student_key("meta.student_id"), F.col("meta.valid_from"), F.col("meta.valid_until"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return spans.select(F.col("entity").alias("student_id"), "span_kind", day("first_day").alias("from_day"), day("last_day").alias("until_day"))
