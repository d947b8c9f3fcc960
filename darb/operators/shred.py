"""Nested JSON records as flat related tables, by adjacency shredding.

Every value of a record becomes one row of an adjacency table: (record_id, node, parent, label, ordinal, kind,
scalar). `node` numbers the record's values in the order of the text, the root is 0 and its parent -1; `label`
is the key under which the value is stored; elements of an array hang under the array's owner with its label
and their `ordinal` from 0 in the stored array (null for a value that isn't an element); an array that is
itself an element is a node of kind 'array'; an empty array is a row of kind 'empty'. Nothing is lost:
`assemble` rebuilds the values.

Entity tables come from it by joins: object nodes are joined with their scalar children, which are pivoted
into columns, and children are joined with parents on (record_id, node). Parsing is the only work in Python (Arrow
batches) and is done once: the adjacency rows that the entities need, objects and their scalar children, are
filtered in one pass and put under their object's node by one shuffle, where the join and the pivot are one
aggregation; the pivoted objects, a small part of the nodes, are checkpointed for the entity tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darb.functions.jsonio import Number, parse, unwrap, utf8
from darb.session import durable

_SCHEMA = "record_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("record_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])


def shred_value(record_id: int | None, root: Any) -> list[tuple]:
    """Adjacency rows of one parsed value; keys that start with '_' are left out with all below them."""
    rows: list[tuple] = []
    stack: list[tuple] = [(-1, "", None, root)]
    while stack:
        parent, label, ordinal, value = stack.pop()
        value, node = unwrap(value), len(rows)
        if isinstance(value, dict):
            rows.append((record_id, node, parent, label, ordinal, "object", None))
            stack.extend((node, utf8(k), None, v) for k, v in reversed(value.items()) if not k.startswith("_"))
        elif isinstance(value, list) and not value:
            rows.append((record_id, node, parent, label, ordinal, "empty", None))
        elif isinstance(value, list):
            if ordinal is not None or parent < 0:
                rows.append((record_id, node, parent, label, ordinal, "array", None))
                parent, label = node, ""
            stack.extend((parent, label, len(value) - 1 - i, v) for i, v in enumerate(reversed(value)))
        elif isinstance(value, Number):
            rows.append((record_id, node, parent, label, ordinal, "number", str(value)))
        elif isinstance(value, str):
            rows.append((record_id, node, parent, label, ordinal, "string", utf8(value)))
        elif isinstance(value, bool):
            rows.append((record_id, node, parent, label, ordinal, "boolean", str(value).lower()))
        else:
            rows.append((record_id, node, parent, label, ordinal, "null", None))
    return rows


def assemble(rows: list[tuple]) -> Any:
    """The value whose adjacency rows these are (numbers as `Number`): the inverse of shred_value."""
    made: dict[int, Any] = {}
    for _, node, parent, label, ordinal, kind, scalar in sorted(rows, key=lambda r: r[1]):
        value: Any = {"object": dict, "array": list, "empty": list}[kind]() if kind in ("object", "array", "empty") else None if kind == "null" else Number(scalar) if kind == "number" else scalar == "true" if kind == "boolean" else scalar
        made[node] = value
        if parent < 0:
            continue
        owner = made[parent]
        if isinstance(owner, list):
            owner.append(value)
        elif ordinal is None:
            owner[label] = value
        else:
            owner.setdefault(label, []).append(value)
    return made.get(0)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for batch in batches:
        for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, value = parse(text)
            if ok:
                rows.extend(shred_value(record_id, value))
            if len(rows) > 20_000:
                yield flush()
                rows.clear()
    if rows:
        yield flush()


def shred(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """The adjacency table of the JSON in column `text`, one record per `record_id`.

    Repeated ids count once (an id always means the same record); rows with a null id, null text or invalid JSON
    give no rows; a scalar document gives its root row only; other columns are ignored whatever their names.
    """
    once = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("text")).where("record_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["record_id"])
    return once.mapInArrow(_shred, _SCHEMA)


def entities(nodes: DataFrame, labels: list[str] | None, fields: list[str], extra: Column | None = None) -> DataFrame:
    """Object nodes with their scalar children as columns: (record_id, node, parent, label, pos, *fields).

    `labels` limits the objects by the key they are stored under (null: all), `extra` adds objects that a
    condition names. A field that is missing, null, an object or an array is null; `pos` is 0 for an object in
    place of an array.
    """
    wanted = F.lit(True) if labels is None else F.col("label").isin(labels)
    if extra is not None:
        wanted = wanted | extra
    is_object = (F.col("kind") == "object") & wanted
    is_child = F.col("label").isin(fields) & F.col("ordinal").isNull() & F.col("kind").isin("string", "number", "boolean")
    # an object meets its scalar children on its own node: both sides of the join come from one reading of the nodes
    rows = nodes.where(is_object | is_child).select(
        "record_id", F.when(is_child, F.col("parent")).otherwise(F.col("node")).alias("node"), F.when(~is_child, F.struct("parent", "label", F.coalesce("ordinal", F.lit(0)).cast("bigint").alias("pos"))).alias("o"), *(F.when(is_child & (F.col("label") == f), F.col("scalar")).alias(f) for f in fields)
    )
    found = rows.groupBy("record_id", "node").agg(F.max("o").alias("o"), *(F.max(f).alias(f) for f in fields)).where("o IS NOT NULL")
    return found.select("record_id", "node", "o.parent", "o.label", "o.pos", *fields)


def whole_number(text: Column) -> Column:
    """A number's text without a fraction of zeros or an exponent; other texts trimmed."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^-?\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", ""))
    wide = t.try_cast("decimal(38,6)")
    return F.coalesce(plain, F.when(wide == F.floor(wide), F.floor(wide).cast("string")), t)


def on_parent(child: DataFrame, parent: DataFrame, names: dict[str, str]) -> DataFrame:
    """Children with columns of their parents, matched on (record_id, node)."""
    above = parent.select("record_id", F.col("node").alias("parent"), *(F.col(a).alias(b) for a, b in names.items()))
    return child.join(above, ["record_id", "parent"])


def _case(df: DataFrame, kind: str, parent_pos: Column, pos: Column, key: Column) -> DataFrame:
    return df.select("record_id", F.lit(kind).alias("node_kind"), parent_pos.cast("string").alias("parent_pos"), pos.cast("bigint").alias("pos"), F.coalesce(key, F.lit("")).alias("item_key"))


def request_tables(requests: DataFrame) -> dict[str, DataFrame]:
    """Related tables of the request blocks: buses, routes, stops (with route) and students (with stop and route)."""
    nodes = shred(requests, "request_id", "data")
    found = durable(entities(nodes, ["buses", "routes", "path", "students"], ["id", "capacity", "node_id"]))
    of = lambda label: found.where(F.col("label") == label)
    buses, routes = of("buses").where("parent = 0"), of("routes").where("parent = 0")
    stops = on_parent(of("path"), routes, {"pos": "route_pos", "id": "route_id"})
    students = on_parent(of("students"), stops, {"pos": "stop_pos", "route_pos": "route_pos", "node_id": "stop_node_id"})
    return {"buses": buses, "routes": routes, "stops": stops, "students": students}


def run_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """Related tables of the run outputs: routes (with their mode) and synthetic crossings."""
    nodes = shred(runs, "output_id", "payload")
    found = durable(entities(nodes, None, ["route_id", "strategy"]))
    modes = on_parent(found, found.where("label = 'modes' AND parent = 0"), {"label": "holder"}).select("record_id", "node", F.col("label").alias("mode"))
    routes = on_parent(found.where("label = 'routes'"), modes, {"mode": "mode"})
    crossings = on_parent(found.where("label = 'synthetic_crossings'"), found.where("label = 'debug_stats' AND parent = 0"), {"label": "holder"})
    return {"routes": routes, "crossings": crossings}


def nested_items(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """p5: (record_id, node_kind, parent_pos, pos, item_key) of both tables, every child with its parent's position.

    Elements that aren't objects give no row; positions are those of the stored arrays.
    """
    q, r = request_tables(requests), run_tables(runs)
    none, pos = F.lit(""), F.col("pos")
    capacity = F.when(F.trim("capacity") != "", whole_number(F.col("capacity")))
    parts = [
        _case(q["buses"], "bus", none, pos, F.col("id")),
        _case(q["buses"].where(capacity.isNotNull()), "capacity", pos, F.lit(0), capacity),
        _case(q["routes"], "route", none, pos, F.col("id")),
        _case(q["stops"], "stop", F.col("route_pos"), pos, F.col("node_id")),
        _case(q["students"], "student", F.concat_ws("/", "route_pos", "stop_pos"), pos, F.col("id")),
        _case(r["routes"], "run_route", F.col("mode"), pos, F.col("route_id")),
        _case(r["crossings"].where("strategy IS NOT NULL"), "crossing", none, pos, F.col("strategy")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbers_of_key(records: DataFrame, record_id: str, text: str, key: str) -> DataFrame:
    """(record_id, value): every finite number stored under `key` at any depth, elements of arrays included."""
    from darb.functions.scalars import finite

    nodes = shred(records, record_id, text).where(F.col("label") == key).where("kind = 'number'")
    return nodes.select("record_id", finite("scalar").alias("value")).where("value IS NOT NULL")
