"""Files whose schemas drift: one consistent table, every change, and the types each field has had.

Method: tagged-union inference. A file's schema is a map from paths to sets of type tags (string, number,
boolean; null has none). Schemas fuse by union, so a path keeps all alternatives that it ever had; the table
gives each alternative a typed branch of its own beside a canonical text; the report names each alternative
where it first appears. Comparing a producer's successive files gives the changes (added, removed, renamed,
retyped), and following renames gives every field one name through all of them.

Plan. Parsing and profiling are one Arrow pass; a profile is small (per path: tags, a digest of its values).
Profiles are range-partitioned by (producer, written_at, file_id), so a producer with a third of all files is
shared by many tasks, and each partition is scanned in order with the state of one file. What crosses a
partition's edge is a prefix scan: every partition first gives a summary (its first and last profile and its
last state, with placeholders for what only its predecessors know); the summaries, one row per partition and
each as wide as a schema, are composed in order by one task that holds one at a time; each composed state goes as
a row to its own partition, before its files, for the second scan.

Which query runs what: `changes` (p1_found) compares the tag sets of successive files and the fused set that a path
has had since it was added; `consistent_table` splits values into typed branches with a canonical text, under the
names that renames give; `alternatives` fuses the schemas of a family by union and reports where each type appears.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from hashlib import blake2b
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darb.functions.jsonio import Number, parse, utf8
from darb.session import durable, shuffle_partitions

TAGS = ("string", "number", "boolean")


class Field(NamedTuple):
    """What a file has at a path: the last name, the sorted type tags, a digest of its values ('' if all are null)."""

    name: str
    tags: tuple[str, ...]
    digest: str


# ---------------------------------------------------------------- one file


def leaves(root: Any) -> Iterator[tuple[str, str, Any]]:
    """(path, last name, value) of each scalar or null in the order of the text; keys with a leading '_' are skipped."""
    stack: list[tuple[str, str, Any]] = [("", "", root)]
    while stack:
        path, name, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, k, v) for k, v in reversed(value.items()) if not k.startswith("_"))
        elif isinstance(value, list):
            stack.extend((path, name, v) for v in reversed(value))
        else:
            yield path, name, value


def tag_of(value: Any) -> str | None:
    if value is None:
        return None
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, Number) else "string"


_NUMBER = re.compile(r"\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*", re.ASCII)


def canonical(value: Any) -> str:
    """Text under which equal values are equal: 17, 17.0 and "17" are one, true and "true" are two."""
    if isinstance(value, bool):
        return "?true" if value else "?false"
    if _NUMBER.fullmatch(value) and len(value) < 400:
        try:
            return "#" + format(Decimal(value.strip()).normalize(), "E")
        except InvalidOperation:
            pass
    return "'" + value


def profile(root: Any) -> dict[str, Field]:
    found: dict[str, tuple[str, set, list]] = {}
    for path, name, value in leaves(root):
        _, tags, values = found.setdefault(path, (name, set(), []))
        if (tag := tag_of(value)) is not None:
            tags.add(tag)
            values.append(canonical(value))
    return {
        utf8(p): Field(utf8(name), tuple(sorted(tags)), blake2b("\x00".join(sorted(values)).encode("utf-8", "replace"), digest_size=12).hexdigest() if values else "")
        for p, (name, tags, values) in found.items()
    }


def words(name: str) -> list[str]:
    """Lower-cased words of a name; a word ends at a space, an underscore or a change of case."""
    return [w.lower() for part in re.split(r"[\s_]+", name) for w in re.split(r"(?<=[^\WA-Z_])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][^\WA-Z\d_])", part) if w]


# ---------------------------------------------------------------- one step


def renames(before: dict[str, Field], after: dict[str, Field]) -> dict[str, str]:
    """{new path: old path} of the fields that a step renames or moves.

    A removed and an added path can be one field if their last names share a word or they hold equal values (a
    path with nulls only holds none). Of several partners the best is taken: the same words in the last name
    before equal values with a shared word, before more shared words, before equal values alone; ties go to the
    pair with the longer common path, then in path order. Each path is in one pair at most.
    """
    gone, new = [p for p in before if p not in after], [p for p in after if p not in before]
    if not gone or not new:
        return {}
    by_word: dict[str, list[str]] = {}
    by_value: dict[str, list[str]] = {}
    for p in gone:
        for w in set(words(before[p].name)):
            by_word.setdefault(w, []).append(p)
        if before[p].digest:
            by_value.setdefault(before[p].digest, []).append(p)
    ranked = []
    for p in new:
        own = words(after[p].name)
        partners = {q for w in set(own) for q in by_word.get(w, ())} | set(by_value.get(after[p].digest, ()) if after[p].digest else ())
        for q in partners:
            other = words(before[q].name)
            shared = len(set(own) & set(other))
            equal = bool(after[p].digest) and after[p].digest == before[q].digest
            jaccard = shared / len(set(own) | set(other)) if own or other else 0.0
            common = len([1 for x, y in zip(p.split("."), q.split(".")) if x == y])
            ranked.append((-(own == other and shared > 0), -(equal and shared > 0), -jaccard, -equal, -common, p, q))
    pairs: dict[str, str] = {}
    used: set[str] = set()
    for *_, p, q in sorted(ranked):
        if p not in pairs and q not in used:
            pairs[p] = q
            used.add(q)
    return pairs


#: Of each path of the last file: the last non-empty tags since it was last added (None: none yet) and the name
#: its field had when it was added. Either may be ("in", path): what path had before the partition.
State = dict[str, tuple[Any, Any]]


def step(before: dict[str, Field] | None, state: State, after: dict[str, Field]) -> tuple[list[tuple[str, str]], State]:
    """Changes (path, kind) and the new state of going from the file `before` to the file `after`; no changes for a first file."""
    pairs = renames(before, after) if before is not None else {}
    changes: list[tuple[str, str]] = []
    new: State = {}
    for path, field in after.items():
        source = path if before is not None and path in before else pairs.get(path)
        if source is None:
            if before is not None:
                changes.append((path, "added"))
            new[path] = (field.tags or None, path)
            continue
        if source != path:
            changes.append((path, "renamed"))
        tags, root = state.get(source, (None, source))
        if field.tags:
            if tags is not None and tags[0] != "in" and tuple(tags) != field.tags:
                changes.append((path, "retyped"))
            new[path] = (field.tags, root)
        else:
            new[path] = (tags, root)
    if before is not None:
        moved = set(pairs.values())
        changes.extend((path, "removed") for path in before if path not in after and path not in moved)
    return changes, new


# ---------------------------------------------------------------- many files

_PROFILE = "file_id bigint, producer string, family string, written_at timestamp, profile string"


def _dump(p: dict[str, Field]) -> str:
    return json.dumps(p, separators=(",", ":"))


def _load(text: str) -> dict[str, Field]:
    return {k: Field(v[0], tuple(v[1]), v[2]) for k, v in json.loads(text).items()}


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(4).to_pylist():
            ok, value = parse(text)
            out.append(_dump(profile(value)) if ok else None)
        keep = pa.array([x is not None for x in out])
        columns = [*batch.columns[:4], pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["file_id", "producer", "family", "written_at", "profile"]).filter(keep)


def file_profiles(files: DataFrame) -> DataFrame:
    """(file_id, producer, family, written_at, profile) of each valid file once.

    Rows with a null file_id, a null payload or invalid JSON are skipped; a repeated file_id is one file.
    """
    rows = files.where("file_id IS NOT NULL AND payload IS NOT NULL").select("file_id", "producer", "family", F.col("written_at").cast("timestamp").alias("written_at"), "payload")
    return rows.mapInArrow(_profiles, _PROFILE).dropDuplicates(["file_id"])


def _resolve(value: Any, known: State, part: int) -> Any:
    """What a placeholder stands for, `known` being the state after the partition's first file."""
    return known.get(value[1], (None, value[1]))[part] if isinstance(value, tuple) and value[:1] == ("in",) else value


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, str]]:
    for batch in batches:
        yield from zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(4).to_pylist())


def _plain(state: State) -> dict:
    return {k: [list(t) if t is not None else None, list(r) if isinstance(r, tuple) else r] for k, (t, r) in state.items()}


def _tupled(state: dict) -> State:
    return {k: (tuple(t) if t is not None else None, tuple(r) if isinstance(r, list) else r) for k, (t, r) in state.items()}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: the first file and, if it goes on through the partition, the symbolic last state."""
    first = None
    producer, last, state, number = None, None, {}, -1
    pid = None
    for batch in batches:
        if batch.num_rows and pid is None:
            pid = batch.column(5)[0].as_py()
        for who, _, text in _rows([batch]):
            now = _load(text)
            if number < 0:
                first = (who, now)
            if number < 0 or who != producer:
                number += 1
                # the first producer's first file may have a predecessor elsewhere: all that it inherits is a placeholder
                state = {p: (f.tags or ("in", p), ("in", p)) for p, f in now.items()} if number == 0 else step(None, {}, now)[1]
            else:
                _, state = step(last, state, now)
            producer, last = who, now
    if first is not None:
        text = json.dumps({"first": first, "single": number == 0, "producer": producer, "last": last, "state": _plain(state)})
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([text])], names=["pid", "summary"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in order of pid to what each partition starts from: (pid, producer, last profile, state)."""
    carry: tuple | None = None
    for batch in batches:
        out = []
        for pid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = json.loads(text)
            who, first = s["first"][0], {k: Field(v[0], tuple(v[1]), v[2]) for k, v in s["first"][1].items()}
            last = {k: Field(v[0], tuple(v[1]), v[2]) for k, v in s["last"].items()}
            joins = carry is not None and carry[0] == who
            out.append((pid, json.dumps({"producer": carry[0], "last": carry[1], "state": _plain(carry[2])}) if joins else None))
            state = _tupled(s["state"])
            if s["single"]:
                known = step(carry[1], carry[2], first)[1] if joins else step(None, {}, first)[1]
                state = {p: (_resolve(t, known, 0), _resolve(r, known, 1)) for p, (t, r) in state.items()}
            carry = (s["producer"], last, state)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([c for _, c in out], pa.string())], names=["pid", "carry"])


def _scan(emit: str):
    """Second scan: rows ('changes': file_id, path, kind; 'names': file_id, path, the field's first name).

    Rows come by pid and in order; a row with a carry stands before the files of its pid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, producer, last, state = None, None, None, {}
        for batch in batches:
            ids, paths, kinds = [], [], []
            for file_id, who, profile_text, at, carry in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6))):
                if at != pid:
                    pid, producer, last, state = at, None, None, {}
                if carry is not None:
                    c = json.loads(carry)
                    producer, last, state = c["producer"], {k: Field(v[0], tuple(v[1]), v[2]) for k, v in c["last"].items()}, _tupled(c["state"])
                    continue
                now = _load(profile_text)
                if last is None or who != producer:
                    found, state = step(None, {}, now)
                else:
                    found, state = step(last, state, now)
                producer, last = who, now
                for path, kind in found if emit == "changes" else [(p, r) for p, (_, r) in state.items()]:
                    ids.append(file_id)
                    paths.append(path)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(kinds, pa.string())], names=["file_id", "field_path", "value"])

    return run


def _scanned(files: DataFrame, emit: str) -> DataFrame:
    n = shuffle_partitions(files.sparkSession)
    order = ["producer", "written_at", "file_id"]
    ordered = file_profiles(files).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = durable(ordered.withColumn("pid", F.spark_partition_id()))
    summaries = durable(ordered.mapInArrow(_summaries, "pid int, summary string"))
    carried = summaries.coalesce(1).sortWithinPartitions("pid").mapInArrow(_compose, "pid int, carry string").where("carry IS NOT NULL")
    # a partition's carry, as wide as a schema, comes to it as a row of its own: no task or driver holds all of them
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in ordered.dtypes if c != "pid"]
    rows = ordered.withColumn("carry", F.lit(None).cast("string")).unionByName(carried.select(*nothing, "pid", "carry"))
    placed = rows.repartition(n, "pid").sortWithinPartitions("pid", F.col("carry").isNull(), *order)
    return placed.mapInArrow(_scan(emit), "file_id bigint, field_path string, value string")


def changes(files: DataFrame) -> DataFrame:
    """p1: (file_id, field_path, change_kind) of each file against its producer's previous one by written_at.

    Files are (file_id, producer, family, written_at, payload). Files of one time come in order of file_id; a
    null producer is a producer like any other; a null written_at comes first. A producer's first file gives no
    rows; files without any field compare like others; other columns are ignored whatever their names.
    """
    return _scanned(files, "changes").withColumnRenamed("value", "change_kind")


def field_names(files: DataFrame) -> DataFrame:
    """(file_id, field_path, field): the path under which a field was added, through all its renames."""
    return _scanned(files, "names").withColumnRenamed("value", "field")


_BRANCH = "file_id bigint, field_path string, pos int, tag string, v_string string, v_number double, v_boolean boolean, canonical string"


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "field_path", "pos", "tag", "v_string", "v_number", "v_boolean", "canonical"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string()]
    for batch in batches:
        rows = []
        for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, root = parse(text)
            seen: dict[str, int] = {}
            for path, _, value in leaves(root) if ok else ():
                pos = seen[path] = seen.get(path, -1) + 1
                tag = tag_of(value)
                shown = None if tag is None else str(value).lower() if tag == "boolean" else canonical(value)
                if shown and shown[0] == "#":  # a number, quoted or not, in one spelling
                    number = Decimal(shown[1:])
                    shown = format(number, "f") if abs(number.adjusted()) < 60 else shown[1:]
                elif shown and tag == "string":
                    shown = shown[1:]
                rows.append((file_id, utf8(path), pos, tag or "null", utf8(value) if tag == "string" else None, float(value) if tag == "number" else None, value if tag == "boolean" else None, utf8(shown)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=names)


def consistent_table(files: DataFrame) -> DataFrame:
    """All values of all files in one table, whatever their layout.

    (family, producer, file_id, field, field_path, pos, tag, v_string, v_number, v_boolean, canonical): `field`
    is the field's name through all renames, `tag` the alternative that the value has, one typed branch per
    alternative holds it, `canonical` is the text on which all alternatives agree (17, 17.0 and "17" are '17').
    """
    once = files.where("file_id IS NOT NULL AND payload IS NOT NULL").select("file_id", "producer", "family", "payload").dropDuplicates(["file_id"])
    values = once.select("file_id", "payload").mapInArrow(_branches, _BRANCH)
    named = field_names(files)
    return values.join(named, ["file_id", "field_path"]).join(once.select("file_id", "producer", "family"), "file_id").select("family", "producer", "file_id", "field", "field_path", "pos", "tag", "v_string", "v_number", "v_boolean", "canonical")


def alternatives(files: DataFrame) -> DataFrame:
    """The fused schema with the appearance of each alternative: (family, field_path, tag, files, first_file_id, first_written_at).

    `tag` is 'null' where only nulls were seen in a file. A row says that in `files` files of the family the path
    had that alternative, first in the file named.
    """
    # a profile's fields are [name, tags, digest]; only the tags matter here
    parsed = file_profiles(files).select("family", "file_id", "written_at", F.explode(F.from_json("profile", "map<string,array<string>>")).alias("field_path", "parts"))
    tags = F.from_json(F.col("parts")[1], "array<string>")
    rows = parsed.select("family", "file_id", "written_at", "field_path", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("null")))).alias("tag"))
    return rows.groupBy("family", "field_path", "tag").agg(F.count("*").alias("files"), F.min(F.struct("written_at", "file_id")).alias("f")).select("family", "field_path", "tag", "files", F.col("f.file_id").alias("first_file_id"), F.col("f.written_at").alias("first_written_at"))
