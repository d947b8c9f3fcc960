"""Queries of the general data operators (problems 1, 3, 4, 5) and their DuckDB twins."""

from __future__ import annotations

from darb.operators import intervals, schema_drift, shred, spatial
from darb.session import table

CHANGES, RINGS, FILES, RUNS = "change_location_input", "cairo_boundary_points", "run_files", "run_output"


def p1_found(spark, sf_dir):
    return schema_drift.changes(table(spark, sf_dir, FILES))


def p1_consistent_table(spark, sf_dir):
    return schema_drift.consistent_table(table(spark, sf_dir, FILES))


def p1_alternatives(spark, sf_dir):
    return schema_drift.alternatives(table(spark, sf_dir, FILES))


def p3_found(spark, sf_dir):
    return intervals.student_periods(table(spark, sf_dir, CHANGES))


def p4_found(spark, sf_dir):
    return spatial.near_and_inside(table(spark, sf_dir, CHANGES), table(spark, sf_dir, RINGS))


def p4_near_classes(spark, sf_dir):
    """The near requests without their pairs: each request with its location's class and that class's links."""
    return spatial.near_classes(spatial.request_points(table(spark, sf_dir, CHANGES)), 5.0)


def p5_found(spark, sf_dir):
    return shred.nested_items(table(spark, sf_dir, CHANGES), table(spark, sf_dir, RUNS))


def p5_request_nodes(spark, sf_dir):
    return shred.shred(table(spark, sf_dir, CHANGES), "request_id", "data")


QUERIES = {"p1_found": p1_found, "p1_consistent_table": p1_consistent_table, "p1_alternatives": p1_alternatives, "p3_found": p3_found, "p4_found": p4_found, "p4_near_classes": p4_near_classes, "p5_found": p5_found, "p5_request_nodes": p5_request_nodes}


def _held(x: str) -> str:
    """JSON that a JSON string holds as text, else the value itself."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND left(ltrim({x} ->> '$'), 1) IN ('{{', '[') THEN ({x} ->> '$')::JSON ELSE {x} END"


def _elements(name: str, source: str, keep: str, path: str) -> str:
    """CTEs of the objects in the array (or in place of it) at a path: (keep, pos, o)."""
    at = "json_type(c) = 'ARRAY'"
    return f"""{name}_c AS (SELECT {keep}, {_held(f"(o -> '{path}')")} AS c FROM {source}),
{name}_e AS (SELECT {keep}, c, unnest(CASE WHEN {at} THEN range(json_array_length(c)::BIGINT) WHEN json_type(c) = 'OBJECT' THEN [0::BIGINT] ELSE []::BIGINT[] END) AS n FROM {name}_c),
{name}_v AS (SELECT {keep}, n, CASE WHEN {at} THEN c -> ('$[' || n || ']') ELSE c END AS x FROM {name}_e),
{name} AS (SELECT {keep}, n, {_held("x")} AS o FROM {name}_v WHERE json_type({_held("x")}) = 'OBJECT')"""


def _records(name: str, table_name: str, key: str, text: str) -> str:
    return f"{name} AS (SELECT id, {_held('j')} AS o FROM (SELECT DISTINCT {key} AS id, {text}::JSON AS j FROM {table_name} WHERE json_valid({text})) WHERE json_type({_held('j')}) = 'OBJECT')"


_P5 = f"""WITH {_records("req", "change_location_input", "request_id", "data")},
{_elements("bus", "req", "id", "$.buses")},
{_elements("route", "req", "id", "$.routes")},
route_n AS (SELECT id, n AS r, o FROM route),
{_elements("stop", "route_n", "id, r", "$.path")},
stop_n AS (SELECT id, r, n AS s, o FROM stop),
{_elements("student", "stop_n", "id, r, s", "$.students")},
{_records("run", "run_output", "output_id", "payload")},
modes_c AS (SELECT id, {_held("(o -> '$.modes')")} AS c FROM run),
modes_e AS (SELECT modes_c.id, m.key AS mode, m.value AS x FROM modes_c, json_each(CASE WHEN json_type(c) = 'OBJECT' THEN c ELSE '{{}}'::JSON END) m WHERE left(m.key, 1) <> '_'),
modes AS (SELECT id, mode, {_held("x")} AS o FROM modes_e WHERE json_type({_held("x")}) = 'OBJECT'),
{_elements("run_route", "modes", "id, mode", "$.routes")},
debug AS (SELECT id, {_held("(o -> '$.debug_stats')")} AS o FROM run),
{_elements("crossing", "debug", "id", "$.synthetic_crossings")}
SELECT id AS record_id, 'bus' AS node_kind, '' AS parent_pos, n AS pos, coalesce(o ->> '$.id', '') AS item_key FROM bus
UNION ALL SELECT id, 'capacity', n::VARCHAR, 0, TRY_CAST(o ->> '$.capacity' AS DOUBLE)::BIGINT::VARCHAR FROM bus WHERE (o ->> '$.capacity') IS NOT NULL
UNION ALL SELECT id, 'route', '', n, coalesce(o ->> '$.id', '') FROM route
UNION ALL SELECT id, 'stop', r::VARCHAR, n, coalesce(o ->> '$.node_id', '') FROM stop
UNION ALL SELECT id, 'student', r || '/' || s, n, coalesce(o ->> '$.id', '') FROM student
UNION ALL SELECT id, 'run_route', mode, n, coalesce(o ->> '$.route_id', '') FROM run_route
UNION ALL SELECT id, 'crossing', '', n, o ->> '$.strategy' FROM crossing WHERE (o ->> '$.strategy') IS NOT NULL
"""

SQL = {
    # types under each path of a file, merged over array elements; null only where nothing else is
    "p1_alternatives": """
WITH f AS (SELECT DISTINCT file_id, family, written_at, payload FROM run_files WHERE json_valid(payload) AND file_id IS NOT NULL),
t AS (SELECT file_id, family, written_at, regexp_replace(regexp_replace(fullkey, '\\[[0-9]+\\]', '', 'g'), '^\\$\\.?', '') AS field_path, type FROM f, json_tree(payload::JSON) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')),
k AS (SELECT file_id, family, written_at, replace(field_path, '"', '') AS field_path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN NULL ELSE 'number' END AS tag FROM t WHERE NOT regexp_matches(field_path, '(^|\\.)"?_')),
s AS (SELECT family, file_id, written_at, field_path, unnest(CASE WHEN count(tag) = 0 THEN ['null'] ELSE list(DISTINCT tag) FILTER (tag IS NOT NULL) END) AS tag FROM k GROUP BY 1, 2, 3, 4)
SELECT family, field_path, tag, count(*) AS files, arg_min(file_id, (written_at, file_id)) AS first_file_id, min(written_at) AS first_written_at FROM s GROUP BY 1, 2, 3
""",
    "p5_found": _P5,
    "p3_found": """
WITH r AS (
  SELECT DISTINCT upper(trim(meta.student_id, ' ' || chr(9) || chr(10) || chr(13))) AS s, meta.valid_from AS a, meta.valid_until AS b
  FROM change_location_input
  WHERE meta.student_id IS NOT NULL AND meta.valid_from IS NOT NULL AND meta.valid_until >= meta.valid_from
), m AS (
  SELECT *, max(b) OVER (PARTITION BY s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT s, min(a) AS a, max(b) AS b FROM g GROUP BY s, island
), n AS (
  SELECT *, lead(a) OVER (PARTITION BY s ORDER BY a) AS next_a FROM p
)
SELECT s AS student_id, 'period' AS span_kind, strftime(a, '%Y-%m-%d') AS from_day, strftime(b, '%Y-%m-%d') AS until_day FROM p
UNION ALL
SELECT s, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(next_a - 1, '%Y-%m-%d') FROM n WHERE next_a IS NOT NULL
""",
    "p4_near_classes": """
WITH pts AS (
  SELECT DISTINCT request_id AS key, meta.new_location.latitude AS lat, meta.new_location.longitude AS lon
  FROM change_location_input
  WHERE meta.new_location.latitude IS NOT NULL AND meta.new_location.longitude IS NOT NULL
    AND NOT isnan(meta.new_location.latitude) AND NOT isnan(meta.new_location.longitude)
    AND NOT (meta.new_location.latitude = 0 AND meta.new_location.longitude = 0)
), c AS (
  SELECT lat, lon, min(key) AS class_key, count(*) AS n FROM pts GROUP BY lat, lon
), l AS (
  SELECT p.lat, p.lon, count(*) AS classes, sum(t.n)::BIGINT AS points FROM c p JOIN c t
    ON (p.lat <> t.lat OR p.lon <> t.lon) AND abs(p.lat - t.lat) < 0.0001
   AND 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))) <= 5
  GROUP BY p.lat, p.lon
)
SELECT key, class_key, n AS class_size, coalesce(classes, 0) AS near_classes, coalesce(points, 0) + n - 1 AS near_points
FROM pts JOIN c USING (lat, lon) LEFT JOIN l USING (lat, lon)
""",
    "p4_found": """
WITH pts AS (
  SELECT DISTINCT request_id AS k, upper(trim(meta.student_id)) AS s, meta.new_location.latitude AS lat, meta.new_location.longitude AS lon
  FROM change_location_input
  WHERE meta.new_location.latitude IS NOT NULL AND meta.new_location.longitude IS NOT NULL
    AND NOT isnan(meta.new_location.latitude) AND NOT isnan(meta.new_location.longitude)
    AND NOT (meta.new_location.latitude = 0 AND meta.new_location.longitude = 0)
), v AS (
  SELECT DISTINCT boundary_id AS b, vertex_seq AS q, lon AS x, lat AS y FROM cairo_boundary_points
), e AS (
  SELECT b, x AS x1, y AS y1,
         coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM v WINDOW w AS (PARTITION BY b ORDER BY q)
), c AS (
  SELECT k, b, count(*) AS n FROM pts JOIN e
    ON (y1 <= lat) <> (y2 <= lat) AND (x2 - x1) * (lat - y1) / (y2 - y1) + x1 > lon
  GROUP BY k, b
)
SELECT 'near' AS case_kind, p.k AS key_a, q.k AS key_b FROM pts p JOIN pts q
  ON p.k < q.k AND coalesce(p.s, '') <> coalesce(q.s, '') AND abs(p.lat - q.lat) < 0.0001
 AND 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2)
     + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) <= 5
UNION ALL
SELECT 'inside', k, b FROM c WHERE n % 2 = 1
""",
}
