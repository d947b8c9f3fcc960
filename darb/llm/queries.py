"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from darb.llm import languages, leakage, percentiles, tokens
from darb.session import table


def p2_found(spark, sf_dir):
    return percentiles.wide_tails(table(spark, sf_dir, "raw_metrics_tidy"))


def p2_percentiles(spark, sf_dir):
    values = percentiles.metric_values(table(spark, sf_dir, "raw_metrics_tidy"))
    found = percentiles.percentiles(values, ["cohort", "mode_name", "metric"], "v", [0.05, 0.25, 0.5, 0.75, 0.95])
    return found.select("cohort", "mode_name", "metric", "n", "pct", F.round("value", 6).alias("value"))


def p2_merged_days(spark, sf_dir):
    """Median and 95th percentile from sketches of single days, merged."""
    values = percentiles.metric_values(table(spark, sf_dir, "raw_metrics_tidy"), ("recorded_at",)).withColumn("day", F.to_date("recorded_at"))
    groups = ["cohort", "mode_name", "metric"]
    days = percentiles.sketch(values, ["day", *groups], "v")
    found = percentiles.sketch_percentiles(percentiles.merge_sketches(days.drop("day"), groups), groups, [0.5, 0.95])
    return found.select(*groups, "n", "pct", F.round("value", 6).alias("value"))


def p6_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_near(spark, sf_dir):
    """Documents with a passage of an item, an edit allowed, with what was found of the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return languages.wrong_labels(table(spark, sf_dir, "documents"))


def p8_segments(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return languages.document_segments(documents, languages.fit(documents))


QUERIES = {
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_merged_days": p2_merged_days,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}

_P2_VALUES = """
WITH once AS (
  SELECT DISTINCT row_id, cohort, mode, avg_walk_dist_m, total_route_time_min FROM raw_metrics_tidy WHERE row_id IS NOT NULL
), long AS (
  SELECT cohort, 'Mode ' || upper(right(trim(mode), 1)) AS mode_name, 'avg_walk_dist_m' AS metric, avg_walk_dist_m AS v FROM once
  UNION ALL
  SELECT cohort, 'Mode ' || upper(right(trim(mode), 1)), 'total_route_time_min', total_route_time_min FROM once
), x AS (
  SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v <> 9999.0
)
"""

#: Words of a column: no format characters, full-width forms and composed letters as NFKC has them, lower case.
_WORDS = "regexp_extract_all(lower(nfc_normalize(translate(regexp_replace({0}, '\\p{{Cf}}', '', 'g'), " + "'" + "".join(map(chr, range(0xFF10, 0xFF1A))) + "".join(map(chr, range(0xFF21, 0xFF3B))) + "".join(map(chr, range(0xFF41, 0xFF5B))) + "', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'))), '[\\p{{L}}\\p{{N}}]+')"


def _passages(table: str, key: str, text: str) -> str:
    words = f"SELECT DISTINCT {key}, {_WORDS.format(text)} AS w FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL"
    return f"SELECT DISTINCT {key}, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS p FROM ({words}) WHERE len(w) >= 12"


SQL = {
    "p7_found": f"WITH d AS ({_passages('documents', 'doc_id', 'text')}), i AS ({_passages('eval_items', 'item_id', 'item_text')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (p)",
    # a sketch of 24 bits keeps a value's sign, exponent and 12 bits of its mantissa
    "p2_merged_days": _P2_VALUES + """, k AS (
  SELECT cohort, mode_name, metric, CASE WHEN v <= 0 THEN v ELSE floor(v / pow(2, floor(log2(v)) - 12)) * pow(2, floor(log2(v)) - 12) END AS v FROM x)
SELECT cohort, mode_name, metric, n, pct, round(value, 6) AS value FROM (
  SELECT cohort, mode_name, metric, count(*) AS n, unnest([0.5::DOUBLE, 0.95]) AS pct, unnest(quantile_cont(v, [0.5, 0.95])) AS value FROM k GROUP BY cohort, mode_name, metric)
""",
    "p2_found": _P2_VALUES + "SELECT cohort, mode_name, metric FROM x GROUP BY ALL HAVING quantile_cont(v, 0.95) >= 3 * quantile_cont(v, 0.5)",
    "p2_percentiles": _P2_VALUES + """
SELECT cohort, mode_name, metric, n, pct, round(value, 6) AS value FROM (
  SELECT cohort, mode_name, metric, count(*) AS n, unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS pct,
         unnest(quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value
  FROM x GROUP BY cohort, mode_name, metric
)
""",
}
