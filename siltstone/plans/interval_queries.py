"""Queries on line intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_path
from siltstone.operators.intervals import spans_and_gaps
from siltstone.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Covered stretches and gaps of the line ranges of findings and labels, per case and path."""
    ranges = [table(spark, folder, name).select("case_id", clean_path(F.col("file")).alias("file"), "line", "end_line") for name in ("findings", "defect_labels")]
    return spans_and_gaps(ranges[0].unionByName(ranges[1]), ["case_id", "file"], "line", "end_line")


P2_SQL = r"""
WITH r AS (
  SELECT case_id, file, line, end_line FROM findings UNION ALL SELECT case_id, file, line, end_line FROM defect_labels
), n AS (
  SELECT DISTINCT case_id, regexp_replace(regexp_replace(replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^\./', '') AS file,
         least(line, coalesce(end_line, line))::BIGINT AS s, greatest(line, coalesce(end_line, line))::BIGINT AS e
  FROM r WHERE line IS NOT NULL AND file IS NOT NULL AND case_id IS NOT NULL
), o AS (
  SELECT *, max(e) OVER (PARTITION BY case_id, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o
), spans AS (
  SELECT case_id, file, island, min(s) AS first_line, max(e) AS last_line FROM g GROUP BY ALL
), gaps AS (
  SELECT case_id, file, last_line + 1 AS first_line, lead(first_line) OVER (PARTITION BY case_id, file ORDER BY first_line) - 1 AS last_line FROM spans
)
SELECT case_id, file, 'span' AS span_kind, first_line, last_line FROM spans
UNION ALL SELECT case_id, file, 'gap', first_line, last_line FROM gaps WHERE last_line IS NOT NULL
"""
