"""Views of the test tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_path, severity_rank
from siltstone.session import small, staged
from siltstone.sources.tables import table

#: Confidence of a finding that names none.
DEFAULT_CONFIDENCE = 0.6


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Valid findings, each once: a known severity, a confidence within 0..1 (or none) and a line."""
    f = table(spark, folder, "findings")
    rank = severity_rank(F.col("severity"))
    valid = rank.isNotNull() & F.col("line").isNotNull() & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
    return f.where(valid).dropDuplicates(["finding_seq"]).select(
        F.col("finding_seq").alias("seq"),
        "case_id",
        F.coalesce("ablation", F.lit("")).alias("ablation"),
        "id",
        "category",
        clean_path(F.col("file")).alias("file"),
        "line",
        F.coalesce("end_line", "line").alias("end_line"),
        F.lower(F.trim("severity")).alias("severity"),
        rank.alias("rank"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        "suggestion",
        "suggested_patch",
        F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        "evidence",
        "created_at",
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled defect ranges, each once."""
    g = table(spark, folder, "defect_labels").where("line IS NOT NULL").dropDuplicates(["gt_seq"])
    return g.select("gt_seq", "case_id", clean_path(F.col("file")).alias("file"), "line", F.coalesce("end_line", "line").alias("end_line"), "category", "note")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cases").dropDuplicates(["case_id"])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Code chunks, each once. Repeats are found by chunk_seq alone, so only their texts move; queries whose rows tell repeats apart by themselves read raw_chunks."""
    raw = raw_chunks(spark, folder)
    twice = staged(raw.groupBy("chunk_seq").count().where("count > 1").select("chunk_seq"), "repeated-chunks")
    known = small(twice)
    return raw.join(known, "chunk_seq", "left_anti").unionByName(raw.join(known, "chunk_seq", "left_semi").dropDuplicates(["chunk_seq"]))


def raw_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Code chunks as delivered, some twice."""
    return table(spark, folder, "code_chunks")


def chunk_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Code chunks, each once, with the SHA-1 of their text (null as empty) in its place."""
    c = raw_chunks(spark, folder).select("chunk_seq", "repo", "file", "id", "kind", F.sha1(F.coalesce("text", F.lit(""))).alias("digest"))
    return c.dropDuplicates(["chunk_seq"])


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that chunks were cut by."""
    c = table(spark, folder, "code_chunks").where("symbol IS NOT NULL AND symbol <> '<file>' AND end_line IS NOT NULL")
    return c.select(F.col("chunk_seq").alias("seq"), "repo", "file", F.col("symbol").alias("name"), "kind", "start_line", "end_line").dropDuplicates(["seq"])


PATH_SQL = r"regexp_replace(regexp_replace(replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^\./', '')"

SQL = {
    "f": rf"""f AS (
  SELECT DISTINCT finding_seq AS seq, case_id, coalesce(ablation, '') AS ablation, id, category, {PATH_SQL} AS file, line, coalesce(end_line, line) AS end_line,
         lower(trim(severity)) AS severity, CASE lower(trim(severity)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank,
         coalesce(title, '') AS title, coalesce(rationale, '') AS rationale, suggestion, suggested_patch, coalesce(confidence, 0.6) AS confidence, evidence, created_at
  FROM findings WHERE lower(trim(severity)) IN ('critical', 'high', 'medium', 'low') AND line IS NOT NULL AND (confidence IS NULL OR confidence BETWEEN 0 AND 1))""",
    "g": rf"""g AS (
  SELECT DISTINCT gt_seq, case_id, {PATH_SQL} AS file, line, coalesce(end_line, line) AS end_line, category, note FROM defect_labels WHERE line IS NOT NULL)""",
    "c": "c AS (SELECT DISTINCT * FROM cases)",
    "k": "k AS (SELECT DISTINCT * FROM code_chunks)",
    "s": """s AS (
  SELECT DISTINCT chunk_seq AS seq, repo, file, symbol AS name, kind, start_line, end_line FROM code_chunks WHERE symbol IS NOT NULL AND symbol <> '<file>' AND end_line IS NOT NULL)""",
}


def with_views(*names: str, more: str = "") -> str:
    """WITH and the named views, then more of them."""
    return "WITH RECURSIVE " + ", ".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
