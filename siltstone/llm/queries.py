"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.bpe import encoded
from siltstone.llm.handwritten import classified, not_handwritten
from siltstone.llm.knn import most_similar, similar_pairs
from siltstone.llm.leakage import leaked
from siltstone.llm.neardup import finding_duplicates
from siltstone.llm.reading import reading_levels
from siltstone.llm.splitting import cut_lines, pieces
from siltstone.llm.survivorship import finding_survivors
from siltstone.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return finding_survivors(table(spark, folder, "findings")).select("case_id", "finding_id", "best_seq", "patch_seq")


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each group with its best usable values."""
    return finding_survivors(table(spark, folder, "findings")).select("case_id", "finding_id", "best_seq", "severity", "confidence", F.col("patch").alias("suggested_patch"), F.size("evidence").cast("bigint").alias("n_evidence"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return finding_duplicates(table(spark, folder, "findings")).pairs().select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per finding with 20 words: its class of equal wording and the number of classes that agree with it."""
    return finding_duplicates(table(spark, folder, "findings")).membership().withColumnRenamed("id", "finding_seq")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lines(table(spark, folder, "code_chunks"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(table(spark, folder, "code_chunks"))


def p4_glued(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk put together again, each without what it repeats: digest of the whole, lines it spans, whether all pieces are
    within the limit, and whether each begins with the end of the one before, five whole lines or as many as fit."""
    cut = pieces(table(spark, folder, "code_chunks"))
    before = F.lag("text").over(Window.partitionBy("chunk_seq").orderBy("piece_no"))
    head = F.substring(F.col("text"), F.lit(1), F.col("repeated"))
    feeds = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + (~F.endswith(head, F.lit("\n"))).cast("int")
    # fewer than five lines only where one more line of the piece before wouldn't leave room, or where it has no more
    longer = F.length(F.substring_index(F.when(F.endswith("before", F.lit("\n")), F.substring(F.col("before"), F.lit(1), F.length("before") - 1)).otherwise(F.col("before")), "\n", -5))
    repeats = F.col("before").isNull() | (F.endswith("before", head) & ((F.col("repeated") == 0) | (feeds <= 5)) & ((feeds == 5) | (longer >= 3999 - 1) | (longer <= F.col("repeated"))))
    new = F.struct("piece_no", F.substring(F.col("text"), F.col("repeated") + 1, F.lit(2**31 - 1)).alias("new"))
    told = cut.withColumn("before", before).select("chunk_seq", new.alias("x"), "first_line", "last_line", (F.length("text") <= 4_000).alias("fits"), repeats.alias("repeats"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["new"]), "")
    return told.groupBy("chunk_seq").agg(F.md5(whole).alias("digest"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.bool_and("fits").alias("fits"), F.bool_and("repeats").alias("repeats"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "code_chunks"))


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """All files with their kind and the shares it rests on."""
    return classified(table(spark, folder, "code_chunks")).select("repo", "file", "kind", *[F.round(c, 4).alias(c) for c in ("mean_line", "space_share", "literal_share", "encoded_share", "different_share")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "vectors"))


def p6_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar others of every usable vector."""
    return most_similar(table(spark, folder, "vectors")).select("id", "other", F.round("cos", 6).alias("cos"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p3_found, p3_classes, p4_found, p4_pieces, p4_glued, p5_found, p5_kinds, p6_found, p6_topk, p7_ids, p8_found, p9_found)}

P1_SQL = r"""
WITH f AS (
  SELECT *, CASE lower(regexp_replace(severity, '^\s+|\s+$', '', 'g')) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS sev,
         CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE -1 END AS conf,
         coalesce(regexp_matches(suggested_patch, '\S'), false) AS has_patch,
         coalesce(len(list_distinct(evidence)), 0) AS ev
  FROM findings WHERE case_id IS NOT NULL AND id IS NOT NULL AND finding_seq IS NOT NULL
), r AS (
  SELECT case_id, id AS finding_id, finding_seq, has_patch,
         row_number() OVER (PARTITION BY case_id, id ORDER BY sev, conf DESC, has_patch DESC, ev DESC, created_at DESC NULLS LAST, finding_seq) AS rn
  FROM f
)
SELECT case_id, finding_id, arg_min(finding_seq, rn) AS best_seq, coalesce(arg_min(finding_seq, rn) FILTER (WHERE has_patch), -1) AS patch_seq
FROM r GROUP BY case_id, finding_id HAVING count(DISTINCT finding_seq) > 1
"""

P1_RECORDS_SQL = P1_SQL[: P1_SQL.index(", r AS (")] + r""", r AS (
  SELECT case_id, id AS finding_id, finding_seq, lower(trim(severity)) AS severity, sev, confidence, conf, suggested_patch, has_patch, evidence, ev,
         row_number() OVER (PARTITION BY case_id, id ORDER BY sev, conf DESC, has_patch DESC, ev DESC, created_at DESC NULLS LAST, finding_seq) AS rn
  FROM f
)
SELECT case_id, finding_id, arg_min(finding_seq, rn) AS best_seq, arg_min(severity, rn) FILTER (WHERE sev < 9) AS severity, arg_min(confidence, rn) FILTER (WHERE conf >= 0) AS confidence,
       arg_min(suggested_patch, rn) FILTER (WHERE has_patch) AS suggested_patch, (arg_min(ev, rn) FILTER (WHERE ev > 0))::BIGINT AS n_evidence
FROM r GROUP BY case_id, finding_id HAVING count(DISTINCT finding_seq) > 1
"""

P3_SQL = r"""
WITH f AS (
  SELECT DISTINCT finding_seq, regexp_replace(regexp_replace(replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^\./', '') AS path,
         regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(rationale, '')), '[a-z0-9_]+') AS w
  FROM findings
), s AS (
  SELECT finding_seq, path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM f WHERE len(w) >= 20
), x AS (SELECT finding_seq, path, len(runs) AS n, unnest(runs) AS run FROM s),
pairs AS (
  SELECT a.finding_seq AS seq_a, b.finding_seq AS seq_b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM x a JOIN x b ON a.path = b.path AND a.run = b.run AND a.finding_seq < b.finding_seq GROUP BY ALL
)
SELECT seq_a, seq_b FROM pairs WHERE shared >= 0.6 * (na + nb - shared)
"""

P3_CLASSES_SQL = P3_SQL[: P3_SQL.index("s AS (")] + r"""c AS (SELECT path, w, min(finding_seq) AS class_id FROM f WHERE len(w) >= 20 GROUP BY ALL),
x AS (SELECT class_id, path, len(runs) AS n, unnest(runs) AS run FROM (SELECT class_id, path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM c)),
l AS (SELECT a.class_id AS class_id, b.class_id AS other, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.path = b.path AND a.run = b.run AND a.class_id <> b.class_id GROUP BY ALL),
d AS (SELECT class_id, count(*) AS n FROM l WHERE shared >= 0.6 * (na + nb - shared) GROUP BY ALL)
SELECT f.finding_seq, c.class_id, coalesce(d.n, 0) AS n_links FROM f JOIN c ON f.path = c.path AND f.w = c.w LEFT JOIN d ON d.class_id = c.class_id
"""

P4_GLUED_SQL = r"""
SELECT DISTINCT chunk_seq, md5(text) AS digest, coalesce(start_line, 1)::INT AS first_line,
       (coalesce(start_line, 1) + length(text) - length(replace(text, chr(10), '')) - ends_with(text, chr(10))::INT)::INT AS last_line, true AS fits, true AS repeats
FROM code_chunks WHERE length(text) > 4000 AND chunk_seq IS NOT NULL
"""

P6_SQL = """
WITH u AS (
  SELECT id, any_value(vector) AS v FROM vectors
  WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id
), d AS (SELECT id, CAST(CAST(v AS DOUBLE[]) AS DOUBLE[64]) AS v FROM u),
c AS (SELECT a.id AS id, b.id AS other, array_cosine_similarity(a.v, b.v) AS cos FROM d a JOIN d b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS rn FROM c)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE rn <= 5 AND cos >= 0.85
"""

P6_TOPK_SQL = P6_SQL[: P6_SQL.index("SELECT DISTINCT least")] + "SELECT id, other, round(cos, 6) AS cos FROM r WHERE rn <= 5"

P8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM d WHERE len(w) >= 12),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)
"""

ORACLES = {
    "p1_found": P1_SQL, "p1_records": P1_RECORDS_SQL, "p3_found": P3_SQL, "p3_classes": P3_CLASSES_SQL, "p4_glued": P4_GLUED_SQL, "p6_found": P6_SQL, "p6_topk": P6_TOPK_SQL, "p8_found": P8_SQL,
}
