"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import has_ink, severity_rank

#: Bounds of a usable confidence.
LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.0, 1.0


def survivors(df: DataFrame, keys: list[str], row_key: str, order: list[Column], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per group of at least two rows with different row_key: best_seq and, for each field, the value and row_key of the
    best row where the field is usable.

    order holds columns of which a greater value wins, null being least; the smaller row_key wins last. fields maps a name to
    (value, usable). A single aggregation takes the maximum of the composite (usable, *order, -row_key, value) for each field:
    rows are combined on the map side, so a group with a third of all rows reaches its reducer as one row per map task.

    Rows with a null key or row_key belong to no group and are left out. Rows repeated with the same row_key count once.
    Returns keys, best_seq, and name and name_seq of each field (null and -1 where no row is usable).
    """
    known = F.col(row_key).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    rank = [c.alias(f"r{i}") for i, c in enumerate(order)] + [(-F.col(row_key)).alias("neg")]
    wanted = [F.max(F.struct(*rank)).alias("_best"), F.min(row_key).alias("_low"), F.max(row_key).alias("_high")]
    for name, (value, usable) in fields.items():
        wanted.append(F.max(F.when(usable, F.struct(*rank, value.alias("value")))).alias(f"_{name}"))
    grouped = df.where(known).groupBy(*keys).agg(*wanted).where(F.col("_low") < F.col("_high"))
    out = [*keys, (-F.col("_best.neg")).alias("best_seq")]
    for name in fields:
        out += [F.col(f"_{name}.value").alias(name), F.coalesce(-F.col(f"_{name}.neg"), F.lit(-1).cast("long")).alias(f"{name}_seq")]
    return grouped.select(*out)


def finding_order(evidence: str = "evidence") -> list[Column]:
    """Severity, usable confidence, a patch that isn't blank, distinct evidence, later creation: greater wins.

    Unknown severity and unusable confidence rank last; null evidence counts as none.
    """
    rank = severity_rank(F.col("severity"))
    confidence = F.when(F.col("confidence").between(LEAST_CONFIDENCE, MOST_CONFIDENCE), F.col("confidence"))
    return [
        F.coalesce(-rank, F.lit(-9)),
        F.coalesce(confidence, F.lit(-1.0)),
        has_ink(F.col("suggested_patch")).cast("int"),
        F.coalesce(F.size(F.array_distinct(F.col(evidence))), F.lit(0)),
        F.col("created_at"),
    ]


def finding_survivors(findings: DataFrame) -> DataFrame:
    """The surviving finding of each (case_id, id): the best row overall and the best usable severity, confidence, patch and evidence."""
    chosen = findings.select("case_id", F.col("id").alias("finding_id"), "finding_seq", "severity", "confidence", "suggested_patch", "evidence", "created_at")
    usable_confidence = F.coalesce(F.col("confidence").between(LEAST_CONFIDENCE, MOST_CONFIDENCE), F.lit(False))
    return survivors(
        chosen,
        ["case_id", "finding_id"],
        "finding_seq",
        finding_order(),
        {
            "severity": (F.lower(F.trim(F.col("severity"))), severity_rank(F.col("severity")).isNotNull()),
            "confidence": (F.col("confidence"), usable_confidence),
            "patch": (F.col("suggested_patch"), has_ink(F.col("suggested_patch"))),
            "evidence": (F.array_distinct(F.col("evidence")), F.coalesce(F.size(F.col("evidence")) > 0, F.lit(False))),
        },
    )
