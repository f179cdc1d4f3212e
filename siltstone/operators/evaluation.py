"""Matching findings with labelled defects, and statistics of the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.review import t_critical

TOLERANCE = 3
#: Tolerated drop of a rate, and rise of false positives a case.
METRIC_DROP, FP_RISE = 0.05, 1.0

#: Configurations, each with one part more than the one before: index, static analysis, verifier, memory.
CONFIGURATIONS = {
    "B-llm-only": [],
    "+rag": ["index"],
    "+static": ["index", "static"],
    "+verifier": ["index", "static", "verifier"],
    "full": ["index", "static", "verifier", "memory"],
}

#: Most configurations that an evaluation compares.
MOST_CONFIGURATIONS = 100

COUNTS = ["true_positives", "false_positives", "false_negatives", "localized"]


def every_run(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Every case under every configuration that any finding names: case_id and ablation. The names are a short list, and an error if it isn't."""
    names = [r[0] for r in findings.select("ablation").distinct().limit(MOST_CONFIGURATIONS + 1).collect()]
    if len(names) > MOST_CONFIGURATIONS:
        raise ValueError(f"more than {MOST_CONFIGURATIONS} configurations")
    return cases.select("case_id", F.explode(F.array(*[F.lit(n).cast("string") for n in names]).cast("array<string>")).alias("ablation"))


def chosen_cases(cases: DataFrame, only: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Cases (case_id) that a list of names asks for, less those that another names; without lists all."""
    kept = cases if only is None else cases.where(F.col("case_id").isin(only))
    return kept if not without else kept.where(~F.col("case_id").isin(without))


def compared_configuration(rates: DataFrame, order: str = "run_no") -> DataFrame:
    """The rates (ablation, run_no) that stand for a run where it is compared: those of the full configuration, else of the last one."""
    return rates.orderBy((F.col("ablation") == "full").desc(), F.desc(order)).limit(1)


def matched_findings(findings: DataFrame, labels: DataFrame, by_category: bool = True, collapse: bool = True) -> DataFrame:
    """seq, group and inside of each finding near a range: its first defect group in label order, and whether it lies within one of the group's ranges.

    Ranges of one case and file (and category) form one group if collapsed, else each range does. A group without a category takes any.
    """
    category = [F.coalesce("category", F.lit("")).alias("g_category")] if by_category else []
    ranges = labels.select("case_id", "file", F.col("line").alias("first"), F.col("end_line").alias("last"), "gt_seq", *category)
    if collapse:
        names = ["case_id", "file", *(["g_category"] if by_category else [])]
        ranges = ranges.join(ranges.groupBy(*names).agg(F.min("gt_seq").alias("group")), names)
    else:
        ranges = ranges.withColumn("group", F.col("gt_seq"))
    near = (F.col("line") >= F.col("first") - TOLERANCE) & (F.col("line") <= F.col("last") + TOLERANCE)
    if by_category:
        near = near & ((F.col("g_category") == "") | (F.col("g_category") == F.col("category")))
    inside = (F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))
    pairs = findings.select("seq", "case_id", "ablation", "file", "line", "category").join(ranges, ["case_id", "file"]).where(near)
    per_group = pairs.groupBy("case_id", "ablation", "seq", "group").agg(F.max(inside).alias("inside"))
    return per_group.groupBy("case_id", "ablation", "seq").agg(F.min(F.struct("group", "inside")).alias("m")).select("case_id", "ablation", "seq", "m.group", "m.inside")


def case_metrics(findings: DataFrame, labels: DataFrame, runs: DataFrame, by_category: bool = True, collapse: bool = True) -> DataFrame:
    """true_positives, false_positives, false_negatives and localized of each run (case_id, ablation)."""
    matched = matched_findings(findings, labels, by_category, collapse)
    found = matched.groupBy("case_id", "ablation", "group").agg(F.min_by("inside", "seq").alias("first_inside"), F.count("*").alias("n"))
    hits = found.groupBy("case_id", "ablation").agg(F.count("*").alias("tp"), F.count_if("first_inside").alias("localized"), F.sum("n").alias("n_matched"))
    category = [F.coalesce("category", F.lit(""))] if by_category else []
    groups = labels.groupBy("case_id").agg((F.count_distinct("file", *category) if collapse else F.count("*")).alias("n_groups"))
    totals = findings.groupBy("case_id", "ablation").agg(F.count("*").alias("n_findings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = runs.select("case_id", "ablation").join(totals, ["case_id", "ablation"], "left").join(hits, ["case_id", "ablation"], "left").join(groups, "case_id", "left")
    return joined.select(
        "case_id",
        "ablation",
        zero("tp").alias("true_positives"),
        (zero("n_findings") - zero("n_matched")).alias("false_positives"),
        (zero("n_groups") - zero("tp")).alias("false_negatives"),
        zero("localized").alias("localized"),
    )


def rates(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and micro-averaged rates of each group; of nothing, recall and precision are 1 and the others 0."""
    sums = metrics.groupBy(*keys).agg(F.count("*").alias("cases"), *[F.sum(c).alias(c) for c in COUNTS])
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    out = sums.withColumn("recall", F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fn))).withColumn("precision", F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp, tp + fp)))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), both))).withColumn(
        "false_positives_per_case", F.coalesce(F.try_divide(fp, F.col("cases")), F.lit(0.0))
    ).withColumn("localization_accuracy", F.when(tp == 0, 0.0).otherwise(F.try_divide(F.col("localized"), tp)))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, min, max, standard error and half the 95 % interval of a value; 0 spread for one row."""
    v = F.col(value).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    sem = stats.withColumn("sem", F.col("std") / F.sqrt("n"))
    return sem.withColumn("ci95", t_critical(F.col("n") - 1) * F.col("sem"))


def regressions(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """metric and verdict (regression, improvement or same) of each group in both, by the tolerances above."""
    names = ["recall", "precision", "f1", "false_positives_per_case"]

    def long(df: DataFrame, value: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names]))
        return df.select(*keys, each.alias("x")).select(*keys, "x.metric", F.col("x.v").alias(value))

    joined = long(current, "now").join(long(baseline, "before"), [*keys, "metric"])
    rise = F.when(F.col("metric") == "false_positives_per_case", F.col("before") - F.col("now")).otherwise(F.col("now") - F.col("before"))
    slack = F.when(F.col("metric") == "false_positives_per_case", FP_RISE).otherwise(METRIC_DROP)
    return joined.withColumn("verdict", F.when(rise < -slack, "regression").when(rise > slack, "improvement").otherwise("same"))
