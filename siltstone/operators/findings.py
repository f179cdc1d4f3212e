"""Operators on findings: near-line deduplication, filters, order, counts, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.review import matches_glob, sarif_level
from siltstone.functions.text import SEVERITIES

NEAR_LINES, MIN_CONFIDENCE = 5, 0.6


def near_line_dedupe(findings: DataFrame, keys: list[str], window: int = NEAR_LINES) -> DataFrame:
    """Rows kept when, best first (rank, then greater confidence, then seq), a row is dropped if one kept before in the same group of keys is
    within `window` lines.

    The fold is sequential, but only the best row of a line can be kept and rows further apart than the window in line order never
    meet. So each group is first reduced to the best row of each line, which combines on the map side however many rows
    a file has, and then cut into islands at gaps wider than the window; each island is folded by itself.
    """
    payload = [c for c in findings.columns if c not in keys + ["line"]]
    best = F.struct(F.col("rank").alias("o1"), (-F.col("confidence")).alias("o2"), F.col("seq").alias("o3"))
    per_line = findings.where(F.col("line").isNotNull()).groupBy(*keys, "line").agg(F.min(F.struct(best.alias("order"), F.struct(*payload).alias("row"))).alias("best"))
    along = Window.partitionBy(*keys).orderBy("line")
    jump = F.coalesce(F.col("line") - F.lag("line").over(along) > window, F.lit(False)).cast("int")
    islands = per_line.withColumn("_jump", jump).withColumn("_island", F.sum("_jump").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = islands.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct("best.order", "line", "best.row"))).alias("rows"))
    kept = F.aggregate(
        "rows",
        F.slice("rows", 1, 0),
        lambda done, x: F.when(F.exists(done, lambda y: F.abs(y["line"] - x["line"]) <= window), done).otherwise(F.array_append(done, x)),
    )
    out = gathered.select(*keys, F.explode(kept).alias("x"))
    return out.select(*keys, F.col("x.line").alias("line"), *[F.col("x.row")[c].alias(c) for c in payload])


def admitted(findings: DataFrame, suppressed: DataFrame | None, globs: list[str], least: float = MIN_CONFIDENCE) -> DataFrame:
    """Findings of enough confidence, not suppressed by id and not in a file that a glob names."""
    kept = findings.where((F.col("confidence") >= least) & ~matches_glob(F.col("file"), globs))
    return kept if suppressed is None else kept.join(suppressed.select("id").distinct(), "id", "left_anti")


def best_first() -> list[Column]:
    return [F.col("rank"), F.desc("confidence"), F.col("seq")]


def top_findings(findings: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best findings of each group with their place, from 1."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first()))).where(F.col("place") <= k)


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every group and severity, 0 where there is none."""
    counts = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot([F.col(k) for k in keys], [F.col(s) for s in SEVERITIES], "severity", "n")


def gate(findings: DataFrame, keys: list[str], fail_on: str) -> DataFrame:
    """exit_code of each group: 2 if a finding is at least as severe as fail_on, else 0; "none" never fails."""
    breach = F.lit(False) if fail_on == "none" else F.bool_or(F.col("rank") <= SEVERITIES.index(fail_on))
    return findings.groupBy(*keys).agg(F.when(F.coalesce(breach, F.lit(False)), 2).otherwise(0).alias("exit_code"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row per result of a SARIF log."""
    return findings.select(
        "seq", F.col("category").alias("rule_id"), sarif_level(F.col("severity")).alias("level"), F.concat("title", F.lit("\n\n"), "rationale").alias("message"),
        F.col("file").alias("uri"), F.greatest(F.lit(1), "line").alias("start_line"), F.greatest(F.lit(1), F.coalesce("end_line", "line")).alias("end_line"), "confidence", "severity",
    )


def sarif_log(findings: DataFrame, keys: list[str], tool: str, version: str) -> DataFrame:
    """A SARIF 2.1.0 document for each group of keys; a group is one review and small."""
    location = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.struct("confidence", "severity").alias("properties"), F.array(location).alias("locations")
    )
    rows = sarif_results(findings).join(findings.select("seq", *keys), "seq")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", result.alias("result")))).alias("r"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda r: F.struct(r.alias("id"), r.alias("name"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("r", lambda x: x["result"]).alias("results"))
    return grouped.select(*keys, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Findings less those a verdict drops, with no more confidence than their verdict's; a finding without a verdict stays.

    A verdict names the place of a finding in its group (index, from 0, by seq); of several the last by verdict_seq holds.
    """
    placed = findings.withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1).cast("long"))
    last = verdicts.groupBy(*keys, "index").agg(F.max_by(F.struct("keep", F.col("confidence").alias("v_confidence")), "verdict_seq").alias("v"))
    joined = placed.join(last, [*keys, "index"], "left").where(F.coalesce(F.col("v.keep"), F.lit(True)))
    return joined.withColumn("confidence", F.least("confidence", "v.v_confidence")).drop("v")


def judged(findings: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """n, valid_rate and mean_score of each group; a finding without a judgment is valid with 0.5."""
    j = judgments.groupBy("id").agg(F.max_by(F.struct("valid", "score"), "judgment_seq").alias("j"))
    joined = findings.join(j, "id", "left").select(*keys, F.coalesce("j.valid", F.lit(True)).alias("valid"), F.coalesce("j.score", F.lit(0.5)).alias("score"))
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("valid").cast("double")).alias("valid_rate"), F.avg("score").alias("mean_score"))


def not_posted(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Findings whose id no comment body names."""
    posted = comments.select(F.regexp_extract("body", "finding id: `([0-9a-f]{6,})`", 1).alias("id")).where("id <> ''").distinct()
    return findings.join(posted, "id", "left_anti")


def inline_or_summary(findings: DataFrame, commentable: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """placement of each finding: inline if its line can be commented on and it is among the `most` best such of its group, else summary."""
    lines = commentable.select("file", F.col("line").alias("_at")).distinct().withColumn("_can", F.lit(True))
    marked = findings.withColumn("_at", F.greatest(F.lit(1), "line")).join(lines, ["file", "_at"], "left")
    place = F.row_number().over(Window.partitionBy(*keys, F.col("_can")).orderBy(*best_first()))
    return marked.withColumn("placement", F.when(F.col("_can") & (place <= most), "inline").otherwise("summary")).drop("_at", "_can")


def comment_body(findings: DataFrame) -> DataFrame:
    """seq and the Markdown body of an inline comment, ending in the finding's id."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n\n{label}"), c)).otherwise("")
    evidence = F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<struct<ev_type:string,ev_ref:string>>")), lambda e: F.concat(F.lit("\n- "), e["ev_type"], F.lit(": "), e["ev_ref"])), "")
    head = F.concat(F.lit("**"), F.upper("severity"), F.lit(": "), F.col("title"), F.lit("** ("), F.col("category"), F.lit(", "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit(" %)"))
    patch = F.when(F.coalesce("suggested_patch", F.lit("")) != "", F.concat(F.lit("\n\n```suggestion\n"), F.col("suggested_patch"), F.lit("\n```"))).otherwise("")
    body = F.concat(head, line("", F.col("rationale")), line("Suggestion: ", F.col("suggestion") if "suggestion" in findings.columns else F.lit(None).cast("string")), patch, F.when(evidence != "", F.concat(F.lit("\n"), evidence)).otherwise(""), F.lit("\n\nfinding id: `"), F.col("id"), F.lit("`"))
    return findings.select("seq", "file", F.greatest(F.lit(1), "line").alias("line"), body.alias("body"))
