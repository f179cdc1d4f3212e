"""Compositions: the context of a review, a review over findings, an evaluation, cases from fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.review import SOURCE_FILE, TEST_FOLDER, finding_id, infer_category, infer_severity, reviewable, slug
from siltstone.functions.text import severity_rank
from siltstone.operators import evaluation as ev
from siltstone.operators import findings as fi
from siltstone.operators import text_tables as tt
from siltstone.operators.code_index import near_changes, overlapping_symbols
from siltstone.operators.runtime import ALWAYS, DIMENSIONS, MEANT_FINDINGS, ChatModel, answered
from siltstone.operators.state import exemplars, suppressed_ids
from siltstone.session import staged


def review_context(patches: DataFrame, key: str, symbols: DataFrame, signals: DataFrame) -> dict[str, DataFrame]:
    """hunks, changed lines, changed symbols and near signals of each patch (key, text); symbols and signals have key and file.

    Files not worth a review are left out before anything is joined; deleted ones have hunks but no changed lines.
    """
    hunks = tt.diff_hunks(patches, key).where(reviewable(F.col("file")))
    changed = tt.effective_lines(hunks.where("status <> 'deleted'"), key)
    return {"hunks": hunks, "changed": changed, "symbols": overlapping_symbols(symbols, changed, [key, "file"]), "signals": near_changes(signals, changed, [key, "file"])}


def review(raw: DataFrame, verdicts: DataFrame | None, suppressed: DataFrame | None, globs: list[str], keys: list[str], least: float = fi.MIN_CONFIDENCE) -> DataFrame:
    """The findings of each review that are reported: verified, sure enough, not suppressed or ignored, one near each line."""
    checked = raw if verdicts is None else fi.apply_verdicts(raw, verdicts, keys).drop("index")
    return fi.near_line_dedupe(fi.admitted(checked, suppressed, globs, least), [*keys, "file"])


def make_findings(found: DataFrame, category: Column) -> DataFrame:
    """What a dimension found (file, line, title and more) as findings of a category, with the id by which each is known again."""
    return found.withColumn("category", category).withColumn("id", finding_id(F.col("file"), F.col("line"), F.col("category"), F.col("title")))


def triaged(prompts: DataFrame, triage: ChatModel | None, keys: list[str]) -> DataFrame:
    """keys, prompt and category for each dimension that a triage model picks for a review: always the constant one, all where it fails or isn't there."""
    if triage is None:
        return prompts.select(*keys, "prompt", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("category"))
    asked_for = prompts.select(*keys, F.concat(F.lit(f"Which of {', '.join(DIMENSIONS)} does this change need? Answer as {{\"dimensions\": [...]}}.\n"), "prompt").alias("prompt"))
    picked = staged(answered(asked_for, triage, keys), "triage")
    listed = F.from_json(tt.outer_object(F.col("answer")), "struct<dimensions:array<string>>")["dimensions"]
    every = F.array(*[F.lit(d) for d in DIMENSIONS])
    known = F.array_intersect(listed, every)
    dims = F.when(F.size(known) > 0, F.array_union(known, F.array(F.lit(ALWAYS)))).otherwise(every)
    return prompts.join(picked.select(*keys, F.explode(F.coalesce(dims, every)).alias("category")), keys).select(*keys, "prompt", "category")


def with_exemplars(prompts: DataFrame, memory: DataFrame | None) -> DataFrame:
    """Prompts (with a category) and, behind each, the latest confirmed bugs of its category; at most two, so the table of them is small."""
    if memory is None:
        return prompts
    said = F.concat(F.lit("- "), "file", F.lit(": "), "title")
    few = exemplars(memory).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("s")))), lambda x: x["s"]), "\n").alias("few"))
    joined = prompts.join(few, "category", "left")
    return joined.withColumn("prompt", F.concat("prompt", F.coalesce(F.concat(F.lit("\n\n## Confirmed before\n"), "few"), F.lit("")))).select(*prompts.columns)


def read_answers(answers: DataFrame, reviewer: ChatModel, keys: list[str]) -> DataFrame:
    """The findings in answers (keys, answer); one without any that looks as if it meant some is sent back once, to be put right."""
    found = tt.answered_findings(answers, keys)
    empty = answers.join(found.select(*keys).distinct(), keys, "left_anti").where(F.col("answer").rlike(MEANT_FINDINGS))
    again = empty.select(*keys, F.concat(F.lit("Give this as one valid JSON object and nothing else:\n"), "answer").alias("prompt"))
    return found.unionByName(tt.answered_findings(staged(answered(again, reviewer, keys), "repaired"), keys))


def asked(
    prompts: DataFrame, reviewer: ChatModel, verifier: ChatModel | None, keys: list[str], least: float = fi.MIN_CONFIDENCE, suppressed: DataFrame | None = None, globs: list[str] | None = None,
    triage: ChatModel | None = None, memory: DataFrame | None = None,
) -> DataFrame:
    """A whole review by models of each prompt (keys, prompt): the dimensions that triage picks are asked, each with what memory has confirmed of it, answers that
    can't be read are put right once, the findings are verified in one listing per review, and what is left is reported as by review(), without
    what memory knows to be false.

    Calls run in the tasks that hold the prompts. An answer that can't be read gives no finding; a verifier that fails drops none. Answers are
    staged, so that no later step or lost executor asks again. Tools answer from tables that only the driver reaches, so a model that asks for them
    is led by runtime.tool_loop there, not here.
    """
    if memory is not None:
        false = suppressed_ids(memory)
        suppressed = false if suppressed is None else suppressed.select("id").unionByName(false)
    wanted = with_exemplars(triaged(prompts, triage, keys), memory)
    wanted = wanted.withColumn("prompt", F.concat(F.lit("Dimension: "), "category", F.lit("\n"), "prompt"))
    answers = staged(answered(wanted, reviewer, [*keys, "category"]), "answers")
    found = read_answers(answers, reviewer, [*keys, "category"])
    raw = make_findings(found, F.col("category")).select("*", F.xxhash64(*keys, "category", "item").alias("seq"), severity_rank(F.col("severity")).alias("rank"))
    if verifier is None:
        return review(raw, None, suppressed, globs or [], keys, least)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1
    said = F.concat(F.lit("#"), F.col("place").cast("string"), F.lit(" ["), "category", F.lit("] "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "title", F.lit("\n"), "rationale")
    listed = raw.withColumn("place", place).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("s")))), lambda x: x["s"]), "\n").alias("listing"))
    checks = prompts.join(listed, keys).select(*keys, F.concat("prompt", F.lit("\n\n## Candidates\n"), "listing").alias("prompt"))
    verdicts = tt.answered_verdicts(staged(answered(checks, verifier, keys), "verdicts"), keys)
    return review(raw, verdicts, suppressed, globs or [], keys, least)


def judged_by(findings: DataFrame, runs: DataFrame, judge: ChatModel, keys: list[str]) -> DataFrame:
    """n, valid_rate and mean_score of each run (keys) by a model that judges all findings of a run at once; a run without findings has 1 and 1.

    A finding that the model says nothing of is valid with 0.5.
    """
    said = F.concat(F.lit("- "), "id", F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "title", F.lit("\n"), "rationale")
    listed = findings.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", said.alias("s")))), lambda x: x["s"]), "\n").alias("listing"))
    asks = listed.select(*keys, F.concat(F.lit('Judge each finding. Answer as {"judgments": [{"id": ..., "valid": ..., "score": ...}]}.\n'), "listing").alias("prompt"))
    judgments = tt.answered_judgments(staged(answered(asks, judge, keys), "judgments"), keys)
    last = judgments.groupBy(*keys, "id").agg(F.max_by(F.struct("valid", "score"), "judgment_seq").alias("j"))
    each = findings.select(*keys, "id").join(last, [*keys, "id"], "left").select(*keys, F.coalesce("j.valid", F.lit(True)).cast("double").alias("valid"), F.coalesce("j.score", F.lit(0.5)).alias("score"))
    rates = each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("valid").alias("valid_rate"), F.avg("score").alias("mean_score"))
    return runs.join(rates, keys, "left").select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("valid_rate", F.lit(1.0)).alias("valid_rate"), F.coalesce("mean_score", F.lit(1.0)).alias("mean_score"))


def evaluated(findings: DataFrame, labels: DataFrame, runs: DataFrame, by_category: bool = True, collapse: bool = True) -> dict[str, DataFrame]:
    """Metrics of each run (case_id, ablation) and rates of each configuration."""
    metrics = ev.case_metrics(findings, labels, runs, by_category, collapse)
    return {"metrics": metrics, "rates": ev.rates(metrics, ["ablation"])}


def rescored(reports: DataFrame, by_category: bool = False) -> dict[str, DataFrame]:
    """Saved reports (caseId, ablation, findings, groundTruth) matched anew, whatever metrics they carry; list order is the order of matching."""
    own = [F.col("caseId").alias("case_id"), "ablation"]
    found = reports.select(*own, F.posexplode("findings").alias("n", "x")).select("case_id", "ablation", F.col("n").cast("long").alias("seq"), "x.file", "x.line", "x.category")
    truth = reports.select("caseId", "groundTruth").groupBy(F.col("caseId").alias("case_id")).agg(F.min_by("groundTruth", F.size("groundTruth")).alias("g"))
    labels = truth.select("case_id", F.posexplode("g").alias("n", "x")).select("case_id", F.col("n").cast("long").alias("gt_seq"), "x.file", "x.line", F.coalesce("x.endLine", "x.line").alias("end_line"), "x.category")
    return evaluated(found, labels, reports.select(*own).distinct(), by_category)


def cases_from_fixes(fixes: DataFrame, most_files: int = 2) -> dict[str, DataFrame]:
    """Cases and labels from fixing commits (sha, parent, repo, message, inverse_diff): the diff that takes the fix back is the change to review, and
    each of its hunks is a defect. Commits that touch no source file outside test folders, or more than most_files, give none."""
    hunks = tt.diff_hunks(fixes.select("sha", F.col("inverse_diff").alias("text")), "sha").where(F.col("file").rlike(SOURCE_FILE) & ~F.col("file").rlike(TEST_FOLDER))
    few = hunks.groupBy("sha").agg(F.count_distinct("file").alias("n")).where(F.col("n") <= most_files)
    case_id = F.concat(slug(F.substring_index("repo", "/", -1)), F.lit("-"), F.substring("sha", 1, 8))
    cases = fixes.join(few, "sha", "left_semi").select("sha", case_id.alias("case_id"), F.col("message").alias("description"), "repo", F.lit("real").alias("label_source"), F.struct(F.col("sha").alias("fix_commit"), F.col("parent").alias("parent_commit")).alias("seed"), "message")
    last = F.when(F.col("new_lines") > 0, F.col("new_start") + F.col("new_lines") - 1).otherwise(F.col("new_start"))
    labels = hunks.join(cases.select("sha", "case_id", "message"), "sha").select(
        "case_id", "file", F.col("new_start").alias("line"), last.alias("end_line"), infer_category(F.col("message")).alias("category"), infer_severity(F.col("message")).alias("severity"), F.concat(F.lit("Inverse of fix "), F.substring("sha", 1, 8)).alias("note")
    )
    return {"cases": cases.drop("sha", "message"), "labels": labels}
