"""Reports of reviews and evaluations as rows and as text: Markdown, JSON, review payloads, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.review import language
from siltstone.functions.text import SEVERITIES
from siltstone.operators.findings import best_first, comment_body, top_findings

PROMPT_SIGNALS, SUMMARY_LINES = 50, 10


def percent(rate: Column) -> Column:
    """A rate as a percentage of one decimal."""
    return F.concat(F.format_number(rate * 100, 1), F.lit("%"))


def with_interval(mean: Column, std: Column, ci95: Column | None = None) -> Column:
    """A mean rate with its interval, or its deviation where that is missing, as percentages."""
    half = std if ci95 is None else F.coalesce(ci95, std)
    return F.concat(percent(mean), F.lit(" ± "), percent(half))


def tally(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts of each severity as one line."""
    counts = [F.concat(F.lit(f"{s}: "), F.count_if(F.col("severity") == s).cast("string")) for s in SEVERITIES]
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws(", ", *counts).alias("tally"))


def markdown(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One Markdown document for each review: counts, then its findings best first. A review is small."""
    bodies = comment_body(findings).select("seq", "body")
    place = F.concat(F.lit("## `"), F.col("file"), F.lit(":"), F.col("line").cast("int").cast("string"), F.when(F.col("end_line") > F.col("line"), F.concat(F.lit("-"), F.col("end_line").cast("int").cast("string"))).otherwise(""), F.lit("`\n\n"))
    rows = findings.join(bodies, "seq").select(*keys, F.struct("rank", (-F.col("confidence")).alias("c"), "seq", F.concat(place, "body").alias("said")).alias("x"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.concat(F.lit("# Review\n\n"), "tally", F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: x["said"]), "\n\n"))
    return grouped.join(tally(findings, keys), keys).select(*keys, text.alias("markdown"))


def json_report(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the JSON document of each review: its findings best first, and their counts. A review is small."""
    one = F.struct("id", "category", "file", "line", F.col("end_line").alias("endLine"), "severity", "title", "rationale", "confidence")
    rows = findings.select(*keys, "severity", F.struct("rank", (-F.col("confidence")).alias("c"), "seq", one.alias("one")).alias("x"))
    counts = F.struct(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), counts.alias("counts"))
    return grouped.select(*keys, F.to_json(F.struct("counts", F.transform("xs", lambda x: x["one"]).alias("findings"))).alias("json"))


def files_by_language(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lang and the sorted files of each language that analyzers know; one change's files are few."""
    known = files.select(*keys, language(F.col("file"), "").alias("lang"), "file").where("lang <> ''").distinct()
    return known.groupBy(*keys, "lang").agg(F.array_sort(F.collect_set("file")).alias("files"))


def summaries(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the head of a posted review: counts and the SUMMARY_LINES best findings."""
    best = top_findings(findings, keys, SUMMARY_LINES)
    line = F.concat(F.lit("- "), F.upper("severity"), F.lit(" `"), F.col("file"), F.lit(":"), F.col("line").cast("int").cast("string"), F.lit("` "), F.col("title"))
    listed = best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    return tally(findings, keys).join(listed, keys).select(*keys, F.concat(F.col("n").cast("string"), F.lit(" findings ("), F.col("tally"), F.lit(")\n\n"), "lines").alias("summary"))


def review_events(findings: DataFrame, keys: list[str], threshold: str = "none") -> DataFrame:
    """keys and event of each review to be posted: REQUEST_CHANGES if a finding is at least as severe as the threshold, else COMMENT."""
    breach = F.lit(False) if threshold == "none" else F.bool_or(F.col("rank") <= SEVERITIES.index(threshold))
    return findings.groupBy(*keys).agg(F.when(F.coalesce(breach, F.lit(False)), "REQUEST_CHANGES").otherwise("COMMENT").alias("event"))


def comments_by_file(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file and the comments on it (line, message, unresolved if high or critical) in order of seq."""
    bodies = comment_body(findings).select("seq", F.col("line").alias("at"), "body")
    comment = F.struct("seq", F.col("at").alias("line"), F.col("body").alias("message"), (F.col("rank") <= 1).alias("unresolved"))
    return findings.join(bodies, "seq").groupBy(*keys, "file").agg(F.array_sort(F.collect_list(comment)).alias("comments"))


def evaluation_table(rates: DataFrame, config: str = "ablation") -> DataFrame:
    """The rows of an evaluation report, the best configuration by F1 marked."""
    best = rates.agg(F.max("f1").alias("best"))
    return rates.crossJoin(F.broadcast(best)).select(
        config, percent(F.col("recall")).alias("recall"), percent(F.col("precision")).alias("precision"), percent(F.col("f1")).alias("f1"), F.format_number("false_positives_per_case", 2).alias("false_positives_per_case"),
        percent(F.col("localization_accuracy")).alias("localization"), (F.col("f1") == F.col("best")).alias("is_best"),
    )


def user_prompts(diffs: DataFrame, signals: DataFrame, keys: list[str], most: int = 12_000) -> DataFrame:
    """keys and prompt of each review: its diff, cut at `most` characters, and the first PROMPT_SIGNALS signals of analyzers in order of file and line."""
    from pyspark.sql import Window

    first = signals.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line", "rule"))).where(F.col("_n") <= PROMPT_SIGNALS)
    said = F.concat(F.lit("- "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "rule", F.lit(": "), "message")
    listed = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", said.alias("s")))), lambda x: x["s"]), "\n").alias("signals"))
    diff = F.when(F.length("diff") > most, F.concat(F.substring("diff", 1, most), F.lit("\n... [truncated]"))).otherwise(F.col("diff"))
    prompt = F.concat(F.lit("## Diff\n```diff\n"), diff, F.lit("\n```"), F.when(F.col("signals").isNotNull(), F.concat(F.lit("\n\n## Analyzers\n"), F.col("signals"))).otherwise(""))
    return diffs.join(listed, keys, "left").select(*keys, prompt.alias("prompt"))


def dry_run(changed_files: DataFrame, symbols: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts of what a review would look at: files, changed symbols and signals."""
    a = changed_files.groupBy(*keys).agg(F.count_distinct("file").alias("files"))
    b = symbols.groupBy(*keys).agg(F.count("*").alias("symbols"))
    c = signals.groupBy(*keys).agg(F.count("*").alias("signals"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return a.join(b, keys, "full").join(c, keys, "full").select(*keys, zero("files"), zero("symbols"), zero("signals"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*best_first())
