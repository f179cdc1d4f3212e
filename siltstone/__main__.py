"""Commands: python -m siltstone COMMAND, over a data folder (tables as name.parquet) or a repository."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.operators import evaluation, findings, pipeline, reports
from siltstone.operators.code_index import extracted_symbols, import_aliases, scanned_calls
from siltstone.operators.runtime import StubModel, embedded
from siltstone.operators.state import with_feedback
from siltstone.operators.text_tables import window_chunks
from siltstone.plans import registry, views
from siltstone.session import local_session
from siltstone.sources import files as sources

REVIEW = ["case_id", "ablation"]


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    """Index a repository's files: files, symbols, chunks, call sites and aliases as tables in the folder out."""
    scanned = sources.scanned(spark, a.folder).cache()
    tables = {
        "files": scanned.select("file", "hash", "lang"),
        "symbols": extracted_symbols(scanned, ["file"]),
        "chunks": window_chunks(scanned, "file"),
        "sites": scanned_calls(scanned, ["file"]),
        "aliases": import_aliases(scanned, ["file"]),
    }
    # vectors come from the stub, unless a model is wired in its place
    tables["vectors"] = embedded(tables["chunks"], StubModel())
    tables["meta"] = scanned.agg(F.count("*").alias("files")).join(tables["chunks"].agg(F.count("*").alias("chunks"))).withColumn("built_at", F.current_timestamp())
    sources.save_index(a.out, **tables)
    return 0


def review(spark: SparkSession, a: argparse.Namespace) -> int:
    """Report the findings of every review; exit code 2 if one is as severe as --fail-on."""
    raw = views.findings(spark, a.folder)
    found = pipeline.review(raw, None, None, a.ignore, REVIEW)
    made = {"md": reports.markdown, "json": reports.json_report, "sarif": lambda f, k: findings.sarif_log(f, k, "siltstone", "0")}
    if a.out:
        for name in made if a.format == "all" else [a.format]:
            made[name](found, REVIEW).write.mode("overwrite").json(f"{a.out}/{name}" if a.format == "all" else a.out)
    worst = findings.gate(found, [], a.fail_on).collect()
    return int(worst[0]["exit_code"]) if worst else 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the rates of every configuration; exit code 3 if the last named one is worse than the first."""
    f, labels = views.findings(spark, a.folder), views.labels(spark, a.folder)
    cases = evaluation.chosen_cases(views.cases(spark, a.folder), a.only)
    if a.only:
        f, labels = (t.join(cases.select("case_id"), "case_id", "left_semi") for t in (f, labels))
    runs = evaluation.every_run(cases, f)
    rates = pipeline.evaluated(f, labels, runs, not a.category_agnostic)["rates"].cache()
    reports.evaluation_table(rates).show(truncate=False)
    if len(a.compare) == 2:
        now, before = (rates.where(F.col("ablation") == n).withColumn("all", F.lit(1)) for n in reversed(a.compare))
        return 3 if evaluation.regressions(now, before, ["all"]).where("verdict = 'regression'").count() else 0
    return 0


def feedback(spark: SparkSession, a: argparse.Namespace) -> int:
    """Record a verdict (accept, reject or ignore) on a finding in the memory at memory; exit code 1 if no finding has the id."""
    f = views.findings(spark, a.folder).where(F.col("id") == a.id)
    record = f.select("id", F.lit(a.verdict).alias("verdict"), "category", "file", "title", F.col("rationale").alias("text"), F.current_timestamp().alias("created"), "seq", F.lit(None).cast("array<double>").alias("vector"))
    last = record.orderBy(F.desc("seq")).limit(1)
    if last.isEmpty():
        return 1
    sources.save_memory(spark, a.memory, with_feedback(sources.load_memory(spark, a.memory), last))
    return 0


def doctor(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print what is installed and set, and whether the folder can be read."""
    parts = {"spark": spark.version, "master": spark.sparkContext.master, "shared folder": spark.conf.get("spark.checkpoint.dir", None) or "own", "folder": "there" if os.path.isdir(a.folder) else "missing"}
    for module in ("numpy", "pandas", "pyarrow", "onnxruntime"):
        parts[module] = "there" if importlib.util.find_spec(module) else "missing"
    print("\n".join(f"{k}: {v}" for k, v in parts.items()))
    return 0 if parts["folder"] == "there" else 1


def post(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the comments that would be posted, by file; nothing is sent."""
    reports.comments_by_file(pipeline.review(views.findings(spark, a.folder), None, None, [], REVIEW), REVIEW).write.mode("overwrite").json(a.out)
    return 0


def query(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run one registered query; write its rows to out, or show some."""
    df = registry.QUERIES[a.name](spark, a.folder)
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, False)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for f, more in ((index, ["out"]), (review, []), (evaluate, []), (post, ["out"]), (feedback, ["id", "verdict", "memory"]), (doctor, []), (query, ["name"])):
        p = commands.add_parser(f.__name__, help=f.__doc__)
        p.add_argument("folder")
        for name in more:
            p.add_argument(name)
        p.set_defaults(run=f)
        if f is review:
            p.add_argument("--out")
            p.add_argument("--format", choices=["md", "json", "sarif", "all"], default="md")
            p.add_argument("--fail-on", choices=["none", "critical", "high", "medium", "low"], default="none")
            p.add_argument("--ignore", nargs="*", default=[])
        if f is evaluate:
            p.add_argument("--category-agnostic", action="store_true")
            p.add_argument("--only", nargs="*")
            p.add_argument("--compare", nargs=2, default=[], metavar=("BASE", "NOW"))
        if f is query:
            p.add_argument("--out")
    a = parser.parse_args(args)
    return a.run(spark or local_session(), a)


if __name__ == "__main__":
    sys.exit(main())
