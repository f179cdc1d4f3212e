"""Queries on findings and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.review import finding_id
from siltstone.operators import evaluation as ev
from siltstone.operators import findings as fi
from siltstone.plans import views
from siltstone.plans.views import with_views
from siltstone.sources.tables import table

GLOBS = ["src/**", "lib/*/*.go", "**.java"]
REVIEW = ["case_id", "ablation"]
HALF = 1e-12


def dedupe_near_line(spark: SparkSession, folder: str) -> DataFrame:
    f = views.findings(spark, folder).select(*REVIEW, "file", "line", "rank", "confidence", "seq")
    return fi.near_line_dedupe(f.where(F.col("confidence") >= fi.MIN_CONFIDENCE), [*REVIEW, "file"]).select(*REVIEW, "file", "line", "rank", "confidence", "seq")


DEDUPE_SQL = with_views("f") + r""", o AS (
  SELECT case_id, ablation, file, list({'line': line, 'rank': rank, 'confidence': confidence, 'seq': seq} ORDER BY rank, confidence DESC, seq) AS rows FROM f WHERE confidence >= 0.6 GROUP BY ALL
), kept AS (
  SELECT case_id, ablation, file, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda done, x: CASE WHEN len(list_filter(done, lambda y: abs(y.line - x[1].line) <= 5)) > 0 THEN done ELSE list_concat(done, x) END)) AS x FROM o
)
SELECT case_id, ablation, file, x.line AS line, x.rank AS rank, x.confidence AS confidence, x.seq AS seq FROM kept"""


def filter_confidence_suppress_glob(spark: SparkSession, folder: str) -> DataFrame:
    f = views.findings(spark, folder)
    suppressed = f.where("ablation = 'B-llm-only' AND severity = 'low'").select("id")
    return fi.admitted(f.select("seq", "id", "file", "confidence"), suppressed, GLOBS).select("seq", "id", "file")


FILTER_SQL = with_views("f") + r"""
SELECT seq, id, file FROM f WHERE confidence >= 0.6 AND id NOT IN (SELECT id FROM f WHERE ablation = 'B-llm-only' AND severity = 'low')
AND NOT regexp_matches(file, '^src/.*$') AND NOT regexp_matches(file, '^lib/[^/]*/[^/]*\.go$') AND NOT regexp_matches(file, '^.*\.java$')"""


def severity_order_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best findings of each review, as in a report's summary."""
    return fi.top_findings(views.findings(spark, folder).select(*REVIEW, "seq", "rank", "confidence"), REVIEW, 10).select(*REVIEW, "seq", F.col("place").cast("long").alias("place"))


TOPK_SQL = with_views("f") + """
SELECT case_id, ablation, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id, ablation ORDER BY rank, confidence DESC, seq) AS place FROM f) WHERE place <= 10"""


def severity_counts_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    return fi.severity_counts(views.findings(spark, folder), REVIEW)


COUNTS_SQL = with_views("f") + """
SELECT r.case_id, r.ablation, s.severity, count(f.seq) AS n FROM (SELECT DISTINCT case_id, ablation FROM f) r CROSS JOIN (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity)
LEFT JOIN f ON f.case_id = r.case_id AND f.ablation = r.ablation AND f.severity = s.severity GROUP BY ALL"""


def severity_gate(spark: SparkSession, folder: str) -> DataFrame:
    return fi.gate(views.findings(spark, folder), REVIEW, "high")


GATE_SQL = with_views("f") + "SELECT case_id, ablation, CASE WHEN bool_or(rank <= 1) THEN 2 ELSE 0 END AS exit_code FROM f GROUP BY ALL"


def finding_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return views.findings(spark, folder).select("seq", finding_id(F.col("file"), F.col("line"), F.col("category"), F.col("title")).alias("fingerprint"))


FINGERPRINT_SQL = with_views("f") + "SELECT seq, substring(sha1(concat_ws(':', file, line::INT::VARCHAR, category, title)), 1, 12) AS fingerprint FROM f"


def sarif_projection(spark: SparkSession, folder: str) -> DataFrame:
    return fi.sarif_results(views.findings(spark, folder)).withColumn("start_line", F.col("start_line").cast("long")).withColumn("end_line", F.col("end_line").cast("long"))


SARIF_SQL = with_views("f") + """
SELECT seq, category AS rule_id, CASE WHEN rank <= 1 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'note' END AS level, title || chr(10) || chr(10) || rationale AS message,
file AS uri, greatest(1, line)::BIGINT AS start_line, greatest(1, end_line)::BIGINT AS end_line, confidence, severity FROM f"""


def rules_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return views.findings(spark, folder).select(*REVIEW, "category").distinct()


RULES_SQL = with_views("f") + "SELECT DISTINCT case_id, ablation, category FROM f"


def findings_by_file(spark: SparkSession, folder: str) -> DataFrame:
    f = views.findings(spark, folder)
    return f.groupBy(*REVIEW, "file").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count_if(F.col("rank") <= 1).alias("unresolved"))


BY_FILE_SQL = with_views("f") + "SELECT case_id, ablation, file, count(*) AS n, min(seq) AS first_seq, count(*) FILTER (WHERE rank <= 1) AS unresolved FROM f GROUP BY ALL"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every case under every configuration."""
    return ev.every_run(views.cases(spark, folder), views.findings(spark, folder))


def _metrics(spark: SparkSession, folder: str, by_category: bool = True, collapse: bool = True) -> DataFrame:
    f = views.findings(spark, folder).select("seq", *REVIEW, "file", "line", "category")
    return ev.case_metrics(f, views.labels(spark, folder), runs(spark, folder), by_category, collapse)


def match_ground_truth_aware(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder)


def match_ground_truth_agnostic(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder, by_category=False)


def match_ground_truth_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder, collapse=False)


def metrics_sql(by_category: bool, collapse: bool) -> str:
    category = "coalesce(category, '')" if by_category else "''"
    group = f"min(gt_seq) OVER (PARTITION BY case_id, file, {category})" if collapse else "gt_seq"
    return with_views("f", "g", "c", more=f"""
q AS (SELECT *, {category} AS cat, {group} AS grp FROM g),
runs AS (SELECT c.case_id, a.ablation FROM c CROSS JOIN (SELECT DISTINCT ablation FROM f) a),
p AS (SELECT f.case_id, f.ablation, f.seq, q.grp, bool_or(f.line BETWEEN q.line AND q.end_line) AS inside FROM f JOIN q ON f.case_id = q.case_id AND f.file = q.file
      AND f.line BETWEEN q.line - 3 AND q.end_line + 3 AND (q.cat = '' OR q.cat = f.category) GROUP BY ALL),
m AS (SELECT case_id, ablation, seq, min(grp) AS grp, arg_min(inside, grp) AS inside FROM p GROUP BY ALL),
h AS (SELECT case_id, ablation, count(DISTINCT grp) AS tp, count(*) AS n FROM m GROUP BY ALL),
l AS (SELECT case_id, ablation, count(*) FILTER (WHERE inside) AS localized FROM (SELECT case_id, ablation, grp, arg_min(inside, seq) AS inside FROM m GROUP BY ALL) GROUP BY ALL),
t AS (SELECT case_id, ablation, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT case_id, count(DISTINCT grp) AS n FROM q GROUP BY ALL),
metrics AS (SELECT r.case_id, r.ablation, coalesce(h.tp, 0) AS true_positives, coalesce(t.n, 0) - coalesce(h.n, 0) AS false_positives, coalesce(k.n, 0) - coalesce(h.tp, 0) AS false_negatives, coalesce(l.localized, 0) AS localized
      FROM runs r LEFT JOIN h USING (case_id, ablation) LEFT JOIN l USING (case_id, ablation) LEFT JOIN t USING (case_id, ablation) LEFT JOIN k USING (case_id))""")  # fmt: skip


RATES_SQL = """count(*) AS cases, sum(true_positives)::BIGINT AS true_positives, sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives, sum(localized)::BIGINT AS localized"""
DERIVED_SQL = """SELECT *, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END + 1e-12, 6) AS f1_,
round(false_positives / cases + 1e-12, 6) AS fpc, round(CASE WHEN true_positives = 0 THEN 0 ELSE localized / true_positives END + 1e-12, 6) AS loc FROM (
SELECT *, CASE WHEN true_positives + false_negatives = 0 THEN 1.0::DOUBLE ELSE true_positives / (true_positives + false_negatives) END AS recall,
CASE WHEN true_positives + false_positives = 0 THEN 1.0::DOUBLE ELSE true_positives / (true_positives + false_positives) END AS precision FROM {of})"""


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """To 6 digits; what is added settles halves, which sums in another order may miss by their last bit."""
    return df.withColumns({n: F.round(F.col(n) + HALF, 6) for n in names})


RATES = ["recall", "precision", "f1", "false_positives_per_case", "localization_accuracy"]


def metrics_micro(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.rates(_metrics(spark, folder), ["ablation"]), RATES)


def _rates_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, cases, true_positives, false_positives, false_negatives, localized, round(recall + 1e-12, 6) AS recall, round(precision + 1e-12, 6) AS precision, f1_ AS f1, fpc AS false_positives_per_case, loc AS localization_accuracy
FROM ({DERIVED_SQL.format(of=f"(SELECT {keys}, {RATES_SQL} FROM {source} GROUP BY {keys})")})"""


METRICS_SQL = metrics_sql(True, True) + _rates_sql("ablation", "metrics")


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    from siltstone.functions.review import language

    first = views.labels(spark, folder).groupBy("case_id").agg(F.min_by("file", "gt_seq").alias("file"))
    return first.select("case_id", language(F.col("file"), "unknown").alias("language"))


def metrics_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by the language of a case's first labelled file."""
    m = _metrics(spark, folder).join(_languages(spark, folder), "case_id", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))
    return _rounded(ev.rates(m, ["ablation", "language"]), RATES)


LANGUAGE_CASE_SQL = r"""CASE lower(regexp_extract(file, '[^/.][^/]*?(\.[^./]*)$', 1)) WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx'
WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java'
WHEN '.cc' THEN 'cpp' WHEN '.cpp' THEN 'cpp' WHEN '.cxx' THEN 'cpp' WHEN '.c++' THEN 'cpp' WHEN '.hh' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.hxx' THEN 'cpp' WHEN '.h++' THEN 'cpp' WHEN '.ipp' THEN 'cpp' WHEN '.inl' THEN 'cpp' ELSE {otherwise} END"""

BY_LANGUAGE_SQL = metrics_sql(True, True) + f""", lang AS (SELECT case_id, {LANGUAGE_CASE_SQL.format(otherwise="'unknown'")} AS language FROM (SELECT case_id, arg_min(file, gt_seq) AS file FROM g GROUP BY case_id)),
ml AS (SELECT metrics.*, coalesce(language, 'unknown') AS language FROM metrics LEFT JOIN lang USING (case_id))
""" + _rates_sql("ablation, language", "ml")


def describe_ci95(spark: SparkSession, folder: str) -> DataFrame:
    """The confidences of each category and severity."""
    stats = ev.described(views.findings(spark, folder), ["category", "severity"], "confidence")
    return _rounded(stats, ["mean", "std", "min", "max", "sem", "ci95"])


def t_sql(df: str) -> str:
    from siltstone.functions.review import NORMAL_95, T_95

    return f"CASE WHEN {df} <= 0 THEN 0 WHEN {df} > {max(T_95)} THEN {NORMAL_95} " + " ".join(f"WHEN {df} >= {k} THEN {T_95[k]}" for k in sorted(T_95, reverse=True)) + " END"


def described_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, n, round(mean + 1e-12, 6) AS mean, round(std + 1e-12, 6) AS std, round(lo + 1e-12, 6) AS min, round(hi + 1e-12, 6) AS max, round(std / sqrt(n) + 1e-12, 6) AS sem, round(({t_sql('(n - 1)')}) * std / sqrt(n) + 1e-12, 6) AS ci95
FROM (SELECT {keys}, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY {keys})"""


DESCRIBE_SQL = with_views("f") + described_sql("category, severity", "(SELECT category, severity, confidence AS v FROM f)")


def multi_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each rate over the runs, a run being one repository's cases under one configuration."""
    per_repo = _metrics(spark, folder).join(views.cases(spark, folder).select("case_id", "repo"), "case_id")
    rates = ev.rates(per_repo, ["ablation", "repo"])
    long = rates.unpivot([F.col("ablation")], [F.col(c).cast("double").alias(c) for c in [*RATES, "true_positives", "false_positives", "false_negatives"]], "metric", "v")
    return _rounded(ev.described(long, ["ablation", "metric"], "v"), ["mean", "std", "min", "max", "sem", "ci95"])


MULTI_RUN_SQL = metrics_sql(True, True) + f""", mr AS (SELECT metrics.*, c.repo FROM metrics JOIN c USING (case_id)),
r AS ({DERIVED_SQL.format(of=f"(SELECT ablation, repo, {RATES_SQL} FROM mr GROUP BY ablation, repo)")}),
x AS (SELECT ablation, metric, v FROM (SELECT ablation, recall, precision, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, false_positives / cases AS false_positives_per_case,
  CASE WHEN true_positives = 0 THEN 0 ELSE localized / true_positives END AS localization_accuracy, true_positives::DOUBLE AS true_positives, false_positives::DOUBLE AS false_positives, false_negatives::DOUBLE AS false_negatives FROM r)
  UNPIVOT (v FOR metric IN (recall, precision, f1, false_positives_per_case, localization_accuracy, true_positives, false_positives, false_negatives)))
""" + described_sql("ablation, metric", "x")


def regression_check(spark: SparkSession, folder: str) -> DataFrame:
    """The full configuration against the plain one, by repository."""
    m = ev.rates(_metrics(spark, folder).join(views.cases(spark, folder).select("case_id", "repo"), "case_id"), ["ablation", "repo"])
    out = ev.regressions(m.where("ablation = 'full'").drop("ablation"), m.where("ablation = 'B-llm-only'").drop("ablation"), ["repo"])
    return out.select("repo", "metric", "verdict")


REGRESSION_SQL = metrics_sql(True, True) + f""", mr AS (SELECT metrics.*, c.repo FROM metrics JOIN c USING (case_id)),
r AS ({DERIVED_SQL.format(of=f"(SELECT ablation, repo, {RATES_SQL} FROM mr GROUP BY ablation, repo)")}),
x AS (SELECT ablation, repo, metric, v FROM (SELECT ablation, repo, recall, precision, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, false_positives / cases AS false_positives_per_case FROM r)
  UNPIVOT (v FOR metric IN (recall, precision, f1, false_positives_per_case)))
SELECT a.repo, a.metric, CASE WHEN a.metric = 'false_positives_per_case' THEN CASE WHEN a.v - b.v > 1.0 THEN 'regression' WHEN a.v - b.v < -1.0 THEN 'improvement' ELSE 'same' END
ELSE CASE WHEN a.v - b.v < -0.05 THEN 'regression' WHEN a.v - b.v > 0.05 THEN 'improvement' ELSE 'same' END END AS verdict
FROM x a JOIN x b ON a.repo = b.repo AND a.metric = b.metric AND a.ablation = 'full' AND b.ablation = 'B-llm-only'"""


def judge_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each review judged by those of the plain configuration with the same id: valid if their confidence is 0.5 or more."""
    f = views.findings(spark, folder)
    judgments = f.where("ablation = 'B-llm-only'").select("id", (F.col("confidence") >= 0.5).alias("valid"), F.col("confidence").alias("score"), F.col("seq").alias("judgment_seq"))
    return _rounded(fi.judged(f.select("id", *REVIEW), judgments, REVIEW), ["valid_rate", "mean_score"])


JUDGE_SQL = with_views("f") + """, j AS (SELECT id, arg_max(confidence >= 0.5, seq) AS valid, arg_max(confidence, seq) AS score FROM f WHERE ablation = 'B-llm-only' GROUP BY id)
SELECT case_id, ablation, count(*) AS n, round(avg(CASE WHEN coalesce(valid, true) THEN 1.0 ELSE 0.0 END) + 1e-12, 6) AS valid_rate, round(avg(coalesce(score, 0.5)) + 1e-12, 6) AS mean_score FROM f LEFT JOIN j USING (id) GROUP BY ALL"""


def verifier_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of each place in a review: those of the review's findings in reverse order, dropping low severity."""
    f = views.findings(spark, folder).select("seq", *REVIEW, "severity", "confidence")
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy(*REVIEW).orderBy(F.desc("seq"))) - 1
    verdicts = f.select(*REVIEW, back.cast("long").alias("index"), (F.col("severity") != "low").alias("keep"), "confidence", F.col("seq").alias("verdict_seq"))
    return fi.apply_verdicts(f, verdicts, REVIEW).select("seq", "index", "confidence")


VERIFIER_SQL = with_views("f") + """, p AS (SELECT *, row_number() OVER (PARTITION BY case_id, ablation ORDER BY seq) - 1 AS index, row_number() OVER (PARTITION BY case_id, ablation ORDER BY seq DESC) - 1 AS back FROM f)
SELECT p.seq, p.index, least(p.confidence, v.confidence) AS confidence FROM p LEFT JOIN p v ON p.case_id = v.case_id AND p.ablation = v.ablation AND p.index = v.back WHERE v.severity <> 'low'"""


def posted_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that no comment of the full configuration names; comments are rendered and read back."""
    f = views.findings(spark, folder)
    comments = fi.comment_body(f.where("ablation = 'full'"))
    return fi.not_posted(f.select("seq", "id"), comments).select("seq", "id")


POSTED_SQL = with_views("f") + "SELECT seq, id FROM f WHERE id NOT IN (SELECT id FROM f WHERE ablation = 'full')"


def inline_overflow_split(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on labelled lines go inline, the 50 best of a review, all others into its summary."""
    lines = views.labels(spark, folder).select("file", F.explode(F.sequence(F.least("line", "end_line"), F.greatest("line", "end_line"))).alias("line"))
    return fi.inline_or_summary(views.findings(spark, folder).select("seq", *REVIEW, "file", "line", "rank", "confidence"), lines, REVIEW).select("seq", "placement")


INLINE_SQL = with_views("f", "g") + """, l AS (SELECT DISTINCT file, unnest(range(least(line, end_line)::BIGINT, greatest(line, end_line)::BIGINT + 1)) AS line FROM g),
m AS (SELECT f.*, l.line IS NOT NULL AS can FROM f LEFT JOIN l ON f.file = l.file AND greatest(1, f.line) = l.line)
SELECT seq, CASE WHEN can AND row_number() OVER (PARTITION BY case_id, ablation, can ORDER BY rank, confidence DESC, seq) <= 50 THEN 'inline' ELSE 'summary' END AS placement FROM m"""


def symbols_for_changed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled ranges, as symbols, within which a finding of the same case lies."""
    from siltstone.operators.code_index import overlapping_symbols

    ranges = views.labels(spark, folder).select("gt_seq", "case_id", "file", F.col("line").alias("start_line"), "end_line")
    return overlapping_symbols(ranges, views.findings(spark, folder).select("case_id", "file", "line"), ["case_id", "file"]).select("gt_seq", "file")


CHANGED_SYMBOLS_SQL = with_views("f", "g") + """
SELECT gt_seq, file FROM g WHERE EXISTS (SELECT 1 FROM f WHERE f.case_id = g.case_id AND f.file = g.file AND f.line BETWEEN g.line AND g.end_line)"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "findings").where("line IS NOT NULL").dropDuplicates(["finding_seq"])
    from siltstone.functions.text import clean_path

    return f.select(F.col("finding_seq").alias("seq"), clean_path(F.col("file")).alias("file"), F.col("line"), F.explode("evidence").alias("e")).where("e.ev_type = 'static_analysis'").select("seq", "file", "line", F.col("e.ev_ref").alias("rule")).distinct()


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    return views.labels(spark, folder).select("file", F.explode(F.sequence(F.least("line", "end_line"), F.greatest("line", "end_line"))).alias("line")).distinct()


def static_near_changed(spark: SparkSession, folder: str) -> DataFrame:
    from siltstone.operators.code_index import near_changes

    return near_changes(_signals(spark, folder), _changed(spark, folder), ["file"]).select("seq", "file", "line", "rule")


def static_exact_lines(spark: SparkSession, folder: str) -> DataFrame:
    from siltstone.operators.code_index import near_changes

    return near_changes(_signals(spark, folder), _changed(spark, folder), ["file"], 0).select("seq", "file", "line", "rule")


def _static_sql(window: int) -> str:
    return with_views("g") + rf""", sig AS (SELECT DISTINCT finding_seq AS seq, {views.PATH_SQL} AS file, line, e.ev_ref AS rule FROM (SELECT finding_seq, file, line, unnest(evidence) AS e FROM findings WHERE line IS NOT NULL) WHERE e.ev_type = 'static_analysis'),
ch AS (SELECT DISTINCT file, unnest(range(least(line, end_line)::BIGINT, greatest(line, end_line)::BIGINT + 1)) AS line FROM g),
near AS (SELECT DISTINCT file, line + unnest(range(-{window}, {window} + 1)) AS line FROM ch)
SELECT seq, file, line, rule FROM sig SEMI JOIN near USING (file, line)"""


def trace_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a trace of steps."""
    from siltstone.operators.state import usage

    e = table(spark, folder, "events").select(
        "user_id", F.lit(1).alias("tool_calls"), F.length("props").alias("prompt_tokens"), F.length("event_type").alias("completion_tokens"), F.floor("value").alias("ms")
    )
    return usage(e, ["user_id"])


USAGE_SQL = "SELECT user_id, count(*) AS steps, count(*) AS tool_calls, sum(length(props))::BIGINT AS prompt_tokens, sum(length(event_type))::BIGINT AS completion_tokens, sum(floor(value))::BIGINT AS ms FROM events GROUP BY user_id"

QUERIES = {
    f.__name__: f
    for f in (
        dedupe_near_line, filter_confidence_suppress_glob, severity_order_topk, severity_counts_zero_filled, severity_gate, finding_fingerprint, sarif_projection, rules_distinct, findings_by_file,
        match_ground_truth_aware, match_ground_truth_agnostic, match_ground_truth_ranges, metrics_micro, metrics_by_language, describe_ci95, multi_run_summary, regression_check, judge_rates, verifier_apply,
        posted_anti_join, inline_overflow_split, symbols_for_changed_lines, static_near_changed, static_exact_lines, trace_usage,
    )
}

MATCH = "SELECT * FROM metrics"
ORACLES = {
    "dedupe_near_line": DEDUPE_SQL, "filter_confidence_suppress_glob": FILTER_SQL, "severity_order_topk": TOPK_SQL, "severity_counts_zero_filled": COUNTS_SQL, "severity_gate": GATE_SQL,
    "finding_fingerprint": FINGERPRINT_SQL, "sarif_projection": SARIF_SQL, "rules_distinct": RULES_SQL, "findings_by_file": BY_FILE_SQL, "match_ground_truth_aware": metrics_sql(True, True) + MATCH,
    "match_ground_truth_agnostic": metrics_sql(False, True) + MATCH, "match_ground_truth_ranges": metrics_sql(True, False) + MATCH, "metrics_micro": METRICS_SQL, "metrics_by_language": BY_LANGUAGE_SQL,
    "describe_ci95": DESCRIBE_SQL, "multi_run_summary": MULTI_RUN_SQL, "regression_check": REGRESSION_SQL, "judge_rates": JUDGE_SQL, "verifier_apply": VERIFIER_SQL, "posted_anti_join": POSTED_SQL,
    "inline_overflow_split": INLINE_SQL, "symbols_for_changed_lines": CHANGED_SYMBOLS_SQL, "static_near_changed": _static_sql(3), "static_exact_lines": _static_sql(0), "trace_usage": USAGE_SQL,
}
