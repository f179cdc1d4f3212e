"""Queries that turn texts into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import review as fn
from siltstone.operators import text_tables as tt
from siltstone.plans import views
from siltstone.plans.review_queries import LANGUAGE_CASE_SQL
from siltstone.plans.views import with_views
from siltstone.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "doc_kind")


def diff_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Added lines of every diff in the documents."""
    hunks = tt.diff_hunks(_documents(spark, folder), "doc_id")
    return hunks.select("doc_id", "file", "status", "hunk_no", "new_start", "new_lines", F.explode_outer("changed_lines").alias("line"))


HUNKS_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, regexp_replace(unnest(a), '\r$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, regexp_matches(line, '^diff --git a/(.+?) b/(.+)$') AS is_file, regexp_matches(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@') AS is_hunk FROM l),
n AS (SELECT *, sum(is_file::INT) OVER w AS file_no, sum((is_hunk OR is_file)::INT) OVER w AS part_no FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, starts_with(line, '+') AND NOT starts_with(line, '+++') AS added, starts_with(line, '-') AND NOT starts_with(line, '---') AS removed,
      first_value(CASE WHEN is_hunk THEN line END) OVER (PARTITION BY doc_id, part_no ORDER BY pos) AS head FROM n WHERE file_no > 0),
p AS (SELECT *, TRY_CAST(regexp_extract(head, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 1) AS INT) AS new_start, coalesce(TRY_CAST(regexp_extract(head, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 2) AS INT), 1) AS new_lines,
      coalesce(sum((NOT is_hunk AND (added OR NOT (removed OR starts_with(line, '\'))))::INT) OVER (PARTITION BY doc_id, part_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE head IS NOT NULL),
fi AS (SELECT doc_id, file_no, max(CASE WHEN is_file THEN regexp_extract(line, '^diff --git a/(.+?) b/(.+)$', 2) END) AS file,
       coalesce(arg_max(CASE WHEN starts_with(line, 'new file') THEN 'added' WHEN starts_with(line, 'deleted file') THEN 'deleted' WHEN starts_with(line, 'rename ') THEN 'renamed' END, pos)
         FILTER (WHERE starts_with(line, 'new file') OR starts_with(line, 'deleted file') OR starts_with(line, 'rename ')), 'modified') AS status FROM o GROUP BY ALL),
h AS (SELECT doc_id, file_no, part_no::INT AS hunk_no, new_start, new_lines, list(DISTINCT (new_start + before)::INT) FILTER (WHERE added AND NOT is_hunk) AS changed FROM p GROUP BY ALL)
"""

DIFF_SQL = HUNKS_SQL + """SELECT doc_id, file, status, hunk_no, new_start, new_lines, unnest(CASE WHEN changed IS NULL THEN [NULL]::INT[] ELSE changed END) AS line FROM h JOIN fi USING (doc_id, file_no)"""


def effective_changed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tt.effective_lines(tt.diff_hunks(_documents(spark, folder), "doc_id"), "doc_id")


EFFECTIVE_SQL = HUNKS_SQL + """SELECT DISTINCT doc_id, file, unnest(CASE WHEN changed IS NOT NULL THEN changed WHEN new_lines > 0 THEN range(new_start, new_start + new_lines)::INT[] ELSE [new_start] END) AS line FROM h JOIN fi USING (doc_id, file_no)"""


def commentable_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tt.commentable_lines(_documents(spark, folder), ["doc_id"])


COMMENTABLE_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
n AS (SELECT *, regexp_matches(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@') AS h, sum(regexp_matches(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM l),
p AS (SELECT *, TRY_CAST(regexp_extract(first_value(line) OVER (PARTITION BY doc_id, part ORDER BY pos), '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 1) AS INT)
  + coalesce(sum((NOT h AND NOT starts_with(line, '-'))::INT) OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln FROM n WHERE part > 0)
SELECT DISTINCT doc_id, ln::INT AS line FROM p WHERE NOT h AND NOT starts_with(line, '-')"""


def parse_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tt.clang_tidy_findings(_documents(spark, folder), ["doc_id"])


LOG_SQL = r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, regexp_extract(line, '^(.*?):(\d+):(\d+):\s+(error|warning|note):\s+(.*?)(?:\s+\[([^\]]+)\])?$', ['file', 'line', 'col', 'severity', 'message', 'rule']) AS x FROM l
      WHERE regexp_matches(line, '^(.*?):(\d+):(\d+):\s+(error|warning|note):\s+(.*?)(?:\s+\[([^\]]+)\])?$'))
SELECT doc_id, x.file AS file, TRY_CAST(x.line AS INT) AS line, TRY_CAST(x.col AS INT) AS "column", x.severity AS severity, CASE WHEN x.rule <> '' THEN x.rule ELSE 'clang-tidy' END AS rule, x.message AS message FROM m WHERE x.severity <> 'note'"""


def parse_go_vet_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tt.go_vet_findings(_documents(spark, folder), ["doc_id"])


GO_VET_SQL = r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, regexp_extract(line, '^(.*?):(\d+):(\d+):\s+(.*)$', ['file', 'line', 'col', 'message']) AS x FROM l WHERE regexp_matches(line, '^(.*?):(\d+):(\d+):\s+(.*)$'))
SELECT doc_id, x.file AS file, TRY_CAST(x.line AS INT) AS line, TRY_CAST(x.col AS INT) AS "column", 'warning' AS severity, 'go-vet' AS rule, x.message AS message FROM m"""


def _raw_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings as delivered, each once; the columns that a query doesn't read don't move."""
    return table(spark, folder, "findings").dropDuplicates(["finding_seq"])


def parse_json_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings written as a fenced model answer, one a row, and read back: invalid ones fall away, missing confidence becomes 0.6."""
    item = F.struct(
        "file", "line", F.col("end_line").alias("endLine"), "severity", "title", "rationale", "suggestion", F.col("suggested_patch").alias("suggestedPatch"), "confidence",
        F.transform("evidence", lambda e: F.struct(e["ev_type"].alias("type"), e["ev_ref"].alias("ref"))).alias("evidence"),
    )
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(item).alias("findings"))), F.lit("\n```"))
    answers = _raw_findings(spark, folder).select("finding_seq", answer.alias("answer"))
    return tt.answered_findings(answers, ["finding_seq"]).select("finding_seq", "file", "line", "severity", "title", "confidence", F.col("n_evidence").cast("long").alias("n_evidence"))


JSON_FINDINGS_SQL = """SELECT DISTINCT finding_seq, file, line, severity, title, coalesce(confidence, 0.6) AS confidence, coalesce(len(evidence), 0) AS n_evidence FROM findings
WHERE file IS NOT NULL AND line IS NOT NULL AND severity IN ('critical', 'high', 'medium', 'low') AND title IS NOT NULL AND rationale IS NOT NULL AND (confidence IS NULL OR confidence BETWEEN 0 AND 1)"""


def parse_tool_json(spark: SparkSession, folder: str) -> DataFrame:
    """Findings written as ruff's and as eslint's JSON and read back."""
    f = _raw_findings(spark, folder)
    ruff = F.to_json(F.array(F.struct(F.col("file").alias("filename"), F.struct(F.col("line").alias("row"), F.lit(1).alias("column")).alias("location"), F.col("category").alias("code"), F.col("title").alias("message"))))
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "low", 0).otherwise(1)
    eslint = F.to_json(F.array(F.struct(F.col("file").alias("filePath"), F.array(F.struct(F.col("line"), level.alias("severity"), F.col("category").alias("ruleId"), F.col("title").alias("message"))).alias("messages"))))
    a = tt.ruff_findings(f.select("finding_seq", ruff.alias("text")), ["finding_seq"]).withColumn("tool", F.lit("ruff"))
    b = tt.eslint_findings(f.select("finding_seq", eslint.alias("text")), ["finding_seq"]).withColumn("tool", F.lit("eslint"))
    return a.unionByName(b).drop("column")


TOOL_JSON_SQL = """WITH f AS (SELECT DISTINCT finding_seq, file, line, severity, category, title FROM findings)
SELECT finding_seq, file, coalesce(line, 1) AS line, 'warning' AS severity, coalesce(category, 'ruff') AS rule, coalesce(title, '') AS message, 'ruff' AS tool FROM f
UNION ALL SELECT finding_seq, file, coalesce(line, 1), CASE WHEN severity = 'critical' THEN 'error' ELSE 'warning' END, coalesce(category, 'eslint'), coalesce(title, ''), 'eslint' FROM f WHERE severity IS NULL OR severity <> 'low'"""


def parse_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts and judgments written as model answers and read back."""
    f = _raw_findings(spark, folder)
    verdict = F.to_json(F.struct(F.array(F.struct(F.col("line").alias("index"), (F.col("severity") != "low").alias("keep"), "confidence")).alias("verdicts")))
    v = tt.answered_verdicts(f.select("finding_seq", verdict.alias("answer")), ["finding_seq"]).select("finding_seq", F.lit("verdict").alias("what"), F.col("index").cast("string").alias("name"), F.col("keep").alias("yes"), F.col("confidence").alias("value"))
    judgment = F.to_json(F.struct(F.array(F.struct("id", (F.col("severity") != "low").alias("valid"), F.col("confidence").alias("score"))).alias("judgments")))
    j = tt.answered_judgments(f.select("finding_seq", judgment.alias("answer")), ["finding_seq"]).select("finding_seq", F.lit("judgment").alias("what"), F.col("id").alias("name"), F.col("valid").alias("yes"), F.col("score").alias("value"))
    return v.unionByName(j)


ANSWERS_SQL = """WITH f AS (SELECT DISTINCT finding_seq, id, line, severity, confidence FROM findings)
SELECT finding_seq, 'verdict' AS what, line::INT::VARCHAR AS name, coalesce(severity <> 'low', true) AS yes, confidence AS value FROM f WHERE line IS NOT NULL
UNION ALL SELECT finding_seq, 'judgment', id, coalesce(severity <> 'low', true), coalesce(confidence, CASE WHEN coalesce(severity <> 'low', true) THEN 0.6 ELSE 0 END) FROM f WHERE id IS NOT NULL"""


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    files = _documents(spark, folder).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return tt.window_chunks(files, "name").select("id", "file", "start_line", "end_line", F.md5("text").alias("digest"))


WINDOWS_SQL = r"""WITH d AS (SELECT 'd' || doc_id::VARCHAR AS file, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT file, a, unnest(range(1, len(a) + 1, 200)) AS b FROM d),
t AS (SELECT file, b::INT AS start_line, least(b + 199, len(a))::INT AS end_line, substring(array_to_string(a[b:b + 199], chr(10)), 1, 4000) AS text FROM s)
SELECT substring(sha1(concat_ws(':', file, start_line::VARCHAR, end_line::VARCHAR)), 1, 16) AS id, file, start_line, end_line, md5(text) AS digest FROM t WHERE regexp_matches(text, '[^ \t\n\r\x0b\x0c]')"""


def chunk_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol chunks of documents: of each the ranges of the labels whose number it has, as symbols."""
    files = _documents(spark, folder).select(F.col("doc_id").cast("string").alias("file"), "text")
    symbols = views.labels(spark, folder).select(F.col("gt_seq").cast("string").alias("file"), F.coalesce("note", F.lit("?")).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), (F.pmod("gt_seq", F.lit(40)) + 1).cast("int").alias("end_line"))
    return tt.symbol_chunks(files, symbols).select("id", "file", "symbol", "start_line", "end_line", F.md5("text").alias("digest"))


CHUNK_SYMBOLS_SQL = with_views("g") + r""", d AS (SELECT doc_id::VARCHAR AS file, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
y AS (SELECT gt_seq::VARCHAR AS file, coalesce(note, '?') AS symbol, 1 AS start_line, (gt_seq % 40 + 1)::INT AS end_line FROM g),
t AS (SELECT y.*, substring(array_to_string(a[start_line:end_line], chr(10)), 1, 4000) AS text FROM y JOIN d USING (file))
SELECT substring(sha1(concat_ws(':', file, start_line::VARCHAR, end_line::VARCHAR)), 1, 16) AS id, file, symbol, start_line, end_line, md5(text) AS digest FROM t WHERE regexp_matches(text, '[^ \t\n\r\x0b\x0c]')"""


def chunk_symbols_all(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol chunks of all lines of all documents: each tenth line begins a symbol of 15 lines, so several of a file overlap and its last may end beyond it."""
    files = _documents(spark, folder).select(F.col("doc_id").cast("string").alias("file"), "text")
    starts = files.where("text IS NOT NULL").select("file", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n", -1)), F.lit(10))).alias("start_line"))
    symbols = starts.select("file", F.concat(F.lit("s"), F.col("start_line").cast("string")).alias("name"), F.lit("function").alias("kind"), "start_line", (F.col("start_line") + 14).alias("end_line"))
    return tt.symbol_chunks(files, symbols).select("id", "file", "symbol", "start_line", "end_line", F.md5("text").alias("digest"))


CHUNK_SYMBOLS_ALL_SQL = r"""WITH d AS (SELECT doc_id::VARCHAR AS file, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
y AS (SELECT file, a, unnest(range(1, len(a) + 1, 10))::INT AS start_line FROM d),
t AS (SELECT file, 's' || start_line::VARCHAR AS symbol, start_line, start_line + 14 AS end_line, substring(array_to_string(a[start_line:start_line + 14], chr(10)), 1, 4000) AS text FROM y)
SELECT substring(sha1(concat_ws(':', file, start_line::VARCHAR, end_line::VARCHAR)), 1, 16) AS id, file, symbol, start_line, end_line, md5(text) AS digest FROM t WHERE regexp_matches(text, '[^ \t\n\r\x0b\x0c]')"""

PATTERN = r"lock_guard|mu\.Lock\(\)|assert\("


def line_grep(spark: SparkSession, folder: str) -> DataFrame:
    return tt.grep(views.raw_chunks(spark, folder), ["chunk_seq"], PATTERN).distinct()


GREP_SQL = with_views("k") + rf"""SELECT chunk_seq, line_no, line FROM (SELECT chunk_seq, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT chunk_seq, string_split(text, chr(10)) AS a FROM k WHERE text IS NOT NULL)) WHERE regexp_matches(line, '{PATTERN}')"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_chunks").select("repo", "file").distinct()


def lang_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("repo", "file", fn.language(F.col("file")).alias("lang"))


LANG_SQL = f"SELECT DISTINCT repo, file, {LANGUAGE_CASE_SQL.format(otherwise=chr(39) + 'text' + chr(39))} AS lang FROM code_chunks"


def reviewable_files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).where(fn.reviewable(F.col("file")))


REVIEWABLE_SQL = r"""SELECT DISTINCT repo, file FROM code_chunks WHERE regexp_matches(lower(file), '[^/.][^/]*\.(c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|ipp|inl|ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|cs|rb|php|swift|scala)$')
AND NOT regexp_matches(file, '\.min\.(js|css)$') AND NOT regexp_matches(file, '(^|/)(dist|build|out|node_modules|vendor|third_party|generated|__generated__)/')"""


def infer_category(spark: SparkSession, folder: str) -> DataFrame:
    """Category and severity of each document's text, as of a commit message."""
    t = _documents(spark, folder)
    return t.select("doc_id", fn.infer_category(F.col("text")).alias("category"), fn.infer_severity(F.col("text")).alias("severity"))


CATEGORY_SQL = (
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in fn.CATEGORY_PATTERNS)
    + f" ELSE '{fn.OTHER_CATEGORY}' END AS category, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{fn.SEVERE}') THEN 'high' ELSE 'medium' END AS severity FROM documents"
)


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return _raw_findings(spark, folder).select("finding_seq", fn.slug(F.col("title")).alias("slug"))


SLUG_SQL = "SELECT DISTINCT finding_seq, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 45) AS slug FROM findings"


def review_key(spark: SparkSession, folder: str) -> DataFrame:
    c = views.cases(spark, folder)
    return c.select("case_id", fn.review_key(F.col("seed.fix_commit"), F.when(F.col("label_source") == "negative", F.col("repo")), F.col("base"), F.col("description")).alias("key"))


REVIEW_KEY_SQL = with_views("c") + """SELECT case_id, coalesce('pr:' || nullif(seed.fix_commit, ''), CASE WHEN label_source = 'negative' THEN 'gerrit:' || nullif(repo, '') END, 'base:' || nullif(base, ''), 'branch:' || nullif(description, ''), 'default') AS key FROM c"""


def guidelines_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Guideline documents by source and language, in order, under their titles, cut at 8,000 characters."""
    from siltstone.sources.files import joined_guidelines

    g = table(spark, folder, "documents").where("doc_kind = 'guideline' AND text IS NOT NULL").select("source", "lang", F.col("doc_id").alias("place"), F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("name"), "text")
    return joined_guidelines(g, ["source", "lang"]).select("source", "lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


GUIDELINES_SQL = """WITH j AS (SELECT source, lang, string_agg('# g' || doc_id::VARCHAR || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents WHERE doc_kind = 'guideline' AND text IS NOT NULL GROUP BY ALL),
k AS (SELECT source, lang, CASE WHEN length(t) > 8000 THEN substring(t, 1, 8000) || chr(10) || '... [truncated]' ELSE t END AS t FROM j)
SELECT source, lang, md5(t) AS digest, length(t) AS n FROM k"""

QUERIES = {
    f.__name__: f
    for f in (
        diff_parse, effective_changed_lines, commentable_lines, parse_log_lines, parse_go_vet_lines, parse_json_findings, parse_tool_json, parse_answers, chunk_windows, chunk_symbols, chunk_symbols_all, line_grep, lang_lookup,
        reviewable_files, infer_category, slugify, review_key, guidelines_concat,
    )
}
ORACLES = {
    "diff_parse": DIFF_SQL, "effective_changed_lines": EFFECTIVE_SQL, "commentable_lines": COMMENTABLE_SQL, "parse_log_lines": LOG_SQL, "parse_go_vet_lines": GO_VET_SQL, "parse_json_findings": JSON_FINDINGS_SQL,
    "parse_tool_json": TOOL_JSON_SQL, "parse_answers": ANSWERS_SQL, "chunk_windows": WINDOWS_SQL, "chunk_symbols": CHUNK_SYMBOLS_SQL, "chunk_symbols_all": CHUNK_SYMBOLS_ALL_SQL, "line_grep": GREP_SQL, "lang_lookup": LANG_SQL, "reviewable_files": REVIEWABLE_SQL,
    "infer_category": CATEGORY_SQL, "slugify": SLUG_SQL, "review_key": REVIEW_KEY_SQL, "guidelines_concat": GUIDELINES_SQL,
}
