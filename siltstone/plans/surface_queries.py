"""Queries on the smaller operators: scalar functions, orders, groupings, reports, and what is saved and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import review as fn
from siltstone.operators import code_index as ci
from siltstone.operators import evaluation as ev
from siltstone.operators import pipeline, reports
from siltstone.operators import state as st
from siltstone.operators import text_tables as tt
from siltstone.operators.runtime import DIMENSIONS
from siltstone.operators.tools import TOOLS
from siltstone.plans import index_queries, review_queries, views
from siltstone.plans.review_queries import HALF, LANGUAGE_CASE_SQL, REVIEW
from siltstone.plans.text_queries import HUNKS_SQL
from siltstone.plans.views import with_views
from siltstone.session import shared_dir
from siltstone.sources import files as fs
from siltstone.sources.tables import table


def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The cosine of every embedding with the next one's."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("after")) + HALF, 6).alias("cosine"))


COSINE_SQL = "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1e-12, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def keyword_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The words by which every finding's text would be recalled."""
    f = views.findings(spark, folder)
    return f.select("seq", F.array_join(fn.keywords(F.concat_ws(" ", "title", "rationale")), ",").alias("terms"))


TERMS_SQL = with_views("f") + r"SELECT seq, array_to_string(list_filter(string_split_regex(lower(title || ' ' || rationale), '[^a-zA-Z0-9_]+'), lambda t: length(t) > 3), ',') AS terms FROM f"


def numbered_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the file tool shows it: lines behind their numbers, from the second on, cut at 4,000 characters."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    shown = tt.numbered(F.col("lines"), F.lit(2), F.size("lines"))
    return d.select("doc_id", F.md5(shown).alias("digest"))


READS_SQL = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(list_transform(range(2, len(a) + 1), lambda i: i::VARCHAR || '| ' || a[i]), chr(10)) AS t FROM d)
SELECT doc_id, md5(CASE WHEN length(t) > 4000 THEN substring(t, 1, 4000) || chr(10) || '... [truncated]' ELSE t END) AS digest FROM s"""


def request_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key under which an answer about each document would be kept."""
    d = table(spark, folder, "documents").select("doc_id")
    return d.select("doc_id", fn.request_key(F.struct(F.lit("stub").alias("model"), F.lit("sum up").alias("prompt"), "doc_id", F.lit("list").alias("schema"))).alias("key"))


KEYS_SQL = """SELECT doc_id, substring(sha256('{"model":"stub","prompt":"sum up","doc_id":' || doc_id::VARCHAR || ',"schema":"list"}'), 1, 32) AS key FROM documents"""


def placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose suggested patch isn't filled in."""
    f = table(spark, folder, "findings").where(fn.is_placeholder(F.col("suggested_patch")))
    return f.select("finding_seq").distinct()


PLACEHOLDER_SQL = r"SELECT DISTINCT finding_seq FROM findings WHERE NOT regexp_matches(coalesce(suggested_patch, ''), '\S') OR regexp_matches(lower(suggested_patch), 'placeholder|fill_me_in')"


def made_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings made anew from their parts under one dimension: id and category."""
    f = views.findings(spark, folder).select("seq", "file", "line", "title")
    return pipeline.make_findings(f, F.lit("security")).select("seq", "id", "category")


MADE_SQL = with_views("f") + "SELECT seq, substring(sha1(file || ':' || line::VARCHAR || ':security:' || title), 1, 12) AS id, 'security' AS category FROM f"


def vectors_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that a search by vector can show: those whose id has a vector."""
    v = table(spark, folder, "vectors").where("vector IS NOT NULL").select("id").distinct()
    return v.join(views.raw_chunks(spark, folder).select("id", "file", "start_line", "end_line").distinct(), "id")


VECTOR_CHUNKS_SQL = "SELECT DISTINCT id, file, start_line, end_line FROM vectors JOIN code_chunks USING (id) WHERE vector IS NOT NULL"


def known_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """The dimensions that each case's findings name, in the order they do; names that are none are dropped."""
    f = views.findings(spark, folder).groupBy("case_id", F.col("category").alias("name")).agg(F.min("seq").alias("asked"))
    known = spark.createDataFrame([(d,) for d in DIMENSIONS], "name string")
    found = f.join(known, "name")
    return found.select("case_id", "name", F.row_number().over(Window.partitionBy("case_id").orderBy("asked")).cast("long").alias("place"))


KNOWN_SQL = with_views("f") + f"SELECT case_id, category AS name, row_number() OVER (PARTITION BY case_id ORDER BY min(seq)) AS place FROM f WHERE category IN ({', '.join(repr(d) for d in DIMENSIONS)}) GROUP BY case_id, category"


def symbols_by_line(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of each file once by name and lines, in order of their first line."""
    s = views.symbols(spark, folder)
    once = s.groupBy("repo", "file", "name", "start_line", "end_line").agg(F.min("seq").alias("seq"))
    return once.select("repo", "file", "name", F.row_number().over(Window.partitionBy("repo", "file").orderBy("start_line", "seq")).cast("long").alias("place"))


BY_LINE_SQL = with_views("s") + "SELECT repo, file, name, row_number() OVER (PARTITION BY repo, file ORDER BY start_line, min(seq)) AS place FROM s GROUP BY repo, file, name, start_line, end_line"


def chosen_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases that an evaluation asks for by a list of ids: all but the three first ones."""
    c = views.cases(spark, folder)
    kept = ev.chosen_cases(c, None, [r[0] for r in c.select("case_id").orderBy("case_id").limit(3).collect()])
    return kept.select("case_id", "label_source")


CASES_SQL = with_views("c") + "SELECT case_id, label_source FROM c WHERE case_id NOT IN (SELECT case_id FROM c ORDER BY case_id LIMIT 3)"


def files_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each repository by language, as analyzers get them."""
    f = table(spark, folder, "code_chunks").select("repo", "file").distinct()
    return reports.files_by_language(f, ["repo"]).select("repo", "lang", F.size("files").cast("long").alias("n"), F.md5(F.array_join("files", ",")).alias("digest"))


LANGUAGES_SQL = f"""WITH f AS (SELECT DISTINCT repo, file, {LANGUAGE_CASE_SQL.format(otherwise="'text'")} AS lang FROM code_chunks)
SELECT repo, lang, count(*) AS n, md5(string_agg(file, ',' ORDER BY file)) AS digest FROM f WHERE lang <> 'text' GROUP BY ALL"""


def dry_run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What a review of each case would look at: its labelled files, its defect ranges as symbols, its findings as signals."""
    g, f = views.labels(spark, folder), views.findings(spark, folder)
    return reports.dry_run(g.select("case_id", "file"), g.select("case_id"), f.select("case_id"), ["case_id"])


DRY_SQL = with_views("f", "g") + """, a AS (SELECT case_id, count(DISTINCT file) AS files, count(*) AS symbols FROM g GROUP BY case_id), b AS (SELECT case_id, count(*) AS signals FROM f GROUP BY case_id)
SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, coalesce(signals, 0) AS signals FROM a FULL JOIN b ON a.case_id = b.case_id"""


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the evaluation's report: rates as percentages, the best configuration marked."""
    rates = ev.rates(review_queries._metrics(spark, folder), ["ablation"])
    return reports.evaluation_table(rates)


EVALUATION_SQL = review_queries.metrics_sql(True, True) + f""", r AS ({review_queries.DERIVED_SQL.format(of=f"(SELECT ablation, {review_queries.RATES_SQL} FROM metrics GROUP BY ablation)")}),
x AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f FROM r)
SELECT ablation, printf('%.1f%%', recall * 100) AS recall, printf('%.1f%%', precision * 100) AS precision, printf('%.1f%%', f * 100) AS f1, printf('%.2f', false_positives / cases) AS false_positives_per_case,
printf('%.1f%%', CASE WHEN true_positives = 0 THEN 0 ELSE localized / true_positives END * 100) AS localization, f = max(f) OVER () AS is_best FROM x"""


def posted_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """The comments of each review on each file, in order, as they would be posted on a change."""
    f = views.findings(spark, folder)
    c = reports.comments_by_file(f, REVIEW)
    return c.select(*REVIEW, "file", F.size("comments").cast("long").alias("n"), F.size(F.filter("comments", lambda x: x["unresolved"])).cast("long").alias("unresolved"), F.array_join(F.transform("comments", lambda x: x["line"].cast("string")), ",").alias("lines"))


POSTED_SQL = with_views("f") + "SELECT case_id, ablation, file, count(*) AS n, count(*) FILTER (WHERE rank <= 1) AS unresolved, string_agg(greatest(1, line)::INT::VARCHAR, ',' ORDER BY seq) AS lines FROM f GROUP BY ALL"


def rescored_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Saved reports, one of each review with its list of findings and its case's labels, matched anew."""
    f, g = views.findings(spark, folder), views.labels(spark, folder)
    runs = review_queries.runs(spark, folder)
    found = f.groupBy(*REVIEW).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("file", "line", "category").alias("x")))), lambda s: s["x"]).alias("findings"))
    truth = g.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gt_seq", F.struct("file", "line", F.col("end_line").alias("endLine"), "category").alias("x")))), lambda s: s["x"]).alias("groundTruth"))
    saved = runs.join(found, REVIEW, "left").join(truth, "case_id", "left").withColumnRenamed("case_id", "caseId")
    return pipeline.rescored(saved)["metrics"]


def saved_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Memory saved twice, the second time merged into the first, and loaded again."""
    memory = index_queries._memory(spark, folder)
    place = f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}"
    for src in (0, 1):
        fs.save_memory(spark, place, memory.where(F.col("src") == src).drop("src"))
    return fs.load_memory(spark, place, memory.drop("src").schema).select("id", "kind", "category", "file", "seq")


def saved_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index saved, replaced by one that was read from it, and loaded: its chunks without their repeats."""
    place = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    schemas = {"chunks": "chunk_seq bigint, id string, file string, start_line int, end_line int", "vectors": "id string"}
    fs.save_index(place, chunks=views.raw_chunks(spark, folder).select("chunk_seq", "id", "file", "start_line", "end_line"))
    first = fs.load_index(spark, place, schemas)
    fs.save_index(place, chunks=first["chunks"].distinct())
    return fs.load_index(spark, place, schemas)["chunks"]


SAVED_INDEX_SQL = "SELECT DISTINCT chunk_seq, id, file, start_line, end_line FROM code_chunks"


def json_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every review's report as JSON, read back as findings."""
    f = views.findings(spark, folder)
    text = reports.json_report(f, REVIEW).select(F.col("json").alias("value"))
    return fs.saved_findings(spark, text).select("id", "file", "line", "severity", "title", "confidence")


JSON_SQL = with_views("f") + "SELECT id, file, line, severity, title, confidence FROM f"


def mined_defects(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of cases made from fixes: each patch document as the change that takes a fix back."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    fixes = d.select(F.col("doc_id").cast("string").alias("sha"), F.lit(None).cast("string").alias("parent"), F.lit("org/repo").alias("repo"), F.lit("fix a deadlock").alias("message"), F.col("text").alias("inverse_diff"))
    return pipeline.cases_from_fixes(fixes, 5)["labels"].select("case_id", "file", "line", "end_line", "category", "severity")


MINED_SQL = HUNKS_SQL + r""", oo AS (SELECT * FROM h JOIN fi USING (doc_id, file_no) WHERE regexp_matches(lower(file), '\.(c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|inl|ipp|ts|tsx|js|jsx|py|go|rs|java)$')
  AND NOT regexp_matches(lower(file), '(^|/)(test|tests|ut|unittest|gtest|spec|__tests__)(/|$)')), few AS (SELECT doc_id FROM oo GROUP BY doc_id HAVING count(DISTINCT file) <= 5)
SELECT 'repo-' || substring(doc_id::VARCHAR, 1, 8) AS case_id, file, new_start AS line, CASE WHEN new_lines > 0 THEN new_start + new_lines - 1 ELSE new_start END AS end_line, 'concurrency' AS category, 'high' AS severity FROM oo WHERE doc_id IN (SELECT doc_id FROM few)"""


def dimension_tools(spark: SparkSession, folder: str) -> DataFrame:
    """The tools that each dimension of a review may call: all of them."""
    return spark.createDataFrame([(d, t) for d in DIMENSIONS for t in TOOLS], "dimension string, tool string")


TOOLS_SQL = "SELECT unnest(['correctness', 'concurrency', 'memory', 'security', 'performance', 'maintainability']) AS dimension, tool FROM (SELECT unnest(['get_diff', 'read_file', 'read_symbol', 'find_definition', 'find_references', 'search_code', 'semantic_search', 'get_static_analysis', 'read_guidelines', 'recall_memory']) AS tool)"


def compared_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The rates that stand for the whole evaluation where it is compared with another."""
    rates = ev.rates(review_queries._metrics(spark, folder), ["ablation"]).withColumn("run_no", F.col("ablation"))
    return ev.compared_configuration(rates).select("ablation", "true_positives", "false_positives", "false_negatives")


COMPARED_SQL = review_queries.metrics_sql(True, True) + " SELECT ablation, sum(true_positives)::BIGINT AS true_positives, sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives FROM metrics GROUP BY ablation ORDER BY ablation = 'full' DESC, ablation DESC LIMIT 1"


def changed_symbols_in_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight symbols of each file, as changed, in order, with the first five sites that call them in their repository."""
    s = views.symbols(spark, folder)
    first = ci.first_symbols(s, ["repo", "file"])
    listed = ci.references(index_queries._sites(spark, folder), ["repo", "callee"], index_queries.SITE_ORDER, 5).groupBy("repo", F.col("callee").alias("name")).agg(F.count("*").alias("n_callers"))
    return first.join(listed, ["repo", "name"], "left").select("seq", "place", F.coalesce("n_callers", F.lit(0).cast("long")).alias("n_callers"))


PROMPT_SYMBOLS_SQL = with_views("k", "s", more=index_queries.SITES) + """, fs AS (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY start_line, seq) AS place FROM s), cn AS (SELECT repo, callee, least(5, count(*)) AS n FROM sites GROUP BY ALL)
SELECT seq, place, coalesce(n, 0) AS n_callers FROM fs LEFT JOIN cn ON cn.repo = fs.repo AND cn.callee = fs.name WHERE place <= 8"""


def fresh_state(spark: SparkSession, folder: str) -> DataFrame:
    """What was reviewed last, recorded into saved state, saved and loaded again."""
    c = views.cases(spark, folder)
    place = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    last = c.groupBy("repo").agg(F.max(F.struct("created_at", "case_id")).alias("m")).select(F.col("repo").alias("key"), F.col("m.case_id").alias("last_sha"), F.lit("run").alias("run_id"), F.col("m.created_at").alias("updated"))
    fs.save_index(place, state=st.recorded(fs.load_review_state(spark, place), last))
    return fs.load_review_state(spark, place).select("key", "last_sha")


STATE_SQL = with_views("c") + "SELECT repo AS key, arg_max(case_id, (created_at, case_id)) AS last_sha FROM c GROUP BY repo"

ORACLES = {
    "vector_cosine": COSINE_SQL, "keyword_terms": TERMS_SQL, "numbered_reads": READS_SQL, "request_keys": KEYS_SQL, "placeholders": PLACEHOLDER_SQL, "made_findings": MADE_SQL, "vectors_of_chunks": VECTOR_CHUNKS_SQL,
    "known_dimensions": KNOWN_SQL, "symbols_by_line": BY_LINE_SQL, "chosen_cases": CASES_SQL, "files_by_language": LANGUAGES_SQL, "dry_run_counts": DRY_SQL, "evaluation_report": EVALUATION_SQL, "posted_by_file": POSTED_SQL,
    "rescored_reports": review_queries.ORACLES["match_ground_truth_agnostic"], "saved_memory": index_queries.MERGE_SQL, "saved_index": SAVED_INDEX_SQL, "json_reports": JSON_SQL, "mined_defects": MINED_SQL,
    "dimension_tools": TOOLS_SQL, "compared_runs": COMPARED_SQL, "changed_symbols_in_prompt": PROMPT_SYMBOLS_SQL, "fresh_state": STATE_SQL,
}
QUERIES = {name: globals()[name] for name in ORACLES}
