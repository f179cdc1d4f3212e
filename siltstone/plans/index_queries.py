"""Queries on the code index, search, memory and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.review import LANGUAGE_NAMES, source_language
from siltstone.operators import code_index as ci
from siltstone.operators import retrieval as rt
from siltstone.operators import state as st
from siltstone.plans import views
from siltstone.plans.review_queries import LANGUAGE_CASE_SQL
from siltstone.plans.views import with_views
from siltstone.session import staged
from siltstone.sources.tables import table

SITE_ORDER = ["file", "line", "site", "chunk_seq"]


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    # the sites of a text are about as large as the text, so repeats go before they are extracted
    return ci.call_sites(views.chunks(spark, folder).select("chunk_seq", "repo", "file", "start_line", "text"), ["chunk_seq", "repo", "file"])


WORDS = ", ".join(f"'{w}'" for w in ci.KEYWORDS + ci.MORE_WORDS)
SITES = rf"""ln AS (SELECT chunk_seq, repo, file, start_line + generate_subscripts(a, 1) - 1 AS line, unnest(a) AS t FROM (SELECT *, string_split(text, chr(10)) AS a FROM k WHERE text IS NOT NULL)),
si AS (SELECT chunk_seq, repo, file, line, generate_subscripts(c, 1) - 1 AS site, nullif(unnest(r), '') AS receiver, unnest(c) AS callee FROM (SELECT *, regexp_extract_all(t, '{ci.CALL}', 1) AS r, regexp_extract_all(t, '{ci.CALL}', 2) AS c FROM ln)),
sites AS (SELECT * FROM si WHERE callee NOT IN ({WORDS}))"""


def call_sites(spark: SparkSession, folder: str) -> DataFrame:
    s = _sites(spark, folder)
    return s.select("chunk_seq", F.col("line").cast("long").alias("line"), F.col("site").cast("long").alias("site"), "receiver", "callee")


CALLS_SQL = with_views("k", more=SITES) + "SELECT chunk_seq, line, site, receiver, callee FROM sites"


def find_definition(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions of every symbol name, and how many there are in its repository."""
    s = views.symbols(spark, folder)
    n = s.groupBy("repo", "name").agg(F.count("*").alias("n"))
    return s.join(n, ["repo", "name"]).select("repo", "name", "file", "kind", "start_line", "end_line", "n")


DEFINITION_SQL = with_views("s") + "SELECT repo, name, file, kind, start_line, end_line, count(*) OVER (PARTITION BY repo, name) AS n FROM s"


def find_references_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 call sites of every name of a repository."""
    return ci.references(_sites(spark, folder), ["repo", "callee"], SITE_ORDER).select("repo", "callee", "file", F.col("line").cast("long").alias("line"), F.col("place").cast("long").alias("place"))


REFERENCES_SQL = with_views("k", more=SITES) + """SELECT repo, callee, file, line, place FROM (SELECT *, row_number() OVER (PARTITION BY repo, callee ORDER BY file, line, site, chunk_seq) AS place FROM sites) WHERE place <= 50"""


def _qualifiers(spark: SparkSession, folder: str, file: str | None) -> DataFrame:
    chunks = views.raw_chunks(spark, folder)
    aliases = ci.import_aliases(chunks, ["repo", "file"], file=file)
    sites = _sites(spark, folder)
    bindings = ci.type_bindings(chunks, ["repo", "file"], file=file)
    return ci.qualified_sites(sites, bindings, aliases, ["repo", "file"]).select("repo", "callee", "qualifier").distinct()


def qualifiers_for(spark: SparkSession, folder: str) -> DataFrame:
    """The types or receivers that a name is called on, under their imported names where renamed; languages by lang as delivered, as in its SQL."""
    return _qualifiers(spark, folder, None)


def qualifiers_for_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """qualifiers_for, languages by the files' extensions."""
    return _qualifiers(spark, folder, "file")


def _aliases_sql() -> str:
    listed = lambda pattern, langs: f"SELECT repo, file, unnest(regexp_extract_all(text, '{pattern}', 1)) AS l FROM k WHERE lang IN ({langs})"
    script, python = (ci.IMPORT_LISTS[n].replace("'", "''") for n in ("script", "python"))
    langs = ", ".join(f"'{x}'" for x in ci.SCRIPTS)
    return rf"""al AS (SELECT DISTINCT repo, file, alias, regexp_extract(o, '([^/.]*)$', 1) AS original FROM (
  SELECT repo, file, unnest(regexp_extract_all(l, '{ci.RENAMED}', 1)) AS o, unnest(regexp_extract_all(l, '{ci.RENAMED}', 2)) AS alias FROM ({listed(script, langs)} UNION ALL {listed(python, "'python'")})
  UNION ALL SELECT repo, file, unnest(regexp_extract_all(text, '{ci.GO_IMPORT}', 2)), unnest(regexp_extract_all(text, '{ci.GO_IMPORT}', 1)) FROM k WHERE lang = 'go')
  WHERE regexp_extract(o, '([^/.]*)$', 1) <> '' AND alias <> regexp_extract(o, '([^/.]*)$', 1))"""


ALIASES = _aliases_sql()


def _bindings_sql() -> str:
    each = []
    for family, patterns in ci.BINDINGS.items():
        langs = ", ".join(f"'{x}'" for x in ci.TYPED_LIKE[family])
        for p in patterns:
            v, t = (2, 1) if family == "cpp" else (1, 2)
            each.append(f"SELECT repo, file, start_line AS q, generate_subscripts(a, 1) AS n, unnest(a) AS variable, unnest(b) AS type FROM (SELECT repo, file, start_line, regexp_extract_all(text, '{p}', {v}) AS a, regexp_extract_all(text, '{p}', {t}) AS b FROM k WHERE lang IN ({langs}))")
    return "bi AS (" + " UNION ALL ".join(each) + ")"


def _bindings(spark: SparkSession, folder: str, file: str | None) -> DataFrame:
    once = ci.type_bindings(views.raw_chunks(spark, folder), ["chunk_seq", "repo", "file"], file=file).distinct()
    return once.groupBy("repo", "file", "variable", "type").agg(F.count("*").alias("n"))


def type_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """How often a variable of a file is declared with a type; languages by lang as delivered, as in its SQL."""
    return _bindings(spark, folder, None)


def type_bindings_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """type_bindings, languages by the files' extensions."""
    return _bindings(spark, folder, "file")


BINDINGS_SQL = with_views("k", more=_bindings_sql()) + "SELECT repo, file, variable, type, count(*) AS n FROM bi GROUP BY ALL"

QUALIFIERS_SQL = with_views("k", more=SITES + ", " + ALIASES + ", " + _bindings_sql() + """, am AS (SELECT repo, file, alias, max(original) AS original FROM al GROUP BY ALL),
lb AS (SELECT repo, file, variable, arg_max(type, (q, n - 1)) AS type FROM bi GROUP BY ALL),
bt AS (SELECT lb.repo, lb.file, variable, coalesce(am.original, type) AS bound FROM lb LEFT JOIN am ON am.repo = lb.repo AND am.file = lb.file AND am.alias = lb.type)""") + """
SELECT DISTINCT s.repo, s.callee, coalesce(bt.bound, a.original, s.receiver) AS qualifier FROM sites s LEFT JOIN bt ON bt.repo = s.repo AND bt.file = s.file AND bt.variable = s.receiver
LEFT JOIN am a ON a.repo = s.repo AND a.file = s.file AND a.alias = s.receiver WHERE s.receiver IS NOT NULL"""


def import_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Renaming imports; languages by lang as delivered, as in its SQL."""
    return ci.import_aliases(views.raw_chunks(spark, folder), ["repo", "file"], file=None)


def import_aliases_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """import_aliases, languages by the files' extensions."""
    return ci.import_aliases(views.raw_chunks(spark, folder), ["repo", "file"])


ALIASES_SQL = with_views("k", more=ALIASES) + "SELECT repo, file, alias, original FROM al"


def _by_file_sql(sql: str) -> str:
    """sql with languages by the files' extensions, else by lang, however it is spelled."""
    spelled = "CASE lower(trim(lang)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGE_NAMES.items()) + " ELSE lower(trim(lang)) END"
    known = f"CASE WHEN lower(file) LIKE '%.h' AND {spelled} = 'cpp' THEN 'cpp' ELSE {LANGUAGE_CASE_SQL.format(otherwise=spelled)} END"
    return sql.replace(views.SQL["k"], f"k AS (SELECT DISTINCT * REPLACE ({known} AS lang) FROM code_chunks)")



def changed_context(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol chunk, as changed, with the first five sites that call it in its repository."""
    c = views.chunks(spark, folder)
    changed = views.symbols(spark, folder).select("seq", "repo", "file", "name", "kind", F.lit(1).alias("start_line"), (F.col("end_line") - F.col("start_line") + 1).alias("end_line")).withColumn("at", F.concat_ws("#", "file", "seq"))
    files = c.select("repo", F.concat_ws("#", "file", "chunk_seq").alias("at"), "text")
    out = ci.changed_symbol_context(changed.drop("file").withColumnRenamed("at", "file"), files.withColumnRenamed("at", "file"), _sites(spark, folder), ["repo"], SITE_ORDER)
    return out.select("seq", F.md5("body").alias("digest"), F.array_join("callers", ",").alias("callers"))


CONTEXT_SQL = with_views("k", "s", more=SITES) + """,
fc AS (SELECT repo, callee, string_agg(file || ':' || line::VARCHAR, ',' ORDER BY place) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY repo, callee ORDER BY file, line, site, chunk_seq) AS place FROM sites) WHERE place <= 5 GROUP BY ALL)
SELECT s.seq, md5(substring(array_to_string(string_split(k.text, chr(10))[1:greatest(0, s.end_line - s.start_line + 1)], chr(10)), 1, 1200)) AS digest, coalesce(fc.callers, '') AS callers
FROM s JOIN k ON k.chunk_seq = s.seq LEFT JOIN fc ON fc.repo = s.repo AND fc.callee = s.name"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every qualified call, and every symbol name qualified by each class of its file."""
    symbols = views.symbols(spark, folder)
    called = _sites(spark, folder).where("receiver IS NOT NULL").select("repo", F.col("receiver").alias("qualifier"), F.col("callee").alias("name"))
    classes = symbols.where("kind = 'class'").select("repo", "file", F.col("name").alias("qualifier"))
    named = symbols.where("kind <> 'class'").select("repo", "file", "name").join(classes, ["repo", "file"]).select("repo", "qualifier", "name")
    return called.unionByName(named)


def resolve_qualified(spark: SparkSession, folder: str) -> DataFrame:
    """What every qualified call, and every symbol name qualified by each class of its file, can mean."""
    return ci.resolved(_requests(spark, folder), views.symbols(spark, folder), ["repo"]).select("repo", "qualifier", "name", "seq", "tier")


RESOLVE_SQL = with_views("k", "s", more=SITES) + """,
rq AS (SELECT DISTINCT repo, receiver AS qualifier, callee AS name FROM sites WHERE receiver IS NOT NULL
  UNION SELECT m.repo, c.name, m.name FROM s m JOIN s c ON m.repo = c.repo AND m.file = c.file WHERE m.kind <> 'class' AND c.kind = 'class'),
t AS (SELECT rq.repo, qualifier, rq.name, d.seq, min(CASE WHEN t.seq IS NULL THEN 2 WHEN d.start_line >= t.start_line AND d.end_line <= t.end_line THEN 0 ELSE 1 END) AS tier
  FROM rq JOIN s d ON d.repo = rq.repo AND d.name = rq.name LEFT JOIN s t ON t.repo = d.repo AND t.file = d.file AND t.name = rq.qualifier GROUP BY ALL)
SELECT repo, qualifier, name, seq, tier FROM (SELECT *, min(tier) OVER (PARTITION BY repo, qualifier, name) AS best FROM t) WHERE tier = best"""


RESOLVE_NEAR_SQL = RESOLVE_SQL[: RESOLVE_SQL.rindex("SELECT repo, qualifier")] + """SELECT repo, qualifier, name, seq, tier FROM (SELECT *, min(tier) OVER (PARTITION BY repo, qualifier, name) AS best FROM t) WHERE tier = best AND tier < 2
UNION ALL SELECT rq.repo, rq.qualifier, rq.name, NULL, 2 FROM rq WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo = rq.repo AND t.qualifier = rq.qualifier AND t.name = rq.name AND tier < 2)"""


def resolve_qualified_near(spark: SparkSession, folder: str) -> DataFrame:
    """resolve_qualified, where what can mean any definition of its name is one row."""
    return ci.resolved_near(_requests(spark, folder), views.symbols(spark, folder), ["repo"]).select("repo", "qualifier", "name", "seq", "tier")


def _known_language(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Chunks as delivered, with the language that the scanner knows them by."""
    return views.raw_chunks(spark, folder).select("chunk_seq", *more, "text", source_language(F.col("file"), F.col("lang")).alias("lang"))


def extract_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Functions, methods and types of every chunk, in every language; lines count within the chunk."""
    return ci.extracted_symbols(_known_language(spark, folder), ["chunk_seq"]).distinct()


def extract_symbols_named(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of one symbol in which the scanner finds that symbol, in the languages whose functions stand by themselves (Java's and Go's methods and
    what JavaScript exports by assignment have other names here, or none)."""
    own = _known_language(spark, folder, "symbol", "file").where("symbol IS NOT NULL AND symbol <> '<file>'").where(F.col("file").rlike(ALONE))
    found = ci.extracted_symbols(own, ["chunk_seq", "symbol"])
    return found.where(F.element_at(F.split("name", "::"), -1) == F.col("symbol")).select("chunk_seq", "symbol").distinct()


ALONE = r"\.(py|ts|c|cc|cpp|h|hpp)$"
NAMED_SQL = rf"SELECT DISTINCT chunk_seq, symbol FROM code_chunks WHERE symbol IS NOT NULL AND symbol <> '<file>' AND text IS NOT NULL AND regexp_matches(file, '{ALONE}')"


def calls_in_code(spark: SparkSession, folder: str) -> DataFrame:
    """Calls outside comments and strings in every chunk, by the scanner; call_sites goes by their look alone."""
    return ci.scanned_calls(_known_language(spark, folder), ["chunk_seq"]).groupBy("chunk_seq", "line", "receiver", "callee").agg(F.lit(1).alias("here")).drop("here")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest embeddings of every one whose id is divisible by 50."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rt.top_k(e.where("id % 50 = 0"), e).select("query", "id", F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


TOPK_SQL = """WITH e AS (SELECT vec_id AS id, CAST(CAST(embedding AS DOUBLE[]) AS DOUBLE[64]) AS v FROM embeddings),
s AS (SELECT q.id AS query, e.id, array_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM s)
SELECT query, id, round(score, 5) AS score, place FROM r WHERE place <= 5"""


def _memory(spark: SparkSession, folder: str) -> DataFrame:
    """Two snapshots of memory: what the plain configuration found, and what the full one did."""
    f = views.findings(spark, folder).where("ablation IN ('B-llm-only', 'full')")
    src = F.when(F.col("ablation") == "full", 1).otherwise(0)
    kind = F.when(F.col("confidence") >= 0.7, "confirmed_bug").otherwise("false_positive")
    rows = f.select(src.alias("src"), "id", kind.alias("kind"), "category", "file", "title", F.col("rationale").alias("text"), F.col("created_at").alias("created"), "seq")
    return rows.groupBy("src", "id").agg(F.max_by(F.struct("kind", "category", "file", "title", "text", "created", "seq"), "seq").alias("r")).select("src", "id", "r.*")


MEMORY = """me AS (SELECT src, id, unnest(arg_max({'kind': kind, 'category': category, 'file': file, 'title': title, 'text': rationale, 'created': created_at, 'seq': seq}, seq)) FROM (
  SELECT *, CASE WHEN ablation = 'full' THEN 1 ELSE 0 END AS src, CASE WHEN confidence >= 0.7 THEN 'confirmed_bug' ELSE 'false_positive' END AS kind FROM f WHERE ablation IN ('B-llm-only', 'full')) GROUP BY src, id),
mm AS (SELECT id, kind, category, file, title, text, created, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created DESC, src DESC) AS rn FROM me) WHERE rn = 1)"""


def memory_merge(spark: SparkSession, folder: str) -> DataFrame:
    return st.merged_memory(_memory(spark, folder)).select("id", "kind", "category", "file", "seq")


MERGE_SQL = with_views("f", more=MEMORY) + "SELECT id, kind, category, file, seq FROM mm"


def feedback_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Memory after verdicts from the remaining configuration's findings: accept if severe, ignore if low, else reject."""
    f = views.findings(spark, folder).where("ablation = '+rag'")
    verdict = F.when(F.col("rank") <= 1, "accept").when(F.col("rank") == 3, "ignore").otherwise("reject")
    feedback = f.select("id", verdict.alias("verdict"), "seq", "category", "file", "title", F.col("rationale").alias("text"), F.col("created_at").alias("created"))
    return st.with_feedback(st.merged_memory(_memory(spark, folder)), feedback).select("id", "kind", "category", "file", "seq")


FEEDBACK = """fb AS (SELECT id, CASE WHEN rank <= 1 THEN 'confirmed_bug' ELSE 'false_positive' END AS kind, category, file, title, rationale AS text, created_at AS created, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM f WHERE ablation = '+rag' AND rank < 3) WHERE rn = 1),
af AS (SELECT * FROM mm WHERE id NOT IN (SELECT id FROM fb) UNION ALL SELECT * FROM fb)"""
FEEDBACK_SQL = with_views("f", more=MEMORY + ", " + FEEDBACK) + "SELECT id, kind, category, file, seq FROM af"


def repo_profile(spark: SparkSession, folder: str) -> DataFrame:
    return st.repo_profile(st.merged_memory(_memory(spark, folder)))


PROFILE_SQL = with_views("f", more=MEMORY) + """SELECT 'file' AS what, file AS value, count(*) AS n FROM mm WHERE kind = 'confirmed_bug' GROUP BY file
UNION ALL SELECT 'category', category, count(*) FROM mm WHERE kind = 'confirmed_bug' GROUP BY category"""


def exemplars(spark: SparkSession, folder: str) -> DataFrame:
    return st.exemplars(st.merged_memory(_memory(spark, folder))).select("category", "id", F.col("place").cast("long").alias("place"))


EXEMPLARS_SQL = with_views("f", more=MEMORY) + """SELECT category, id, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY created DESC, seq) AS place FROM mm WHERE kind = 'confirmed_bug') WHERE place <= 2"""


def keyword_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Memory recalled by the title of every finding whose number is divisible by 50, within its category."""
    f = views.findings(spark, folder).where("seq % 50 = 0")
    queries = f.select(F.col("seq").alias("query_id"), "category", F.col("title").alias("query"))
    # read for sizes and for texts, merged once
    memory = staged(st.merged_memory(_memory(spark, folder)).select("id", "seq", "category", "title", "text"), "memory")
    return rt.keyword_recall(queries, memory).select("query_id", "id", "score", F.col("place").cast("long").alias("place"))


RECALL_SQL = with_views("f", more=MEMORY) + r""", q AS (SELECT seq AS query_id, category, list_filter(string_split_regex(lower(title), '[^a-zA-Z0-9_]+'), lambda t: length(t) > 3) AS terms FROM f WHERE seq % 50 = 0),
z AS (SELECT q.query_id, mm.id, mm.seq, len(list_filter(q.terms, lambda t: contains(lower(mm.title || ' ' || mm.text), t))) AS score FROM q JOIN mm USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS place FROM z WHERE score > 0)
SELECT query_id, id, score, place FROM r WHERE place <= 3"""


def _indexed_before(c: DataFrame) -> DataFrame:
    """The chunks of a former index: methods weren't chunked yet, and every chunk whose seq is divisible by 7 has since been edited to a text of equal length."""
    edited = F.when(F.col("chunk_seq") % 7 == 0, F.sha1(F.concat("digest", F.lit("*")))).otherwise(F.col("digest"))
    return c.where("kind <> 'method'").withColumn("digest", edited)


def index_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Files against a former index, by the content of their chunks."""
    c = views.chunk_digests(spark, folder)
    return st.freshness(st.content_hashes(c, ["repo", "file"]), st.content_hashes(_indexed_before(c), ["repo", "file"]), ["repo", "file"])


FRESH = """dg AS (SELECT repo, file, kind, chunk_seq, sha1(coalesce(text, '')) AS d FROM k),
nw AS (SELECT repo, file, string_agg(d, ',' ORDER BY chunk_seq) AS hash FROM dg GROUP BY ALL), od AS (SELECT repo, file, string_agg(CASE WHEN chunk_seq % 7 = 0 THEN sha1(d || '*') ELSE d END, ',' ORDER BY chunk_seq) AS hash FROM dg WHERE kind <> 'method' GROUP BY ALL),
fr AS (SELECT coalesce(nw.repo, od.repo) AS repo, coalesce(nw.file, od.file) AS file, CASE WHEN nw.file IS NULL THEN 'gone' WHEN od.file IS NOT NULL AND nw.hash IS NOT DISTINCT FROM od.hash THEN 'unchanged' ELSE 'stale' END AS state FROM nw FULL JOIN od ON nw.repo = od.repo AND nw.file = od.file)"""
FRESH_SQL = with_views("k", more=FRESH) + "SELECT repo, file, state FROM fr"


def index_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the next index against the same former one."""
    c = views.chunk_digests(spark, folder)
    old = _indexed_before(c)
    keys = ["repo", "file"]
    vectors = table(spark, folder, "vectors").where("vector IS NOT NULL")
    return st.refreshed_chunks(st.content_hashes(c, keys), old.select(*keys, "id"), c.select(*keys, "id"), st.content_hashes(old, keys), vectors, keys)


REUSE_SQL = with_views("k", more=FRESH) + """, v AS (SELECT DISTINCT id FROM vectors WHERE vector IS NOT NULL),
kept AS (SELECT k.repo, k.file, k.id, fr.state = 'unchanged' AS reused FROM k JOIN fr ON k.repo = fr.repo AND k.file = fr.file WHERE fr.state = 'stale' OR (fr.state = 'unchanged' AND k.kind <> 'method'))
SELECT repo, file, kept.id, reused, reused AND v.id IS NOT NULL AS has_vector FROM kept LEFT JOIN v ON v.id = kept.id"""


def review_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Cases as reviews: the commits of each repository form a chain in order of time; a case's fix commit is the head, and the last reviewed one
    is that of the repository's case before (real), its own (synthetic) or one off the chain (negative)."""
    from pyspark.sql import Window

    c = views.cases(spark, folder)
    along = Window.partitionBy("repo").orderBy("created_at", "case_id")
    commits = c.select("case_id", "repo", "label_source", F.col("case_id").alias("sha"), F.lag("case_id").over(along).alias("parent"))
    last = F.when(F.col("label_source") == "real", F.col("parent")).when(F.col("label_source") == "synthetic", F.col("sha")).otherwise(F.concat(F.lit("off-"), F.col("sha")))
    targets = commits.select(F.col("case_id").alias("key"), F.col("sha").alias("head"), last.alias("last"), (F.col("label_source") == "none").alias("from_patch"))
    return st.review_modes(targets, commits.select("sha", "parent")).select("key", "mode")


MODE_SQL = with_views("c") + """, cm AS (SELECT case_id, label_source, lag(case_id) OVER (PARTITION BY repo ORDER BY created_at, case_id) AS parent FROM c)
SELECT case_id AS key, CASE WHEN label_source = 'synthetic' THEN 'up-to-date' WHEN label_source = 'real' AND parent IS NOT NULL THEN 'incremental' ELSE 'full' END AS mode FROM cm"""


def record_reviewed(spark: SparkSession, folder: str) -> DataFrame:
    """What was reviewed last of each repository, after its real cases and then its others."""
    c = views.cases(spark, folder)
    of = lambda df: df.groupBy("repo").agg(F.max_by(F.struct("case_id", "created_at"), F.struct("created_at", "case_id")).alias("m")).select(F.col("repo").alias("key"), F.col("m.case_id").alias("last_sha"), F.lit("run").alias("run_id"), F.col("m.created_at").alias("updated"))
    return st.recorded(of(c.where("label_source = 'real'")), of(c.where("label_source <> 'real'"))).select("key", "last_sha")


RECORD_SQL = with_views("c") + """SELECT repo AS key, arg_max(case_id, (label_source <> 'real', created_at, case_id)) AS last_sha FROM c GROUP BY repo"""


def fix_commit_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The ten latest fix-like commits of one or two source files: cases are commits, their labels name the files."""
    c = views.cases(spark, folder).select("case_id", F.col("created_at").alias("at"), F.coalesce("description", F.lit("")).alias("message"))
    return st.fix_commits(c.join(views.labels(spark, folder).select("case_id", "file"), "case_id").withColumnRenamed("case_id", "sha")).select("sha", F.col("n_files").cast("long").alias("n_files"))


FIX_SQL = with_views("c", "g") + r"""SELECT case_id AS sha, count(DISTINCT file) AS n_files FROM c JOIN g USING (case_id) WHERE regexp_matches(lower(coalesce(description, '')), 'fix|bug|crash|leak|overflow|race|deadlock|null')
AND regexp_matches(lower(file), '\.(c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|inl|ipp|ts|tsx|js|jsx|py|go|rs|java)$') AND NOT regexp_matches(lower(file), '(^|/)(test|tests|ut|unittest|gtest|spec|__tests__)(/|$)')
GROUP BY case_id, created_at HAVING count(DISTINCT file) BETWEEN 1 AND 2 ORDER BY created_at DESC, case_id LIMIT 10"""


def graph_layers(spark: SparkSession, folder: str) -> DataFrame:
    """A layered run over each dimension's findings: count in the first layer, drop empty ones in the second, sum up in the third."""
    from siltstone.operators.runtime import DIMENSIONS, Node, run_layers

    # all dimensions are counted in one pass, and each node takes its own
    f = views.findings(spark, folder).where(F.col("category").isin(DIMENSIONS))
    counts = staged(f.groupBy("category", "case_id").agg(F.count("*").alias("n")), "dimension-counts")
    of = lambda d: lambda state: {"dimension_findings": {d: counts.where(F.col("category") == d).select("case_id", "n")}}

    def combine(state: dict) -> dict:
        out = None
        for d, df in state["dimension_findings"].items():
            one = df.select(F.lit(d).alias("dimension"), "case_id", "n")
            out = one if out is None else out.unionByName(one)
        return {"findings": out}

    nodes = [Node(d, 1, of(d)) for d in DIMENSIONS] + [Node("verifier", 2, lambda s: {}), Node("aggregator", 3, combine)]
    return run_layers(nodes, {"dimension_findings": {}})["findings"]


LAYERS_SQL = with_views("f") + "SELECT category AS dimension, case_id, count(*) AS n FROM f WHERE category IN ('correctness', 'concurrency', 'memory', 'security', 'performance', 'maintainability') GROUP BY ALL"

QUERIES = {
    f.__name__: f
    for f in (
        call_sites, find_definition, find_references_capped, qualifiers_for, qualifiers_for_by_file, import_aliases, import_aliases_by_file, type_bindings, type_bindings_by_file, changed_context, resolve_qualified, resolve_qualified_near, extract_symbols, extract_symbols_named, calls_in_code, vector_topk, memory_merge, feedback_upsert, repo_profile, exemplars,
        keyword_recall, index_freshness, index_reuse, review_mode, record_reviewed, fix_commit_pick, graph_layers,
    )
}
ORACLES = {
    "call_sites": CALLS_SQL, "find_definition": DEFINITION_SQL, "find_references_capped": REFERENCES_SQL, "qualifiers_for": QUALIFIERS_SQL, "import_aliases": ALIASES_SQL, "type_bindings": BINDINGS_SQL, "qualifiers_for_by_file": _by_file_sql(QUALIFIERS_SQL), "import_aliases_by_file": _by_file_sql(ALIASES_SQL), "type_bindings_by_file": _by_file_sql(BINDINGS_SQL), "changed_context": CONTEXT_SQL, "resolve_qualified": RESOLVE_SQL, "resolve_qualified_near": RESOLVE_NEAR_SQL, "extract_symbols_named": NAMED_SQL,
    "vector_topk": TOPK_SQL, "memory_merge": MERGE_SQL, "feedback_upsert": FEEDBACK_SQL, "repo_profile": PROFILE_SQL, "exemplars": EXEMPLARS_SQL, "keyword_recall": RECALL_SQL, "index_freshness": FRESH_SQL,
    "index_reuse": REUSE_SQL, "review_mode": MODE_SQL, "record_reviewed": RECORD_SQL, "fix_commit_pick": FIX_SQL, "graph_layers": LAYERS_SQL,
}
