"""The search tools of a review: named queries on its tables, each with keyword arguments and a text for an answer.

The tables of a context are DataFrames; what a tool returns is bounded by its own limit before it reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import code_index as ci
from siltstone.operators import retrieval, text_tables
from siltstone.operators.runtime import EmbedModel

#: Most lines and characters of an answer.
MOST_LINES, MOST_CHARS = 200, 4_000


@dataclass
class Context:
    """What the tools search; a missing table answers as an empty one.

    files (file, text), hunks (file, hunk_no, text), symbols (seq, file, name, kind, start_line, end_line), sites (file, line, site, callee), qualified
    (sites with qualifier), chunks (id, file, symbol, start_line, end_line, text), vectors (id, vector), signals (file, line, column, severity, rule, message),
    guidelines (text), memory (id, seq, kind, category, title, text, and vector where records are embedded).
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    embed: EmbedModel | None = None


def shortened(text: str, most: int = MOST_CHARS) -> str:
    return text if len(text) <= most else text[:most] + "\n... [truncated]"


def lines_of(df: DataFrame | None, form: str, order: list[str], most: int = MOST_LINES) -> str:
    """The first rows in order, each as form (an SQL expression) says."""
    if df is None:
        return ""
    rows = df.orderBy(*order).limit(most).selectExpr(f"{form} AS said").collect()
    return shortened("\n".join(r["said"] for r in rows))


def of_file(df: DataFrame | None, file: str | None) -> DataFrame | None:
    return df if df is None or not file else df.where(F.col("file") == file)


def get_diff(c: Context, file: str | None = None) -> str:
    return lines_of(of_file(c.tables.get("hunks"), file), "text", ["file", "hunk_no"]) or "No diff."


def read_file(c: Context, file: str, first: int | None = None, last: int | None = None) -> str:
    found = text_tables.read_lines(c.tables["files"], file, first, last).limit(1).collect() if "files" in c.tables else []
    return found[0]["text"] if found else f"Cannot read {file}"


DEFINITION = "concat(file, ':', start_line, '-', end_line, ' (', kind, ')')"
SITE = ["file", "line", "site"]


def definitions(c: Context, name: str, qualifier: str | None = None) -> DataFrame | None:
    symbols = c.tables.get("symbols")
    if symbols is None:
        return None
    if not qualifier:
        return symbols.where(F.col("name") == name)
    ask = symbols.sparkSession.createDataFrame([(qualifier, name)], "qualifier string, name string")
    return symbols.join(ci.resolved(ask, symbols, []).select("seq"), "seq", "left_semi")


def read_symbol(c: Context, name: str, file: str | None = None, qualifier: str | None = None) -> str:
    found = definitions(c, name, qualifier)
    rows = [] if found is None else found.orderBy((F.col("file") == F.lit(file or "")).desc(), "seq").limit(1).collect()
    if not rows:
        return f"No definition found for {name}"
    d = rows[0]
    return f"// {d['file']}:{d['start_line']}-{d['end_line']} ({d['kind']})\n" + read_file(c, d["file"], d["start_line"], d["end_line"])


def find_definition(c: Context, name: str) -> str:
    return lines_of(definitions(c, name), DEFINITION, ["seq"]) or f"No definition indexed for {name}"


def find_references(c: Context, name: str, qualifier: str | None = None) -> str:
    """Call sites of the name on the qualifier, else of the name alone, else whole-word matches in the files."""
    sites, qualified = c.tables.get("sites"), c.tables.get("qualified")
    if sites is not None:
        found = lines_of(ci.find_references(sites, qualified if qualified is not None else sites.limit(0).withColumn("qualifier", F.lit("")), name, SITE, qualifier), "concat(file, ':', line)", ["file", "line"])
        if found:
            others = [] if qualifier or qualified is None else [r[0] for r in qualified.where(F.col("callee") == name).select("qualifier").distinct().orderBy("qualifier").limit(9).collect()]
            return found + (f"\n# also called on: {', '.join(others[:8])}" if len(others) > 1 else "")
    return search_code(c, rf"\b{name}\b") if "files" in c.tables else f"No references found for {name}"


def search_code(c: Context, pattern: str, glob: str | None = None) -> str:
    found = text_tables.grep(c.tables["files"], ["file"], pattern, glob=glob) if "files" in c.tables else None
    return lines_of(found, "concat(file, ':', line_no, ':', line)", ["file", "line_no"]) or "No matches."


def semantic_search(c: Context, query: str, k: int = 5) -> str:
    vectors, chunks = c.tables.get("vectors"), c.tables.get("chunks")
    if vectors is None or chunks is None or c.embed is None:
        return "No vectors to search; use search_code."
    asked = vectors.sparkSession.createDataFrame([("query", [float(x) for x in c.embed.embed([query])[0]])], "id string, vector array<double>")
    hits = retrieval.top_k(asked, vectors.select("id", F.col("vector").cast("array<double>").alias("vector")), k).join(chunks.dropDuplicates(["id"]), "id")
    form = "concat('// ', file, ':', start_line, '-', end_line, ' (', symbol, ', ', round(score, 3), ')', chr(10), substring(text, 1, 800))"
    return lines_of(hits, form, ["place"], k) or "No matches."


def get_static_analysis(c: Context, file: str | None = None) -> str:
    form = "concat(file, ':', line, ':', column, ': ', severity, ': ', message, ' [', rule, ']')"
    return lines_of(of_file(c.tables.get("signals"), file), form, ["file", "line", "column"]) or "No static analysis findings."


def read_guidelines(c: Context, topic: str | None = None) -> str:
    found = c.tables["guidelines"].limit(1).collect() if "guidelines" in c.tables else []
    return (found[0]["text"] if found else "") or "No guidelines."


def recall_memory(c: Context, query: str, category: str | None = None, k: int = 3, kind: str | None = None) -> str:
    memory = c.tables.get("memory")
    if memory is None:
        return "No relevant memory."
    pool = memory if category is None else memory.where(F.col("category") == category)
    pool = pool if kind is None else pool.where(F.col("kind") == kind)
    embedded = pool.where(F.size("vector") > 0) if c.embed is not None and "vector" in memory.columns else None
    form = "concat('[', kind, '] (', category, ') ', title, ': ', text)"
    if embedded is not None and not embedded.isEmpty():
        # by cosine, in order of seq where equal; records without a vector take no part
        asked = memory.sparkSession.createDataFrame([(0, [float(x) for x in c.embed.embed([query])[0]])], "id int, vector array<double>")
        hits = retrieval.top_k(asked, embedded.select(F.col("seq").alias("id"), F.col("vector").cast("array<double>").alias("vector")), k).select(F.col("id").alias("seq"), "place").join(embedded, "seq")
        return lines_of(hits, form, ["place"], k)
    asked = memory.sparkSession.createDataFrame([(0, "all", query)], "query_id int, category string, query string")
    hits = retrieval.keyword_recall(asked, pool.withColumn("category", F.lit("all")), k).join(pool, "id")
    return lines_of(hits, form, ["place"], k) or "No relevant memory."


TOOLS: dict[str, Callable[..., str]] = {
    f.__name__: f for f in (get_diff, read_file, read_symbol, find_definition, find_references, search_code, semantic_search, get_static_analysis, read_guidelines, recall_memory)
}


def call(c: Context, name: str, args: dict) -> str:
    """The answer of a tool; a wrong name or argument, or a failure, is an answer too."""
    if name not in TOOLS:
        return f"error: no tool {name}"
    try:
        return TOOLS[name](c, **args)
    except Exception as e:
        return f"error: {e}"
