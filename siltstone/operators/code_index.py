"""Symbols, call sites, import aliases and the graph between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.review import source_language
from siltstone.operators.syntax import calls_of, symbols_of

MAX_REFERENCES = 50

#: Words before a parenthesis that aren't calls or functions.
KEYWORDS = [
    "if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "case", "decltype", "noexcept", "alignof", "static_assert",
    "and", "or", "not", "throw", "co_await", "co_yield", "co_return",
]
MORE_WORDS = ["func", "fn", "def", "function", "new", "in", "is", "await", "yield", "elif", "except", "with", "assert", "lambda", "print", "class", "match", "loop", "unsafe", "synchronized", "super", "this", "self"]

CALL = r"(?:([A-Za-z_]\w*)(?:\.|->|::))?([A-Za-z_]\w*)\s*\("


def call_sites(chunks: DataFrame, keys: list[str], text: str = "text", start: str = "start_line") -> DataFrame:
    """Calls by their look: keys, line (of the file), site (place in the line), receiver (or null) and callee."""
    lines = chunks.where(F.col(text).isNotNull() & F.col(start).isNotNull()).select(*keys, F.col(start).alias("_start"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    found = lines.select(*keys, (F.col("_start") + F.col("_pos")).alias("line"), F.posexplode(F.arrays_zip(F.regexp_extract_all("_line", F.lit(CALL), 1).alias("receiver"), F.regexp_extract_all("_line", F.lit(CALL), 2).alias("callee"))).alias("site", "x"))
    named = found.select(*keys, "line", "site", F.nullif(F.col("x.receiver"), F.lit("")).alias("receiver"), F.col("x.callee").alias("callee"))
    return named.where(~F.col("callee").isin(KEYWORDS + MORE_WORDS))


def in_language(chunks: DataFrame, file: str | None, lang: str) -> DataFrame:
    """chunks and _lang, by the file's extension, else by lang; by lang as it is spelled where file is None."""
    return chunks.withColumn("_lang", F.col(lang) if file is None else source_language(F.col(file), F.col(lang)))


#: Where a statement that imports names lists them, by language (group 1), and a renaming in such a list: the name, maybe within a module, and the new one.
IMPORT_LISTS = {"script": r"\bimport\b([^;'\"]*)['\"]", "python": r"(?m)^[ \t]*(?:from[ \t]+[\w.]+[ \t]+)?import[ \t]+([^\n#;]*)"}
RENAMED = r"([\w$.]+)\s+as\s+([\w$]+)"
#: A Go import under a name of its own.
GO_IMPORT = r"(?m)^[ \t]*(?:import[ \t]+)?([A-Za-z_]\w*)[ \t]+\"([^\"\s]+/[A-Za-z_]\w*)\""
SCRIPTS = ["typescript", "tsx", "javascript"]


def import_aliases(chunks: DataFrame, keys: list[str], lang: str = "lang", text: str = "text", file: str | None = "file") -> DataFrame:
    """keys, alias and original of renaming imports of TypeScript, JavaScript, Python and Go; those that keep the name are left out.

    One pass: each text gives its pairs as one array. Of a dotted name or a path the last part is the original.
    """
    rows = in_language(chunks.where(F.col(text).isNotNull()), file, lang)
    within = lambda pattern: F.array_join(F.regexp_extract_all(text, F.lit(pattern), 1), "\n,")
    lists = F.when(F.col("_lang").isin(SCRIPTS), within(IMPORT_LISTS["script"])).when(F.col("_lang") == "python", within(IMPORT_LISTS["python"]))
    zipped = lambda source, pattern, name, alias: F.arrays_zip(F.regexp_extract_all(source, F.lit(pattern), name).alias("original"), F.regexp_extract_all(source, F.lit(pattern), alias).alias("alias"))
    pairs = F.when(F.col("_lang") == "go", zipped(text, GO_IMPORT, 2, 1)).otherwise(zipped(lists, RENAMED, 1, 2))
    found = rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.alias", F.substring_index(F.substring_index("x.original", "/", -1), ".", -1).alias("original"))
    return found.where((F.col("original") != "") & (F.col("alias") != F.col("original"))).distinct()


#: How a variable gets its type, by language: the groups are (variable, type) or, for C++, (type, variable).
BINDINGS = {
    "typescript": [r"\b(?:const|let|var)\s+(\w+)\s*:\s*([A-Z]\w*)", r"\b(?:const|let|var)\s+(\w+)\s*=\s*new\s+([A-Za-z_]\w*)"],
    "python": [r"(?m)^\s*(\w+)\s*=\s*([A-Z]\w*)\(", r"(?m)^\s*(\w+)\s*:\s*([A-Z]\w*)\b"],
    "go": [r"\b(\w+)\s*:=\s*&?([A-Za-z_]\w*)\{", r"\bvar\s+(\w+)\s+\*?([A-Za-z_]\w*)"],
    "cpp": [r"(?m)^\s*([A-Z]\w*)\s*[*&]?\s+[*&]?(\w+)\s*[;=({]"],
}
TYPED_LIKE = {"typescript": ["typescript", "tsx"], "python": ["python"], "go": ["go"], "cpp": ["cpp"]}


def type_bindings(chunks: DataFrame, keys: list[str], lang: str = "lang", text: str = "text", seq: str = "start_line", file: str | None = "file") -> DataFrame:
    """keys, variable, type and seq of variables whose declaration names their type, as far as its look tells; only the languages of BINDINGS."""
    out = None
    known = in_language(chunks.where(F.col(text).isNotNull()), file, lang)
    for family, patterns in BINDINGS.items():
        own = known.where(F.col("_lang").isin(TYPED_LIKE[family]))
        for pattern in patterns:
            found = own.select(*keys, F.col(seq).alias("_seq"), F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))).alias("_pos", "_x"))
            variable, kind = ("_x.b", "_x.a") if family == "cpp" else ("_x.a", "_x.b")
            rows = found.select(*keys, F.col(variable).alias("variable"), F.col(kind).alias("type"), F.struct("_seq", "_pos").alias("seq"))
            out = rows if out is None else out.unionByName(rows)
    return out


def first_symbols(symbols: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """The first `most` symbols (seq, start_line) of each review in order of line, with their place from 1: what a prompt has room for."""
    return symbols.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line", "seq")).cast("long")).where(F.col("place") <= most)


def changed_symbol_context(changed: DataFrame, files: DataFrame, sites: DataFrame, scope: list[str], order: list[str], callers: int = 5, body: int = 1200) -> DataFrame:
    """Each changed symbol (scope, file, name, kind, start_line, end_line) with its body, cut at `body` characters, and its first `callers` call sites as file:line."""
    first = references(sites, [*scope, "callee"], order, callers)
    listed = first.groupBy(*scope, F.col("callee").alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "file", "line").alias("at")))).alias("c"))
    lines = F.slice(F.split("text", "\n", -1), F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1))
    read = changed.join(files.select(*scope, "file", "text"), [*scope, "file"]).withColumn("body", F.substring(F.array_join(lines, "\n"), 1, body)).drop("text")
    return read.join(listed, [*scope, "name"], "left").withColumn("callers", F.coalesce(F.transform("c", lambda x: x["at"]), F.array())).drop("c")


def qualified_sites(sites: DataFrame, bindings: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Sites with a receiver and their qualifier: the bound variable's type, else the receiver, each under its imported name.

    bindings has keys, variable, type and seq, of which the last holds; aliases has keys, alias and original.
    """
    original = aliases.groupBy(*keys, "alias").agg(F.max("original").alias("original"))
    last = bindings.groupBy(*keys, "variable").agg(F.max_by("type", "seq").alias("type"))
    typed = last.join(original.withColumnRenamed("alias", "type"), [*keys, "type"], "left").select(*keys, F.col("variable").alias("receiver"), F.coalesce("original", "type").alias("bound"))
    named = original.select(*keys, F.col("alias").alias("receiver"), F.col("original").alias("named"))
    joined = sites.where(F.col("receiver").isNotNull()).join(typed, [*keys, "receiver"], "left").join(named, [*keys, "receiver"], "left")
    return joined.withColumn("qualifier", F.coalesce("bound", "named", "receiver")).drop("bound", "named")


def references(sites: DataFrame, keys: list[str], order: list[str], most: int = MAX_REFERENCES) -> DataFrame:
    """The first `most` sites of each key in order, numbered from 1; the limit is applied on both sides of the shuffle."""
    return sites.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def find_references(sites: DataFrame, qualified: DataFrame, name: str, order: list[str], qualifier: str | None = None) -> DataFrame:
    """The first sites that call name on the qualifier; if there is none, or none is asked for, the first that call it at all."""
    bare = references(sites.where(F.col("callee") == name), ["callee"], order).select("file", "line", F.lit(1).alias("tier"))
    if qualifier is None:
        return bare.drop("tier")
    exact = references(qualified.where((F.col("callee") == name) & (F.col("qualifier") == qualifier)), ["callee", "qualifier"], order).select("file", "line", F.lit(0).alias("tier"))
    both = exact.unionByName(bare).withColumn("best", F.min("tier").over(Window.partitionBy()))
    return both.where(F.col("tier") == F.col("best")).select("file", "line")


def resolved_near(requests: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """The definitions that qualifier.name means most nearly: those enclosed by a definition of the qualifier (tier 0); if none, those in a file that has one
    (tier 1); a request with neither gets one row of tier 2 without a seq, for it can mean every definition of its name.

    requests has scope, qualifier and name; symbols has seq, scope, file, name, start_line and end_line. Requests meet the definitions of
    their qualifier first, and then only the names within those files, so a name that everything defines costs no more than its
    own files. Returns scope, qualifier, name, seq and tier.
    """
    asked = requests.distinct()
    types = symbols.select(*scope, "file", F.col("name").alias("qualifier"), F.col("start_line").alias("t_start"), F.col("end_line").alias("t_end"))
    methods = symbols.select("seq", *scope, "file", "name", "start_line", "end_line")
    around = asked.join(types, [*scope, "qualifier"]).join(methods, [*scope, "file", "name"])
    inside = F.coalesce((F.col("start_line") >= F.col("t_start")) & (F.col("end_line") <= F.col("t_end")), F.lit(False))
    tiers = around.groupBy(*scope, "qualifier", "name", "seq").agg(F.min(F.when(inside, 0).otherwise(1)).alias("tier"))
    best = tiers.groupBy(*scope, "qualifier", "name").agg(F.min("tier").alias("best"))
    known = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*scope, "qualifier", "name")]
    named = best.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "qualifier", "name")], "best")
    near = tiers.join(named, known).where(F.col("tier") == F.col("best")).select(*scope, "qualifier", "name", "seq", "tier")
    rest = asked.join(best.select(*scope, "qualifier", "name"), [*scope, "qualifier", "name"], "left_anti")
    return near.unionByName(rest.select(*scope, "qualifier", "name", F.lit(None).cast(symbols.schema["seq"].dataType).alias("seq"), F.lit(2).alias("tier")))


def resolved(requests: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """resolved_near with every definition of the name in the place of the rows of tier 2: as many rows as requests times definitions, where a caller wants that."""
    near = resolved_near(requests, symbols, scope)
    every = near.where("tier = 2").drop("seq").join(symbols.select("seq", *scope, "name"), [*scope, "name"])
    return near.where("tier < 2").unionByName(every.select(*near.columns))


def overlapping_symbols(symbols: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols within whose lines something changed."""
    c = changed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("line").alias("_line"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return symbols.join(c, [*same, F.col("_line").between(F.col("start_line"), F.col("end_line"))], "left_semi")


def near_changes(signals: DataFrame, changed: DataFrame, keys: list[str], window: int = 3) -> DataFrame:
    """Signals at most `window` lines from a changed line of their file: each changed line stands for the lines around it, an equi-join."""
    around = changed.select(*keys, F.explode(F.sequence(F.col("line") - window, F.col("line") + window)).alias("line")).distinct()
    return signals.join(around, [*keys, "line"], "left_semi")


def scanned(files: DataFrame, keys: list[str], of: Callable, kinds: str, text: str, lang: str) -> DataFrame:
    """What `of` (a function of a text and its language that gives tuples) finds in each file: keys and the columns of kinds."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [of(t, x) for t, x in zip(frame["_text"], frame["_lang"])]
            rows = [(*k, *r) for k, f in zip(zip(*[frame[c] for c in keys]), found) for r in f]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    own = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), F.col(lang).alias("_lang")).mapInPandas(each, f"{own}, {kinds}")


def extracted_symbols(files: DataFrame, keys: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keys, name, kind, start_line and end_line of the functions, methods and types of files in any language of LANGUAGES; lang is its name there."""
    return scanned(files, keys, symbols_of, "name string, kind string, start_line int, end_line int", text, lang)


def scanned_calls(files: DataFrame, keys: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keys, line (within the text), receiver and callee of the calls outside comments and strings."""
    return scanned(files, keys, calls_of, "line int, receiver string, callee string", text, lang)
