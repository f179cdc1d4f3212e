"""Parsers that turn texts into rows: diffs, analyzer logs, model answers, files into chunks and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines of a diff and of analyzers' logs.
FILE_HEADER = r"(?d)^diff --git a/(.+?) b/(.+)$"
HUNK_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
CLANG_TIDY = r"(?d)^(.*?):(\d+):(\d+):\s+(error|warning|note):\s+(.*?)(?:\s+\[([^\]]+)\])?$"
GO_VET = r"(?d)^(.*?):(\d+):(\d+):\s+(.*)$"

CHUNK_CHARS, CHUNK_LINES = 4_000, 200


def numbered_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos (from 0) and line of each line of the text."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


#: Where a patch is cut into its files, and a file's section or patch into its hunks: in front of their headers.
BEFORE_FILE = r"(?md)(?=^diff --git a/.+? b/.)"
HUNK_START = r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"
BEFORE_HUNK = rf"\n(?={HUNK_START})"


def new_side(hunk: Column, is_new: Callable[[Column], Column], is_added: Callable[[Column], Column]) -> Column:
    """The numbers of the added ones among a hunk's lines of the new side: where only those lines are kept, a line's place is its number."""
    start = F.regexp_extract(hunk, HUNK_HEADER, 1).try_cast("int")
    lines = F.filter(F.split(hunk, "\n", -1), lambda x, i: (i > 0) & is_new(x))
    return F.array_compact(F.transform(lines, lambda x, i: F.when(is_added(x), start + i)))


def diff_hunks(patches: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per hunk of unified diffs: key, file, status, new_start, new_lines, changed_lines (array of the new side's added lines).

    A line's number is the hunk's start and the lines before it in the hunk that are neither removed nor a "\\ No newline" note. As
    in the format's common readers, an added line that looks like +++ and a removed one like --- are taken for context.
    A carriage return at a line's end doesn't count. Lines before the first file are skipped. hunk_no counts the headers of files and hunks.

    A patch is one row and is taken apart within it: texts without a header are dropped first, and nothing is shuffled.
    """
    with_files = patches.where(F.contains(text, F.lit("diff --git "))).select(key, F.regexp_replace(text, r"\r(?=\n|\z)", "").alias("_t"))
    sections = F.filter(F.split("_t", BEFORE_FILE, -1), lambda x: x.rlike(rf"\A{BEFORE_FILE}"))
    # each section has so many headers; before it are those of all earlier ones
    headers = F.transform("_s", lambda x: F.regexp_count(x, F.lit(BEFORE_HUNK)) + 1)
    before = F.aggregate(headers, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    files = with_files.select(key, sections.alias("_s")).select(key, "_s", before.alias("_before")).select(key, "_before", F.posexplode("_s").alias("_no", "_x"))
    marks = F.filter(F.split("_x", "\n", -1), lambda x: x.startswith("new file") | x.startswith("deleted file") | x.startswith("rename "))
    last = F.get(marks, F.size(marks) - 1)
    status = F.when(last.startswith("new file"), "added").when(last.startswith("deleted file"), "deleted").when(last.startswith("rename "), "renamed").otherwise("modified")
    own = files.select(key, F.regexp_extract("_x", rf"(?m){FILE_HEADER}", 2).alias("file"), status.alias("status"), F.get("_before", F.col("_no")).alias("_first"), F.posexplode(F.split("_x", BEFORE_HUNK, -1)).alias("_hunk", "_h"))
    hunk = F.col("_h")
    added = lambda x: x.startswith("+") & ~x.startswith("+++")
    advances = lambda x: added(x) | ~((x.startswith("-") & ~x.startswith("---")) | x.startswith("\\"))
    return own.where("_hunk > 0").select(
        key, "file", "status", (F.col("_first") + F.col("_hunk") + 1).alias("hunk_no"), F.regexp_extract(hunk, HUNK_HEADER, 1).try_cast("int").alias("new_start"),
        F.coalesce(F.regexp_extract(hunk, HUNK_HEADER, 2).try_cast("int"), F.lit(1)).alias("new_lines"), new_side(hunk, advances, added).alias("changed_lines"),
    )


def effective_lines(hunks: DataFrame, *keys: str) -> DataFrame:
    """keys, file and line: the added lines of each hunk, or for one that only removes its window on the new side, or its start."""
    window = F.when(F.col("new_lines") > 0, F.sequence("new_start", F.col("new_start") + F.col("new_lines") - 1)).otherwise(F.array("new_start"))
    return hunks.select(*keys, "file", F.explode(F.when(F.size("changed_lines") > 0, F.col("changed_lines")).otherwise(window)).alias("line")).distinct()


def commentable_lines(patches: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and line: added and context lines of one file's hunks, on which a comment can stand. A patch is taken apart within its row."""
    hunks = patches.where(F.contains(text, F.lit("@@ -"))).select(*keys, F.explode(F.split(text, BEFORE_HUNK, -1)).alias("_h")).where(F.col("_h").rlike(rf"\A{HUNK_START}"))
    kept = lambda x: ~x.startswith("-")
    return hunks.select(*keys, F.explode(new_side(F.col("_h"), kept, lambda x: F.lit(True))).alias("line")).distinct()


def clang_tidy_findings(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, file, line, column, severity, rule and message of each error or warning of clang-tidy's output."""
    lines = numbered_lines(logs, keys, text).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    part = lambda i: F.regexp_extract("line", CLANG_TIDY, i)
    rows = lines.where(F.col("line").rlike(CLANG_TIDY) & (part(4) != "note"))
    rule = F.when(part(6) != "", part(6)).otherwise("clang-tidy")
    return rows.select(*keys, part(1).alias("file"), part(2).try_cast("int").alias("at"), part(3).try_cast("int").alias("column"), part(4).alias("severity"), rule.alias("rule"), part(5).alias("message")).withColumnRenamed("at", "line")


def go_vet_findings(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The same of go vet's output: always warnings of rule go-vet."""
    lines = numbered_lines(logs, keys, text).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    part = lambda i: F.regexp_extract("line", GO_VET, i)
    rows = lines.where(F.col("line").rlike(GO_VET))
    return rows.select(*keys, part(1).alias("file"), part(2).try_cast("int").alias("at"), part(3).try_cast("int").alias("column"), F.lit("warning").alias("severity"), F.lit("go-vet").alias("rule"), part(4).alias("message")).withColumnRenamed("at", "line")


RUFF = "array<struct<filename:string,location:struct<row:int,column:int>,code:string,message:string>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,ruleId:string,message:string>>>>"


def ruff_findings(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The findings in ruff's JSON; text that isn't JSON has none."""
    items = logs.select(*keys, F.explode(F.from_json(text, RUFF)).alias("x"))
    return items.select(
        *keys, F.col("x.filename").alias("file"), F.coalesce("x.location.row", F.lit(1)).alias("line"), F.coalesce("x.location.column", F.lit(1)).alias("column"), F.lit("warning").alias("severity"),
        F.coalesce("x.code", F.lit("ruff")).alias("rule"), F.coalesce("x.message", F.lit("")).alias("message"),
    )


def eslint_findings(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The findings in eslint's JSON: severity 2 is an error, 1 a warning, less is dropped."""
    files = logs.select(*keys, F.explode(F.from_json(text, ESLINT)).alias("x")).select(*keys, F.col("x.filePath").alias("file"), F.explode("x.messages").alias("m"))
    return files.where("m.severity IS NULL OR m.severity >= 1").select(
        *keys, "file", F.coalesce("m.line", F.lit(1)).alias("line"), F.coalesce("m.column", F.lit(1)).alias("column"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"),
        F.coalesce("m.ruleId", F.lit("eslint")).alias("rule"), F.coalesce("m.message", F.lit("")).alias("message"),
    )


def outer_object(answer: Column) -> Column:
    """The text from the first { to the last } of a model's answer, code fences aside; null without both."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"^\s+|\s+$", ""), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


ANSWER = (
    "struct<findings:array<struct<file:string,line:string,endLine:string,severity:string,title:string,rationale:string,suggestion:string,suggestedPatch:string,"
    "confidence:string,evidence:array<struct<type:string,ref:string>>>>>"
)


def answered_findings(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """The valid findings in model answers, in order (item, from 0): file, line, severity, title and rationale must be there and well formed; confidence, in
    0..1, is 0.6 where missing, evidence empty. What isn't JSON or isn't valid gives no row."""
    items = answers.select(*keys, F.posexplode(F.from_json(outer_object(F.col(text)), ANSWER)["findings"]).alias("item", "x"))
    line, end, confidence = F.col("x.line").try_cast("int"), F.col("x.endLine").try_cast("int"), F.col("x.confidence").try_cast("double")
    valid = (
        F.col("x.file").isNotNull()
        & line.isNotNull()
        & (F.col("x.endLine").isNull() | end.isNotNull())
        & F.col("x.severity").isin("critical", "high", "medium", "low")
        & F.col("x.title").isNotNull()
        & F.col("x.rationale").isNotNull()
        & (F.col("x.confidence").isNull() | confidence.between(0, 1))
    )
    return items.where(F.coalesce(valid, F.lit(False))).select(
        *keys, "item", F.col("x.file").alias("file"), line.alias("line"), end.alias("end_line"), F.col("x.severity").alias("severity"), F.col("x.title").alias("title"), F.col("x.rationale").alias("rationale"),
        F.coalesce("x.suggestion", F.lit("")).alias("suggestion"), F.col("x.suggestedPatch").alias("suggested_patch"), F.coalesce(confidence, F.lit(0.6)).alias("confidence"), F.size(F.coalesce("x.evidence", F.array())).alias("n_evidence"),
    )


def answered_verdicts(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """keys, index, keep and confidence of the verdicts in model answers; one without a numeric index is dropped, keep is true unless false."""
    kind = "struct<verdicts:array<struct<index:string,keep:string,confidence:string>>>"
    items = answers.select(*keys, F.posexplode(F.from_json(outer_object(F.col(text)), kind)["verdicts"]).alias("verdict_seq", "x"))
    index = F.col("x.index").try_cast("long")
    return items.where(index.isNotNull()).select(*keys, "verdict_seq", index.alias("index"), F.coalesce(F.col("x.keep") != "false", F.lit(True)).alias("keep"), F.col("x.confidence").try_cast("double").alias("confidence"))


def answered_judgments(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """keys, id, valid, score and reason of the judgments in model answers; score is 0.6 where missing, 0 if not valid."""
    kind = "struct<judgments:array<struct<id:string,valid:string,score:string,reason:string>>>"
    items = answers.select(*keys, F.posexplode(F.from_json(outer_object(F.col(text)), kind)["judgments"]).alias("judgment_seq", "x"))
    valid = F.coalesce(F.col("x.valid") != "false", F.lit(True))
    return items.where("x.id IS NOT NULL").select(*keys, "judgment_seq", "x.id", valid.alias("valid"), F.coalesce(F.col("x.score").try_cast("double"), F.when(valid, 0.6).otherwise(0.0)).alias("score"), "x.reason")


def chunk_id(file: Column, first: Column, last: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", file, first.cast("string"), last.cast("string"))), 1, 16)


def window_chunks(files: DataFrame, file: str, text: str = "text", size: int = CHUNK_LINES, most: int = CHUNK_CHARS) -> DataFrame:
    """Files in windows of `size` lines, cut at `most` characters, blank ones left out: id, file, start_line, end_line, text."""
    lines = files.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.split(text, "\n", -1).alias("lines"))
    starts = lines.select("file", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"), F.lit(size))).alias("start_line"))
    body = F.substring(F.array_join(F.slice("lines", F.col("start_line"), size), "\n"), 1, most)
    cut = starts.select("file", "start_line", F.least(F.col("start_line") + size - 1, F.size("lines")).alias("end_line"), body.alias("text"))
    return cut.where(F.col("text").rlike(r"[^ \t\n\r\x0b\x0c]")).select(chunk_id(F.col("file"), F.col("start_line"), F.col("end_line")).alias("id"), "*")


def symbol_chunks(files: DataFrame, symbols: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """One chunk per symbol of files (file, text): its lines, cut at `most` characters, blank ones left out."""
    body = F.substring(F.array_join(F.slice(F.split("text", "\n", -1), F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n"), 1, most)
    joined = symbols.join(files.select("file", "text"), "file")
    cut = joined.select("file", F.col("name").alias("symbol"), "kind", "start_line", "end_line", body.alias("text")).where(F.col("text").rlike(r"[^ \t\n\r\x0b\x0c]"))
    return cut.select(chunk_id(F.col("file"), F.col("start_line"), F.col("end_line")).alias("id"), "*")


def numbered(lines: Column, first: Column, last: Column, most: int = CHUNK_CHARS) -> Column:
    """The lines first..last of an array of lines, each behind its number, cut at `most` characters with a note."""
    shown = F.array_join(F.transform(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), lambda x, i: F.concat((first + i).cast("string"), F.lit("| "), x)), "\n")
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most), F.lit("\n... [truncated]"))).otherwise(shown)


def read_lines(files: DataFrame, file: str, first: int | None = None, last: int | None = None, most: int = CHUNK_CHARS) -> DataFrame:
    """The named file's lines first..last (clamped to the file), each behind its number, cut at `most` characters with a note."""
    lines = files.where(F.col("file") == file).select(F.split("text", "\n", -1).alias("l"))
    end = F.least(F.size("l"), F.lit(last)) if last else F.size("l")
    return lines.select(numbered(F.col("l"), F.greatest(F.lit(1), F.lit(first or 1)), end, most).alias("text"))


def grep(files: DataFrame, keys: list[str], pattern: str, text: str = "text", glob: str | None = None) -> DataFrame:
    """keys, line_no (from 1) and line of each line that the regex meets, optionally in files that the glob names."""
    from siltstone.functions.review import matches_glob

    chosen = files if glob is None else files.where(matches_glob(F.col("file"), [glob]))
    lines = numbered_lines(chosen, keys, text)
    return lines.where(F.col("line").rlike(pattern)).select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")
