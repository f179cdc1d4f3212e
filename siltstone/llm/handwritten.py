"""Generated, minified, third-party and data files among code, by layout statistics."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.splitting import family_of, let
from siltstone.session import staged

#: Thresholds by family of languages: mean line length above which, and white-space share below which, a file is minified; share of its
#: characters on lines of nothing but literals, and in encoded runs, above which it is data; share of different lines (numbers
#: aside) below which it is generated.
LIMITS = {
    "py": {"mean": 180, "space": 0.08, "literal": 0.6, "encoded": 0.5, "different": 0.35},
    "go": {"mean": 160, "space": 0.08, "literal": 0.6, "encoded": 0.5, "different": 0.35},
    "rust": {"mean": 160, "space": 0.08, "literal": 0.6, "encoded": 0.5, "different": 0.35},
    "js": {"mean": 140, "space": 0.10, "literal": 0.6, "encoded": 0.5, "different": 0.35},
    "c": {"mean": 160, "space": 0.08, "literal": 0.6, "encoded": 0.5, "different": 0.35},
}
#: Lines a file needs before the share of different ones says anything; letters and digits of an encoded run.
LEAST_LINES, ENCODED_RUN = 12, 120
#: Lines of a run by which copies are known again, characters a run needs, and the share of a file's runs that stand in another repository, too,
#: from which on it is a copy. Runs that make up one part in HOT_SHARE of all, so at most HOT_SHARE of them, are told by a broadcast.
RUN_LINES, RUN_CHARS, COPIED, HOT_SHARE = 6, 60, 0.3, 10_000
#: A line of this length, almost without blanks and dense in letters and digits, counts as encoded in any language.
LONG_LINE, DENSE = 2_000, 0.95

#: Folders of third-party code, names of generated files, and how their first lines read.
THIRD_PARTY_FOLDERS = r"(?:^|/)(?:vendor|vendored|third[_-]?party|node_modules|external|externals|extern|deps|contrib|libs|bower_components)/"
GENERATED_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|h|cc)|(?:^|/)zz_generated[^/]*|(?:^|/)moc_[^/]*|\.(?:gen|generated|g)\.\w+|(?:^|/)__generated__/[^/]*)$"
MINIFIED_NAMES = r"[.-]min\.(?:js|mjs|css)$"
GENERATED_HEAD = r"(?i)^(?:code generated\b|auto-?generated (?:file\b|by\b)|<auto-generated|@generated\b|generated (?:from|by)\b|this file (?:was|is) (?:automatically |auto-?)?generated\b|automatically generated\b|produced by \S+ v?\d)"
HOLDER_HEAD = r"(?i)\bcopyright\s*(?:\(c\)|©|\d)|^\(c\)\s*\d{4}|^spdx-(?:filecopyrighttext|license)|^@licen[sc]e\b|^author\s*:|^this file is part of\b|^part of\b|^imported from\b|^vendored from\b"
#: Where a file's first line of code begins; what comes before are blank lines and comments.
FIRST_CODE = r"(?m)^[ \t]*+(?!//|#|/?\*|<!--|\s)\S"
COMMENT_LINE = r"^\s*(?://|#|/?\*|<!--)"
#: Last lines of a file among which a generator's banner is looked for.
TAIL_LINES = 3
BLANKS = " \t\r\n"

LITERALS = r"""[bB](?=['"])|"[^"\n]*"|'[^'\n]*'|\b[0-9][\w.]*|\b(?:true|false|null|None|True|False)\b|[\s\[\]{}(),:;+-]"""
#: How a line of nothing but literals can begin; most lines of code are told from one by this alone.
LITERAL_START = r"""^\s*(?:[\[\]{}(),:;+0-9"'-]|[bB]["']|true|false|null|None|True|False)"""
#: A number with what belongs to it in front, which is bounded: a long run of such letters without a digit is passed in linear time.
NUMBERS = r"[0-9a-fx]{0,16}\d[0-9a-f]*"


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\r?\n", -1), lambda x: F.length(F.trim(x)) > 0)


def head_of(whole: Column) -> Column:
    """The comment lines in front of a text's first code, without their marks, and whether there is code."""

    def told(at: Column) -> Column:
        front = F.when(at > 0, F.substring(whole, F.lit(1), at - 1)).otherwise(whole)
        # a block comment whose lines don't begin with asterisks ends at its own mark
        opened = (at > 0) & front.rlike(r"(?:^|\n)[ \t]*/\*(?:[^*]|\*(?!/))*+\z")
        rest = F.substring_index(F.substring(whole, at, F.lit(2**31 - 1)), "*/", 1)
        return F.struct(said(lines_of(F.when(opened, F.concat(front, rest)).otherwise(front))).alias("head"), (at > 0).alias("has_code"))

    return let(F.regexp_instr(whole, F.lit(FIRST_CODE)), told)


def said(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:///?|/\*+!?|#+!?|\*+|<!--)?\s*", "")))


def layout(lines: Column) -> Column:
    """Counts of a text's lines that aren't blank, and the comments among its last ones."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    literal = F.filter(lines, lambda x: F.when(x.rlike(LITERAL_START), F.length(F.regexp_replace(x, LITERALS, "")) == 0).otherwise(F.lit(False)))
    last = F.filter(F.slice(lines, -F.least(F.lit(TAIL_LINES), F.size(lines)), TAIL_LINES), lambda x: x.rlike(COMMENT_LINE))
    return F.struct(
        F.size(lines).cast("bigint").alias("n_lines"),
        total(lines).alias("n_chars"),
        total(literal).alias("n_literal"),
        F.array_max(F.transform(lines, F.length)).alias("max_line"),
        F.when(F.size(lines) > 0, said(last)).otherwise(F.array().cast("array<string>")).alias("tail"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Layout sums of each chunk, each chunk_seq once."""
    whole = F.coalesce("text", F.lit(""))
    among = lambda letters: (F.length(whole) - F.length(F.translate(whole, letters, ""))).cast("bigint")
    # a text without a line of that length has no such run
    run = F.regexp_extract_all(whole, F.lit(rf"[A-Za-z0-9+/=]{{{ENCODED_RUN},}}"), 0)
    encoded = F.when(F.col("layout.max_line") >= ENCODED_RUN, F.aggregate(run, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))).otherwise(F.lit(0).cast("bigint"))
    known = chunks.where(F.col("file").isNotNull() & F.col("repo").isNotNull())
    per_chunk = known.select("chunk_seq", "repo", "file", "lang", "start_line", "text", let(lines_of(whole), layout).alias("layout"), head_of(whole).alias("front")).select(
        "chunk_seq",
        "repo",
        "file",
        "lang",
        F.coalesce("start_line", F.lit(1)).alias("start_line"),
        "layout.*",
        among(BLANKS).alias("n_space"),
        among(string.ascii_letters + string.digits).alias("n_alnum"),
        F.length(whole).cast("bigint").alias("n_all"),
        encoded.alias("n_encoded"),
        "front.*",
    )
    return per_chunk.dropDuplicates(["chunk_seq"])


def file_key(repo: str = "repo", file: str = "file") -> Column:
    """16 bytes that stand for a file: 128 bits, so that two files don't share them."""
    return F.unhex(F.md5(F.concat_ws("\0", repo, file)))


def line_forms(chunks: DataFrame) -> DataFrame:
    """fid, repo (a hash), forms and sizes of each chunk with text: the hash of each line with numbers made one, and its length."""
    known = chunks.where(F.col("file").isNotNull() & F.col("repo").isNotNull() & F.col("text").isNotNull())
    form = lambda x: F.xxhash64(F.when(x.rlike("[0-9]"), F.regexp_replace(x, NUMBERS, "9")).otherwise(x))
    told = lambda xs: F.struct(F.transform(xs, form).alias("forms"), F.transform(xs, F.length).alias("sizes"))
    lines = let(F.transform(lines_of(F.col("text")), lambda x: F.trim(x)), told)
    return staged(known.select(file_key().alias("fid"), F.xxhash64("repo").alias("repo"), lines.alias("x")).select("fid", "repo", "x.*"), "line-forms")


def copied_shares(forms: DataFrame) -> DataFrame:
    """fid and copied_share: the share of a file's runs of RUN_LINES lines (numbers and blanks aside) that also stand in another repository.

    forms is what line_forms gives. A run is known by a hash; whether it stands in several repositories is a combinable aggregate, so no pairs of
    files are made. The flags go back to the files by an equi-join on runs, whose hot keys (a licence that every file has) are told by a
    broadcast of at most HOT_SHARE rows.
    """

    def run(i: Column) -> Column:
        chars = reduce(lambda x, y: x + y, [F.get("sizes", i + k) for k in range(RUN_LINES)])
        return F.when(chars >= RUN_CHARS, F.xxhash64(*[F.get("forms", i + k) for k in range(RUN_LINES)]))

    runs = F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("forms") - RUN_LINES), run)))
    runs = staged(forms.where(F.size("forms") >= RUN_LINES).select("fid", "repo", F.explode(runs).alias("run")), "line-runs")
    shared = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("run", "n")
    shared = staged(shared, "shared-runs")
    often = F.col("n") * HOT_SHARE >= runs.count()
    tagged = runs.select("fid", "run").join(F.broadcast(shared.where(often).select("run", F.lit(True).alias("hot"))), "run", "left")
    rare = tagged.where("hot IS NULL").join(shared.where(~often).select("run"), "run", "left_semi")
    copied = tagged.where("hot").select("fid").unionByName(rare.select("fid")).groupBy("fid").agg(F.count("*").alias("n_copied"))
    return runs.groupBy("fid").agg(F.count("*").alias("n_runs")).join(copied, "fid").select("fid", (F.col("n_copied") / F.col("n_runs")).alias("copied_share"))


def file_statistics(chunks: DataFrame) -> DataFrame:
    """One row per (repo, file): sums over its chunks, shares, the comment lines it begins and ends with, and how much of it stands elsewhere.

    The leading comments are those of the first chunk and of the first one with code, whole.
    """
    sums = ["n_lines", "n_chars", "n_literal", "n_space", "n_alnum", "n_all", "n_encoded"]
    order = F.struct("start_line", "chunk_seq")
    none = F.array().cast("array<string>")
    files = chunk_statistics(chunks).groupBy("repo", "file").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("max_line").alias("max_line"),
        F.min_by(F.struct("has_code", "head"), order).alias("first"),
        F.min_by(F.when(F.col("has_code"), F.col("head")), F.when(F.col("has_code"), order)).alias("before_code"),
        F.max_by("tail", order).alias("tail"),
        F.max("lang").alias("lang"),
    )
    files = files.withColumn("head", F.when(F.col("first.has_code"), F.col("first.head")).otherwise(F.concat("first.head", F.coalesce("before_code", none))))
    forms = line_forms(chunks)
    # equal lines of a file meet as (file, hash) and are combined on the map side: a file with a third of all chunks is no single group
    different = forms.select("fid", F.explode(F.array_distinct("forms")).alias("form")).distinct().groupBy("fid").agg(F.count("*").alias("n_different"))
    share = lambda c, n: F.coalesce(F.col(c) / F.when(F.col(n) > 0, F.col(n)), F.lit(0.0))
    joined = files.withColumn("fid", file_key()).join(different, "fid", "left").join(copied_shares(forms), "fid", "left")
    return joined.select(
        "repo",
        "file",
        family_of(F.col("file"), F.col("lang")).alias("family"),
        "head",
        "tail",
        F.coalesce("copied_share", F.lit(0.0)).alias("copied_share"),
        "n_lines",
        "max_line",
        share("n_chars", "n_lines").alias("mean_line"),
        share("n_space", "n_all").alias("space_share"),
        share("n_alnum", "n_all").alias("alnum_share"),
        share("n_literal", "n_chars").alias("literal_share"),
        share("n_encoded", "n_all").alias("encoded_share"),
        share("n_different", "n_lines").alias("different_share"),
    )


def classified(chunks: DataFrame) -> DataFrame:
    """file_statistics and kind: minified, data, generated, third_party or hand_written, by the first that holds.

    minified: long lines almost without white space. data: most characters stand on lines of nothing but literals, or in encoded
    runs. generated: the lines are few forms that differ in their numbers, or the leading or last comment lines say so (as their own statement, not
    within code or other words), or the name does. third_party: the same wording stands in another repository as well (COPIED of its runs of
    lines); in support, for a copy that no other repository has, the folder is one for such copies, or the leading comment lines name a holder
    or origin that shares no word with the repository's name. A copied file whose leading comments name its own repository is the original.

    Rows with a null repo or file name no file and are left out; a chunk delivered twice counts once, a null text as none; a file of
    null or empty texts is judged by its path alone. Empty input gives no rows.
    """
    stats = file_statistics(chunks)
    limit = lambda name: F.coalesce(*[F.when(F.col("family") == f, F.lit(v[name])) for f, v in LIMITS.items()])
    some = F.col("n_lines") > 0
    minified = some & (((F.col("mean_line") > limit("mean")) & (F.col("space_share") < limit("space"))) | (F.col("file").rlike(MINIFIED_NAMES) & (F.col("space_share") < 2 * limit("space"))))
    encoded = (F.col("encoded_share") > limit("encoded")) | ((F.col("max_line") > LONG_LINE) & (F.col("alnum_share") > DENSE))
    data = some & ((F.col("literal_share") > limit("literal")) | encoded)
    says = lambda pattern: F.coalesce(F.exists("head", lambda x: x.rlike(pattern)), F.lit(False))
    repeats = (F.col("n_lines") >= LEAST_LINES) & (F.col("different_share") < limit("different"))
    ends = F.coalesce(F.exists("tail", lambda x: x.rlike(GENERATED_HEAD)), F.lit(False))
    generated = (some & repeats) | says(GENERATED_HEAD) | ends | F.col("file").rlike(GENERATED_NAMES)
    path = F.translate("file", "\\", "/")
    holders = F.lower(F.array_join(F.filter("head", lambda x: x.rlike(HOLDER_HEAD)), " "))
    own = F.exists(F.filter(F.split(F.lower("repo"), r"[^a-z0-9]+"), lambda w: F.length(w) > 2), lambda w: F.contains(holders, w))
    foreign = (F.length(holders) > 0) & ~own
    copied = (F.col("copied_share") >= COPIED) & ~F.coalesce(own, F.lit(False))
    third_party = copied | path.rlike(THIRD_PARTY_FOLDERS) | F.coalesce(foreign, F.lit(False))
    kind = F.when(data & (F.col("encoded_share") > limit("encoded")), "data").when(minified, "minified").when(data, "data").when(generated, "generated").when(third_party, "third_party")
    return stats.withColumn("kind", kind.otherwise("hand_written"))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """repo and file of all files that nobody wrote by hand."""
    return classified(chunks).where("kind <> 'hand_written'").select("repo", "file")
