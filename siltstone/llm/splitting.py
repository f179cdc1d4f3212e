"""Splitting oversized code chunks where declarations begin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most characters of a piece, and the lines of the piece before that it repeats.
LIMIT, OVERLAP_LINES = 4_000, 5

#: Families of languages by file extension, and by name where the extension says nothing.
FAMILY_OF_EXTENSION = {
    "py": ["py", "pyi"],
    "go": ["go"],
    "rust": ["rs"],
    "js": ["js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"],
    "c": ["c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "ipp", "java"],
}
FAMILY_OF_LANG = {"py": ["python", "py"], "go": ["go", "golang"], "rust": ["rust", "rs"], "js": ["javascript", "js", "typescript", "ts"], "c": ["c", "c++", "cpp", "java"]}

#: What stands for a comment's and a string's characters in masked text.
COMMENT, STRING = "\x01", "\x02"

#: One lexeme of each family: a comment, a string, or code; backslashes with what they escape have been masked before.
BLOCK = r"/\*(?s:.)*?(?:\*/|\z)"
LEXEME = {
    "py": r'"""(?s:.)*?(?:"""|\z)|' + r"'''(?s:.)*?(?:'''|\z)" + r"""|#[^\n]*|"[^"\n]*"|'[^'\n]*'|[^#"']+|(?s:.)""",
    "go": rf"""//[^\n]*|{BLOCK}|`[^`]*(?:`|\z)|"[^"\n]*"|'[^'\n]*'|[^/`"']+|(?s:.)""",
    "rust": rf"""//[^\n]*|{BLOCK}|\br(#*)"(?s:.)*?(?:"\1|\z)|"[^"]*(?:"|\z)|'(?:[^'\n]|\x02\x02[^'\n]*)'|[^/"'r]+|(?s:.)""",
    "js": rf"""//[^\n]*|{BLOCK}|`[^`]*(?:`|\z)|"[^"\n]*"|'[^'\n]*'|(?<=[=(,:!&|?;\[] ?)/(?![/*\s])[^/\n]+/[a-z]*|[^/`"'=(,:!&|?;\[]+|(?s:.)""",
    "c": rf"""//[^\n]*|{BLOCK}|\bR"([^\s(]*)\((?s:.)*?(?:\)\1"|\z)|\"\"\"(?s:.)*?(?:\"\"\"|\z)|"[^"\n]*"|'[^'\n]*'|[^/"'R]+|(?s:.)""",
}
IS_COMMENT = {"py": r"^#", "go": r"^(?://|/\*)", "rust": r"^(?://|/\*)", "js": r"^(?://|/\*)", "c": r"^(?://|/\*)"}
IS_STRING = {"py": r"""^["'](?s:.)*["']\z|^(?:\"\"\"|''')""", "go": r"""^(?:`|"(?s:.)*"\z|'(?s:.)*'\z)""", "rust": r"""^(?:r#*"|"|'(?s:.)*'\z)""", "js": r"""^(?:`|"(?s:.)*"\z|'(?s:.)*'\z|/.+/)""", "c": r"""^(?:R"|"(?s:.)*"\z|'(?s:.)*'\z|\"\"\")"""}

#: Lines that begin a class or the like, and a function or the like, in masked text without the blanks in front.
CLASS = {
    "py": r"^class\s+\w",
    "go": r"^type\s+\w+(?:\[[^\]]*\])?\s+(?:struct|interface)\b",
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl|struct|enum|trait|union)\b",
    "js": r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+[\w$]|^(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*=\s*class\b",
    "c": r"^(?:(?:public|private|protected|static|final|abstract|sealed|export|strictfp)\s+)*(?:class|interface|@interface|record|enum(?:\s+class)?|struct|union)\s+\w[^;=()]*(?:\(.*\)[^;]*)?$",
}
ARROW = r"(?:async\s*)?(?:function\b|(?:<[^>]*>)?\([^)]*\)\s*(?::[^=]*?)?=>|[\w$]+\s*=>)"
FUNCTION = {
    "py": r"^(?:async\s+)?def\s+\w|^\w+\s*(?::[^=]+)?=\s*lambda\b",
    "go": r"^func\b|^(?:var\s+)?\w+(?:\s+[^=:]+)?\s*:?=\s*func\b",
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+|extern\s+(?:\x02+\s+)?)*fn\s+\w|^(?:let|const|static)\s+(?:mut\s+)?\w+(?:\s*:[^=]+)?\s*=\s*(?:move\s*)?\|",
    "js": rf"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b|^(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*{ARROW}|^[\w$.]+\s*=\s*{ARROW}|^export\s+default\s+{ARROW}",
    "c": r"^(?!(?:if|for|while|switch|return|else|do|catch|try|throw|new|delete|case|using|typedef|import|package|goto|sizeof|assert|static_assert|synchronized|default)\b)[\w:<>,*&\[\]\s~.?]*?(?:\boperator\s*\S+|~?\w+)\s*\((?!.*;\s*$)|^(?:const\s+)?auto\s+\w+\s*=\s*\[",
}
#: A function assigned to a name, of which the line has only the opening parenthesis, and how the line of the closing one goes on.
OPEN_ARROW = r"^(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>)?\([^()]*$|^[\w$.]+\s*=\s*(?:async\s*)?\([^()]*$|^export\s+default\s+(?:async\s*)?\([^()]*$"
CLOSED_ARROW = r"^\)\s*(?::[^=]*)?=>"
#: Direct members of a class where they look unlike functions outside.
MEMBER = {
    "js": rf"^(?!(?:if|for|while|switch|return|catch|do|else|function|new|throw|await|super)\b)(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+)*\*?\s*[#\w$]+\s*(?:<[^>]*>)?\((?!.*;\s*$)|^(?:(?:public|private|protected|static|readonly|override)\s+)*[#\w$]+\s*(?::[^=]+)?=\s*{ARROW}",
    "c": r"^(?!(?:if|for|while|switch|return|else|do|catch|try|throw|new|delete|case|using|typedef|assert|static_assert|friend)\b)[\w:<>,*&\[\]\s~.?]*?(?:\boperator\s*\S+|~?\w+)\s*\((?!.*;\s*$)",
}
#: Heads of blocks whose content doesn't count as nested, with their brace and without it at a line's end; and a word without which a text has none.
CONTAINER = {
    "rust": r"(?<![\w.])mod\s+\w+\s*\{",
    "js": r"(?<![\w.])(?:namespace|module)\s+[\w.\x02]+\s*\{",
    "c": r"(?<![\w.])(?:namespace\b[^;={}()]*|extern\s+\x02+\s*)\{",
}
CONTAINER_BEFORE_BRACE = {
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+$",
    "js": r"^(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+[\w.\x02]+$",
    "c": r"^(?:inline\s+)?namespace\b[^;={}()]*$|^extern\s+\x02+$",
}
CONTAINER_WORD = {"rust": r"\bmod\b", "js": r"\b(?:namespace|module)\b", "c": r"\b(?:namespace|extern)\b"}
#: Lines that belong to the declaration behind them.
ATTACHED = {"py": r"^@\w", "go": r"(?!)", "rust": r"^#!?\[", "js": r"^@\w[^{]*$", "c": r"^@(?!interface)\w[^{]*$|^template\s*<[^{;(]*$|^\[\[.*\]\]\s*$"}


def by_family(family: Column, made: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, column in made.items():
        out = F.when(family == name, column) if out is None else out.when(family == name, column)
    return out.otherwise(otherwise)


def family_of(file: Column, lang: Column) -> Column:
    """The family by the file's extension, else by lang, else the one with braces."""
    extension = F.lower(F.regexp_extract(F.trim(file), r"\.(\w+)$", 1))
    name = F.lower(F.trim(lang))
    out = None
    for key, table in ((extension, FAMILY_OF_EXTENSION), (name, FAMILY_OF_LANG)):
        for family, known in table.items():
            out = F.when(key.isin(known), family) if out is None else out.when(key.isin(known), family)
    return out.otherwise("c")


def blotting(family: str) -> Callable[[Column], Column]:
    def blot(x: Column) -> Column:
        return F.when(x.rlike(IS_COMMENT[family]), fill(x, COMMENT)).when(x.rlike(IS_STRING[family]), fill(x, STRING)).otherwise(x)

    return blot


#: What closes a string of many lines by family, what stands before it where it opens one, and what behind it where it closes one.
LONG_STRING = {"py": '"""', "js": "`", "go": "`"}
OPENS_AFTER = {
    "py": r"(?:^|[=(,\[{+%:]\s*|\breturn\s+)[rbfuRBFU]{0,2}\z|:[ \t]*(?:\x01*)\r?\n(?:[ \t]*\r?\n)*[ \t]+[rbfuRBFU]{0,2}\z",
    "js": r"(?:[=(,:+\[?&|{>!]|\b(?:return|yield|await|typeof|case)|\b[\w.]+)[ \t]*\z",
    "go": r"(?:[=(,:+\[{]|\breturn)[ \t]*\z",
}
CLOSES_BEFORE = {"py": r"^[ \t]*(?:[),.\]}%]|#|\r?\n|\z)", "js": r"^[ \t]*(?:[;,)\]}.+]|\r?\n|\z)", "go": r"^[ \t]*(?:[;,)\]}.+]|\r?\n|\z)"}
#: The end of a block comment at the end of a text: a line of asterisks, or one that holds no more than it.
COMMENT_END = r"(?:^|\n)[ \t]*(?:\*[^\n]*)?\*/\z"


def fill(x: Column, c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^\s]", c), r"\n", f"{c}\n")


def begun_before(text: Column, family: Column) -> Column:
    """text with what stands in front of the end of a comment or string blotted out if that began before the text: a block comment that is closed without
    having been opened, or a string of many lines whose marks are odd in number, the first of which stands like a closing one."""
    rest = lambda at: F.substring(text, at, F.lit(2**31 - 1))
    end = F.instr(text, "*/")
    closed = (end > 0) & ((F.instr(text, "/*") == 0) | (end < F.instr(text, "/*"))) & F.substring(text, F.lit(1), end + 1).rlike(COMMENT_END)
    without = F.concat(fill(F.substring(text, F.lit(1), end + 1), COMMENT), rest(end + 2))
    each = {f: F.when(closed, without).otherwise(text) for f in ("rust", "c")}
    for f, mark in LONG_STRING.items():
        first = F.instr(text, mark)
        odd = (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark) % 2 == 1
        inside = odd & ~F.substring(text, F.lit(1), first - 1).rlike(OPENS_AFTER[f]) & rest(first + len(mark)).rlike(CLOSES_BEFORE[f])
        cut = F.concat(fill(F.substring(text, F.lit(1), first + len(mark) - 1), STRING), rest(first + len(mark)))
        each[f] = F.when(inside, cut).when(closed & F.lit(f != "py"), without).otherwise(text)
    return by_family(family, each, text)


def masked(text: Column, family: Column) -> Column:
    """text with comments and strings blotted out, line for line."""
    plain = F.regexp_replace(F.translate(text, COMMENT + STRING, "  "), r"\\[^\n]", STRING * 2)

    def lexed(code: Column) -> Column:
        each = {name: F.array_join(F.transform(F.regexp_extract_all(code, F.lit(lexeme), 0), blotting(name)), "") for name, lexeme in LEXEME.items()}
        return by_family(family, each, code)

    return let(plain, lambda whole: let(begun_before(whole, family), lexed))


def oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks of more than limit characters, each chunk_seq once."""
    big = chunks.where(F.col("chunk_seq").isNotNull() & (F.length("text") > limit))
    return big.select("chunk_seq", "file", "symbol", "lang", "start_line", "text").dropDuplicates(["chunk_seq"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once: within a lambda, Spark doesn't share equal expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(line: Column, c: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))


def leading_closers(line: Column) -> Column:
    """How many braces a line without the blanks in front closes before anything else."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[}\s]*", 0), r"\s", ""))


def containers_around(lines: Column, family: str) -> Column:
    """For each line of masked text the number of open container blocks in which it begins.

    A fold with the stack of open blocks, one character each ("1" for a container), so any depth is told. Braces that a line closes beyond
    those it opens are taken off first; the blocks that it opens are containers as far as container heads stand on it or on the line before it.
    """
    empty = F.struct(F.lit("").alias("stack"), F.lit(0).alias("pending"), F.lit("").alias("counts"))

    def step(s: Column, raw: Column) -> Column:
        return let(F.regexp_replace(raw, r"^\s+|\s+$", ""), lambda x: let(F.greatest(leading_closers(x), occurrences(x, "}") - occurrences(x, "{")), lambda pops: after(s, x, pops)))

    def after(s: Column, x: Column, pops: Column) -> Column:
        opened = occurrences(x, "{") - occurrences(x, "}") + pops
        heads = F.least(opened, s["pending"] + F.size(F.regexp_extract_all(x, F.lit(CONTAINER[family]), 0)))
        left = F.substring(s["stack"], F.lit(1), F.greatest(F.lit(0), F.length(s["stack"]) - pops))
        pending = F.when(x.rlike(CONTAINER_BEFORE_BRACE[family]), 1).when(x.rlike(rf"^[{COMMENT}\s]*$"), s["pending"]).otherwise(0)
        return F.struct(
            F.concat(left, F.repeat(F.lit("1"), heads), F.repeat(F.lit("0"), opened - heads)).alias("stack"),
            pending.alias("pending"),
            F.concat(s["counts"], F.lit(" "), occurrences(s["stack"], "1").cast("string")).alias("counts"),
        )

    return F.aggregate(lines, empty, step, lambda s: F.split(F.substring(s["counts"], 2, 2**31 - 1), " ")).cast("array<int>")


def masked_lines(text: Column, family: Column) -> Column:
    """The lines of the masked text and the number of containers around each."""

    def told(code: Column) -> Column:
        lines = F.split(code, "\n", -1)
        around = lambda family: lambda x: containers_around(x, family)
        each = {f: F.when(code.rlike(word), let(lines, around(f))) for f, word in CONTAINER_WORD.items()}
        none = F.lit(None).cast("array<int>")
        return let(by_family(family, each, none), lambda within: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(within, i), F.lit(0)).alias("within"))))

    return let(masked(text, family), told)


def declaration_lines(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_seq, start_line and at: the lines (counted from 0 within the chunk) at which declarations of oversized chunks begin.

    Comments and strings are blotted out lexeme by lexeme with a regex of the language's family (by the file's extension, for lang is
    often wrong). What is left decides by line: how deep it stands (braces, or indentation in Python; namespaces and modules aside, however
    deeply nested), relative to the shallowest line, so a window that begins inside a function is read aright; whether a declaration
    begins; and which lines in front (comments, decorators, annotations, attributes, template heads) belong to it. Where one class
    or impl is the whole chunk its direct members count instead. A chunk is one row and its lines stay in one task; chunks are
    spread by chunk_seq.
    """
    big = oversized(chunks, limit).withColumn("family", family_of(F.col("file"), F.col("lang")))
    lines = big.select("chunk_seq", "start_line", "family", F.posexplode(masked_lines(F.col("text"), F.col("family"))).alias("at", "x")).select("chunk_seq", "start_line", "family", "at", "x.line", "x.within")
    code = F.regexp_replace("line", r"^\s+|\s+$", "")
    is_py = F.col("family") == "py"
    count = lambda c: occurrences(F.col("code"), c)
    seen = lines.withColumn("code", code)
    seen = seen.select(
        "chunk_seq",
        "start_line",
        "family",
        "at",
        "code",
        "within",
        F.length(F.regexp_replace(F.regexp_extract("line", r"^[ \t]*", 0), "\t", "    ")).alias("indent"),
        (F.col("code") == "").alias("blank"),
        F.col("code").rlike(rf"^[{COMMENT}\s]+$").alias("comment"),
        F.col("code").rlike(rf"^[{STRING}\s]+$").alias("string"),
        (count("{") - count("}")).alias("turn"),
        (count("(") + count("[") - count(")") - count("]")).alias("round"),
        leading_closers(F.col("code")).alias("closing"),
        by_family(F.col("family"), {f: F.col("code").rlike(p) for f, p in ATTACHED.items()}, F.lit(False)).alias("attached"),
    )
    before = Window.partitionBy("chunk_seq").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("chunk_seq")
    deep = seen.withColumn("depth", F.coalesce(F.sum("turn").over(before), F.lit(0))).withColumn("inside", F.coalesce(F.sum("round").over(before), F.lit(0)))
    deep = deep.withColumn("is_code", ~F.col("blank") & ~F.col("comment") & ~F.col("string") & ~(is_py & (F.col("inside") > 0)))
    deep = deep.withColumn("own_level", F.when(is_py, F.col("indent")).otherwise(F.col("depth")))
    shallowest = F.when(is_py, F.when(F.col("is_code"), F.col("indent"))).otherwise(F.least(F.col("depth") - F.col("closing"), F.col("depth")))
    deep = deep.withColumn("base", F.coalesce(F.min(shallowest).over(whole), F.lit(0)))
    is_container = by_family(F.col("family"), {f: F.col("code").rlike(rf"{p}|{CONTAINER_BEFORE_BRACE[f]}") for f, p in CONTAINER.items()}, F.lit(False))
    deep = deep.withColumn("container", is_container).withColumn("level", F.col("own_level") - F.col("base") - F.when(is_py, 0).otherwise(F.col("within")))
    is_class = by_family(F.col("family"), {f: F.col("code").rlike(p) for f, p in CLASS.items()}, F.lit(False))
    is_function = by_family(F.col("family"), {f: F.col("code").rlike(p) for f, p in FUNCTION.items()}, F.lit(False))
    # the next line behind that begins with a closing parenthesis, by the reverse order
    later = Window.partitionBy("chunk_seq").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    closes = F.last(F.when(F.col("code").rlike(r"^\)"), F.col("code")), True).over(later)
    deep = deep.withColumn("spans", F.coalesce((F.col("family") == "js") & F.col("code").rlike(OPEN_ARROW) & closes.rlike(CLOSED_ARROW), F.lit(False)))
    is_function = is_function | F.col("spans")
    is_member = by_family(F.col("family"), {f: F.col("code").rlike(p) for f, p in MEMBER.items()}, is_function)
    deep = deep.withColumn("is_class", F.col("is_code") & is_class).withColumn("is_function", F.col("is_code") & is_function).withColumn("is_member", F.col("is_code") & (is_member | is_class))
    # a chunk is one class if that is its only line of code on the outermost level
    outer = F.col("is_code") & (F.col("level") == 0) & ~F.col("attached") & ~F.col("container") & ~F.col("code").rlike(r"^[{})\];,\s]*$")
    deep = deep.withColumn("outer", F.sum(outer.cast("int")).over(whole)).withColumn("outer_class", F.sum((outer & F.col("is_class")).cast("int")).over(whole))
    deep = deep.withColumn("one_class", (F.col("outer") == 1) & (F.col("outer_class") == 1))
    inner = F.min(F.when(F.col("is_code") & (F.col("level") > 0), F.col("level"))).over(whole)
    deep = deep.withColumn("member_level", F.when(is_py, inner).otherwise(F.lit(1)))
    begins = F.when(F.col("one_class"), F.col("is_member") & (F.col("level") == F.col("member_level"))).otherwise((F.col("is_class") | F.col("is_function")) & (F.col("level") == 0))
    # lines in front: the run of comments and attached lines that ends just before
    joins = (F.col("comment") | F.col("attached")) & ~F.col("blank")
    deep = deep.withColumn("begins", begins).withColumn("tie", F.when(joins, F.when(is_py, F.col("indent")).otherwise(F.lit(0))))
    apart = F.when(F.col("tie").isNull(), F.col("at"))
    deep = deep.withColumn("last_apart", F.coalesce(F.max(apart).over(before), F.lit(-1)))
    # in Python a comment that stands deeper belongs to the body in front of it
    deeper = F.max(F.when(F.col("tie").isNotNull(), F.struct("at", "tie"))).over(before)
    starts = deep.withColumn("nearest", deeper).where("begins").withColumn(
        "first", F.when(is_py & (F.col("nearest.at") == F.col("at") - 1) & (F.col("nearest.tie") > F.col("indent")), F.col("at")).otherwise(F.col("last_apart") + 1)
    )
    return starts.where(F.col("first") > 0).select("chunk_seq", "start_line", F.col("first").alias("at")).distinct()


#: The first stretch of a shadow text in which a line feed before a declaration is \x01, of at most so many characters: to the nearest declaration, else
#: the last blank line, else the last line end, else all of them.
UNIT = "[^\x01]{0,%d}\x01|[^\x01]{0,%d}\n[ \t\r]*\n|[^\x01]{0,%d}\n|[^\x01]{1,%d}"
#: The same as far as possible: to the last declaration.
BOUNDARY = "^(?:(?s:.){0,%d}\x01|(?s:.){0,%d}\n[ \t\r]*\n|(?s:.){0,%d}\n|(?s:.){1,%d})"


def bounds_of(limit: int) -> tuple[int, int, int, int]:
    return limit - 1, limit - 2, limit - 1, limit


def shadowed(chunks: DataFrame, limit: int) -> DataFrame:
    """Oversized chunks with their lines (parts), the lines at which declarations begin (cuts) and a shadow of the text, of equal length,
    in which the line feed before each of those is \x01."""
    big = oversized(chunks, limit)
    starts = declaration_lines(chunks, limit).groupBy("chunk_seq").agg(F.collect_set("at").alias("cuts"))
    rows = big.join(starts, "chunk_seq", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    parts = F.split(F.translate("text", "\x01", "\x02"), "\n", -1)
    shadow = F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i == 0, "").when(F.array_contains("cuts", i), "\x01").otherwise("\n"), x)), "")
    return rows.withColumn("shadow", shadow).withColumn("size", F.length("text")).withColumn("n_parts", F.size(parts))


def cut_lines(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_seq and cut_line, the line of the file, of every declaration of an oversized chunk but one on its first line.

    The shadow text is taken apart by one bounded regex whose alternatives are ordered by strength: a unit reaches to the nearest declaration if
    one begins within the limit, else to a blank line, a line end, or as far as the limit. A unit that ends before a declaration gives a cut;
    its line follows from the line feeds of the units up to it.

    Null texts and chunk_seqs give nothing, as do chunks without a start_line; a chunk delivered twice counts once.
    """
    rows = shadowed(chunks.where(F.col("start_line").isNotNull()), limit).select("chunk_seq", "start_line", F.posexplode(F.regexp_extract_all("shadow", F.lit(UNIT % bounds_of(limit)), 0)).alias("no", "unit"))
    feeds = F.length("unit") - F.length(F.translate("unit", "\n\x01", ""))
    upto = Window.partitionBy("chunk_seq").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.withColumn("cut_line", (F.col("start_line") + F.sum(feeds).over(upto)).cast("int"))
    return lines.where(F.endswith("unit", F.lit("\x01"))).select("chunk_seq", "cut_line")


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Oversized chunks cut into pieces of at most limit characters: chunk_seq, piece_no (from 0), file, symbol, first_line, last_line, text and repeated, the
    number of characters at its beginning that it repeats.

    A piece repeats the last `overlap` lines of the piece before, or as many of them, whole, as leave room for a new character. Then it
    goes on as far as the limit lets it to the start of a declaration, else behind a blank line, else a line end, else anywhere:
    one bounded regex with alternatives in that order, on a shadow text of equal length. Taking the pieces' texts without what they
    repeat gives the chunk's text again. Lines are true; a null start_line counts from 1.
    """
    rows = shadowed(chunks, limit)
    pattern = BOUNDARY % bounds_of(limit)

    def tail_of(piece: Column) -> Column:
        """The length of the longest run of at most `overlap` whole lines at a piece's end that leaves room for a character."""
        ends = F.endswith(piece, F.lit("\n"))
        lines = [F.length(F.when(ends, F.substring_index(piece, "\n", -k - 1)).otherwise(F.substring_index(piece, "\n", -k))) for k in range(overlap, 0, -1)]
        return F.coalesce(F.get(F.filter(F.array(*lines), lambda n: n < limit), F.lit(0)), F.lit(0)) if lines else F.lit(0)

    def after(s: Column, body: Column) -> Column:
        tail = let(F.substring(F.col("text"), s["at"] - s["tail"] + 1, s["tail"] + body), tail_of)
        made = F.array_append(s["made"], F.struct(s["at"].alias("at"), s["tail"].alias("tail"), body.alias("body")))
        return F.struct((s["at"] + body).alias("at"), (s["left"] - body).alias("left"), tail.alias("tail"), made.alias("made"))

    def step(s: Column, _: Column) -> Column:
        room = F.lit(limit) - s["tail"]
        window = F.substring(F.col("shadow"), s["at"] + 1, room)
        body = F.when(s["left"] <= room, s["left"]).otherwise(F.length(F.regexp_extract(window, pattern, 0)))
        return F.when(s["left"] <= 0, s).otherwise(let(body, lambda b: after(s, b)))

    # what is left is carried along: within the fold, the length of the text would be counted at every step
    empty = F.struct(F.lit(0).alias("at"), F.col("size").alias("left"), F.lit(0).alias("tail"), F.array().cast("array<struct<at:int,tail:int,body:int>>").alias("made"))
    # a step ends behind a line feed of its own, or takes all its room within one line; such a piece is full, so each further one within the
    # line repeats a line less, until it repeats none and a step takes the whole limit
    most = F.col("n_parts") * (overlap + 3) + F.ceil(F.col("size") / limit).cast("int") + 1
    unfinished = F.raise_error(F.concat(F.lit("pieces: the fold ended before the text of chunk_seq "), F.col("chunk_seq").cast("string")))
    rows = rows.withColumn("made", F.aggregate(F.sequence(F.lit(1), most), empty, step, lambda s: F.when(s["left"] <= 0, s["made"]).otherwise(unfinished)))
    out = rows.select("chunk_seq", "file", "symbol", "start_line", "text", F.posexplode("made").alias("piece_no", "p"))
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    begin, size = F.col("p.at") - F.col("p.tail"), F.col("p.tail") + F.col("p.body")
    first = F.coalesce("start_line", F.lit(1)) + feeds(F.substring(F.col("text"), F.lit(1), begin))
    piece = F.substring(F.col("text"), begin + 1, size)
    return out.select(
        "chunk_seq", "piece_no", "file", "symbol", first.cast("int").alias("first_line"), (first + feeds(piece) - F.endswith(piece, F.lit("\n")).cast("int")).cast("int").alias("last_line"), piece.alias("text"), F.col("p.tail").alias("repeated")
    )
