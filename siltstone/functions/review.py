"""Column functions of code review: fingerprints, languages, globs, classification of messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "c": [".c", ".h"],
    "cpp": [".cc", ".cpp", ".cxx", ".c++", ".hh", ".hpp", ".hxx", ".h++", ".ipp", ".inl"],
    "python": [".py"],
    "go": [".go"],
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "rust": [".rs"],
    "java": [".java"],
}

#: Other spellings of names of languages.
LANGUAGE_NAMES = {"py": "python", "golang": "go", "ts": "typescript", "js": "javascript", "c++": "cpp", "cxx": "cpp", "rs": "rust"}

#: Extensions worth a review besides those of LANGUAGES, and paths that aren't.
MORE_REVIEWABLE = [".kt", ".cs", ".rb", ".php", ".swift", ".scala"]
NOT_REVIEWABLE = [
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum)$",
    r"\.min\.(js|css)$",
    r"\.(map|snap|lock)$",
    r"(^|/)(dist|build|out|node_modules|vendor|third_party|generated|__generated__)/",
    r"(?i)\.(png|jpe?g|gif|svg|ico|pdf|woff2?|ttf|eot|mp4|zip|gz)$",
]

#: Categories by the first pattern that a lower-cased message meets, and what makes it severe.
CATEGORY_PATTERNS = [
    ("concurrency", r"\b(race|deadlock|lock|atomic|mutex|concurren|thread)"),
    ("memory", r"\b(null|nullptr|dangling|leak|free|raii|use[- ]after|uninitial)"),
    ("security", r"\b(overflow|injection|unsafe|integer|format[- ]string|sanitiz|security|cve)"),
    ("performance", r"\b(perf|copy|allocation|hot[- ]path|slow|optimi)"),
]
OTHER_CATEGORY = "correctness"
SEVERE = r"\bcrash|core[- ]?dump|segv|deadlock|cve|security\b"

#: Source files, and folders of tests.
SOURCE_FILE = r"(?i)\.(c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|inl|ipp|ts|tsx|js|jsx|py|go|rs|java)$"
TEST_FOLDER = r"(?i)(^|/)(test|tests|ut|unittest|gtest|spec|__tests__)(/|$)"

#: Two-sided 95 % points of Student's t by degrees of freedom; beyond the last, the normal one.
T_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.16, 14: 2.145, 15: 2.131, 20: 2.086, 25: 2.06, 30: 2.042,
}
NORMAL_95 = 1.96


def finding_id(file: Column, line: Column, category: Column, title: Column) -> Column:
    """The 12 digits by which a finding is known again."""
    return F.substring(F.sha1(F.concat_ws(":", file, line.cast("string"), category, title)), 1, 12)


def extension(file: Column) -> Column:
    """The lower-cased extension with its dot, '' without one; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file, r"[^/.][^/]*?(\.[^./]*)$", 1))


def language(file: Column, otherwise: str = "text") -> Column:
    pairs = [F.lit(x) for lang, extensions in LANGUAGES.items() for e in extensions for x in (e, lang)]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(file)), F.lit(otherwise))


def source_language(file: Column, lang: Column) -> Column:
    """The language by the file's extension, else by lang, however it is spelled; a .h is C++ where lang says so."""
    name = F.lower(F.trim(lang))
    spelled = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]), name), name)
    return F.when((extension(file) == ".h") & (spelled == "cpp"), "cpp").otherwise(F.coalesce(F.nullif(language(file, ""), F.lit("")), spelled))


def reviewable(file: Column) -> Column:
    """True for source files outside lock files, bundles, generated and vendored folders; null counts as not."""
    known = [e for extensions in LANGUAGES.values() for e in extensions] + MORE_REVIEWABLE
    skipped = F.lit(False)
    for pattern in NOT_REVIEWABLE:
        skipped = skipped | file.rlike(pattern)
    return F.coalesce(extension(file).isin(known) & ~skipped, F.lit(False))


def glob_pattern(glob: str) -> str:
    """The regex of a glob: ** is anything, * anything within one folder; all else, ? too, stands for itself."""
    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def matches_glob(file: Column, globs: list[str]) -> Column:
    """True where file meets one of the globs (a bounded list of settings)."""
    return F.coalesce(file.rlike("|".join(glob_pattern(g) for g in globs)), F.lit(False)) if globs else F.lit(False)


def infer_category(message: Column, given: Column | None = None) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    found = F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in CATEGORY_PATTERNS], F.lit(OTHER_CATEGORY))
    return found if given is None else F.coalesce(F.when(given != "", given), found)


def infer_severity(message: Column, given: Column | None = None) -> Column:
    found = F.when(F.lower(F.coalesce(message, F.lit(""))).rlike(SEVERE), "high").otherwise("medium")
    return found if given is None else F.coalesce(F.when(given != "", given), found)


def slug(text: Column, most: int = 45) -> Column:
    dashes = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashes, "^-+|-+$", ""), 1, most)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def review_key(pr: Column, change: Column, base: Column, branch: Column) -> Column:
    """The most specific name of what is reviewed; an empty one counts as missing."""
    named = [F.when(c != "", F.concat(F.lit(prefix), c)) for prefix, c in (("pr:", pr), ("gerrit:", change), ("base:", base), ("branch:", branch))]
    return F.coalesce(*named, F.lit("default"))


def request_key(request: Column) -> Column:
    """The key of a cached answer: every field of the request, its schema too, in the order of the struct."""
    return F.substring(F.sha2(F.to_json(request), 256), 1, 32)


def t_critical(df: Column) -> Column:
    """The two-sided 95 % point for df degrees of freedom: that of the greatest tabulated number not above it."""
    out = F.when(df <= 0, 0.0).when(df > max(T_95), NORMAL_95)
    for k in sorted(T_95, reverse=True):
        out = out.when(df >= k, T_95[k])
    return out


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, cut to the shorter; 0 where one is empty or all zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n).cast("array<double>"), F.slice(b, 1, n).cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when(norm > 0, total(F.zip_with(x, y, lambda p, q: p * q)) / norm).otherwise(0.0)


def keywords(query: Column) -> Column:
    """The words of more than three letters of a lower-cased query, repeats kept."""
    return F.filter(F.split(F.lower(query), r"\W+"), lambda t: F.length(t) > 3)


def is_placeholder(value: Column) -> Column:
    """True for a setting that isn't filled in: empty, or one that says so."""
    return F.coalesce(value, F.lit("")).rlike(r"(?i)placeholder|fill_me_in|\A\s*\z")
