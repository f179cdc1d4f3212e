"""Files of a repository and of a review: sources, guidelines, ignore lists, cases, index and state tables."""

from __future__ import annotations

import os
import tomllib
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.review import LANGUAGES, extension, language

#: Guideline files in order, the most characters of all together, and the folders that a scan passes by.
GUIDELINE_FILES = ["CONTRIBUTING.md", "CONTRIBUTING", "AGENTS.md", "CODING_GUIDELINES.md", "STYLE.md", ".clang-tidy"]
GUIDELINE_CHARS = 8_000
SKIPPED = ["node_modules"]
#: Least characters of a part of the guidelines: its mark, its line end and the blank line behind it.
PART_CHARS = 5

CASE = (
    "id string, description string, repo string, diffFile string, base string, commits string, labelSource string, seed struct<fixCommit:string,parentCommit:string,source:string>, "
    "groundTruth array<struct<file:string,line:int,endLine:int,category:string,severity:string,note:string>>"
)


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """file (relative), hash (SHA-1), lang and text of the source files below root; hidden entries and SKIPPED folders are passed by."""
    known = [e for extensions in LANGUAGES.values() for e in extensions]
    prefix = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), prefix, -1)
    rows = files.select(path.alias("file"), F.sha1("content").alias("hash"), F.col("content").cast("string").alias("text"))
    hidden = F.concat(F.lit("/"), F.col("file")).rlike(r"/\.|/(" + "|".join(SKIPPED) + ")/")
    return rows.where(extension(F.col("file")).isin(known) & ~hidden).select("file", "hash", language(F.col("file")).alias("lang"), "text")


def joined_guidelines(parts: DataFrame, keys: list[str], most: int = GUIDELINE_CHARS) -> DataFrame:
    """keys and text: the parts (place, name, text) of each group in order of place under their names, cut at `most` characters with a note.

    Parts that the cut leaves nothing of are dropped before any are gathered: every part takes at least PART_CHARS, so no group has more than
    most / PART_CHARS of them behind the shuffle (the limit is applied on both sides of it), and of those only the ones that begin before the cut are kept.
    """
    said = F.concat(F.lit("# "), "name", F.lit("\n"), F.col("text"))
    cut = parts.select(*keys, "place", F.substring(said, 1, most + 1).alias("said"))
    order = Window.partitionBy(*keys).orderBy("place", "said")
    first = cut.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most // PART_CHARS + 1)
    begins = F.coalesce(F.sum(F.length("said") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = first.withColumn("_begins", begins).where(F.col("_begins") <= most + 2)
    gathered = left.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n")
    return gathered.select(*keys, F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n... [truncated]"))).otherwise(whole).alias("text"))


def guidelines(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """One row with the text of the guideline files that are there; none without any."""
    names = GUIDELINE_FILES if names is None else names
    paths = {n: os.path.join(root, n) for n in names if os.path.isfile(os.path.join(root, n))}
    if not paths:
        return spark.createDataFrame([], "text string")
    # a few named files, read by the driver (Spark passes by those whose name begins with a dot), none further than the cut
    parts = []
    for place, (name, path) in enumerate(paths.items()):
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            parts.append((1, place, name, f.read(GUIDELINE_CHARS + 1)))
    return joined_guidelines(spark.createDataFrame(parts, "all int, place int, name string, text string"), ["all"]).select("text")


def all_ignored(lines: DataFrame | None, configured: list[str]) -> list[str]:
    """The globs of the ignore file and of the settings, each once; a bounded list of settings."""
    own = [] if lines is None else [r["glob"] for r in ignore_globs(lines).collect()]
    return list(dict.fromkeys([*own, *configured]))


def ignore_globs(lines: DataFrame, column: str = "value") -> DataFrame:
    """glob of each line that isn't blank or a comment."""
    trimmed = lines.select(F.regexp_replace(F.col(column), r"^\s+|\s+$", "").alias("glob"))
    return trimmed.where((F.col("glob") != "") & ~F.startswith("glob", F.lit("#")))


def cases(spark: SparkSession, root: str) -> DataFrame:
    """The case.json files in the folders below root by id; unreadable JSON is skipped, a case without id is an error when read."""
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(CASE).json(f"{root}/*/case.json")
    checked = F.when(F.col("id").isNull(), F.raise_error(F.lit("a case without id"))).otherwise(F.col("id"))
    return raw.withColumn("id", checked).withColumn("labelSource", F.coalesce("labelSource", F.lit("real"))).withColumn("description", F.coalesce("description", F.lit(""))).withColumn("repo", F.coalesce("repo", F.lit("."))).orderBy("id")


def saved_findings(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Findings of saved reports (a column value with one document): a list, an object with findings, or one finding; a leading BOM is dropped."""
    one = "struct<id:string,category:string,file:string,line:int,endLine:int,severity:string,title:string,rationale:string,confidence:double>"
    bare = F.regexp_replace("value", "^﻿", "")
    read = text.select(F.coalesce(F.from_json(bare, f"struct<findings:array<{one}>>")["findings"], F.from_json(bare, f"array<{one}>")).alias("f"))
    return read.select(F.explode("f").alias("x")).where("x.file IS NOT NULL").select("x.*")


POINTER = "CURRENT"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and then moved there, so that a reader sees the old one or the new."""
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(fresh, target) or (fs.delete(target, False) and fs.rename(fresh, target))


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return "".join(r["value"] for r in spark.read.text(path).collect())


def save_index(folder: str, **tables: DataFrame) -> None:
    """Index tables (meta, chunks, symbols, vectors) as Parquet in a version folder of their own; then the pointer to the current version is switched.

    Nothing that a reader, or the tables themselves, may still read is deleted: a version stays until it is dropped by hand. A write that
    fails leaves the pointer where it was.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    _write_text(spark, f"{folder}/{POINTER}", version)


def load_index(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame] | None:
    """The tables of the current version; a missing vectors table is empty, any other missing one, or no version, means there is no index."""
    version = _read_text(spark, f"{folder}/{POINTER}")
    if version is None:
        return None
    jvm = spark.sparkContext._jvm
    out = {}
    for name, schema in schemas.items():
        place = f"{folder}/{version}/{name}"
        path = jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.schema(schema).parquet(place)
        elif name == "vectors":
            out[name] = spark.createDataFrame([], schema)
        else:
            return None
    return out


MEMORY = "id string, kind string, category string, file string, title string, text string, created timestamp, seq bigint, vector array<double>"


def load_memory(spark: SparkSession, folder: str, schema: str = MEMORY) -> DataFrame:
    """The saved records of memory; empty where there are none."""
    found = load_index(spark, folder, {"memory": schema})
    return spark.createDataFrame([], schema) if found is None else found["memory"]


def save_memory(spark: SparkSession, folder: str, memory: DataFrame) -> DataFrame:
    """Memory saved after what others have saved since is merged in (of one id the later record, of equally late ones the own); returns what is saved."""
    from siltstone.operators.state import merged_memory

    columns = memory.columns
    both = load_memory(spark, folder, memory.schema).withColumn("src", F.lit(0)).unionByName(memory.withColumn("src", F.lit(1)))
    save_index(folder, memory=merged_memory(both).select(*columns))
    return load_memory(spark, folder, memory.schema)


STATE = "key string, last_sha string, run_id string, updated timestamp"


def load_review_state(spark: SparkSession, folder: str) -> DataFrame:
    """What was reviewed last; empty where nothing was."""
    found = load_index(spark, folder, {"state": STATE})
    return spark.createDataFrame([], STATE) if found is None else found["state"]


def diff_text(spark: SparkSession, diff_file: str | None = None, commits: str | None = None, base: str | None = None, run: Callable[[list[str]], str] | None = None) -> str:
    """The text of a change: the file's if one is named, else the commits' diff, else that from the merge base of base to HEAD, else the work tree's.

    run starts the version control's diff with the arguments given to it and returns its output; without one only files can be read.
    """
    if diff_file:
        return spark.read.text(diff_file, wholetext=True).first()["value"]
    if run is None:
        raise ValueError("a change that isn't a file needs a command that makes its diff")
    return run(["diff", "--unified=3", commits or (f"{base}...HEAD" if base else "HEAD")])


def listed(spark: SparkSession, root: str, run: Callable[[list[str]], str] | None = None) -> DataFrame:
    """scanned, of the files that the version control lists, tracked or new but not ignored; of all below root where it can't be asked."""
    files = scanned(spark, root)
    try:
        names = run(["ls-files", "--cached", "--others", "--exclude-standard"]).splitlines() if run else None
    except Exception:
        names = None
    return files if names is None else files.join(spark.createDataFrame([(n,) for n in names], "file string").distinct(), "file", "left_semi")


def settings(defaults: dict[str, Any], file: str | None = None, env: dict[str, str] | None = None, prefix: str = "SILTSTONE_") -> dict[str, Any]:
    """Settings by name: the environment's before the file's (TOML) before the defaults; an unreadable file counts as empty."""
    try:
        with open(file or "", "rb") as f:
            own = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        own = {}
    env = dict(os.environ) if env is None else env
    out = {}
    for name, default in defaults.items():
        given = env.get(prefix + name.upper())
        value = given if given else own.get(name, default)
        kind = type(default)
        if isinstance(value, str) and kind in (bool, int, float):
            value = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        out[name] = value
    return out
