"""State between runs: memory of reviewed findings, index refresh, and what was reviewed last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def merged_memory(snapshots: DataFrame) -> DataFrame:
    """One record per id of several snapshots (src, id, created, ...): the latest, of equal ones that of the greatest src."""
    rest = [c for c in snapshots.columns if c not in ("id",)]
    latest = snapshots.groupBy("id").agg(F.max(F.struct("created", "src", F.struct(*rest).alias("row"))).alias("m"))
    return latest.select("id", *[F.col("m.row")[c].alias(c) for c in rest if c != "src"])


def with_feedback(memory: DataFrame, feedback: DataFrame) -> DataFrame:
    """Memory after feedback (id, verdict, seq and the record's columns): accept makes it a confirmed bug, reject a false positive, both in place of any record
    of the id; ignore changes nothing. Of several for one id the last by seq holds."""
    columns = [c for c in memory.columns if c not in ("id", "kind")]
    last = feedback.where(F.col("verdict").isin("accept", "reject")).groupBy("id").agg(F.max_by(F.struct("verdict", *columns), "seq").alias("f"))
    new = last.select("id", F.when(F.col("f.verdict") == "accept", "confirmed_bug").otherwise("false_positive").alias("kind"), *[F.col("f")[c].alias(c) for c in columns])
    return memory.join(new.select("id"), "id", "left_anti").unionByName(new)


def repo_profile(memory: DataFrame) -> DataFrame:
    """Counts of confirmed bugs by file and by category in one pass: of (what, value, n)."""
    bugs = memory.where(F.col("kind") == "confirmed_bug")
    sets = bugs.groupingSets([["file"], ["category"]], "file", "category").agg(F.count("*").alias("n"), F.grouping("file").alias("no_file"))
    return sets.select(F.when(F.col("no_file") == 0, "file").otherwise("category").alias("what"), F.when(F.col("no_file") == 0, F.col("file")).otherwise(F.col("category")).alias("value"), "n")


def suppressed_ids(memory: DataFrame) -> DataFrame:
    return memory.where(F.col("kind") == "false_positive").select("id").distinct()


def exemplars(memory: DataFrame, k: int = 2) -> DataFrame:
    """The k latest confirmed bugs of each category, with their place from 1."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("created"), "seq"))
    return memory.where(F.col("kind") == "confirmed_bug").withColumn("place", place).where(F.col("place") <= k)


def freshness(current: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state of every file on either side (keys, hash): unchanged, stale (another hash, or not indexed) or gone."""
    old = indexed.select(*keys, F.col("hash").alias("old_hash"), F.lit(True).alias("_old"))
    both = current.select(*keys, F.col("hash").alias("new_hash"), F.lit(True).alias("_new")).join(old, keys, "full")
    state = F.when(F.col("_new").isNull(), "gone").when(F.col("_old") & F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("stale")
    return both.select(*keys, state.alias("state"))


def content_hashes(chunks: DataFrame, keys: list[str], seq: str = "chunk_seq", digest: str = "digest") -> DataFrame:
    """keys and hash of every file, from the digests of its chunks: a combinable sum of 64-bit hashes of each chunk's place and digest, and another of
    other hashes, so nothing of a file is gathered and 16 bytes of it move."""
    parts = [F.sum(F.xxhash64(seq, digest, F.lit(salt)).cast("decimal(20,0)")).cast("string") for salt in (1, 2)]
    return chunks.groupBy(*keys).agg(F.concat_ws(":", F.count("*").cast("string"), *parts).alias("hash"))


def refreshed_chunks(current: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, indexed: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of the next index: those of unchanged files as they were, with their vector, and all of the others anew, to be embedded.

    Returns keys, id, reused and has_vector.
    """
    state = freshness(current, indexed, keys).where("state <> 'gone'")
    known = old_chunks.select(*keys).distinct().withColumn("_known", F.lit(True))
    reuse = state.join(known, keys, "left").select(*keys, ((F.col("state") == "unchanged") & F.coalesce("_known", F.lit(False))).alias("reused"))
    kept = old_chunks.join(reuse.where("reused"), keys).select(*keys, "id", "reused")
    fresh = new_chunks.join(reuse.where(~F.col("reused")), keys).select(*keys, "id", "reused")
    embedded = vectors.select("id").distinct().withColumn("_v", F.lit(True))
    return kept.unionByName(fresh).join(embedded, "id", "left").select(*keys, "id", "reused", (F.col("reused") & F.coalesce("_v", F.lit(False))).alias("has_vector"))


def linear_jumps(edges: DataFrame) -> list[DataFrame]:
    """For j = 0, 1, ... the commit 2^j steps up from each commit, as far as every commit on the way has one parent: sha and up.

    A history of n commits has at most n rows a level and log2 of its longest line of levels.
    """
    from siltstone.session import staged

    single = edges.groupBy("sha").agg(F.count_distinct("parent").alias("n"), F.max("parent").alias("up")).where("n = 1")
    levels = [staged(single.select("sha", "up"), "jumps")]
    most = max(1, levels[0].count()).bit_length()
    while len(levels) <= most:
        below = levels[-1]
        above = staged(below.join(below.select(F.col("sha").alias("up"), F.col("up").alias("top")), "up").select("sha", F.col("top").alias("up")), "jumps")
        if above.isEmpty():
            break
        levels.append(above)
    return levels


def line_places(commits: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """sha, stop (the first commit up from it that hasn't one parent) and steps to there, of each commit, by the greatest jumps first."""
    out = commits.select("sha", F.col("sha").alias("stop"), F.lit(0).cast("long").alias("steps"))
    for j in reversed(range(len(jumps))):
        up = jumps[j].select(F.col("sha").alias("stop"), "up")
        out = out.join(up, "stop", "left").select("sha", F.coalesce("up", "stop").alias("stop"), F.when(F.col("up").isNotNull(), F.col("steps") + 2**j).otherwise(F.col("steps")).alias("steps"))
    return out


def ancestor_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the pairs (head, last) in which last is head or an ancestor of it, by edges (sha, parent; a merge has several rows).

    Only wanted pairs are followed. A pair goes along a line of single parents in log2 steps: if last lies on the way, it is the commit as many
    steps up as the two differ in their distance to the line's end. Where a line ends in a merge, the pair goes on from each of its parents, from
    none twice; so a pair has no more rows than its history has merges.
    """
    from siltstone.session import staged

    edges = edges.where("parent IS NOT NULL").distinct()
    jumps = linear_jumps(edges)
    merges = edges.join(edges.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha"), "sha", "left_semi")
    wanted = pairs.where("head IS NOT NULL AND last IS NOT NULL").select("head", "last").distinct()
    goal = line_places(wanted.select(F.col("last").alias("sha")).distinct(), jumps).select(F.col("sha").alias("last"), F.col("stop").alias("last_stop"), F.col("steps").alias("last_steps"))
    wanted = staged(wanted.join(goal, "last"), "wanted-pairs")
    front, found, seen = wanted.withColumn("at", F.col("head")), None, None
    while True:
        place = line_places(front.select(F.col("at").alias("sha")).distinct(), jumps).withColumnRenamed("sha", "at")
        placed = staged(front.join(place, "at"), "pair-places")
        on_line = placed.where((F.col("stop") == F.col("last_stop")) & (F.col("steps") >= F.col("last_steps"))).withColumn("left", F.col("steps") - F.col("last_steps")).withColumn("to", F.col("at"))
        for j, level in enumerate(jumps):
            taken = F.getbit(F.col("left"), F.lit(j)) == 1
            on_line = on_line.join(level.select(F.col("sha").alias("to"), "up"), "to", "left").withColumn("to", F.when(taken, F.col("up")).otherwise(F.col("to"))).drop("up")
        hit = staged(on_line.where(F.col("to") == F.col("last")).select("head", "last").distinct(), "pairs-found")
        found = hit if found is None else found.unionByName(hit)
        here = placed.select("head", "last", "at")
        seen = here if seen is None else staged(seen.unionByName(here), "pairs-seen")
        ahead = placed.join(hit, ["head", "last"], "left_anti").select("head", "last", "last_stop", "last_steps", F.col("stop").alias("sha"))
        front = ahead.join(merges, "sha").select("head", "last", "last_stop", "last_steps", F.col("parent").alias("at")).distinct()
        front = staged(front.join(seen, ["head", "last", "at"], "left_anti"), "pair-front")
        if front.isEmpty():
            return found.distinct()


def review_modes(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """mode of each target (key, head, last, from_patch): up-to-date if last is head, incremental if it is an ancestor of it, else full (as for patch files, without
    a head or a last review, and after diverging)."""
    asked = targets.where(~F.coalesce("from_patch", F.lit(False)) & (F.col("head") != F.col("last")))
    reach = ancestor_pairs(asked, edges).withColumn("_up", F.lit(True))
    mode = (
        F.when(F.col("from_patch") | F.col("head").isNull() | F.col("last").isNull(), "full").when(F.col("head") == F.col("last"), "up-to-date").when(F.col("_up"), "incremental").otherwise("full")
    )
    return targets.join(reach, ["head", "last"], "left").select("key", "head", "last", mode.alias("mode"))


def recorded(state: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The table of what was reviewed last (key, last_sha, run_id, updated) after new reviews; one without a head changes nothing."""
    both = state.withColumn("_new", F.lit(0)).unionByName(reviewed.where("last_sha IS NOT NULL").withColumn("_new", F.lit(1)))
    latest = both.groupBy("key").agg(F.max(F.struct("_new", "updated", "last_sha", "run_id")).alias("m"))
    return latest.select("key", "m.last_sha", "m.run_id", "m.updated")


def fix_commits(changes: DataFrame, most_files: int = 2, limit: int = 10) -> DataFrame:
    """The latest `limit` commits (sha, at, message, file) whose message reads like a fix and that touch 1 to most_files source files outside test folders."""
    from siltstone.functions.review import SOURCE_FILE, TEST_FOLDER

    says = F.lower("message").rlike("fix|bug|crash|leak|overflow|race|deadlock|null")
    source = F.col("file").rlike(SOURCE_FILE) & ~F.col("file").rlike(TEST_FOLDER)
    counted = changes.where(says & source).groupBy("sha", "at").agg(F.count_distinct("file").alias("n_files"))
    return counted.where(F.col("n_files").between(1, most_files)).orderBy(F.desc("at"), "sha").limit(limit)


def append_trace(trace: DataFrame, folder: str, send: Callable[[list[str]], None] | None = None, batch: int = 500) -> None:
    """A run's trace as JSON lines, added to the folder; and, if send is given, passed to it by each task in lists of at most `batch` lines.

    send may see a line again if a task is repeated; what it raises fails the task.
    """
    trace.write.mode("append").json(folder)
    if send is not None:

        def each(rows: Iterator[Row]) -> None:
            waiting = []
            for r in rows:
                waiting.append(r["line"])
                if len(waiting) == batch:
                    send(waiting)
                    waiting = []
            if waiting:
                send(waiting)

        trace.select(F.to_json(F.struct(*trace.columns)).alias("line")).foreachPartition(each)


def usage(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tokens, calls and milliseconds of a trace."""
    return trace.groupBy(*keys).agg(F.count("*").alias("steps"), *[F.sum(c).alias(c) for c in ("tool_calls", "prompt_tokens", "completion_tokens", "ms")])


def chosen_revisions(changes: DataFrame, revisions: DataFrame) -> DataFrame:
    """change, revision, number and ref of each change (change, current, patchset): the revision of its patchset, else its current one; a change whose
    wanted revision isn't among its revisions (change, revision, number, ref) has none."""
    joined = changes.join(revisions, "change").where(F.when(F.col("patchset").isNotNull(), F.col("number") == F.col("patchset")).otherwise(F.col("revision") == F.col("current")))
    return joined.select("change", "revision", "number", "ref")
