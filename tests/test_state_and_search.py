import numpy as np
import pytest

from siltstone.functions import review as fn
from siltstone.operators import retrieval as rt
from siltstone.operators import state as st

MEMORY = "src int, id string, kind string, category string, file string, created int, seq int"


def test_memory_latest_wins_and_ties_go_to_the_second(spark):
    rows = [(0, "a", "confirmed_bug", "c", "f", 2, 1), (1, "a", "false_positive", "c", "f", 2, 2), (0, "b", "confirmed_bug", "c", "f", 3, 3), (1, "b", "false_positive", "c", "f", 1, 4)]
    merged = st.merged_memory(spark.createDataFrame(rows, MEMORY))
    assert {r.id: r.kind for r in merged.collect()} == {"a": "false_positive", "b": "confirmed_bug"}
    assert {(r.what, r["value"], r.n) for r in st.repo_profile(merged).collect()} == {("file", "f", 1), ("category", "c", 1)}
    feedback = spark.createDataFrame([("a", "accept", 9, "c", "g", 5), ("b", "ignore", 9, "c", "g", 5), ("n", "reject", 9, "c", "g", 5)], "id string, verdict string, seq int, category string, file string, created int")
    after = {r.id: r.kind for r in st.with_feedback(merged, feedback).collect()}
    assert after == {"a": "confirmed_bug", "b": "confirmed_bug", "n": "false_positive"}
    assert {r.id for r in st.suppressed_ids(st.with_feedback(merged, feedback)).collect()} == {"n"}
    assert [r.id for r in st.exemplars(st.with_feedback(merged, feedback), 1).collect()] == ["a"]


def test_freshness_and_reuse(spark):
    s = "file string, hash string"
    now = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", "3"), ("null", None)], s)
    old = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("null", None)], s)
    assert {r.file: r.state for r in st.freshness(now, old, ["file"]).collect()} == {"same": "unchanged", "changed": "stale", "new": "stale", "gone": "gone", "null": "unchanged"}
    chunks = "file string, id string"
    before = spark.createDataFrame([("same", "s1"), ("changed", "c1"), ("gone", "g1")], chunks)
    after = spark.createDataFrame([("same", "s9"), ("changed", "c9"), ("new", "n9"), ("null", "u9")], chunks)
    got = st.refreshed_chunks(now, before, after, old, spark.createDataFrame([("s1",), ("c9",)], "id string"), ["file"])
    assert {(r.id, r.reused, r.has_vector) for r in got.collect()} == {("s1", True, True), ("c9", False, False), ("n9", False, False), ("u9", False, False)}


def test_review_modes_follow_the_history(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 12)] + [("m", "c3"), ("m", "x")], "sha string, parent string")
    targets = [("a", "c11", "c11", False), ("b", "c11", "c0", False), ("c", "c2", "c5", False), ("d", "c11", "x", False), ("e", "m", "x", False), ("f", "c3", None, False), ("g", None, "c1", False), ("h", "c3", "c1", True)]
    got = {r.key: r.mode for r in st.review_modes(spark.createDataFrame(targets, "key string, head string, last string, from_patch boolean"), edges).collect()}
    assert got == {"a": "up-to-date", "b": "incremental", "c": "full", "d": "full", "e": "incremental", "f": "full", "g": "full", "h": "full"}


def test_chosen_revisions(spark):
    changes = spark.createDataFrame([(1, "b", None), (2, "b", 1), (3, "z", None), (4, "a", 9)], "change int, current string, patchset int")
    revisions = spark.createDataFrame([(c, r, n, f"ref{n}") for c in (1, 2, 3, 4) for r, n in (("a", 1), ("b", 2))], "change int, revision string, number int, ref string")
    assert {(r.change, r.revision, r.ref) for r in st.chosen_revisions(changes, revisions).collect()} == {(1, "b", "ref2"), (2, "a", "ref1")}
    p = spark.createDataFrame([("PLACEHOLDER_key",), (" ",), (None,), ("sk-1",)], "v string")
    assert [r[0] for r in p.select(fn.is_placeholder(p.v)).collect()] == [True, True, True, False]


def test_recorded_keeps_what_has_no_head(spark):
    s = "key string, last_sha string, run_id string, updated int"
    got = st.recorded(spark.createDataFrame([("a", "1", "r", 5), ("b", "1", "r", 5)], s), spark.createDataFrame([("a", "2", "r", 1), ("b", None, "r", 9)], s))
    assert {r.key: r.last_sha for r in got.collect()} == {"a": "2", "b": "1"}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = rt.top_k(df.where("id < 4"), df, 5).orderBy("query", "place").collect()
    x = np.zeros((63, 8))
    for i, v in rows:
        x[i, : len(v or [])] = v or []
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    for q in range(4):
        cos = x @ x[q]
        want = sorted((i for i in range(63) if i != 61), key=lambda i: (-round(cos[i], 9), i))[:5]
        assert [r.id for r in got if r["query"] == q] == want
    assert rt.top_k(df.where("id < 0"), df, 5).count() == 0


def test_keyword_recall_counts_repeats_and_parts(spark):
    queries = spark.createDataFrame([(1, "c", "Leak leak in the buffers"), (2, "c", "a an of"), (3, "d", "leak"), (4, None, "leak")], "query_id int, category string, query string")
    memory = spark.createDataFrame([("x", 1, "c", "Memory leaked", "t"), ("y", 2, "c", "buffers", None), ("z", 3, "c", "other", "t")], "id string, seq int, category string, title string, text string")
    assert [(r.query_id, r.id, r.score) for r in rt.keyword_recall(queries, memory).orderBy("place").collect()] == [(1, "x", 2), (1, "y", 1)]


def test_functions_on_values(spark):
    files = ["a/B.CPP", "x.min.js", "src/vendor/x.go", "README.md", ".hidden", "a.kt", "dir.v2/noext", None]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    got = df.select(fn.language(df.file).alias("lang"), fn.reviewable(df.file).alias("ok"), fn.extension(df.file).alias("e")).collect()
    assert [r.lang for r in got] == ["cpp", "javascript", "go", "text", "text", "text", "text", "text"]
    assert [r.ok for r in got] == [True, False, False, False, False, True, False, False]
    assert fn.glob_pattern("a?/**.c*") == r"^a\?/.*\.c[^/]*$"
    m = spark.createDataFrame([("Fix deadlock",), ("free twice",), ("CVE-1",), ("slow path",), ("typo",), (None,)], "m string")
    assert [r[0] for r in m.select(fn.infer_category(m.m)).collect()] == ["concurrency", "memory", "security", "performance", "correctness", "correctness"]
    assert [r[0] for r in m.select(fn.infer_severity(m.m)).collect()] == ["high", "medium", "high", "medium", "medium", "medium"]
    d = spark.createDataFrame([(0,), (1,), (17,), (24,), (30,), (31,)], "d int")
    assert [r[0] for r in d.select(fn.t_critical(d.d)).collect()] == [0, 12.706, 2.131, 2.086, 2.042, 1.96]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 5.0]), ([0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(fn.cosine(v.a, v.b)).collect()] == [pytest.approx(0.70710678), 0, 0]
    k = spark.createDataFrame([("1", "", None, "b"), ("", "2", "x", "b"), (None, None, "x", "b"), (None, "", "", "b"), (None, None, None, "")], "p string, c string, b string, n string")
    assert [r[0] for r in k.select(fn.review_key(k.p, k.c, k.b, k.n)).collect()] == ["pr:1", "gerrit:2", "base:x", "branch:b", "default"]
    s = spark.createDataFrame([("  Fix: The Bug!! ",)], "s string")
    assert s.select(fn.slug(s.s)).collect()[0][0] == "fix-the-bug"
