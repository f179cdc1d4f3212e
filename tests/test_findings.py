from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.operators import findings as fi

SCHEMA = "case_id string, ablation string, file string, line int, rank int, confidence double, seq bigint, best string"


def greedy(rows, window=5):
    kept = []
    for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[4], -r[5], r[6])):
        if not any(k[:3] == r[:3] and abs(k[3] - r[3]) <= window for k in kept):
            kept.append(r)
    return {k[6] for k in kept}


row = st.tuples(st.just("c"), st.sampled_from(["x", "y"]), st.sampled_from(["f", "g"]), st.one_of(st.none(), st.integers(0, 40)), st.integers(0, 3), st.sampled_from([0.1, 0.6, 0.9]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=30))
def test_near_line_dedupe_is_the_greedy_fold(spark, rows):
    rows = [(*r, i, "clash") for i, r in enumerate(rows)]
    got = fi.near_line_dedupe(spark.createDataFrame(rows, SCHEMA), ["case_id", "ablation", "file"])
    assert {r["seq"] for r in got.collect()} == greedy(rows)


def test_near_line_dedupe_is_no_clustering(spark):
    rows = [("c", "", "f", 10, 0, 0.9, 1, ""), ("c", "", "f", 14, 1, 0.9, 2, ""), ("c", "", "f", 18, 2, 0.9, 3, "")]
    assert {r["seq"] for r in fi.near_line_dedupe(spark.createDataFrame(rows, SCHEMA), ["case_id", "file"]).collect()} == {1, 3}


def test_one_file_with_most_rows(spark):
    rows = [("c", "", "hot", i % 40, i % 4, 0.5, i, "") for i in range(4000)]
    assert {r["seq"] for r in fi.near_line_dedupe(spark.createDataFrame(rows, SCHEMA), ["case_id", "file"]).collect()} == greedy(rows)


def test_gate_counts_and_order(spark):
    rows = [("c", "", "f", 1, 1, 0.5, 1), ("c", "", "f", 2, 3, 0.9, 2), ("d", "", "f", 2, 3, 0.9, 3)]
    df = spark.createDataFrame(rows, "case_id string, ablation string, file string, line int, rank int, confidence double, seq bigint").selectExpr("*", "element_at(array('critical','high','medium','low'), rank + 1) AS severity")
    assert {(r.case_id, r.exit_code) for r in fi.gate(df, ["case_id"], "high").collect()} == {("c", 2), ("d", 0)}
    assert {r.exit_code for r in fi.gate(df, ["case_id"], "none").collect()} == {0}
    counts = {(r.case_id, r.severity): r.n for r in fi.severity_counts(df, ["case_id"]).collect()}
    assert counts[("c", "high")] == 1 and counts[("d", "critical")] == 0 and len(counts) == 8
    assert [r.seq for r in df.orderBy(*fi.best_first()).collect()] == [1, 2, 3]


def test_admitted_leaves_out_unsure_suppressed_and_ignored(spark):
    df = spark.createDataFrame([("a", 0.5, "src/x.c"), ("b", 0.9, "src/x.c"), ("c", 0.9, "lib/a/b.go"), ("d", 0.9, "lib/a/c/b.go")], "id string, confidence double, file string")
    suppressed = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in fi.admitted(df, suppressed, ["lib/*/*.go"]).collect()} == {"d"}
    assert {r.id for r in fi.admitted(df, None, ["**.c"]).collect()} == {"c", "d"}


def test_verdicts_drop_and_lower(spark):
    df = spark.createDataFrame([(1, "c", 0.9), (2, "c", 0.9), (3, "c", 0.4)], "seq bigint, case_id string, confidence double")
    v = spark.createDataFrame([("c", 0, False, None, 1), ("c", 1, True, 0.5, 1), ("c", 2, True, 0.8, 1)], "case_id string, index bigint, keep boolean, confidence double, verdict_seq int")
    assert {(r.seq, r.confidence) for r in fi.apply_verdicts(df, v, ["case_id"]).collect()} == {(2, 0.5), (3, 0.4)}


def test_inline_cap_and_bodies(spark):
    rows = [(i, "c", "f", i, i % 4, 0.5) for i in range(1, 8)] + [(9, "c", "f", 99, 0, 0.9)]
    df = spark.createDataFrame(rows, "seq bigint, case_id string, file string, line int, rank int, confidence double")
    lines = spark.createDataFrame([("f", i) for i in range(1, 8)], "file string, line int")
    got = {r.seq: r.placement for r in fi.inline_or_summary(df, lines, ["case_id"], most=2).collect()}
    assert {s for s, p in got.items() if p == "inline"} == {4, 1} and len(got) == 8
    f = spark.createDataFrame([(1, "f", 0, "low", "t", "memory", 0.5, "why", "p", None, "0123456789ab")], "seq bigint, file string, line int, severity string, title string, category string, confidence double, rationale string, suggested_patch string, evidence array<struct<ev_type:string,ev_ref:string>>, id string")
    body = fi.comment_body(f).collect()[0]
    assert body.line == 1 and "```suggestion\np\n```" in body.body and body.body.endswith("`0123456789ab`")
    assert fi.not_posted(f, fi.comment_body(f)).count() == 0


def test_sarif_document(spark):
    import json

    f = spark.createDataFrame([(1, "c", "memory", "high", "t", "why", "f", 0, None, 0.5)], "seq bigint, case_id string, category string, severity string, title string, rationale string, file string, line int, end_line int, confidence double")
    log = json.loads(fi.sarif_log(f, ["case_id"], "tool", "1").collect()[0].sarif)
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1}
