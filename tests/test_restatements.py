"""Random inputs against short restatements in Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.operators import evaluation as ev
from siltstone.operators import text_tables as tt

OPTIONS = {"max_examples": 10, "deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}


def plain_diff(text):
    files, hunk = [], None
    for line in text.split("\n"):
        if m := re.match(r"^diff --git a/(.+?) b/(.+)$", line):
            files.append((m[2], []))
            hunk = None
        elif files and (m := re.match(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            at = int(m[1])
            hunk = [at, int(m[2] or 1), []]
            files[-1][1].append(hunk)
        elif hunk:
            if line.startswith("+") and not line.startswith("+++"):
                hunk[2].append(at)
                at += 1
            elif not (line.startswith("-") and not line.startswith("---")) and not line.startswith("\\"):
                at += 1
    return sorted((f, a, n, tuple(c)) for f, hunks in files for a, n, c in hunks)


line = st.sampled_from(["+a", "-b", " c", "", "+++ x", "--- y", "\\ No newline", "text", "@@ -1,2 +3,4 @@ f", "@@ -5 +9 @@", "@@ -1,0 +7,0 @@", "diff --git a/x.c b/x.c", "diff --git a/y z.c b/y z.c", "index 1..2"])


@settings(**OPTIONS)
@given(st.lists(st.lists(line, max_size=14), min_size=1, max_size=12))
def test_diffs(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {i: [] for i, _ in rows}
    for r in tt.diff_hunks(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id").collect():
        got[r.doc_id].append((r.file, r.new_start, r.new_lines, tuple(r.changed_lines)))
    assert {i: sorted(v) for i, v in got.items()} == {i: plain_diff(t) for i, t in rows}


def plain_match(findings, labels, by_category, collapse):
    groups = {}
    for i, (file, first, last, category) in enumerate(labels):
        key = (file, category or "" if by_category else "") if collapse else i
        groups.setdefault(key, (file, category or "" if by_category else "", []))[2].append((first, last))
    used, matched, localized = {}, 0, 0
    for file, at, category in findings:
        for k, (g_file, g_category, ranges) in groups.items():
            if file == g_file and g_category in ("", category) and any(a - 3 <= at <= b + 3 for a, b in ranges):
                matched += 1
                if k not in used:
                    used[k] = True
                    localized += any(a <= at <= b for a, b in ranges)
                break
    return len(used), len(findings) - matched, len(groups) - len(used), localized


finding = st.tuples(st.sampled_from("fg"), st.integers(0, 30), st.sampled_from(["memory", "security"]))
label = st.tuples(st.sampled_from("fg"), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["memory", "security", None]))


@settings(**OPTIONS)
@given(st.lists(st.tuples(st.lists(finding, max_size=8), st.lists(label, max_size=5)), min_size=1, max_size=6), st.booleans(), st.booleans())
def test_matching(spark, cases, by_category, collapse):
    f = [(i, f"c{c}", "a", *x) for c, (found, _) in enumerate(cases) for i, x in enumerate(found)]
    g = [(i, f"c{c}", *x) for c, (_, labels) in enumerate(cases) for i, x in enumerate(labels)]
    got = ev.case_metrics(
        spark.createDataFrame(f, "seq bigint, case_id string, ablation string, file string, line int, category string"),
        spark.createDataFrame(g, "gt_seq bigint, case_id string, file string, line int, end_line int, category string"),
        spark.createDataFrame([(f"c{c}", "a") for c in range(len(cases))], "case_id string, ablation string"),
        by_category,
        collapse,
    )
    want = {f"c{c}": plain_match(*x, by_category, collapse) for c, x in enumerate(cases)}
    assert {r.case_id: (r.true_positives, r.false_positives, r.false_negatives, r.localized) for r in got.collect()} == want
